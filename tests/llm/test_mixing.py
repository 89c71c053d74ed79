from prosopa.llm import mixing

DOCS = "doc_id long, source string, text string, slots int"
TARGETS = "mix_id string, source string, target_share double, max_repeats int, own_tokens int"


def mix(spark, docs, targets, **options):
    return mixing.Mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **options)


def test_shares_repeats_and_blocks(spark):
    docs = [(i, "abc"[i % 3] if i % 7 else "a", "x" * (37 * i % 211 + 5), 0) for i in range(400)]
    docs += [(900, None, "x" * 50, 0), (901, "a", None, 0), (902, "z", "x" * 500, 0), (5, docs[5][1], docs[5][2], 0)]
    targets = [("m", "a", 0.2, 1, 0), ("m", "b", 0.7, 2, 0), ("m", "c", 0.1, 4, 0), ("m", "none", 0.0001, 3, 0), ("n", "b", 1.0, 1, 0), (None, "a", 1.0, 1, 0), ("n", "b", 1.0, 1, 0)]
    run = mix(spark, docs, targets, block_tokens=64, slots_per_shard=10)
    report = {(r.mix_id, r.source): r for r in run.report().collect()}
    own = {}
    for i, s, t, _ in set(docs):
        if s and t:
            own[s] = own.get(s, 0) + len(t) + 1
    total = own["a"] + own["b"] + own["c"]
    assert set(report) == {("m", "a"), ("m", "b"), ("m", "c"), ("m", "none"), ("n", "b")}
    for (m, s), r in report.items():
        base = total if m == "m" else own["b"]
        share = {"a": 0.2, "b": 0.7, "c": 0.1, "none": 0.0001}[s] if m == "m" else 1.0
        assert r.own_tokens == own.get(s, 0) and r.short == (share * base > r.max_repeats * own.get(s, 0))
        assert abs(r.drawn_tokens - min(share * base, r.max_repeats * own.get(s, 0))) <= 32
    assert abs(sum(r.actual_share for (m, _), r in report.items() if m == "m") - 1) < 1e-9
    uses = run.uses().collect()
    cap = {("m", "a"): 1, ("m", "b"): 2, ("m", "c"): 4, ("n", "b"): 1}
    assert all(u.uses <= cap[u.mix_id, u.source] for u in uses)
    for key in cap:
        mine = [u.uses for u in uses if (u.mix_id, u.source) == key]
        assert max(mine) - min(mine) <= 1
    told = run.documents().collect()
    assert all(0 <= d.whole_repeats <= d.repeats <= cap[d.mix_id, d.source] for d in told)
    assert sum(d.tokens for d in told) == sum(r.drawn_tokens for r in report.values())


def test_blocks_hold_every_token_once(spark):
    docs = [(i, "a", "y" * (i * 13 % 90), 0) for i in range(100)]
    run = mix(spark, docs, [("m", "a", 1.0, 1, 0)], block_tokens=32)
    spans = run.spans.collect()
    assert sum(s.span_tokens for s in spans) == sum(len(d[2]) + 1 for d in docs)
    held = {}
    for s in spans:
        held[s.block_no] = held.get(s.block_no, 0) + s.span_tokens
    assert all(v == 32 for k, v in held.items() if k != max(held)) and max(held) == len(held) - 1
    assert run.drawn.groupBy("block_no").count().where("count > 1").count() == 0


def test_empty_tables(spark):
    assert mix(spark, [], [("m", "a", 0.5, 1, 0)]).report().collect()[0].short is False
    assert mix(spark, [(1, "a", "x", 0)], []).report().count() == 0


def test_a_short_source_is_filled_to_its_cap(spark):
    docs = [(1, "a", "x" * 1499, 0), (2, "b", "x" * 5999, 0)]
    got = {r.source: r for r in mix(spark, docs, [("m", "a", 0.8, 3, 0), ("m", "b", 0.2, 1, 0)]).report().collect()}
    assert (got["a"].drawn_tokens, got["a"].short, got["b"].short) == (4500, True, False)
    assert abs(got["b"].drawn_tokens - 1500) <= 512 and abs(got["a"].planned_share - 0.6) < 1e-9


def test_shards_of_several_strata(spark):
    docs = [(i, "ab"[i % 2], "x" * 63, 0) for i in range(600)]
    run = mix(spark, docs, [("m", "a", 0.5, 2, 0), ("m", "b", 0.5, 1, 0)], block_tokens=64, slots_per_shard=10, stratum_slots=40)
    shards = {}
    for r in run.drawn.collect():
        shards.setdefault(r.shard, []).append((r.source, r.block_no))
    assert sum(map(len, shards.values())) == 600 and max(map(len, shards.values())) <= 10 and len({b for v in shards.values() for b in v}) == 600
    assert len({sum(s == "a" for s, _ in v) for v in shards.values()}) > 2


def test_permutations_are_one_to_one():
    import numpy as np

    from prosopa.functions.permute import permuted

    for n in (1, 2, 7, 1000):
        orders = {tuple(permuted(np.arange(n), n, k)) for k in range(20)}
        assert all(sorted(o) == list(range(n)) for o in orders) and (n < 7 or len(orders) == 20)
    at = permuted(np.arange(5), np.array([5] * 5), np.array([3] * 5))
    assert (at == permuted(np.arange(5), 5, 3)).all()


def test_draws_add_up():
    import numpy as np

    counts = mixing.draw(np.array([70, 5, 0, 25]), 7, np.random.default_rng(1))
    assert counts.sum(axis=0).tolist() == [70, 5, 0, 25] and counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1
