"""The text operators on nulls, repeated rows, empty tables, very long texts and clashing names."""

from pyspark.sql import functions as F

from prosopa.llm import confusables, mixing, packing, quality, runs


def with_clashes(df, *names):
    """`df` with extra columns named like those that the operators use inside."""
    return df.select("*", *(F.lit("clash").alias(n) for n in names if n not in df.columns))


def twice(df):
    return df.unionByName(df)


def test_one_form(spark):
    long = "x" * 300_000
    rows = [("ＡＢ",), ("AB",), ("А​B",), (None,), ("",), (" ",), (long,), ("Ｘ" * 3,)]
    raw = with_clashes(twice(spark.createDataFrame(rows, "v string")), "value", "reference", "skeleton", "_value", "_reference", "rows", "members")
    refs = with_clashes(twice(spark.createDataFrame([("AB",), (None,), ("",), ("XXX",)], "r string")), "value", "reference", "skeleton", "v")
    got = {tuple(r) for r in confusables.disguised(raw, "v", refs, "r").collect()}
    assert got == {("ＡＢ", "AB"), ("А​B", "AB"), ("Ｘ" * 3, "XXX")}
    formed = confusables.with_one_form(raw, "v", refs, "r", "one")
    assert formed.count() == 16 and {(r.v, r.one) for r in formed.collect()} == got | {(v, v) for (v,) in rows} - {(a, a) for a, _ in got}
    assert confusables.skeleton_classes(raw, "v").count() == 7
    assert confusables.disguised(raw.limit(0), "v", refs, "r").count() == 0 and confusables.disguised(raw, "v", refs.limit(0), "r").count() == 0


def test_runs(spark):
    states = spark.createDataFrame([(1, "alpha"), (2, "beta"), (None, "gamma"), (3, None)], "state_no int, state string")
    rows = [(1, "alpha>Alpha >beta", [900, 0, 950], [None, 910, 940]), (2, None, None, None), (3, "", [], []), (4, "gamma>gamma", None, [1, 2])]
    raw = with_clashes(twice(spark.createDataFrame(rows, "id long, seq string, f array<int>, l array<int>")), "key", "pos", "label", "at", "fs", "ls", "state_no", "_run", "_block", "_change")
    entry = runs.with_states(runs.entries(raw, "id", "seq", "f", "l"), states)
    got = {(r.key, r.start_pos, r.end_pos, r.state_no, r.entries, r.first_year, r.last_year) for r in runs.collapse_runs(entry).collect()}
    assert {(1, 1, 2, 1, 2, 900, 910), (1, 3, 3, 2, 1, 940, 950), (3, 1, 1, None, 1, None, None)} <= got
    assert {(4, 1, 1, None), (4, 2, 2, None)} <= {g[:4] for g in got} and not any(g[0] == 2 for g in got)
    assert runs.collapse_runs(runs.with_states(runs.entries(raw.limit(0), "id", "seq", "f", "l"), states)).count() == 0
    assert runs.match_states(raw, "seq", states.limit(0)).count() == 0


def test_packing(spark):
    rows = [(1, "a" * 50_000), (2, None), (3, ""), (None, "abc"), (4, "é" * 10), (5, "b" * 99), (6, "b" * 100)]
    raw = with_clashes(twice(spark.createDataFrame(rows, "doc_id long, text string")), "tokens", "size", "parts", "part_no", "capacity_tokens", "container", "shard", "rank", "high", "low", "kind")
    packed = packing.pack(raw, [100]).collect()
    held = {}
    for r in packed:
        held[r.container] = held.get(r.container, 0) + r.tokens
    assert max(held.values()) <= 100 and {r.doc_id for r in packed} == {1, 3, 4, 5, 6}
    assert sum(r.tokens for r in packed) == 50_001 + 1 + 21 + 100 + 101
    assert packing.pack(raw.limit(0), [100]).count() == 0


def test_mixing(spark):
    rows = [(i, "a" if i % 3 else "b", "text " * (i + 1)) for i in range(60)] + [(100, None, "x"), (101, "a", None), (None, "a", "x"), (102, "c", "")]
    raw = with_clashes(twice(spark.createDataFrame(rows, "doc_id long, source string, text string")), "size", "bucket", "held", "start", "blocks", "slots", "mix_id", "uses", "low", "high")
    wanted = twice(spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2), ("m", "none", 0.0, 1), (None, "a", 1.0, 1), ("m", None, 0.1, 1), ("n", "c", None, 1)], "mix_id string, source string, target_share double, max_repeats int"))
    mix = mixing.Mix(raw, wanted, block_tokens=64)
    told = {r.source: r for r in mix.report().collect()}
    assert set(told) == {"a", "b", "none"} and abs(sum(r.actual_share for r in told.values()) - 1) < 1e-9
    assert {(r.doc_id, r.repeats <= 2) for r in mix.documents().collect()} <= {(i, True) for i in range(60)}


def test_quality(spark):
    rows = [(1, "The man went to the house.\n" * 20_000), (2, None), (3, ""), (4, " \n \n"), (None, "text"), (5, "😀" if False else "😀 😀\n12 | 34 | 56")]
    raw = with_clashes(twice(spark.createDataFrame(rows, "doc_id long, text string")), "lines", "words", "kind", "en", "list_lines", "language")
    got = {r.doc_id: r for r in quality.quality(raw).collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].lines == 20_000 and got[1].kind == "prose" and got[3].lines == 0 and got[4].kind is None
    assert quality.quality(raw.limit(0)).count() == 0
