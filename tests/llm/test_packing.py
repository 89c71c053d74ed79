import numpy as np
import pytest

from prosopa.llm import packing

DOCS = "doc_id long, text string, tokens string, container int"


def check(rows, docs, capacities):
    size = {i: len(t.encode()) + 1 for i, t, *_ in docs if i is not None and t is not None}
    for c in capacities:
        mine = [r for r in rows if r.capacity_tokens == c]
        held, parts = {}, {}
        for r in mine:
            held[r.container] = held.get(r.container, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.part_no, r.parts, r.tokens))
        assert max(held.values(), default=0) <= c
        assert {i: sum(p[2] for p in v) for i, v in parts.items()} == size
        for i, v in parts.items():
            assert sorted(p[0] for p in v) == list(range(1, len(v) + 1)) and {p[1] for p in v} == {len(v)}
            assert (len(v) > 1) == (size[i] > c)
    return size


def test_every_text_is_packed_whole(spark):
    rng = np.random.default_rng(7)
    docs = [(i, "é" * int(n), "x", 1) for i, n in enumerate(rng.integers(0, 300, 600))]
    docs += [(1000, None, None, None), (1001, "", "", 0), (None, "abc", "", 0), (1002, "a" * 255, "", 0), (1003, "a" * 256, "", 0), (1003, "a" * 256, "", 0), (1004, "z" * 5000, "", 0)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), [256, 512], rows_per_shard=100).collect()
    size = check(rows, {d[0]: d for d in docs}.values(), [256, 512])
    for c in (256, 512):
        used = len({r.container for r in rows if r.capacity_tokens == c})
        assert used <= 1.06 * sum(size.values()) / c + 12


def test_equal_sizes_and_tiny_input(spark):
    docs = [(i, "a" * 99, "", 0) for i in range(50)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), [300]).collect()
    check(rows, docs, [300])
    assert len({r.container for r in rows}) == 17
    assert packing.pack(spark.createDataFrame([], DOCS), [300]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DOCS), [])


def test_configurations_never_overuse_a_group():
    sizes, demand = np.array([30, 45, 60]), np.array([10, 7, 9])
    fillings, containers = packing.configurations(sizes, demand, 100)
    assert (fillings @ sizes <= 100).all() and ((fillings * containers[:, None]).sum(axis=0) <= demand).all()


def test_best_fit_takes_the_tightest_space():
    assert list(packing.best_fit([5, 4, 9], [(6, "a"), (5, "b")], 10, "n")) == ["b", "a", "n2"]
