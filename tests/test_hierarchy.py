import random

from pyspark.sql import functions as F

from prosopa.operators import hierarchy

LINKS = "node long, parent long"


def truth(links):
    up = {}
    for n, p in links:
        if n is not None and p is not None and n != p:
            up[n] = min(p, up.get(n, p))
    out = {}
    for n in {*up, *up.values()}:
        path, at = [n], n
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        if at in up:
            loop = path[path.index(up[at]) :]
            out[n] = (min(loop), -1, None)
        else:
            out[n] = (at, len(path) - 1, "/".join(map(str, path[::-1])))
    return out


def check(spark, links):
    want = truth(links)
    sets = hierarchy.nested_sets(spark.createDataFrame(links, LINKS)).cache()
    rows = sets.collect()
    assert {r.node: (r.root, r.depth) for r in rows} == {n: v[:2] for n, v in want.items()} and len(rows) == len(want)
    got = {r.node: r.path for r in hierarchy.paths(sets).collect()}
    assert got == {n: v[2] for n, v in want.items()}
    inside = {(r.ancestor, r.node) for r in hierarchy.ancestor_pairs(sets).collect()}
    assert inside == {(int(a), n) for n, v in want.items() if v[2] for a in v[2].split("/")}
    for r in rows:
        if r.depth >= 0:
            assert r.size == sum(a == r.node for a, _ in inside)
    trees = [r for r in rows if r.depth >= 0]
    assert sorted(r.pre for r in trees) == list(range(len(trees)))
    sizes = {r.node: r.size for r in trees}
    assert all(r.root_size == sizes[r.root] for r in trees)


def test_random_forest_with_cycles(spark):
    rng = random.Random(5)
    links = [(i, rng.randint(1, i - 1)) for i in range(2, 120) if rng.random() < 0.9]
    links += [(201, 202), (202, 203), (203, 201), (204, 201), (205, 204), (301, 302), (302, 301)]
    check(spark, links + links[:5])


def test_deep_chain_and_wide_star(spark):
    check(spark, [(i + 1, i) for i in range(1, 70)] + [(1000 + i, 999) for i in range(60)])


def test_hot_parents_and_block_borders(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "ROWS_PER_SLICE", 3)
    monkeypatch.setattr(hierarchy, "BLOCK_BITS", 2)
    rng = random.Random(6)
    links = [(100 + i, 1) for i in range(30)] + [(200 + i, 100 + i % 5) for i in range(30)] + [(i, rng.randint(300, i - 1)) for i in range(301, 340)]
    check(spark, links + [(500 + i, 500 + (i + 1) % 8) for i in range(8)] + [(600 + i, 500) for i in range(9)])


def test_rejected_links(spark):
    links = spark.createDataFrame([(5, 2), (5, 1), (5, 1), (5, 3), (6, 5), (7, 7), (None, 1)], LINKS)
    assert sorted(tuple(r) for r in hierarchy.rejected_links(links).collect()) == [(5, 2, 1), (5, 3, 1)]
    assert hierarchy.rejected_links(links.limit(0)).count() == 0


def test_spent_checkpoints_are_removed(spark):
    from pathlib import Path

    from prosopa.session import cut, cut_told, release

    kept, (spent, told) = cut(spark.range(5)), cut_told(spark.range(6), rows=F.count("id"), top=F.max("id"))
    assert told == {"rows": 6, "top": 5} and Path(spent._cut_path.removeprefix("file:")).exists()
    release(spent, spark.range(3))
    assert not Path(spent._cut_path.removeprefix("file:")).exists() and kept.count() == 5
    assert cut(spark.range(5).where("id > 9")).count() == 0


def test_nulls_self_links_and_empty(spark):
    check(spark, [(None, 1), (2, None), (3, 3), (5, 4)])
    empty = hierarchy.nested_sets(spark.createDataFrame([], LINKS))
    assert empty.count() == 0


def test_only_cycles(spark):
    check(spark, [(1, 2), (2, 1), (7, 8), (8, 9), (9, 7)])


def test_father_links_by_code(spark):
    kin = spark.createDataFrame([(10, 20, 75, "x"), (20, 10, 180, "y"), (0, 5, 75, ""), (6, 6, 75, ""), (7, None, 75, ""), (1, 2, None, ""), (1, 2, 999, ""), (3, 4, 134, "")], "c_personid long, c_kin_id long, c_kin_code int, node string")
    codes = spark.createDataFrame([(75, "F", "F"), (180, "S", "S"), (134, "W", "W"), (301, None, None)], "c_kincode int, c_kinrel string, c_kinrel_simplified string")
    assert {tuple(r) for r in hierarchy.father_links(kin, codes).collect()} == {(10, 20)}


def test_descendants_of(spark):
    sets = hierarchy.nested_sets(spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 1)], LINKS))
    chosen = spark.createDataFrame([(2,)], "node long")
    assert {tuple(r) for r in hierarchy.descendants_of(sets, chosen).collect()} == {(2, 3, 1), (2, 4, 2)}


def test_all_descendants_are_listed(spark, monkeypatch):
    from prosopa.plans import problems

    links = spark.createDataFrame([(2, 1), (3, 2), (200, 100)], "node long, parent long")
    monkeypatch.setattr(problems, "_sets", lambda s, d: hierarchy.nested_sets(links))
    got = problems.QUERIES["p3_all_descendants"](spark, "")
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (100, 200, 1)}
