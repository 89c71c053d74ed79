import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosopa.functions import classify, exprs
from prosopa.functions.distances import weighted_distances
from prosopa.functions.permute import numbered, permuted
from prosopa.operators import attributes, breaks, graph, kinship, models, sequences, spatial
from prosopa.plans.config import CLUSTERS


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_percent_and_eras(spark):
    r = one(spark, a=exprs.percent(F.lit(50), F.lit(200)), b=exprs.percent(F.lit(0), F.lit(100)), c=exprs.percent(F.lit(10), F.lit(0)))
    assert (r.a, r.b, r.c) == (25.0, 0.0, 0.0)
    years = spark.createDataFrame([(800,), (1100,), (1300,), (1500,), (2025,), (None,)], "y int")
    assert [r[0] for r in years.select(classify.era("y")).collect()] == ["pre_song", "song_to_yuan", "yuan_to_ming", "ming_to_qing", "out_of_scope", "out_of_scope"]
    years = spark.createDataFrame([(1000,), (1400,), (1700,), (None,)], "y int")
    assert [r[0] for r in years.select(classify.era("y", "break3", "missing_year")).collect()] == ["cluster1_song_and_before", "cluster2_yuan_ming", "cluster3_qing_after", "missing_year"]
    assert one(spark, b=classify.time_bin(F.lit(-1), 50)).b == -50


def test_zscores(spark):
    df = spark.createDataFrame([(10, 5), (20, 5), (30, 5), (None, None)], "a int, b int")
    rows = exprs.zscores(df, {"z": "a", "flat": "b"}).orderBy(F.asc_nulls_last("a")).collect()
    assert abs(sum(r.z for r in rows[:3])) < 1e-12 and abs(sum(r.z**2 for r in rows[:3]) / 3 - 1) < 1e-12
    assert [r.flat for r in rows] == [0.0, 0.0, 0.0, None] and rows[3].z is None
    assert exprs.zscores(df, {"z": "a"}, fill_mean=True).where("a is null").first().z == 0.0


def test_classification_literals(spark):
    df = spark.createDataFrame([(" Central ",), ("unknown",), (None,)], "c string")
    assert [r[0] for r in df.select(classify.category("c")).collect()] == ["Central", "unknown_category", "missing_category"]
    df = spark.createDataFrame([("欽天監監正",), ("太醫院御醫",), ("知州",), (None,)], "o string")
    assert [r[0] for r in df.select(classify.domain("o")).collect()] == ["astronomical", "medical", "other", "other"]
    df = spark.createDataFrame([("中書令",), ("中書令史",)], "o string")
    from prosopa.plans.config import HIGH_WORDS, NOT_HIGH_WORDS

    assert [r[0] for r in df.select(classify.included("o", HIGH_WORDS, NOT_HIGH_WORDS)).collect()] == [True, False]


def test_softmax_and_sigmoid(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, -1.0), (800.0, -800.0)], "a double, b double")
    for r in df.select(*(c.alias(f"p{i}") for i, c in enumerate(exprs.softmax_baseline(["a", "b"])))).collect():
        assert abs(sum(r) - 1) < 1e-12
    assert one(spark, s=exprs.sigmoid(F.lit(0.0))).s == 0.5


def test_collapse_and_distance(spark):
    df = spark.createDataFrame([(["m", "m", "a", "m"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(sequences.collapsed("s")).collect()] == [["m", "a", "m"], []]
    df = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["A", "X", "C"]), (3, ["C"])], "sequence_no long, sequence array<string>")
    code = {r.sequence_no: r.code for r in sequences.encoded(df).collect()}
    assert [len(code[i]) for i in (1, 2, 3)] == [3, 3, 1] and code[1][0] == code[2][0] != code[3] == code[1][2] and code[1][1] != code[2][1]


def test_near_sequences_against_all_pairs(spark):
    rng = random.Random(3)
    codes = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)})
    df = spark.createDataFrame(list(enumerate(codes)), "sequence_no long, code string")

    def far(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            d2 = [i + 1]
            for j, y in enumerate(b):
                d2.append(min(d[j] + (x != y), d[j + 1] + 1, d2[j] + 1))
            d = d2
        return d[-1]

    for steps in (1, 2):
        want = {(i, j, far(a, b)) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and far(a, b) <= steps}
        assert {tuple(r) for r in sequences.near_sequences(df, steps).collect()} == want
    with pytest.raises(ValueError):
        sequences.near_sequences(df, 4)


def test_exact_medians(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.0, rng.uniform(0, 1), rng.uniform(0, 1e6)])) for g in "abc" for _ in range({"a": 1, "b": 200, "c": 333}[g])]
    rows += [("b", None), ("d", None), ("e", 5.0), ("e", 5.0), ("f", 1.0), ("f", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in attributes.exact_medians(df, ["g"], {"m": "v"}, bins=4).collect()}
    want = {g: float(np.median([v for k, v in rows if k == g and v is not None])) if g != "d" else None for g in "abcdef"}
    assert got == want
    assert attributes.exact_medians(df, [], {"m": "v"}).first().m == float(np.median([v for _, v in rows if v is not None]))


def test_segments_fitted_together(spark):
    rng = np.random.default_rng(3)
    rows = [(int(600 + 50 * (i % 6)), float(rng.normal()), int(rng.random() < 0.3 + 0.3 * (i % 2))) for i in range(900)]
    df = spark.createDataFrame(rows, "year int, x double, y int")
    got = {(r.start_bin, r.end_bin): r.cost for r in breaks.model_segment_costs(df, "year", "y", ["x"], 600, 900, 50).collect()}
    assert len(got) == 15

    def deviance(first, last):
        part = [(x, y) for t, x, y in rows if first <= (t - 600) // 50 < last]
        x, y = np.column_stack([np.ones(len(part)), [p[0] for p in part]]), np.array([p[1] for p in part])
        beta = np.zeros(2)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + np.diag([0, 0.01]), x.T @ (y - mu) - np.array([0, 0.01]) * beta)
        mu = 1 / (1 + np.exp(-x @ beta))
        return -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))

    assert all(abs(c - deviance(*k)) < 1e-6 for k, c in got.items())


def test_k_medoids(spark):
    items = spark.createDataFrame([(1, "aaaa", 10), (2, "aaab", 10), (3, "zzzz", 1)], "sequence_no long, code string, weight long")
    got = {r.sequence_no: r.medoid for r in sequences.k_medoids(items, 2).collect()}
    assert got[1] == got[2] != got[3]
    assert {r.career_type for r in sequences.career_types(sequences.k_medoids(items, 9)).collect()} == {"career_type_1", "career_type_2", "career_type_3"}
    assert sequences.k_medoids(items.limit(0), 2).count() == 0


def test_k_medoids_tries_every_member(spark):
    # The heaviest item has 79 near ones, the rest lies 6 away from it around a member that costs least.
    near = ["aaaaaaaa"[:i] + x + "aaaaaaaa"[i + 1 :] for x in "bcdefghijk" for i in range(8)][:79]
    far = ["aazzzzzz", *("aazzzzzz"[:i] + x + "aazzzzzz"[i + 1 :] for x in "bcdefghijk" for i in range(8))]
    codes = ["aaaaaaaa", *near, *far]
    rows = [(i, c, 12 if i == 0 else 1 if c in near else 10) for i, c in enumerate(codes)]
    size = lambda a, b: sum(x != y for x, y in zip(a, b))
    best = min((sum(size(c, x) * w for _, x, w in rows), i) for i, c, _ in rows)[1]
    assert codes[best] == "aazzzzzz"
    got = sequences.k_medoids(spark.createDataFrame(rows, "sequence_no long, code string, weight long"), 1).collect()
    assert {r.medoid for r in got} == {best}


def _steps(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_weighted_distances():
    draw = np.random.default_rng(5)
    text = lambda n: "".join(draw.choice(list("abc中"), n))
    members = [text(n) for n in (0, 1, 3, 8, 9, 16, 17, 32, 33, 64, 65, 128, 129)]
    weights = [int(x) for x in draw.integers(1, 9, len(members))]
    texts = ["", *members[2:5], *(text(n) for n in (2, 7, 40, 70))]
    assert list(weighted_distances(members, weights, texts)) == [sum(w * _steps(m, t) for m, w in zip(members, weights)) for t in texts]


def test_few_members_can_be_the_best(spark):
    # Long members of weight 1 around short heavy ones: their bounds alone must tell that they can't be the best.
    draw = np.random.default_rng(7)
    codes = sorted({"".join(draw.choice(list("abcdefgh"), n)) for n in draw.integers(3, 12, 150)} | {"a", "ab", "b"})
    rows = [(i, c, 40 if len(c) < 3 else 1) for i, c in enumerate(codes)]
    cost = {i: sum(w * _steps(c, x) for _, x, w in rows) for i, c, _ in rows}
    items = spark.createDataFrame(rows, "sequence_no long, code string, weight long")
    bound = {r.sequence_no: r.bound for r in sequences._bounded(sequences.to_medoids(items, [(0, codes[0])]), sequences._tokens(items)).collect()}
    assert bound.keys() == cost.keys() and all(bound[i] <= cost[i] for i in cost)
    assert sum(bound[i] <= min(cost.values()) for i in cost) <= 5
    got = sequences.k_medoids(items, 1, candidates=1).select("medoid").distinct().collect()
    assert [r.medoid for r in got] == [min(cost, key=lambda i: (cost[i], i))]


def test_nearest_medoids_need_no_shuffle(spark):
    items = spark.createDataFrame([(1, "aa", 1), (2, "ab", 1), (3, "bb", 1)], "sequence_no long, code string, weight long")
    placed = sequences.to_medoids(items, [(3, "bb"), (1, "aa")])
    assert {(r.sequence_no, r.medoid, r.distance) for r in placed.collect()} == {(1, 1, 0), (2, 1, 1), (3, 3, 0)}
    assert "Exchange" not in placed._jdf.queryExecution().toString()


def test_medoids_over_many_slices(spark, monkeypatch):
    # Small slices and blocks, so that one cluster needs several of each.
    monkeypatch.setattr(sequences, "MEMBERS", 16)
    monkeypatch.setattr(sequences, "CANDIDATES", (4, 8))
    monkeypatch.setattr(sequences, "GROWTH", 4)
    draw = np.random.default_rng(11)
    codes = sorted({"".join(draw.choice(list("abc"), n)) for n in draw.integers(5, 9, 90)})
    items = spark.createDataFrame([(i, c, 1 + i % 2) for i, c in enumerate(codes)], "sequence_no long, code string, weight long")
    cost = [sum((1 + i % 2) * _steps(c, x) for i, x in enumerate(codes)) for c in codes]
    got = sequences.k_medoids(items, 1, candidates=2).select("medoid").distinct().collect()
    assert [r.medoid for r in got] == [cost.index(min(cost))]


def test_medoids_of_moving_clusters(spark, monkeypatch):
    # Members go from cluster to cluster for several rounds; against trying every member in each round.
    monkeypatch.setattr(sequences, "MEMBERS", 16)
    monkeypatch.setattr(sequences, "CANDIDATES", (2, 4))
    monkeypatch.setattr(sequences, "CELLS", 4)
    draw = np.random.default_rng(58)
    codes = sorted({"".join(draw.choice(list("abcd"), n)) for n in draw.integers(2, 10, 110)})
    weight = [int(w) for w in draw.integers(1, 9, len(codes))]
    far = [[_steps(a, b) for b in codes] for a in codes]
    centres = [min(range(len(codes)), key=lambda i: (-weight[i], i))]
    while len(centres) < 4:
        near = [min(far[i][c] for c in centres) for i in range(len(codes))]
        centres.append(min(range(len(codes)), key=lambda i: (-near[i] * weight[i] ** 0.5, i)))
    rounds, moved = 0, None
    while moved != centres:
        centres, rounds = sorted(moved or centres), rounds + 1
        own = [min(centres, key=lambda c: (far[i][c], c)) for i in range(len(codes))]
        members = [[i for i, m in enumerate(own) if m == c] for c in centres]
        moved = sorted(min(m, key=lambda c: (sum(far[c][x] * weight[x] for x in m), c)) for m in members)
    assert rounds > 3
    items = spark.createDataFrame(list(zip(range(len(codes)), codes, weight)), "sequence_no long, code string, weight long")
    got = sequences.k_medoids(items, 4, candidates=2).collect()
    assert {r.sequence_no: r.medoid for r in got} == dict(enumerate(own))


EDGES = "source long, target long"


def test_graph_basics(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], EDGES)
    assert {tuple(r) for r in graph.two_hop(path).collect()} == {(1, 3), (3, 1), (2, 4), (4, 2)}
    keep = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    inner = graph.build_graph(spark.createDataFrame([(1, 2), (2, 3), (1, 4)], EDGES), keep, "induced")
    assert {(r.source, r.target) for r in inner.collect()} == {(1, 2), (2, 3)}
    assert [tuple(r) for r in graph.projection(spark.createDataFrame([(1, 2), (2, 3)], EDGES), keep).collect()] == [(1, 3, 1)]
    with pytest.raises(ValueError):
        graph.build_graph(path, keep, "other")
    triangle = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], EDGES)
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    got = {r.id: (r.triangles, round(r.clustering, 3)) for r in graph.clustering(triangle, nodes).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 0.333), 4: (0, 0.0), 5: (0, 0.0)}


def test_bounded_paths(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 9), (3, 9), (4, 9)], EDGES)
    got = [tuple(r) for r in graph.bounded_paths(edges, ids(1), ids(9, 4)).orderBy("distance").collect()]
    assert got == [(1, 9, 2, [1, 2, 9]), (1, 4, 3, [1, 2, 9, 4])]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 8)], EDGES)
    assert [(r.high, r.distance) for r in graph.bounded_paths(chain, ids(1), ids(7, 8)).collect()] == [(7, 6)]
    star = spark.createDataFrame([(1, i) for i in range(11, 21)], EDGES)
    assert sorted(r.high for r in graph.bounded_paths(star, ids(1), ids(*range(11, 21))).collect()) == list(range(11, 19))


def test_centralities(spark):
    edges = [(1, 2), (2, 3), (3, 4), (2, 4), (4, 5)]
    df, nodes = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    a = np.zeros((6, 6))
    for u, v in edges:
        a[u - 1, v - 1] = a[v - 1, u - 1] = 1
    top = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.id: r.eigenvector for r in graph.eigenvector(df, nodes).collect()}
    assert max(abs(got[i + 1] - top[i]) for i in range(6)) < 1e-4
    between = {r.id: r.betweenness for r in graph.betweenness(df, nodes).collect()}
    want = {1: 0, 2: 3, 3: 0, 4: 3, 5: 0, 6: 0}
    assert all(abs(between[i] - want[i] / 10) < 1e-9 for i in want)


def test_registered_centralities_settle(spark, monkeypatch):
    from prosopa.plans import reference

    graph_of = lambda edges, n: (spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i,) for i in range(n)], "id long"))
    monkeypatch.setattr(reference, "document_graph", lambda s, d: graph_of([(i, i + 1) for i in range(19)], 20))
    top = np.sin(np.pi * np.arange(1, 21) / 21)
    top /= np.linalg.norm(top)
    assert sum(abs(r.eigenvector - top[r.id]) for r in reference.eigenvector(spark, "").collect()) < 1e-4
    monkeypatch.setattr(reference, "document_graph", lambda s, d: graph_of([(0, i) for i in range(1, 81)], 81))
    assert {r.id: round(r.betweenness, 9) for r in reference.betweenness_sampled(spark, "").collect()} == {i: float(i == 0) for i in range(81)}


def test_nearest_and_moran(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 10.0, 10.0)], "id long, x double, y double")
    got = spatial.nearest(points, 2).collect()
    assert len(got) == 8 and {r.neighbour for r in got if r.id == 0} == {1, 2}
    with pytest.raises(ValueError):
        spatial.nearest(points, 4)
    rng = random.Random(9)
    rows = [(i, rng.choice([rng.uniform(0, 1), rng.uniform(0, 100)]), rng.uniform(0, 1)) for i in range(150)]
    want = {(i, j) for i, x, y in rows for _, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if j != i)[:3]}
    assert {(r.id, r.neighbour) for r in spatial.nearest(spark.createDataFrame(rows, "id long, x double, y double"), 3).collect()} == want
    crowd = [(i, 5.0, 5.0) if i % 3 == 0 else (i, float(i % 7), float(i % 5)) for i in range(120)]
    want = {(i, j) for i, x, y in crowd for _, j in sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in crowd if j != i)[:4]}
    assert {(r.id, r.neighbour) for r in spatial.nearest(spark.createDataFrame(crowd, "id long, x double, y double"), 4).collect()} == want
    values = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)], "id long, value double")
    links = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "id long, neighbour long")
    assert spatial.morans_i(values, links).first().morans_i > 0


def test_moran_of_every_cluster(spark, monkeypatch):
    from prosopa.plans import reference

    rng = random.Random(4)
    rows = [(i, CLUSTERS[i % 3 if i % 5 else 0], rng.uniform(0, 9) + 4 * (i % 3), rng.uniform(0, 9), i % 2) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, cluster string, x double, y double, bureau_medical int")
    monkeypatch.setattr(reference, "places", lambda s, d: points)
    got = {r.label: r for r in reference.moran_permutation(spark, "").collect()}
    assert set(got) == {*CLUSTERS, "bureau_medical"} and {r.permutations for r in got.values()} == {999}
    assert {r.permutations for r in reference.centroid_permutation(spark, "").collect()} == {999}
    near = spatial.nearest(points, 8)
    for c in CLUSTERS:
        values = points.select("id", (F.col("cluster") == c).cast("double").alias("value"))
        want = spatial.morans_i(values, near).first()
        assert got[c].n == want.n == 60 and abs(got[c].observed_i - want.morans_i) < 1e-9 and abs(got[c].expected_i + 1 / 59) < 1e-12
        assert abs(got[c].permutation_mean_i - got[c].expected_i) < 0.02 and got[c].permutation_sd_i > 0


def test_centroids_of_dealt_labels(spark):
    rows = [(i, "ab"[i % 2], float(i % 2) * 3, float(i % 2) * 4) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, c string, x double, y double")
    got = spatial.centroid_test(points, "c", ["a", "b"], 99).first()
    assert got.permutations == 99 and got.p_value == 0.01 and 0 < got.permutation_mean_km < got.observed_km
    assert spatial.centroid_test(points.limit(0), "c", ["a", "b"], 99).count() == 0


def test_permutations(spark):
    got = permuted(np.arange(1000), 1000, 5)
    assert sorted(got) == list(range(1000)) and list(got) != list(range(1000))
    rows = numbered(spark.range(500).withColumnRenamed("id", "k"), "k", rows_per_bucket=40).collect()
    assert sorted(r.row_no for r in rows) == list(range(500))
    dealt = spatial.dealt(np.arange(60), np.array([20, 40, 60]), np.arange(4), 7)
    assert dealt.shape == (60, 4) and all(np.bincount(dealt[:, p]).tolist() == [20, 20, 20] for p in range(4))


def test_logit_scalings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    rows = models.design(df, ["a", "b"], "y")
    full = np.column_stack([np.ones(300), x])

    def newton(l2):
        beta, ridge = np.zeros(3), np.diag([0, l2, l2])
        for _ in range(50):
            mu = 1 / (1 + np.exp(-full @ beta))
            beta += np.linalg.solve((full * (mu * (1 - mu))[:, None]).T @ full + ridge, full.T @ (y - mu) - ridge @ beta)
        return beta

    for penalty, scale, l2 in ((2.0, "sum", 2.0), (0.01, "mean", 3.0), (10.0, "inverse", 0.1)):
        assert np.allclose(models.logit(rows, penalty, scale)["coefficients"], newton(l2), atol=1e-6)
    assert models.logit(rows.where("y = 1"), 1.0)["coefficients"] is None
    two = models.multinomial(rows, 2, 0.01)
    assert np.allclose(two["coefficients"][0], newton(3.0), atol=1e-5)


def test_models_use_all_terms(spark):
    from prosopa.plans import reference

    data = "/root/testdata/sf0.01"
    got = {r.feature for r in reference.multinomial(spark, data).collect()}
    assert {"intercept", *reference.PLACE_TERMS, *reference.NETWORK_CONTROLS, "has_civil_exam", "bureau_medical"} <= got
    got = reference.mple_logit(spark, data).collect()
    assert {r.cluster for r in got} == set(CLUSTERS) and {"contagion", "is_high_official", "bureau_medical", "x_coord_z"} <= {r.term for r in got}
    got = reference.dyad_logits(spark, data).collect()
    assert {(r.model, r.term) for r in got} >= {("science_official_transmission", "father_science"), ("civil_exam_transmission", "father_has_civil_exam")}
    assert {"log_posting_count_z", "betweenness_z", "bureau_medical"} <= {r.term for r in reference.logit_sum_l2(spark, data).collect()}


def test_breaks_against_all_partitions(spark):
    rng = random.Random(2)
    for _ in range(20):
        bins = rng.randint(2, 7)
        costs = [(a, b, rng.choice([None, rng.uniform(1, 50)])) for a in range(bins) for b in range(a + 1, bins + 1)]
        table = {(a, b): c for a, b, c in costs if c is not None}
        best = None
        for mask in range(1 << (bins - 1)):
            cut = [0, *[i + 1 for i in range(bins - 1) if mask >> i & 1], bins]
            spans = list(zip(cut, cut[1:]))
            if len(spans) <= 4 and all(s in table for s in spans):
                bic = sum(table[s] for s in spans) + len(spans) * math.log(100)
                best = bic if best is None else min(best, bic)
        got = breaks.select_breaks(costs, bins, 100, 1, 3)
        assert (got is None) == (best is None) and (best is None or abs(got[0] - best) < 1e-9)
    assert spark.range(1).select(breaks.nearest_year(F.lit(1203))).first()[0] == 1127


def test_kin_pairs_both_ways(spark):
    kin = spark.createDataFrame([(10, 20, 75), (20, 10, 180), (10, 20, 75)], "c_personid long, c_kin_id long, c_kin_code int")
    codes = spark.createDataFrame([(75, "父", "F"), (180, None, "S")], "c_kincode int, c_kinrel_chn string, c_kinrel_simplified string")
    r = kinship.pairs(kin, codes).collect()
    assert [tuple(x) for x in r] == [(20, 10, "75;180", "父;None", 2)]


def test_rates_show_empty_cells(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "f int, c int")
    assert {tuple(r) for r in attributes.rates(df, "f", ["c"]).collect()} == {("c", 0, 2, 1, 50.0), ("c", 1, 0, 0, 0.0)}


def test_relations_and_checks(spark):
    a = spark.createDataFrame([(1, 2, 5), (3, 3, 1), (None, 2, 1)], "x long, y long, c int")
    b = spark.createDataFrame([(2, 1, 7), (4, 2, None), (2, 4, 9)], "x long, y long, c int")
    got = {tuple(r) for r in graph.relations((a, "x", "y", "c", "assoc"), (b, "x", "y", "c", "kin")).collect()}
    assert got == {(1, 2, "assoc", 5), (2, 4, "kin", 9)}
