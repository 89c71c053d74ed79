"""The general operators on nulls, repeated rows, empty tables and columns with clashing names."""

from pyspark.sql import functions as F

from prosopa.operators import geo, hierarchy, nested


def with_clashes(df, *names):
    """`df` with extra columns named like those that the operators use inside."""
    return df.select("*", *(F.lit("clash").alias(n) for n in names if n not in df.columns))


def twice(df):
    return df.unionByName(df)


def test_points(spark):
    schema = "key long, lon double, lat double"
    rows = [(1, 10.0, 10.0), (2, 10.001, 10.0), (None, 10.0, 10.0), (3, None, 10.0), (4, float("nan"), 10.0), (5, 0.0, 0.0), (6, 190.0, 10.0), (7, 10.0, 10.0)]
    raw = with_clashes(twice(spark.createDataFrame(rows, schema)), "id", "x", "y", "s", "c", "n", "block", "ids", "_slices", "_rows")
    points = geo.usable_points(raw, "key", "lon", "lat")
    assert {r.id for r in points.collect()} == {1, 2, 7}
    assert {(r.key_a, r.key_b) for r in geo.near_pairs(points, 0.8).collect()} == {(1, 2), (1, 7), (2, 7)}
    ring = [(9.0, 9.0), (11.0, 9.0), (11.0, 11.0), (9.0, 11.0)]
    area_schema = "area_id long, rings array<array<struct<x:double,y:double>>>"
    areas = with_clashes(twice(spark.createDataFrame([(50, [ring]), (51, None), (52, [None]), (53, [[]]), (54, [ring[:2]])], area_schema)), "area", "ring", "strip", "id", "x", "y")
    assert {tuple(r) for r in geo.points_in_areas(points, areas).collect()} == {(1, 50), (2, 50), (7, 50)}
    none = points.limit(0)
    assert geo.near_pairs(none, 0.8).count() == 0 and geo.points_in_areas(none, areas).count() == 0 and geo.points_in_areas(points, areas.limit(0)).count() == 0


def test_nested_records(spark):
    whole = '{"nodes": [null, {"id": 1, "highOffices": [null, {"id": 5}, 7]}, "text", {"id": "x", "scienceOffices": {}}]}'
    rows = [(1, whole), (2, None), (3, ""), (4, "{"), (5, "[]"), (6, '{"nodes": null}'), (7, '{"nodes": []}')]
    raw = with_clashes(twice(spark.createDataFrame(rows, "record_id long, payload string")), "root", "whole", "nodes", "node", "node_no", "at", "document_state", "scienceOffices")
    shaped = nested.shapes(raw)
    assert {tuple(r) for r in nested.object_keys(shaped).collect()} == {(1, 1, "nodes", 0), (1, 2, "nodes", 0), (1, 1, "highOffices", 1)}
    assert {r.document_state for r in nested.documents(raw).collect()} >= {"document_missing", "document_broken"}
    empty = nested.shapes(raw.limit(0))
    assert nested.node_table(empty).count() == 0 and nested.office_table(empty).count() == 0


def test_hierarchies(spark):
    links = [(2, 1), (3, 1), (4, 3), (None, 1), (5, None), (6, 6), (8, 9), (9, 8), (7, 8)]
    raw = with_clashes(twice(spark.createDataFrame(links, "node long, parent long")), "up", "top", "steps", "size", "root", "depth", "pre", "f_node")
    got = {r.node: (r.root, r.depth) for r in hierarchy.nested_sets(raw).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 2), 7: (8, -1), 8: (8, -1), 9: (8, -1)}
    empty = hierarchy.nested_sets(raw.limit(0))
    assert empty.count() == 0 and hierarchy.ancestor_pairs(empty).count() == 0 and hierarchy.paths(empty).count() == 0
