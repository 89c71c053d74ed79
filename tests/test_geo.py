import math
import random

from prosopa.operators import geo

POINTS = "id long, x double, y double, extra string"
RINGS = "area_id long, rings array<array<struct<x double, y double>>>"


def km(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def brute(rows, radius):
    good = {(i, x, y) for i, x, y, _ in rows if i is not None and x is not None and y is not None and not x == y == 0 and abs(x) <= 180 and abs(y) <= 90}
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[0] != b[0] and km(a[1:], b[1:]) <= radius}


def pairs(spark, rows, radius, **options):
    points = geo.usable_points(spark.createDataFrame(rows, POINTS), "id", "x", "y")
    got = [(r.key_a, r.key_b) for r in geo.near_pairs(points, radius, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    spots = [(rng.uniform(99, 101), rng.uniform(29, 31)) for _ in range(60)]
    rows = [(i, *rng.choice(spots), "a") for i in range(200)] + [(200 + i, rng.uniform(100, 100.2), rng.uniform(30, 30.2), "b") for i in range(100)]
    assert pairs(spark, rows, 5.0) == brute(rows, 5.0)
    assert pairs(spark, rows, 5.0, ids_per_block=2, rows_per_slice=3) == brute(rows, 5.0)


def test_near_pairs_at_poles_and_date_line(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(89.9, 90), "") for i in range(60)]
    rows += [(100 + i, rng.choice([-180.0, 180.0, 179.999, -179.999]), rng.uniform(-0.01, 0.01), "") for i in range(20)]
    assert pairs(spark, rows, 4.0) == brute(rows, 4.0)


def test_near_pairs_edge_cases(spark):
    assert pairs(spark, [], 1.0) == set()
    rows = [(1, 5.0, 5.0, None), (1, 5.0, 5.0, None), (2, 5.0, 5.0, "x"), (None, 5.0, 5.0, ""), (3, None, 5.0, ""), (4, 0.0, 0.0, ""), (5, 200.0, 5.0, ""), (6, float("nan"), 5.0, "")]
    assert pairs(spark, rows, 1.0) == {(1, 2)}


def test_points_in_areas_with_holes_and_borders(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]  # not closed: is closed
    areas = spark.createDataFrame([(7, [square, hole]), (8, [hole]), (9, None), (10, [[(0.0, 0.0), None, (1.0, 1.0)]])], RINGS)
    rows = [(1, 0.5, 0.5, ""), (2, 2.0, 2.0, ""), (3, 4.0, 2.0, ""), (4, 1.0, 2.0, ""), (5, 5.0, 2.0, ""), (6, 0.5, 1.0, ""), (7, 4.0, 4.0, "")]
    points = geo.usable_points(spark.createDataFrame(rows, POINTS), "id", "x", "y")
    for size in (65536, 1):
        got = {(r.id, r.area) for r in geo.points_in_areas(points, areas, rows_per_slice=size).collect()}
        assert got == {(1, 7), (2, 8), (3, 7), (4, 7), (4, 8), (6, 7), (7, 7)}


def test_points_in_areas_against_ray_casting(spark):
    rng = random.Random(3)
    corners = [(2 + rng.uniform(1, 2) * math.cos(t * math.pi / 10), 2 + rng.uniform(1, 2) * math.sin(t * math.pi / 10)) for t in range(20)]
    ring = corners + corners[:1]
    rows = [(i, rng.uniform(0.001, 4), rng.uniform(0, 4), "") for i in range(300)]

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:])) % 2 == 1

    points = geo.usable_points(spark.createDataFrame(rows, POINTS), "id", "x", "y")
    got = {r.id for r in geo.points_in_areas(points, spark.createDataFrame([(1, [ring])], RINGS)).collect()}
    assert got == {i for i, x, y, _ in rows if inside(x, y)}
    assert geo.points_in_areas(points, spark.createDataFrame([], RINGS)).count() == 0


def test_parity_on_the_grid_of_cells(spark):
    """Corners, sides and points on the borders of strips and bins, against exact arithmetic."""
    from fractions import Fraction

    rng = random.Random(8)
    step = lambda: rng.randint(0, 16) / 8
    rings = [[(step(), step()) for _ in range(rng.randint(3, 7))] for _ in range(12)]
    rows = [(i, step() + 0.0625 * rng.randint(0, 1), step() + 0.0625 * rng.randint(0, 1), "") for i in range(200)]
    rows = [(i, x or 0.5, y, e) for i, x, y, e in rows]

    def inside(ring, x, y):
        x, y, odd = Fraction(x), Fraction(y), False
        ring = [(Fraction(a), Fraction(b)) for a, b in ring]
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (c - a) * (y - b) == (d - b) * (x - a) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d) and (a, b) != (c, d):
                return True
            if (b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b):
                odd = not odd
        return odd

    points = geo.usable_points(spark.createDataFrame(rows, POINTS), "id", "x", "y")
    areas = spark.createDataFrame([(50 + k, [ring]) for k, ring in enumerate(rings)], RINGS)
    want = {(i, 50 + k) for i, x, y, _ in rows for k, ring in enumerate(rings) if inside(ring, x, y)}
    for options in ({}, {"sides_per_slice": 2, "rows_per_slice": 5}, {"strip_degrees": 0.3, "bin_degrees": 0.07}):
        assert {(r.id, r.area) for r in geo.points_in_areas(points, areas, **options).collect()} == want


def test_border_tolerance(spark):
    areas = spark.createDataFrame([(7, [[(0.1, 0.1), (0.4, 0.2), (0.3, 0.7)]])], RINGS)
    rows = [(1, 0.1 + 0.3 / 3, 0.1 + 0.1 / 3, ""), (2, 0.25, 0.15 - 1e-6, ""), (3, 0.4, 0.2, "")]
    points = geo.usable_points(spark.createDataFrame(rows, POINTS), "id", "x", "y")
    assert {r.id for r in geo.points_in_areas(points, areas).collect()} == {1, 3}
    assert {r.id for r in geo.points_in_areas(points, areas, border_degrees=1e-5).collect()} == {1, 2, 3}


def test_a_hundred_thousand_sides_in_one_strip(spark):
    n = 50_000
    top = [(100 + 40 * k / n, 30.05 + 0.01 * (k % 2)) for k in range(n + 1)]
    ring = top + [(x, 30.02) for x, _ in reversed(top)]
    rng = random.Random(4)
    rows = [(i, rng.uniform(99, 141), rng.uniform(30.0, 30.1), "") for i in range(2000)]

    def inside(x, y):
        if not 100 < x < 140 or not 30.02 < y:
            return False
        k = int((x - 100) * n / 40)
        (a, b), (c, d) = top[k], top[k + 1]
        return y < b + (x - a) * (d - b) / (c - a)

    points = geo.usable_points(spark.createDataFrame(rows, POINTS), "id", "x", "y")
    got = {r.id for r in geo.points_in_areas(points, spark.createDataFrame([(1, [ring])], RINGS)).collect()}
    assert got == {i for i, x, y, _ in rows if inside(x, y)}


def test_haversine(spark):
    row = spark.range(1).select(geo.haversine_km(*map(__import__("pyspark.sql.functions", fromlist=["lit"]).lit, (116.4, 39.9, 121.47, 31.23))).alias("d")).first()
    assert 1000 < row.d < 1150 and abs(row.d - 1067.079) < 0.01
