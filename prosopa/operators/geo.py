"""Points near other points, and points in regions, without comparing all with all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.session import hot_keys, slice_join

EARTH_KM = 6371.0088


def haversine_km(x1, y1, x2, y2) -> Column:
    """Great-circle distance in km between (lon, lat) degrees, on a sphere of EARTH_KM."""
    x1, y1, x2, y2 = (c if isinstance(c, Column) else F.col(c) for c in (x1, y1, x2, y2))
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(
        F.sin(F.radians(x2 - x1) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable(x: Column, y: Column) -> Column:
    """Both coordinates present, not both 0, inside the degree ranges. NaN counts as out of range."""
    return F.coalesce(
        x.isNotNull() & y.isNotNull() & ~((x == 0) & (y == 0)) & (F.abs(x) <= 180) & (F.abs(y) <= 90), F.lit(False)
    )


def usable_points(df: DataFrame, id_col: str, x_col: str, y_col: str) -> DataFrame:
    """Distinct (id, x, y) of the rows with an id and a usable position; other columns are left out."""
    point = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y")
    )
    return point.where(F.col("id").isNotNull() & usable(F.col("x"), F.col("y"))).distinct()


def _lattice(radius_km: float):
    """(strip height, strip of y, cells around strip, cell of x in strip).

    Strips are as high as the radius. A strip's cells are at least as wide as the longitude
    half-width of the radius at the highest latitude of the strip and its two neighbours, so
    partners lie at most one strip and one cell away; next to the poles a strip is one cell.
    """
    reach = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    sine = math.sin(math.radians(min(reach, 90)))

    def strip(y: Column) -> Column:
        return F.floor((y + 90) / reach).cast("long")

    def cells(s: Column) -> Column:
        top = F.abs((s + 0.5) * reach - 90) + 1.5 * reach
        width = F.degrees(F.asin(F.least(F.lit(1.0), sine / F.cos(F.radians(top))))) * (1 + 1e-9)
        return F.when(top + reach >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / width))).cast("long")

    def cell(x: Column, n: Column) -> Column:
        return F.pmod(F.floor((x + 180) * n / 360), n).cast("long")

    return strip, cells, cell


def near_pairs(
    points: DataFrame, radius_km: float, ids_per_block: int = 256, rows_per_slice: int = 2048
) -> DataFrame:
    """Pairs (key_a < key_b, distance_km) of different ids at most `radius_km` apart, each once.

    `points` has id, x (longitude) and y (latitude), e.g. from `usable_points`. Ids at one spot
    travel in blocks of about `ids_per_block`, so a spot that holds a third of all rows is many
    small rows rather than one group, and crowded lattice cells are cut into slices
    (`slice_join`). The antimeridian and the poles are handled. An id with several positions takes
    the nearest. No points: no rows.
    """
    strip, cells, cell = _lattice(radius_km)
    hot = hot_keys(points, ["x", "y"], ids_per_block)
    blocks = (
        points.join(hot, ["x", "y"], "left")
        .withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_slices")), F.lit(0)).cast("int"))
        .groupBy("x", "y", "block")
        .agg(F.collect_list("id").alias("ids"))
        .withColumn("s", strip(F.col("y")))
        .withColumn("n", cells(F.col("s")))
    )
    home = blocks.select("s", cell(F.col("x"), F.col("n")).alias("c"), F.struct("x", "y", "block").alias("b"), F.col("ids").alias("b_ids"))
    probe = (
        blocks.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("t", F.col("s") + F.col("up"))
        .withColumn("m", cells(F.col("t")))
        .withColumn("at", cell(F.col("x"), F.col("m")))
        .withColumn("c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(F.col("at") + k, F.col("m"))))))
        .select(F.col("t").alias("s"), "c", "up", F.struct("x", "y", "block").alias("a"), F.col("ids").alias("a_ids"))
    )
    close = (
        slice_join(home, probe, ["s", "c"], ["b"], rows_per_slice)
        .where((F.col("up") == 1) | (F.col("a") <= F.col("b")))
        .withColumn("distance_km", haversine_km(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")))
        .where(F.col("distance_km") <= radius_km)
        .withColumn("own", F.col("a") == F.col("b"))
        .select("distance_km", "own", "b_ids", F.explode("a_ids").alias("id_a"))
        .select("distance_km", "own", "id_a", F.explode("b_ids").alias("id_b"))
        .where(F.when(F.col("own"), F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b")))
    )
    return (
        close.groupBy(F.least("id_a", "id_b").alias("key_a"), F.greatest("id_a", "id_b").alias("key_b"))
        .agg(F.min("distance_km").alias("distance_km"))
    )


def ring_edges(areas: DataFrame, area_col: str = "area_id", rings_col: str = "rings") -> DataFrame:
    """One row (area, ring, x1, y1, x2, y2) for each side of each ring; ring 0 is the outline, later
    rings are holes. Rings that don't end where they began are closed; null rings, null corners and
    rings of fewer than three corners are left out. Rows that repeat an area exactly count once; different
    rows of one area count together."""
    corners = (
        areas.select(F.col(area_col).alias("area"), F.col(rings_col).alias("rings"))
        .distinct()
        .select("area", F.posexplode("rings").alias("ring", "raw"))
        .withColumn("p", F.filter("raw", lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull()))
        .where(F.size("p") >= 3)
    )
    sides = corners.select(
        "area",
        "ring",
        F.explode(
            F.transform("p", lambda p, i: F.struct(p.alias("u"), F.element_at(F.col("p"), (i + 1) % F.size("p") + 1).alias("v")))
        ).alias("e"),
    )
    return sides.select(
        "area",
        "ring",
        F.col("e.u.x").alias("x1"),
        F.col("e.u.y").alias("y1"),
        F.col("e.v.x").alias("x2"),
        F.col("e.v.y").alias("y2"),
    ).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _left(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Whether (x, y), moved by an infinitesimal step east and a much smaller one north, lies left of the side from
    (x1, y1) to (x2, y2). The step settles all ties alike, so that crossings of a path add up at corners."""
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return (turn > 0) | ((turn == 0) & ((y2 < y1) | ((y2 == y1) & (x2 > x1))))


def _cell_rows(edge: DataFrame, strip_degrees: float, bin_degrees: float) -> DataFrame:
    """(strip, bin, area, ring, x1, y1, x2, y2) of the sides that touch a cell, and, with null sides, one row for each
    area and ring that holds the cell's lower right corner an odd number of times.

    A corner's parity counts the sides east of it on the line at the bottom of its strip: these are
    ranked from the east on each line of each ring, and the bins between the first and second, third and fourth
    crossing ... are odd.
    """
    h, w, slack = strip_degrees, bin_degrees, 1e-6
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    lined = edge.withColumn("strip", F.explode(F.sequence(F.floor(low / h - slack).cast("long"), F.floor(high / h + slack).cast("long"))))
    bottom = F.col("strip") * F.lit(h)
    at = lambda y: x1 + F.coalesce(F.try_divide((F.greatest(low, F.least(high, y)) - y1) * (x2 - x1), y2 - y1), F.lit(0.0))
    flat = y1 == y2
    west = F.when(flat, F.least(x1, x2)).otherwise(F.least(at(bottom), at(bottom + h)))
    east = F.when(flat, F.greatest(x1, x2)).otherwise(F.greatest(at(bottom), at(bottom + h)))
    bins = F.sequence(F.floor(west / w - slack).cast("long"), F.floor(east / w + slack).cast("long"))
    sides = lined.select("strip", F.explode(bins).alias("bin"), "area", "ring", "x1", "y1", "x2", "y2")

    # The easternmost corner that has the side east of it lies one bin before the crossing, give or take one.
    line = lined.where((y1 > bottom) != (y2 > bottom))
    first = F.floor(at(bottom) / w).cast("long")
    has_east = lambda b: _left(x1, y1, x2, y2, (b + 1) * F.lit(w), bottom) == (y2 > y1)
    last = F.when(has_east(first), first).when(has_east(first - 1), first - 1).when(has_east(first - 2), first - 2).otherwise(first - 3)
    ring = Window.partitionBy("strip", "area", "ring").orderBy(F.desc("last"))
    ranked = line.select("strip", "area", "ring", last.alias("last")).select("strip", "area", "ring", "last", F.row_number().over(ring).alias("no"), F.lead("last").over(ring).alias("next"))
    odd = ranked.where((F.col("no") % 2 == 1) & (F.col("next") < F.col("last")))
    none = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return sides.unionByName(odd.select("strip", F.explode(F.sequence(F.col("next") + 1, F.col("last"))).alias("bin"), "area", "ring", *none))


def points_in_areas(
    points: DataFrame,
    areas: DataFrame,
    area_col: str = "area_id",
    rings_col: str = "rings",
    strip_degrees: float = 0.125,
    bin_degrees: float = 0.5,
    border_degrees: float = 1e-12,
    rows_per_slice: int = 65536,
    sides_per_slice: int = 4096,
) -> DataFrame:
    """(id, area) for each point in an area, by crossing parity in plane coordinates.

    Ring sides are put into latitude strips and, inside them, into bins of longitude. The ray of a point goes
    east to the border of its bin, down that border to the corner of the cell and east from there: the sides of its
    own cell are met one by one, those further east are counted once for all points of the cell as the parity of
    its corner (`_cell_rows`). Crossings are added up for each point, area and ring. A point at most `border_degrees`
    from a side of an outline belongs to the area, and so does one as close to the edge of a hole; one strictly
    inside a hole does not. Points in no area give no row, in several areas several. Cells with many points are cut
    into slices, and cells with many sides as well.
    """
    rows = _cell_rows(ring_edges(areas, area_col, rings_col), strip_degrees, bin_degrees)
    cell = ["strip", "bin"]
    crowded = hot_keys(rows, cell, sides_per_slice).withColumnRenamed("_slices", "_parts")
    part = F.coalesce(F.pmod(F.xxhash64("area", "ring", "x1", "y1", "x2", "y2"), F.col("_parts")), F.lit(0)).cast("int")
    rows = rows.join(crowded, cell, "left").withColumn("part", part).drop("_parts")
    placed = points.withColumn("strip", F.floor(F.col("y") / strip_degrees).cast("long")).withColumn("bin", F.floor(F.col("x") / bin_degrees).cast("long"))
    placed = placed.join(crowded, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    met = slice_join(placed, rows, [*cell, "part"], ["id", "x", "y"], rows_per_slice)
    x, y, x1, y1, x2, y2 = side = tuple(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    side = side[2:]
    border, bottom = (F.col("bin") + 1) * F.lit(bin_degrees), F.col("strip") * F.lit(strip_degrees)
    up = y2 > y1
    here, turned, corner = _left(*side, x, y), _left(*side, border, y), _left(*side, border, bottom)
    ahead = ((y1 > y) != (y2 > y)) & (here == up) & (turned != up)
    down = ((x1 > border) != (x2 > border)) & (turned != corner)
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    close = lambda v, a, b: v.between(F.least(a, b) - border_degrees, F.greatest(a, b) + border_degrees)
    on_side = (F.abs(turn) <= border_degrees * F.hypot(x2 - x1, y2 - y1)) & close(x, x1, x2) & close(y, y1, y2)
    hits = met.select(
        "id", "x", "y", "area", "ring", F.coalesce(on_side, F.lit(False)).alias("on"), F.when(x1.isNull(), True).otherwise(ahead != down).alias("crosses")
    ).where(F.col("on") | F.col("crosses"))
    rings = hits.groupBy("id", "x", "y", "area", "ring").agg(
        (F.count_if(F.col("crosses")) % 2 == 1).alias("odd"), F.bool_or("on").alias("on")
    )
    return (
        rings.groupBy("id", "x", "y", "area")
        .agg(
            F.bool_or((F.col("ring") == 0) & (F.col("odd") | F.col("on"))).alias("held"),
            F.bool_or((F.col("ring") > 0) & F.col("odd") & ~F.col("on")).alias("holed"),
        )
        .where(F.col("held") & ~F.col("holed"))
        .select("id", "area")
        .distinct()
    )
