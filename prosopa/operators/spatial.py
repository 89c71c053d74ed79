"""Spatial statistics: centroids, dispersion, nearest neighbours, Moran's I, permutation tests."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.functions.permute import key_of, numbered, permuted
from prosopa.operators.attributes import exact_medians
from prosopa.operators.geo import haversine_km
from prosopa.session import cut, slice_join


def centroids(points: DataFrame, by: str) -> DataFrame:
    """(by, centroid_x, centroid_y): mean longitude and latitude of each group."""
    return points.groupBy(by).agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))


def dispersion(points: DataFrame, by: str) -> DataFrame:
    """Count, centroid, extent, spread and distances to the centroid of each group: standard distance is the
    root of the mean square; spreads are 0 for single points; the median is exact."""
    middle = centroids(points, by)
    far = cut(points.select(by, "x", "y").join(middle, by).withColumn("d", haversine_km("x", "y", "centroid_x", "centroid_y")))
    spread = lambda c: F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp(c)), F.lit(0.0))
    return far.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"),
        spread("x").alias("x_std"), spread("y").alias("y_std"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("standard_distance_km"), F.avg("d").alias("mean_distance_km"),
    ).join(exact_medians(far, [by], {"median_distance_km": "d"}), by)


def centroid_distances(points: DataFrame, by: str, clusters: Sequence[str]) -> DataFrame:
    """(cluster_a, cluster_b, distance_km) for the pairs of the named groups, in their order."""
    middle = centroids(points, by).where(F.col(by).isin(*clusters))
    place = F.array_position(F.array(*map(F.lit, clusters)), F.col(by))
    a = middle.select(F.col(by).alias("cluster_a"), place.alias("pa"), F.col("centroid_x").alias("ax"), F.col("centroid_y").alias("ay"))
    b = middle.select(F.col(by).alias("cluster_b"), place.alias("pb"), F.col("centroid_x").alias("bx"), F.col("centroid_y").alias("by_"))
    return a.join(b, F.col("pa") < F.col("pb")).select("cluster_a", "cluster_b", haversine_km("ax", "ay", "bx", "by_").alias("distance_km"))


def nearest(points: DataFrame, k: int, start_cell: float | None = None) -> DataFrame:
    """(id, neighbour, rank, d2): the k nearest other points of each in plane degrees, ties by id.

    Ids at one spot share their neighbours, so spots rather than points are searched: of any spot only
    the k + 1 smallest ids can be neighbours, and a spot's k + 1 nearest ids hold the k nearest of each
    of its ids. A spot that holds a third of all rows is one row of the search. Spots meet the spots of
    the 3 x 3 grid cells around theirs, crowded cells in slices. Neighbours within one cell's width are
    certain; spots with fewer than k + 1 certain ones go on with a cell twice as wide, the others are
    done. That ends for any points, as a cell as wide as their extent holds them all. No point is compared with all. Ids must be unique. With k or fewer points there is a ValueError.
    """
    points = cut(points.select(F.col("id").cast("long").alias("id"), "x", "y"))
    told = points.agg(F.count(F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    n, width = told[0], max(told[1] or 0.0, told[2] or 0.0)
    if not 0 < k < n:
        raise ValueError(f"k = {k} needs 0 < k < {n} points")
    first_ids = points.withColumn("at", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("at") <= k + 1)
    spot = cut(first_ids.groupBy("x", "y").agg(F.collect_list("id").alias("ids")))
    cell = start_cell or max(width * (k / n) ** 0.5, 1e-9)
    open_, done = spot.select("x", "y"), None
    while True:
        grid = lambda c, w=cell: F.floor(F.col(c) / w).cast("long")
        home = spot.select(grid("x").alias("cx"), grid("y").alias("cy"), "ids", F.col("x").alias("nx"), F.col("y").alias("ny"))
        step = F.array(F.lit(-1), F.lit(0), F.lit(1))
        probe = open_.withColumn("gx", grid("x")).withColumn("gy", grid("y")).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
        probe = probe.select("x", "y", (F.col("gx") + F.col("dx")).alias("cx"), (F.col("gy") + F.col("dy")).alias("cy"))
        pair = slice_join(home, probe, ["cx", "cy"], ["nx", "ny"], 2048)
        pair = pair.withColumn("d2", F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)).where(F.col("d2") <= cell * cell)
        pair = pair.select("x", "y", "d2", F.explode("ids").alias("neighbour"))
        ranked = pair.withColumn("at", F.row_number().over(Window.partitionBy("x", "y").orderBy("d2", "neighbour"))).where(F.col("at") <= k + 1)
        near = ranked.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("d2", "neighbour"))).alias("near"))
        full = cut(near.where(F.size("near") == k + 1))
        done = full if done is None else done.unionByName(full)
        open_ = cut(open_.join(full.select("x", "y"), ["x", "y"], "left_anti"))
        if open_.isEmpty():
            others = F.slice(F.filter("near", lambda m: m["neighbour"] != F.col("id")), 1, k)
            row = slice_join(points, done, ["x", "y"], ["id"], 65536).select("id", F.posexplode(others).alias("at", "m"))
            return row.select("id", "m.neighbour", (F.col("at") + 1).alias("rank"), "m.d2")
        cell *= 2


def morans_i(values: DataFrame, neighbours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, morans_i) of values (id, value, *by) over neighbour rows (id, neighbour): each of a
    point's k neighbours weighs 1/k; null where the values don't vary."""
    by = list(by)
    mean = values.groupBy(*by).agg(F.avg("value").alias("_m"), F.count(F.lit(1)).alias("n"))
    centred = (values.join(mean, by) if by else values.crossJoin(F.broadcast(mean))).select("id", *by, "n", (F.col("value") - F.col("_m")).alias("c"))
    weight = neighbours.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    linked = neighbours.join(weight, "id")
    other = centred.select(F.col("id").alias("neighbour"), *by, F.col("c").alias("c2"))
    cross = centred.join(linked, "id").join(other, ["neighbour", *by]).groupBy(*by).agg(F.sum(F.col("c") * F.col("c2") / F.col("k")).alias("up"))
    square = centred.groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).alias("down"), F.max("n").alias("n"))
    both = square.join(cross, by) if by else square.crossJoin(F.broadcast(cross))
    return both.select(*by, "n", F.when(F.col("down") > 0, F.col("up") / F.col("down")).alias("morans_i"))


def dealt(numbers: np.ndarray, ends: np.ndarray, permutations: np.ndarray, seed: int) -> np.ndarray:
    """Which value each row number gets in each permutation (rows x permutations, as places in the sorted
    distinct values). `ends` are the running counts of those values: sorted by value, the rows that hold the i-th
    end at ends[i], so the value behind a permuted number is found by its place, without a join."""
    keys = np.array([key_of(seed, p) for p in permutations.tolist()], np.uint64)
    return np.searchsorted(ends, permuted(numbers[:, None], int(ends[-1]), keys[None, :]), side="right")


def centroid_test(points: DataFrame, by: str, clusters: Sequence[str], permutations: int, seed: int = 20260608) -> DataFrame:
    """Observed centroid distances with mean and spread over permuted labels and p = (hits + 1) / (m + 1).

    Points are numbered once; each task deals labels to its rows in all permutations and sends one sum for
    each permutation and label, so no row is shuffled. Rows of one id count each.
    """
    observed = centroid_distances(points, by, clusters).withColumnRenamed("distance_km", "observed_km")
    rows = cut(numbered(points.select("id", F.col(by).alias("label"), "x", "y").withColumn("_key", F.struct("id", "x", "y", "label")), "_key").drop("_key"))
    # One row for each label: labels are a classification, of few values.
    held = sorted(((r[0], r[1]) for r in rows.groupBy("label").agg(F.count(F.lit(1))).collect()), key=lambda r: (r[0] is not None, r[0]))
    if not held:
        return observed.selectExpr("cluster_a", "cluster_b", "observed_km", "CAST(NULL AS DOUBLE) permutation_mean_km", "CAST(NULL AS DOUBLE) permutation_sd_km", "0L permutations", "CAST(NULL AS DOUBLE) p_value")
    labels, ends = [r[0] for r in held], np.cumsum([r[1] for r in held])
    draws, width = np.arange(permutations), len(held)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, permutations * width))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                place = (dealt(part["row_no"].to_numpy(), ends, draws, seed) + draws[None, :] * width).ravel()
                for i, w in enumerate((np.ones(len(part)), part["x"].to_numpy(), part["y"].to_numpy())):
                    total[i] += np.bincount(place, np.repeat(w, permutations), permutations * width)
        name = np.tile(np.array(labels, dtype=object), permutations)
        yield pd.DataFrame({"permutation": np.repeat(draws, width), "c": name, "n": total[0], "sx": total[1], "sy": total[2]})

    told = rows.select("row_no", "x", "y").mapInPandas(sums, "permutation long, c string, n double, sx double, sy double")
    middle = cut(told.groupBy("permutation", "c").agg((F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my")))
    a = middle.select("permutation", F.col("c").alias("cluster_a"), F.col("mx").alias("ax"), F.col("my").alias("ay"))
    b = middle.select("permutation", F.col("c").alias("cluster_b"), F.col("mx").alias("bx"), F.col("my").alias("by_"))
    drawn = observed.join(a, "cluster_a").join(b, ["permutation", "cluster_b"]).withColumn("d", haversine_km("ax", "ay", "bx", "by_"))
    return drawn.groupBy("cluster_a", "cluster_b").agg(
        F.first("observed_km").alias("observed_km"), F.avg("d").alias("permutation_mean_km"), F.stddev_pop("d").alias("permutation_sd_km"),
        F.count(F.lit(1)).alias("permutations"), ((F.count_if(F.col("d") >= F.col("observed_km")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )


def morans_tests(points: DataFrame, flags: Mapping[str, Column], neighbours: DataFrame, permutations: int, seed: int = 20260608) -> DataFrame:
    """(label, ones, n, observed_i, permutation_mean_i, permutation_sd_i, permutations, p_value, expected_i): Moran's
    I of each 0/1 flag of `points` against the rest, a row each, with its expectation, permutation mean and spread, and p.

    The flags of a point are the bits of one number, so all of them are dealt out together, and a point
    holds its numbers of all permutations in one array (the observed one first), dealt from the counts of the
    numbers alone. An array meets those of the point's neighbours in one join, whatever the number of permutations
    and flags. Null flags count as 0. Every point needs neighbours.
    """
    names = list(flags)
    if not 0 < len(names) < 64:
        raise ValueError("from 1 to 63 flags")
    kind = "byte" if len(names) < 8 else "long"
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags.values())), F.lit(0).cast("long"))
    rows = cut(points.select(F.col("id").cast("long").alias("id"), bits.cast(kind).alias("bits")))
    told = rows.agg(F.count(F.lit(1)), *(F.sum(F.getbit("bits", F.lit(i))) for i in range(len(names)))).first()
    # At most one row for each combination of flags.
    held = sorted(tuple(r) for r in rows.groupBy("bits").agg(F.count(F.lit(1))).collect())
    values, ends = np.array([r[0] for r in held], np.int64), np.cumsum([r[1] for r in held])
    draws = np.arange(permutations)

    def deals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                many = np.column_stack([part["bits"].to_numpy(np.int64), values[dealt(part["row_no"].to_numpy(), ends, draws, seed)]])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "many": list(many.astype(np.int8 if kind == "byte" else np.int64))})

    # The few rows are spread first, or one task would deal out all permutations.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = cut(numbered(rows, "id").repartition(tasks, "id").mapInPandas(deals, f"id long, many array<{kind}>"))
    weight = neighbours.groupBy("id").agg((1 / F.count(F.lit(1))).alias("w"))
    pair = neighbours.select("id", "neighbour").join(weight, "id").join(listed.withColumnRenamed("many", "a"), "id")
    pair = pair.join(listed.select(F.col("id").alias("neighbour"), F.col("many").alias("b")), "neighbour").select("a", "b", "w")
    width = permutations + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, other = np.zeros((len(names), width)), np.zeros((len(names), width))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                if len(part):
                    a, b, w = np.vstack(part["a"].to_numpy()), np.vstack(part["b"].to_numpy()), part["w"].to_numpy()
                    for i in range(len(names)):
                        has = (b >> i) & 1
                        other[i] += w @ has
                        both[i] += w @ (has & (a >> i))
        at = np.indices((len(names), width))
        yield pd.DataFrame({"flag": at[0].ravel(), "draw": at[1].ravel(), "both": both.ravel(), "other": other.ravel()})

    drawn = pair.mapInPandas(sums, "flag int, draw int, both double, other double").groupBy("flag", "draw").agg(F.sum("both").alias("both"), F.sum("other").alias("other"))
    n = told[0]
    ones = points.sparkSession.createDataFrame([(i, name, int(told[i + 1] or 0)) for i, name in enumerate(names)], "flag int, label string, ones long")
    p = F.col("ones") / n
    value = F.when((F.col("ones") > 0) & (F.col("ones") < n), (F.col("both") - p * F.col("other") - p * F.col("ones") + p * p * n) / (n * p * (1 - p)))
    row = drawn.join(F.broadcast(ones), "flag").select("label", "ones", "draw", value.alias("i"))
    observed = row.where("draw = 0").select("label", F.col("i").alias("observed_i"))
    return row.where("draw > 0").join(observed, "label").groupBy("label", "ones", "observed_i").agg(
        F.avg("i").alias("permutation_mean_i"), F.stddev_samp("i").alias("permutation_sd_i"), F.count("i").alias("permutations"),
        ((F.count_if(F.col("i") >= F.col("observed_i")) + 1) / (F.count("i") + 1)).alias("p_value"),
    ).select("label", "ones", F.lit(n).alias("n"), "observed_i", "permutation_mean_i", "permutation_sd_i", "permutations", "p_value", F.lit(-1 / (n - 1)).alias("expected_i"))
