"""Structural breaks in a binned panel: segment costs, exact search by BIC, alignment with known years."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.functions.classify import time_bin
from prosopa.plans.config import TRANSITION_YEARS
from prosopa.session import cut


def panel(df: DataFrame, year: str, outcome: str, start: int, end: int, width: int) -> DataFrame:
    """(bin_no, time_bin, n, ones) of the rows in the window with a known year: bins are numbered as they
    occur, so an empty bin doesn't part its neighbours. The panel has one row for each bin."""
    rows = df.where(F.col(year).between(start, end)).select(time_bin(year, width).alias("time_bin"), F.coalesce(F.col(outcome), F.lit(0)).cast("int").alias("y"))
    binned = rows.groupBy("time_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    return binned.withColumn("bin_no", (F.row_number().over(Window.orderBy("time_bin")) - 1).cast("int")).select("bin_no", "time_bin", "n", "ones")


def _deviance(ones: Column, n: Column) -> Column:
    p = ones / n
    return -2 * (ones * F.log(p) + (n - ones) * F.log(1 - p))


def segment_costs(binned: DataFrame, min_bins: int = 2, min_rows: int = 120) -> DataFrame:
    """(start_bin, end_bin, n, ones, cost): every run of bins of the least length with its intercept-only
    logit deviance, from prefix sums; null where too few rows or one class only. Bins are few."""
    order = Window.orderBy("bin_no")
    run = binned.select("bin_no", "n", "ones", F.sum("n").over(order).alias("cn"), F.sum("ones").over(order).alias("co"))
    a = run.select(F.col("bin_no").alias("start_bin"), (F.col("cn") - F.col("n")).alias("n0"), (F.col("co") - F.col("ones")).alias("o0"))
    b = run.select((F.col("bin_no") + 1).alias("end_bin"), F.col("cn").alias("n1"), F.col("co").alias("o1"))
    pair = a.join(b, F.col("end_bin") - F.col("start_bin") >= min_bins).select("start_bin", "end_bin", (F.col("n1") - F.col("n0")).alias("n"), (F.col("o1") - F.col("o0")).alias("ones"))
    fit = (F.col("n") >= min_rows) & (F.col("ones") > 0) & (F.col("ones") < F.col("n"))
    return pair.withColumn("cost", F.when(fit, _deviance(F.col("ones"), F.col("n"))))


def _segment_fits(rows: DataFrame, segments: Sequence[tuple[int, int]], width: int, ridge: float, iterations: int = 100, tolerance: float = 1e-9) -> list[float]:
    """The deviance of a penalised logit of (bin_no, x, y) in each segment of bins, all fitted together.

    Each round is one pass over the rows: a task sorts its rows by bin, so a segment is a slice of them, and sends
    the sums of all segments. Newton steps are taken on the driver, halved for a segment whose goal fell.
    """
    many, size = len(segments), 1 + width + width * width
    penalty = np.full(width, ridge)
    penalty[0] = 0.0

    def sums(beta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((many, size))
            for batch in batches:
                if len(batch):
                    batch = batch.sort_values("bin_no")
                    bins, x, y = batch["bin_no"].to_numpy(), np.vstack(batch["x"].to_numpy()), batch["y"].to_numpy()
                    for i, (first, last) in enumerate(segments):
                        at = slice(*np.searchsorted(bins, [first, last]))
                        mu = np.clip(1 / (1 + np.exp(-np.clip(x[at] @ beta[i], -35, 35))), 1e-15, 1 - 1e-15)
                        ll = np.sum(y[at] * np.log(mu) + (1 - y[at]) * np.log1p(-mu))
                        total[i] += np.concatenate([[ll], x[at].T @ (y[at] - mu), ((x[at] * (mu * (1 - mu))[:, None]).T @ x[at]).ravel()])
            yield pd.DataFrame({"i": np.arange(many * size), "v": total.ravel()})

        told = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        return told["v"].to_numpy().reshape(many, size)

    best, tried = np.zeros((many, width)), np.zeros((many, width))
    goal, ll = np.full(many, -np.inf), np.zeros(many)
    open_ = np.ones(many, bool)
    for _ in range(iterations):
        told = sums(tried)
        for i in np.flatnonzero(open_):
            now = told[i, 0] - 0.5 * np.sum(penalty * tried[i] ** 2)
            if now < goal[i] - 1e-9:
                tried[i] = (best[i] + tried[i]) / 2
                continue
            gain, goal[i], ll[i], best[i] = now - goal[i], now, told[i, 0], tried[i]
            move = np.linalg.pinv(told[i, 1 + width :].reshape(width, width) + np.diag(penalty)) @ (told[i, 1 : 1 + width] - penalty * best[i])
            open_[i] = gain > tolerance and np.max(np.abs(move)) > tolerance
            tried[i] = best[i] + move
        if not open_.any():
            break
    return [float(-2 * v) for v in ll]


def model_segment_costs(df: DataFrame, year: str, outcome: str, features: Sequence[str], start: int, end: int, width: int, min_bins: int = 2, min_rows: int = 120, inverse_penalty: float = 100.0) -> DataFrame:
    """As `segment_costs`, but with the deviance of a penalised logit on the features in each segment. Null
    features count as 0. The table of costs has a row for each pair of bins."""
    binned = cut(panel(df, year, outcome, start, end, width))
    spans = segment_costs(binned, min_bins, min_rows)
    x = F.array(F.lit(1.0), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    rows = df.where(F.col(year).between(start, end)).select(time_bin(year, width).alias("time_bin"), x.alias("x"), F.coalesce(F.col(outcome), F.lit(0)).cast("int").alias("y"))
    rows = cut(rows.join(binned.select("time_bin", "bin_no"), "time_bin").select("bin_no", "x", "y"))
    segments = sorted((r[0], r[1]) for r in spans.where(F.col("cost").isNotNull()).select("start_bin", "end_bin").collect())
    costs = _segment_fits(rows, segments, len(features) + 1, 1 / inverse_penalty) if segments else []
    fitted = df.sparkSession.createDataFrame([(a, b, c) for (a, b), c in zip(segments, costs, strict=True)], "start_bin int, end_bin int, cost double")
    return spans.drop("cost").join(fitted, ["start_bin", "end_bin"], "left")


def select_breaks(costs: Sequence[tuple[int, int, float | None]], bins: int, rows: int, parameters: int, max_breaks: int) -> tuple[float, list[tuple[int, int]]] | None:
    """(BIC, segments) of the best cover of 0 .. bins by segments with a cost: least summed cost for each number of
    segments, then least BIC; on ties the earliest starts and the fewest breaks. None without a cover.
    The cost table has a row for each pair of bins, whatever the data's size."""
    cost = {(a, b): c for a, b, c in costs if c is not None}
    best: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, -1)}
    for used in range(1, max_breaks + 2):
        for end in range(1, bins + 1):
            for start in range(end):
                if (used - 1, start) in best and (start, end) in cost:
                    total = best[used - 1, start][0] + cost[start, end]
                    if (used, end) not in best or total < best[used, end][0]:
                        best[used, end] = (total, start)
    covers = [(best[u, bins][0] + u * parameters * math.log(rows), u) for u in range(1, max_breaks + 2) if (u, bins) in best]
    if not covers:
        return None
    bic, used = min(covers)
    segments, end = [], bins
    for u in range(used, 0, -1):
        start = best[u, end][1]
        segments.append((start, end))
        end = start
    return bic, segments[::-1]


def break_table(binned: DataFrame, costs: DataFrame, parameters: int = 1, max_breaks: int = 5, tolerance: int = 50) -> DataFrame:
    """(segment, start_bin, end_bin, first_time_bin, n, ones, cost, bic, nearest_transition, years_off, aligned):
    the chosen segments; all but the first begin at a break. No cover: no rows."""
    spark = binned.sparkSession
    rows = [(r["start_bin"], r["end_bin"], r["cost"]) for r in costs.select("start_bin", "end_bin", "cost").collect()]
    told = binned.agg(F.count(F.lit(1)), F.sum("n")).first()
    chosen = select_breaks(rows, told[0], told[1] or 0, parameters, max_breaks) if told[0] else None
    picked = [(i + 1, a, b, chosen[0]) for i, (a, b) in enumerate(chosen[1])] if chosen else []
    segment = spark.createDataFrame(picked, "segment int, start_bin int, end_bin int, bic double")
    row = segment.join(costs, ["start_bin", "end_bin"]).join(binned.select(F.col("bin_no").alias("start_bin"), F.col("time_bin").alias("first_time_bin")), "start_bin")
    near = nearest_year(F.col("first_time_bin"))
    is_break = F.col("segment") > 1
    off = F.abs(F.col("first_time_bin") - near)
    return row.select(
        "segment", "start_bin", "end_bin", "first_time_bin", "n", "ones", "cost", "bic",
        F.when(is_break, near).alias("nearest_transition"), F.when(is_break, off).alias("years_off"), F.when(is_break, off <= tolerance).alias("aligned"),
    )


def nearest_year(year: Column, years: Sequence[int] = TRANSITION_YEARS) -> Column:
    """The nearest of a fixed list of years, the first listed on ties; null for null."""
    best = F.array_min(F.array(*(F.struct(F.abs(year - y).alias("off"), F.lit(i).alias("i"), F.lit(y).alias("y")) for i, y in enumerate(years))))
    return F.when(year.isNotNull(), best["y"])
