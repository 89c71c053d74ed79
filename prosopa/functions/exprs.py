"""Column expressions: percentages, z-scores, clipping, probabilities, tolerant casts, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent(part: Column | str, total: Column | str, digits: int = 4) -> Column:
    """100 part / total, rounded half up; 0 where the total is 0 or null."""
    part, total = _col(part), _col(total)
    return F.when(total != 0, F.round(part / total * 100, digits)).otherwise(F.lit(0.0))


def clean(text: Column | str) -> Column:
    """Trimmed text, the empty text for null."""
    return F.coalesce(F.trim(_col(text)), F.lit(""))


def whole_number(text: Column | str) -> Column:
    """The whole number a text holds; null for blanks, fractions and anything else."""
    t = F.trim(_col(text).cast("string"))
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long"))


def first_text(*texts: Column | str) -> Column:
    """The first text that isn't null or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(_col(t).cast("string")), F.lit("")) for t in texts))


def code_label(code: Column | str, labels: Mapping[int, str], fallback: str) -> Column:
    """The label of a code; null, 0 and unknown codes get the fallback."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), F.nullif(_col(code), F.lit(0))) if pairs else F.lit(None).cast("string")
    return F.coalesce(known, F.lit(fallback))


def label(key: Column | str, labels: Mapping[str, str], keep_unknown: bool = False) -> Column:
    """The label of a key; unknown keys are null, or kept as they are."""
    key = _col(key)
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key)
    return F.coalesce(known, key) if keep_unknown else known


def clip(x: Column | str, low: float, high: float) -> Column:
    """x, kept between low and high; null stays null."""
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column | str) -> Column:
    """Logistic function of x clipped to ±35."""
    return 1 / (1 + F.exp(-clip(x, -35.0, 35.0)))


def softmax_baseline(etas: Sequence[Column | str]) -> list[Column]:
    """Probabilities of the baseline (score 0) and of each scored category, shifted by the largest score."""
    scores = [F.lit(0.0), *map(_col, etas)]
    top = F.greatest(*scores)
    shifted = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, shifted)
    return [s / total for s in shifted]


def zscores(df: DataFrame, columns: Mapping[str, str], fill_mean: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """`df` with population z-scores {new: column}. A column without spread scores 0. Null scores null,
    or, with fill_mean, counts as the mean (which changes the spread) and scores 0.

    Means and spreads come from one aggregate (one row, or one row for each of `by`) that is joined
    back, so no row is gathered with all others.
    """
    group = df.groupBy(*by).agg(*(F.avg(F.col(c).cast("double")).alias(f"_m_{n}") for n, c in columns.items()))
    joined = df.crossJoin(F.broadcast(group)) if not by else df.join(group, list(by), "left")
    filled = {n: (F.coalesce(F.col(c).cast("double"), F.col(f"_m_{n}")) if fill_mean else F.col(c).cast("double")) for n, c in columns.items()}
    spread = joined.groupBy(*by).agg(*(F.stddev_pop(x).alias(f"_s_{n}") for n, x in filled.items()))
    joined = joined.crossJoin(F.broadcast(spread)) if not by else joined.join(spread, list(by), "left")
    z = {n: F.when(x.isNotNull(), F.when(F.col(f"_s_{n}") > 0, (x - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).otherwise(0.0)) for n, x in filled.items()}
    return joined.select(*df.columns, *(v.alias(n) for n, v in z.items()))


def varying(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features whose values differ; one row of spreads comes to the driver."""
    spread = df.agg(*(F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features)).first()
    return [f for f in features if spread[f] is not None and spread[f] > 0]


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """`df` with a prefix on every column name."""
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))

