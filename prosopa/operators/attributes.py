"""Entity attributes: deterministic picks of one row, and summaries of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.functions.exprs import percent
from prosopa.functions.permute import numbered_in_order
from prosopa.session import cut


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int = 1, rank: str | None = None) -> DataFrame:
    """The first `count` rows of each group by an order that should settle all ties. The limit is
    applied before the shuffle as well (window group limit), so hot groups send few rows."""
    name = rank or "_rank"
    top = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= count)
    return top if rank else top.drop(name)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group, by aggregation rather than by a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, skip_blank: bool = True, out: str = "mode") -> DataFrame:
    """The most frequent value of each group, the smallest on ties; groups of blanks only give no row."""
    rows = df.where(F.col(value).isNotNull() & ((F.trim(F.col(value).cast("string")) != "") if skip_blank else F.lit(True)))
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(value).alias(out))).alias("_best")).select(*keys, F.col(f"_best.{out}").alias(out))


def top_values(df: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """The `count` most frequent non-blank values of each group: rank, count and share of the group."""
    rows = df.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("count"))
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    ranked = pick(counted, [key], [F.desc("count"), F.asc(value)], count, "rank")
    return ranked.join(total, key).select(key, "rank", value, "count", percent("count", "_total").alias("share_pct"))


def most_common(df: DataFrame, value: str, count: int) -> DataFrame:
    """(value, count): the `count` most frequent non-blank values of a table, the smaller first on ties."""
    rows = df.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(value)).limit(count)


def ordered_distinct_text(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Distinct values of {new: column} joined by semicolons in the order of the values (numbers as
    numbers, null as None, last), and record_count. Numbers and texts are sorted before they are written."""
    def joined(column: str) -> Column:
        texts = F.transform(F.array_sort(F.collect_set(column)), lambda v: v.cast("string"))
        nulls = F.when(F.count_if(F.col(column).isNull()) > 0, F.array(F.lit("None"))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(texts, nulls), ";")

    return df.groupBy(*keys).agg(*(joined(c).alias(n) for n, c in columns.items()), F.count(F.lit(1)).alias("record_count"))


def rates(df: DataFrame, given: str, outcomes: Sequence[str], values: Sequence = (0, 1)) -> DataFrame:
    """Rate of each 0/1 outcome for each value of a 0/1 condition: rows for empty cells too."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(o, v) for o in outcomes for v in values], f"outcome string, {given} int")
    long = df.select(F.col(given).cast("int").alias(given), F.explode(F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(o).cast("int").alias("hit")) for o in outcomes))).alias("o"))
    counted = long.groupBy("o.outcome", given).agg(F.count(F.lit(1)).alias("pairs"), F.sum("o.hit").alias("ones"))
    joined = spine.join(counted, ["outcome", given], "left").na.fill({"pairs": 0, "ones": 0})
    return joined.select("outcome", given, "pairs", "ones", percent("ones", "pairs").alias("rate_pct"))


def long_form(one_row: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A one-row table as (metric, value) rows of text; doubles with six decimals."""
    kinds = dict(one_row.dtypes)
    text = lambda m: F.format_string("%.6f", F.col(m)) if kinds[m] == "double" else F.col(m).cast("string")
    return one_row.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), text(m).alias("value")) for m in metrics))))


def in_order(df: DataFrame, order: str, out: str = "row_no") -> DataFrame:
    """`df` with its places 0 .. n-1 in the order of a unique column, which may be a struct of several."""
    return numbered_in_order(df, order, out)


def exact_medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], bins: int = 1024, rounds: int = 2) -> DataFrame:
    """(*keys, *values): the exact median of each column {new: column} in each group, null without values.

    In each round the rows of a group are counted in `bins` equal bins between bounds, and the bounds close in on the
    bins of the two middle ranks; then only the distinct values between the bounds are ranked. So no task holds
    the values of a group, however large, unless they lie denser than the extent / bins ^ rounds.
    """
    out = df.select(*keys).distinct() if keys else None
    on = lambda a, b: a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))
    for new, column in values.items():
        rows = df.select(*keys, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        bound = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).cast("long").alias("_under"))
        # Ranks of the middle, from 1; _under rows lie below _lo.
        low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
        for _ in range(rounds):
            bound = cut(bound)
            width = (F.col("_hi") - F.col("_lo")) / bins
            place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
            inside = on(rows, bound).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).withColumn("_b", place)
            held = inside.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"), *(F.first(c).alias(c) for c in ("_n", "_under")))
            upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b")) + F.col("_under")
            held = held.withColumn("_upto", upto).where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_c") < high))
            bound = held.groupBy(*keys).agg(F.first("_n").alias("_n"), F.min("_first").alias("_lo"), F.max("_last").alias("_hi"), F.min(F.col("_upto") - F.col("_c")).alias("_under"))
        bound = cut(bound)
        value = on(rows, bound).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), *(F.first(c).alias(c) for c in ("_n", "_under")))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")) + F.col("_under")
        value = value.withColumn("_upto", upto)
        covers = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        middle = value.groupBy(*keys).agg(((F.min(F.when(covers(low), F.col("_v"))) + F.min(F.when(covers(high), F.col("_v")))) / 2).alias(new))
        out = middle if out is None else (out.join(middle, list(keys), "left") if keys else out.crossJoin(F.broadcast(middle)))
    return out
