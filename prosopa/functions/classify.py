"""Column expressions that classify: keywords, bureaus, domains, categories, eras, bins, flags."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopa.functions.exprs import clean
from prosopa.plans.config import BUREAU_FLAGS, BUREAUS, DOMAINS, ENTRY_CODES, ERAS


def any_word(text: Column | str, words: Sequence[str]) -> Column:
    """Whether any of the words is in the trimmed text. Null text has none."""
    return clean(text).rlike("|".join(re.escape(w) for w in words))


def included(text: Column | str, words: Sequence[str], but_not: Sequence[str]) -> Column:
    """Whether a word is in the text and none of the others is."""
    return any_word(text, words) & ~any_word(text, but_not)


def first_match(text: Column | str, patterns: Mapping[str, str], otherwise: str) -> Column:
    """The name of the first pattern found in the text."""
    text = clean(text)
    chain = reduce(lambda w, kv: w.when(text.rlike(kv[1]), kv[0]), patterns.items(), F)
    return chain.otherwise(otherwise)


def bureau(office: Column | str) -> Column:
    return first_match(office, BUREAUS, "other_technical")


def domain(*names: Column | str, rules: Mapping[str, Sequence[str]] = DOMAINS) -> Column:
    """The first domain one of whose substrings is in the lower-cased names, else `other`."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit("")) for n in names)))
    chain = reduce(lambda w, kv: w.when(reduce(lambda a, b: a | b, (text.contains(s) for s in kv[1])), kv[0]), rules.items(), F)
    return chain.otherwise("other")


def category(value: Column | str) -> Column:
    """missing_category for null or blank, unknown_category for any writing of unknown, else trimmed."""
    text = clean(value)
    return F.when(text == "", "missing_category").when(F.lower(text) == "unknown", "unknown_category").otherwise(text)


def career_state(domain_: Column, category_: Column) -> Column:
    return F.when(domain_ != "other", F.concat(F.lit("domain_"), domain_)).otherwise(F.concat(F.lit("category_"), category_))


def era(year: Column | str, scheme: str = "break4", missing: str = "out_of_scope") -> Column:
    """The era of a year by closed ranges; `missing` for null, out_of_scope for years outside all."""
    year = F.col(year) if isinstance(year, str) else year
    chain = reduce(lambda w, e: w.when(year.between(e[1], e[2]), e[0]), ERAS[scheme], F.when(year.isNull(), missing))
    return chain.otherwise("out_of_scope")


def with_era(df: DataFrame, year: str, eras: DataFrame, out: str = "era") -> DataFrame:
    """Range join with an era table (name, first_year, last_year); rows outside all eras get out_of_scope.
    Era tables hold a handful of rows by nature; the planner broadcasts them if they are small."""
    e = eras.select(F.col("name").alias("_name"), F.col("first_year").alias("_from"), F.col("last_year").alias("_to"))
    joined = df.join(e, F.col(year).between(F.col("_from"), F.col("_to")), "left")
    return joined.select(*(df[c] for c in df.columns), F.coalesce("_name", F.lit("out_of_scope")).alias(out))


def time_bin(year: Column | str, width: int) -> Column:
    """First year of the bin, downward for negative years."""
    year = F.col(year) if isinstance(year, str) else year
    return (F.floor(year / width) * width).cast("int")


def one_hot(value: Column | str, keys: Sequence[str] = tuple(BUREAU_FLAGS), prefix: str = "bureau_") -> list[Column]:
    """A 0/1 column for each key; null and other values are all zero."""
    value = F.col(value) if isinstance(value, str) else value
    return [F.coalesce((value == k).cast("int"), F.lit(0)).alias(prefix + k) for k in keys]


def code_flags(df: DataFrame, key: str, code: str, sets: Mapping[str, Sequence] = ENTRY_CODES) -> DataFrame:
    """One row for each non-null key with a 0/1 flag for each code set, in one aggregation."""
    flags = [F.max(F.when(F.col(code).isin(*codes), 1).otherwise(0)).alias(name) for name, codes in sets.items()]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*flags)


def geo_validity(x: Column | str, y: Column | str) -> list[Column]:
    """raw_geo, invalid_zero_coord, valid_geo and geo_reason of a position."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    raw = x.isNotNull() & y.isNotNull()
    zero = F.coalesce(raw & (x == 0) & (y == 0), F.lit(False))
    reason = F.when(~raw, "missing_coordinate").when(zero, "zero_zero_coordinate").otherwise("valid_coordinate")
    return [raw.alias("raw_geo"), zero.alias("invalid_zero_coord"), (raw & ~zero).alias("valid_geo"), reason.alias("geo_reason")]


def known(value: Column | str, positive: bool = False) -> Column:
    """1 where a value is there (and above 0, if asked), else 0."""
    value = F.col(value) if isinstance(value, str) else value
    test = value.isNotNull() & (value > 0) if positive else value.isNotNull()
    return F.coalesce(test, F.lit(False)).cast("int")
