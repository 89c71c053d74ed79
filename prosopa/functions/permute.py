"""Pseudorandom permutations of row numbers, and distributed row numbers."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosopa.session import cut

ROUNDS = 24


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers spread over 64 bits (the finaliser of a public 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int | np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """The places of the numbers `x` in a pseudorandom permutation of 0 .. n-1 that depends on the key.
    In each round a number may change places with its partner, as a hash of the pair says, so every
    round is one to one. n and key may vary by element; numbers and sizes stay below 2^63."""
    with np.errstate(over="ignore"):
        x, n, key = np.asarray(x).astype(np.uint64), np.asarray(n).astype(np.uint64), np.asarray(key).astype(np.uint64)
        for r in range(ROUNDS):
            salt = _mixed(key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1))
            partner = (salt % n + n - x) % n
            swap = _mixed(np.maximum(x, partner) ^ salt) & np.uint64(1)
            x = np.where(swap == 1, partner, x)
    return x.astype(np.int64)


def key_of(*parts: object) -> int:
    """A 64-bit key of the given values, the same in every process."""
    text = "\x1f".join(map(str, parts)).encode()
    return crc32(text) << 32 | crc32(text[::-1] + b"key")


def numbered(df: DataFrame, key: str, out: str = "row_no", rows_per_bucket: int = 20_000) -> DataFrame:
    """`df` with the numbers 0 .. n-1 in a pseudorandom order of the unique column `key`: places inside
    hash buckets of bounded size plus the running sum of the buckets, so no task holds all rows."""
    buckets = max(1, df.count() // rows_per_bucket)
    row = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    held = row.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    start = held.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = row.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1)
    return placed.join(start, "_bucket").select(*df.columns, (F.col("_start") + F.col("_at")).alias(out))


def numbered_in_order(df: DataFrame, key: str, out: str = "row_no") -> DataFrame:
    """`df` with the numbers 0 .. n-1 in the order of the unique column `key`: rows are parted by ranges of the
    key, numbered inside each range, and moved on by the rows of the ranges before."""
    ranged = cut(df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()))
    held = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    start = held.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1)
    return placed.join(start, "_range").select(*df.columns, (F.col("_start") + F.col("_at")).alias(out))
