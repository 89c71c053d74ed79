"""Session helpers: lineage cuts, table access, and splitting of hot join keys."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's `spark.checkpoint.dir`, or, only where that is
    unset and the master is local (tests, one machine), a fresh temporary folder. Off local mode an unset
    folder is a ValueError, as executors couldn't read each other's files."""
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = named or tempfile.mkdtemp(prefix="prosopa-checkpoint-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage: it is written as a Parquet table into the shared folder and read
    back, so it survives lost executors and is read by column. It is written plain, without dictionaries and
    compression, so that the size the planner sees, and broadcasts by, is that of the rows."""
    path = f"{checkpoint_folder(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_told(df: DataFrame, **told: Column) -> tuple[DataFrame, dict]:
    """`cut` with figures of the rows (aggregates by name), taken while they are written, without another job."""
    seen = Observation()
    return cut(df.observe(seen, *(c.alias(n) for n, c in told.items()))), seen.get


def release(*frames: DataFrame) -> None:
    """Remove the tables of frames from `cut` that nothing reads any more, so that a loop holds those of its
    last rounds only. Other frames are left alone."""
    for df in frames:
        path = getattr(df, "_cut_path", None) if "_cut_path" in df.__dict__ else None
        if path is not None:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_slice: int) -> DataFrame:
    """Keys with more than `rows_per_slice` rows and the number of slices each needs (at most
    rows / rows_per_slice keys; counted with map-side combining)."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > rows_per_slice).select(
        *keys, F.ceil(F.col("_rows") / rows_per_slice).cast("int").alias("_slices")
    )


def slice_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Sequence[str], rows_per_slice: int = 4096, hot: DataFrame | None = None
) -> DataFrame:
    """Inner equi-join in which no key keeps more than about `rows_per_slice` rows of `many` together.

    A hot key of `many` is cut into slices by a hash of the `spread` columns; the `few` rows of that
    key are repeated once for each slice. All other keys stay in slice 0. Column names outside
    `keys` must not clash. Rows with a null key never match. `hot` (keys and _slices) is given where the
    rows of each key are known already.
    """
    hot = hot_keys(many, keys, rows_per_slice) if hot is None else hot
    left = (
        many.join(hot, list(keys), "left")
        .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_slices")), F.lit(0)).cast("int"))
        .drop("_slices")
    )
    right = (
        few.join(hot, list(keys), "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
        .drop("_slices")
    )
    return left.join(right, [*keys, "_slice"]).drop("_slice")
