"""Readers: CSV and JSON with declared schemas, whole documents, required tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """Raises with the sorted names of the tables or views that the catalog lacks."""
    lacking = sorted(n for n in names if not spark.catalog.tableExists(n))
    if lacking:
        raise ValueError("missing tables: " + ", ".join(lacking))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there in the file system that Spark reads it from."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, optional: bool = False) -> DataFrame:
    """A CSV file with a header and a declared schema, with only the columns asked for. An optional file
    that isn't there has no rows; it is looked for where Spark would read it."""
    if optional and not _exists(spark, path):
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, payload): JSON files whole, one row each, for the nested-record operators."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("file"))
    return files.select(F.xxhash64("file").alias("record_id"), "payload")
