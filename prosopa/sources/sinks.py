"""Writers: JSON, CSV, graph files with dense numbers, and marks of SVG views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopa.functions.classify import one_hot
from prosopa.functions.permute import numbered_in_order

def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, single: bool = False) -> None:
    """CSV with a header, in one file if asked (for small results)."""
    rows = df.select(*columns) if columns else df
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, text unescaped, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def graph_rows(nodes: DataFrame, edges: DataFrame, cluster: str, clusters: Sequence[str], attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(edge lines, attributes): edges as text of two dense 1-based numbers in the order of the ids, and nodes with
    their number, the attributes and one 0/1 column for each cluster. Edges with an end that is no node are left out."""
    number = numbered_in_order(nodes, "id").withColumn("node_no", F.col("row_no") + 1).drop("row_no")
    at = lambda side: number.select(F.col("id").alias(side), F.col("node_no").alias(f"{side}_no"))
    lines = edges.join(at("source"), "source").join(at("target"), "target").select(F.concat_ws(" ", "source_no", "target_no").alias("value"))
    return lines, number.select("node_no", *attributes, *one_hot(cluster, clusters, "cluster_"))


def write_graph_files(nodes: DataFrame, edges: DataFrame, folder: str, cluster: str, clusters: Sequence[str], attributes: Sequence[str]) -> None:
    """The tables of `graph_rows` as text and CSV. Without rows the CSV still has its header."""
    lines, rows = graph_rows(nodes, edges, cluster, clusters, attributes)
    lines.write.mode("overwrite").text(f"{folder}/edges")
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/attributes")


def svg_marks(points: DataFrame, label: str, width: int = 800, height: int = 600) -> DataFrame:
    """(value): one SVG circle for each (x, y, label), scaled to the extent with 5 % of room around, as rows that
    Spark writes as text; nothing is drawn on the driver."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    row = points.select("x", "y", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("t")).crossJoin(F.broadcast(box))
    wide = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1.0)
    sx = (F.col("x") - F.col("x0") + 0.05 * wide("x0", "x1")) / (1.1 * wide("x0", "x1")) * width
    sy = height - (F.col("y") - F.col("y0") + 0.05 * wide("y0", "y1")) / (1.1 * wide("y0", "y1")) * height
    escaped = F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return row.select(F.format_string('<circle cx="%.2f" cy="%.2f" r="2"><title>%s</title></circle>', sx, sy, escaped).alias("value"))
