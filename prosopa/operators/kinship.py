"""Father-child dyads with the attributes of both, and transmission rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopa.functions.exprs import percent, prefixed
from prosopa.operators.attributes import earliest, ordered_distinct_text


def pairs(kin: DataFrame, codes: DataFrame) -> DataFrame:
    """(father_id, child_id, relation_codes, relation_labels_chn, record_count): F rows name the father,
    S rows the son; both directions of one pair come together. Ids that are null or 0 and equal ids give no pair; repeated rows
    count once."""
    code = codes.select("c_kincode", "c_kinrel_chn", "c_kinrel_simplified").where(F.col("c_kinrel_simplified").isin("F", "S")).distinct()
    row = kin.select("c_personid", "c_kin_id", "c_kin_code").distinct().join(code, F.col("c_kin_code") == F.col("c_kincode"))
    father = F.col("c_kinrel_simplified") == "F"
    pair = row.select(
        F.when(father, F.col("c_kin_id")).otherwise(F.col("c_personid")).alias("father_id"),
        F.when(father, F.col("c_personid")).otherwise(F.col("c_kin_id")).alias("child_id"), "c_kin_code", "c_kinrel_chn",
    ).where((F.col("father_id") != 0) & (F.col("child_id") != 0) & (F.col("father_id") != F.col("child_id")))
    return ordered_distinct_text(pair, ["father_id", "child_id"], {"relation_codes": "c_kin_code", "relation_labels_chn": "c_kinrel_chn"})


def dyads(pair: DataFrame, people: DataFrame, key: str = "c_personid", surname: str = "c_surname_chn") -> DataFrame:
    """`pair` with the columns of `people` for father (father_) and child (child_), and same_surname,
    which needs a surname that isn't blank. Unknown persons have null attributes; of a person's rows
    that differ the smallest counts, whole."""
    one = earliest(people, [key], [c for c in people.columns if c != key])
    father, child = prefixed(one, "father_"), prefixed(one, "child_")
    joined = pair.join(father, F.col("father_id") == F.col(f"father_{key}"), "left").join(child, F.col("child_id") == F.col(f"child_{key}"), "left")
    same = (F.coalesce(F.trim(f"father_{surname}"), F.lit("")) != "") & F.col(f"father_{surname}").eqNullSafe(F.col(f"child_{surname}"))
    return joined.drop(f"father_{key}", f"child_{key}").withColumn("same_surname", same.cast("int"))


def transmission(pair: DataFrame, cluster: str, father: str, child: str, clusters: Sequence[str]) -> DataFrame:
    """(cluster, pairs, father_ones, child_ones, both_ones, rate_pct): one row for each named cluster, empty
    ones too; the rate is of fathers with the trait whose child has it."""
    spine = pair.sparkSession.createDataFrame([(c,) for c in clusters], "cluster string")
    f, c = F.coalesce(F.col(father), F.lit(0)), F.coalesce(F.col(child), F.lit(0))
    counted = pair.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(f).alias("father_ones"), F.sum(c).alias("child_ones"), F.sum(f * c).alias("both_ones"))
    row = spine.join(counted, "cluster", "left").na.fill(0, ["pairs", "father_ones", "child_ones", "both_ones"])
    return row.withColumn("rate_pct", percent("both_ones", "father_ones"))
