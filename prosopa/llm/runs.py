"""Runs of equal or nearly equal consecutive entries, collapsed to one entry with count and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.llm.confusables import label_key

# Signs that separate the entries of a written sequence.
SEPARATORS = "[>＞﹥›»→⇒⟶➔]"


def _without_one(text: Column) -> Column:
    """The text and every text made from it by leaving out one character."""
    return F.array_union(
        F.array(text),
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))),
    )


def one_slip_apart(a: Column, b: Column) -> Column:
    """At most one letter lost, added or changed, or two neighbours exchanged."""
    i = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = F.exists(
        i,
        lambda k: F.concat(F.substring(a, F.lit(1), k - 1), F.substring(a, k + 1, F.lit(1)), F.substring(a, k, F.lit(1)), F.substring(a, k + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)


def match_states(labels: DataFrame, col: str, states: DataFrame, no_col: str = "state_no", state_col: str = "state") -> DataFrame:
    """(label, state_no) for each distinct label that stands for a state.

    Labels and states are compared without case, spacing, punctuation, look-alike and invisible
    characters, exactly or one slip apart; an exact match wins over a slip, then the smallest
    state number. Two texts one slip apart share a text with at most one character left out, so
    candidates come from an equi-join. Null labels and labels that match no state give no row.
    """
    label = labels.where(F.col(col).isNotNull()).select(F.col(col).alias("label")).distinct().withColumn("key", label_key("label"))
    state = states.where(F.col(no_col).isNotNull() & F.col(state_col).isNotNull()).select(F.col(no_col).cast("int").alias("state_no"), label_key(state_col).alias("state_key"))
    left = label.select("key").distinct().withColumn("part", F.explode(_without_one(F.col("key"))))
    right = state.withColumn("part", F.explode(_without_one(F.col("state_key"))))
    best = (
        left.join(right, "part")
        .where(one_slip_apart(F.col("key"), F.col("state_key")))
        .groupBy("key")
        .agg(F.min(F.struct((F.col("key") != F.col("state_key")).alias("slip"), "state_no")).alias("best"))
        .select("key", F.col("best.state_no").alias("state_no"))
    )
    return label.join(best, "key").select("label", "state_no")


def entries(df: DataFrame, key: str, sequence: str, firsts: str | None = None, lasts: str | None = None) -> DataFrame:
    """(key, pos from 1, label, first_year, last_year): the entries of written sequences. Rows that
    repeat exactly count once. Years null or below 1 are unknown. A null sequence has no entries,
    an empty one has one empty entry. Of rows that give different sequences for one key each is kept
    under the key, so keys should be unique up to exact copies."""
    none = F.lit(None).cast("array<int>")
    rows = df.select(F.col(key).alias("key"), F.col(sequence).alias("seq"), (F.col(firsts) if firsts else none).alias("fs"), (F.col(lasts) if lasts else none).alias("ls")).distinct()
    part = rows.select("key", "fs", "ls", F.posexplode(F.split("seq", SEPARATORS)).alias("at", "label"))
    year = lambda c: F.when(F.get(c, "at") > 0, F.get(c, "at"))
    return part.select("key", (F.col("at") + 1).alias("pos"), "label", year("fs").alias("first_year"), year("ls").alias("last_year"))


def with_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """`rows` with the state number of each label (null where it stands for none)."""
    known = match_states(rows, "label", states).withColumnRenamed("label", "_label")
    return rows.join(known, rows["label"] == F.col("_label"), "left").drop("_label")


def collapse_runs(rows: DataFrame, state: str = "state_no", block: int = 4096) -> DataFrame:
    """(key, start_pos, end_pos, state, entries, first_year, last_year), one row for each longest run
    of entries of one state at consecutive positions. `rows` has key, pos, first_year, last_year.

    An entry is compared with its predecessor in a lag window, changes are flagged, and the running
    sum of the flags numbers the runs. Windows cover blocks of `block` positions of a key, so one
    endless sequence isn't one task; runs that meet at a block's border are then joined in a second
    pass over the border runs alone. Entries of unknown state (null) are runs of their own.
    """
    blocked = rows.withColumn("_block", F.floor((F.col("pos") - 1) / block).cast("long"))
    inside = Window.partitionBy("key", "_block").orderBy("pos")
    before, at = F.lag(state).over(inside), F.lag("pos").over(inside)
    change = F.when((before == F.col(state)) & (at == F.col("pos") - 1), 0).otherwise(1)
    flagged = blocked.withColumn("_change", change).withColumn("_run", F.sum("_change").over(inside))
    piece = flagged.groupBy("key", "_block", "_run").agg(
        F.min("pos").alias("start_pos"),
        F.max("pos").alias("end_pos"),
        F.min(state).alias(state),
        F.count(F.lit(1)).alias("entries"),
        F.min(F.least("first_year", "last_year")).alias("first_year"),
        F.max(F.greatest("first_year", "last_year")).alias("last_year"),
    )
    low, high = F.col("_block") * block + 1, (F.col("_block") + 1) * block
    border = ((F.col("start_pos") == low) & (F.col("_block") > 0)) | (F.col("end_pos") == high)
    columns = ["key", "start_pos", "end_pos", state, "entries", "first_year", "last_year"]
    across = Window.partitionBy("key").orderBy("start_pos")
    meets = (F.lag(state).over(across) == F.col(state)) & (F.lag("end_pos").over(across) == F.col("start_pos") - 1)
    merged = (
        piece.where(border)
        .withColumn("_change", F.when(meets, 0).otherwise(1))
        .withColumn("_run", F.sum("_change").over(across))
        .groupBy("key", "_run")
        .agg(
            F.min("start_pos").alias("start_pos"),
            F.max("end_pos").alias("end_pos"),
            F.min(state).alias(state),
            F.sum("entries").alias("entries"),
            F.min("first_year").alias("first_year"),
            F.max("last_year").alias("last_year"),
        )
    )
    return piece.where(~border).select(*columns).unionByName(merged.select(*columns))


def repeats(runs: DataFrame, state: str = "state_no") -> DataFrame:
    """The runs of two or more entries of a known state."""
    return runs.where(F.col(state).isNotNull() & (F.col("entries") >= 2))
