"""Texts of varying length combined into containers of fixed capacity by a linear grouping scheme.

Sizes are whole numbers up to the capacity, so a histogram of at most `capacity` rows holds all that
the plan needs: large sizes are rounded up to the largest of their equal-cardinality group, a
configuration program over those few sizes says how many containers hold which mix of groups, and
the rows then take their places by rank. What is left, small texts above all, goes best-fit into
the space that rounding left, in shards of bounded size.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.session import cut

#: Sizes above this share of the capacity are large.
LARGE_SHARE = 1 / 4
GROUPS = 64
ROWS_PER_SHARD = 20_000


def byte_tokens(text: Column) -> Column:
    """Size of a text in byte tokens: one for each UTF-8 byte and one end token; 0 for null."""
    return F.coalesce(F.octet_length(text) + 1, F.lit(0)).cast("long")


def group_sizes(sizes: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(rounded size, members) of the equal-cardinality groups of a histogram with ascending sizes.
    Equal sizes stay together; each group is named by its largest size."""
    if not len(sizes):
        return sizes, counts
    place = (np.cumsum(counts) - counts / 2) * groups // counts.sum()
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    return np.maximum.reduceat(sizes, starts), np.add.reduceat(counts, starts)


def _best_filling(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits the capacity."""
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), dtype=np.int16)
    for g in np.flatnonzero(worth > 1e-12):
        old = value.copy()
        for n in range(1, capacity // int(sizes[g]) + 1):
            shift = n * int(sizes[g])
            offer = old[: capacity + 1 - shift] + n * worth[g]
            better = offer > value[shift:] + 1e-12
            value[shift:][better] = offer[better]
            taken[g, shift:][better] = n
    left, filling = int(np.argmax(value)), np.zeros(len(sizes), dtype=np.int64)
    best = value[left]
    for g in range(len(sizes) - 1, -1, -1):
        filling[g] = taken[g, left]
        left -= int(filling[g] * sizes[g])
    return best, filling


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(fillings, containers): the basic solution of the configuration program, by generated columns,
    rounded down, so that no group is used more often than it has members. After `rounds` columns the plan so far
    is taken, which is valid but may fill containers less; a warning says so."""
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    for _ in range(rounds):
        amount = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(k))
        best, filling = _best_filling(price, sizes, capacity)
        if best <= 1 + 1e-4:
            break
        step = np.linalg.solve(basis, filling.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = filling
    else:
        warnings.warn(f"the packing plan for {capacity} isn't finished after {rounds} columns", RuntimeWarning, stacklevel=2)
    containers = np.floor(np.linalg.solve(basis, demand.astype(float)) + 1e-7).astype(np.int64)
    used = containers > 0
    return basis.T[used].astype(np.int64), containers[used]


def slots(histogram: pd.DataFrame, capacity: int, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> list[tuple]:
    """The plan for one capacity as (group low, group high, first rank, last rank + 1, members of the
    group in one container, first container): members of a group, by rank, fill these containers."""
    part = histogram[(histogram["tokens"] > capacity * large_share) & (histogram["tokens"] < capacity)].sort_values("tokens")
    tops, demand = group_sizes(part["tokens"].to_numpy(np.int64), part["rows"].to_numpy(np.int64), groups)
    if not len(tops):
        return []
    fillings, containers = configurations(tops, demand, capacity)
    first = np.concatenate([[0], np.cumsum(containers)[:-1]])
    lows, out = np.concatenate([[int(capacity * large_share)], tops[:-1]]), []
    for g in range(len(tops)):
        rank = 0
        for c in np.flatnonzero(fillings[:, g]):
            n = int(fillings[c, g] * containers[c])
            out.append((int(lows[g]), int(tops[g]), rank, rank + n, int(fillings[c, g]), int(first[c])))
            rank += n
    return out


def best_fit(sizes: list[int], spaces: list[tuple[int, str]], capacity: int, prefix: str) -> Iterator[str]:
    """A container for each size, in the given order: the one with the least space that suffices,
    else a new one."""
    open_ = sorted(spaces)
    for n, size in enumerate(sizes):
        at = bisect_left(open_, (size, ""))
        space, name = open_.pop(at) if at < len(open_) else (capacity, f"{prefix}{n}")
        insort(open_, (space - size, name))
        yield name


def _fill_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Placed containers of a shard (kind 0: their space) take its unplaced parts (kind 1), longest first."""
    space, part = rows[rows["kind"] == 0], rows[rows["kind"] == 1].sort_values(["tokens", "doc_id", "part_no"], ascending=[False, True, True])
    capacity, shard = int(rows["capacity_tokens"].iloc[0]), int(rows["shard"].iloc[0])
    names = list(best_fit(part["tokens"].tolist(), list(zip(space["tokens"].tolist(), space["container"].tolist(), strict=True)), capacity, f"s{shard}-"))
    return part.assign(container=names)[["capacity_tokens", "container", "doc_id", "part_no", "tokens"]]


def parts(docs: DataFrame, capacities: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(capacity_tokens, doc_id, part_no, parts, tokens): each text once for each capacity, in one
    part unless it is larger than the container; then in full parts and a last one with the rest.
    Null texts have no size and no part; the empty text has one token. Rows with a null id are left out;
    rows that repeat an id with the same size count once."""
    size = byte_tokens(F.col(text_col))
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size")).where(F.col("doc_id").isNotNull() & (F.col("size") > 0)).distinct()
    row = row.withColumn("capacity_tokens", F.explode(F.array(*(F.lit(int(c)) for c in capacities))))
    row = row.withColumn("parts", F.ceil(F.col("size") / F.col("capacity_tokens")).cast("int"))
    row = row.withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    last = F.col("part_no") == F.col("parts")
    tokens = F.when(last, F.col("size") - (F.col("parts") - 1) * F.col("capacity_tokens")).otherwise(F.col("capacity_tokens"))
    return row.select("capacity_tokens", "doc_id", "part_no", "parts", tokens.cast("long").alias("tokens"))


def pack(
    docs: DataFrame, capacities: list[int], id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """(capacity_tokens, container, doc_id, part_no, parts, tokens): every part of `parts` in one container.

    Containers never hold more than the capacity, whatever the input. Only the size histogram, at
    most `capacity` rows for each capacity, comes to the driver. No texts: no rows.
    """
    spark = docs.sparkSession
    capacities = sorted({int(c) for c in capacities if c is not None and c > 0})
    if not capacities:
        raise ValueError("pack needs at least one positive capacity")
    part = cut(parts(docs, capacities, id_col, text_col))
    full = part.where(F.col("tokens") == F.col("capacity_tokens"))
    whole = full.select("capacity_tokens", F.concat_ws("-", F.lit("w"), "doc_id", "part_no").alias("container"), "doc_id", "part_no", "parts", "tokens")
    rest = part.where(F.col("tokens") < F.col("capacity_tokens"))

    histogram = rest.groupBy("capacity_tokens", "tokens").agg(F.count(F.lit(1)).alias("rows")).toPandas()
    plan = [(c, *slot) for c in capacities for slot in slots(histogram[histogram["capacity_tokens"] == c], c, groups)]
    shards = {c: max(1, int(h["rows"].sum()) // rows_per_shard) for c, h in histogram.groupby("capacity_tokens")}
    shard_count = F.element_at(F.create_map(*(F.lit(int(x)) for kv in shards.items() for x in kv)), F.col("capacity_tokens")) if shards else F.lit(1)

    # Ranks within a group: counts of hash buckets, their running sums, and the order inside a bucket.
    slot = spark.createDataFrame(plan, "capacity_tokens int, low long, high long, rank_from long, rank_to long, each long, first long")
    group = slot.select("capacity_tokens", "low", "high").distinct()
    bucketed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id"), shard_count.cast("long")).cast("int"))
    inside = (F.col("r.capacity_tokens") == F.col("g.capacity_tokens")) & (F.col("r.tokens") > F.col("g.low")) & (F.col("r.tokens") <= F.col("g.high"))
    # The plan has at most groups rows for each capacity and slots of at most groups x groups, so both may be broadcast.
    ranked = bucketed.alias("r").join(F.broadcast(group.alias("g")), inside, "left").select("r.*", "g.high")
    large = ranked.where(F.col("high").isNotNull())
    tally = large.groupBy("capacity_tokens", "high", "shard").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("capacity_tokens", "high").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = tally.select("capacity_tokens", "high", "shard", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("offset"))
    order = Window.partitionBy("capacity_tokens", "high", "shard").orderBy("doc_id", "part_no")
    large = large.withColumn("at", F.row_number().over(order) - 1).join(offset, ["capacity_tokens", "high", "shard"]).withColumn("rank", F.col("offset") + F.col("at"))
    where = (
        (F.col("l.capacity_tokens") == F.col("s.capacity_tokens"))
        & (F.col("l.high") == F.col("s.high"))
        & (F.col("l.rank") >= F.col("s.rank_from"))
        & (F.col("l.rank") < F.col("s.rank_to"))
    )
    placed = cut(
        large.alias("l")
        .join(F.broadcast(slot.alias("s")), where, "left")
        .select("l.capacity_tokens", "l.shard", "l.doc_id", "l.part_no", "l.parts", "l.tokens", (F.col("s.first") + F.floor((F.col("l.rank") - F.col("s.rank_from")) / F.col("s.each"))).alias("no"))
    )
    seated = placed.where(F.col("no").isNotNull()).withColumn("container", F.concat(F.lit("c"), F.col("no").cast("string")))
    left = placed.where(F.col("no").isNull()).drop("no").unionByName(ranked.where(F.col("high").isNull()).drop("high"))

    space = (
        seated.groupBy("capacity_tokens", "container")
        .agg((F.first("capacity_tokens") - F.sum("tokens")).alias("tokens"))
        .where(F.col("tokens") > 0)
        .select("capacity_tokens", F.pmod(F.xxhash64("container"), shard_count.cast("long")).cast("int").alias("shard"), F.lit(0).alias("kind"), "container", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("part_no"), "tokens")
    )
    loose = left.select("capacity_tokens", "shard", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("container"), "doc_id", "part_no", "tokens")
    filled = space.unionByName(loose).groupBy("capacity_tokens", "shard").applyInPandas(
        _fill_shard, "capacity_tokens int, container string, doc_id long, part_no int, tokens long"
    )
    # How many parts a text has follows from its last part, which is the one that can be loose.
    filled = filled.withColumn("parts", F.col("part_no"))
    columns = ["capacity_tokens", "container", "doc_id", "part_no", "parts", "tokens"]
    return whole.select(*columns).unionByName(seated.select(*columns)).unionByName(filled.select(*columns))


def fill(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, containers, tokens, share_filled) of a packing."""
    return packed.groupBy("capacity_tokens").agg(
        F.count_distinct("container").alias("containers"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.count_distinct("container") * F.col("capacity_tokens"))).alias("share_filled"),
    )
