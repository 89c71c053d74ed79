"""Records of several sources mixed to target shares of the total size, in fixed-length blocks.

A mix asks each source for a number of tokens, which becomes a number of block slots: whole passes over
the source's blocks and part of one more. The slots go to output shards of bounded size. Shards come in
strata of at most STRATUM_SLOTS slots; a stratum holds its proportional part of every source's slots, so it
is known by arithmetic, and within it the counts of each shard are drawn. Strata and shards are rows, drawn and
filled in as many tasks as there are, and every size is treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosopa.functions.permute import key_of, permuted
from prosopa.llm.packing import byte_tokens
from prosopa.session import cut

BLOCK_TOKENS = 1024
SLOTS_PER_SHARD = 4096
#: Slots of a stratum: 256 shards.
STRATUM_SLOTS = 1 << 20
#: Slots that one task fills.
SLOTS_PER_TASK = 1 << 14


def sized_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size) of the rows with an id, a source and a text, exact repeats once."""
    row = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), byte_tokens(F.col(text_col)).alias("size"))
    return row.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.col("size") > 0)).distinct()


def plan(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each (mix_id, source) of the targets: what is asked for and what is there.

    own_tokens is the source's size (0 without documents) and blocks its blocks, the last of which may be
    partly filled; target_tokens is its share of the mix's total size with each document once, most_tokens
    what max_repeats allows. slots are the blocks to draw: as many whole passes over the source as fit
    the target, and of the next pass the number of blocks that comes nearest to what is left, so a source
    ends within half a block of its target, or at max_repeats passes where the target is out of reach. Targets
    with a null mix, source or share are left out; repeated ones count once, with the largest share and cap.
    Negative caps and shares count as 0.
    """
    wanted = targets.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull() & F.col("target_share").isNotNull())
    wanted = wanted.groupBy("mix_id", "source").agg(
        F.greatest(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats")
    )
    own = sized.groupBy("source").agg(F.sum("size").alias("own_tokens"))
    row = wanted.join(own, "source", "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)))
    total = F.sum("own_tokens").over(Window.partitionBy("mix_id"))
    row = row.withColumn("target_tokens", F.col("target_share") * total).withColumn("most_tokens", F.col("max_repeats") * F.col("own_tokens"))
    row = row.withColumn("blocks", F.ceil(F.col("own_tokens") / block_tokens).cast("long"))
    reach = F.least("target_tokens", F.col("most_tokens").cast("double"))
    passes = F.coalesce(F.floor(F.try_divide(reach, F.col("own_tokens"))), F.lit(0)).cast("long")
    rest = reach - F.col("_passes") * F.col("own_tokens")
    row = row.withColumn("_passes", passes).withColumn("_more", F.least(F.round(rest / block_tokens).cast("long"), F.col("blocks")))
    return row.withColumn("slots", F.col("_passes") * F.col("blocks") + F.col("_more")).drop("_passes", "_more")


def block_spans(sized: DataFrame, block_tokens: int = BLOCK_TOKENS, rows_per_bucket: int = 20_000) -> DataFrame:
    """(source, block_no, doc_id, span_from, span_tokens): each source's texts end to end, in a
    pseudorandom order, cut into blocks. A span is the part of a text that lies in a block.

    Positions are prefix sums in two levels, inside hash buckets of about `rows_per_bucket` rows and
    over the buckets, so a source with a third of all rows is many small windows.
    """
    buckets = max(1, sized.count() // rows_per_bucket)
    row = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "source"), F.lit(buckets)).cast("int"))
    held = row.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = held.select("source", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = row.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, ["source", "bucket"])
    placed = placed.withColumn("low", F.col("start") + F.col("ahead")).withColumn("high", F.col("low") + F.col("size"))
    first, last = F.floor(F.col("low") / block_tokens), F.floor((F.col("high") - 1) / block_tokens)
    cutting = placed.select("source", "doc_id", "low", "high", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block_no"))
    from_, to = F.greatest("low", F.col("block_no") * block_tokens), F.least("high", (F.col("block_no") + 1) * block_tokens)
    return cutting.select("source", "block_no", "doc_id", (from_ - F.col("low")).alias("span_from"), (to - from_).alias("span_tokens"))


def draw(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by shard and source: multinomial draws, given that the shards are as equal as can be and
    that each source's counts add up to `counts`."""
    left, out = np.asarray(counts, dtype=np.int64), []
    total = int(left.sum())
    for shard in range(shards):
        take = total * (shard + 1) // shards - total * shard // shards
        taken = rng.multivariate_hypergeometric(left, take, method="marginals")
        out.append(taken)
        left = left - taken
    return np.array(out)


def shard_counts(planned: DataFrame, seed: int, slots_per_shard: int = SLOTS_PER_SHARD, stratum_slots: int = STRATUM_SLOTS) -> DataFrame:
    """(mix_id, source, blocks, shard, first_slot, slots): how many blocks of each source go into each
    output shard of a mix, and which of its slots these are.

    Stratum c of C holds the slots from floor(n c / C) to floor(n (c + 1) / C) of each source's n, so
    its rows need nothing of other strata. A stratum draws with a generator of its own.
    """
    per_stratum = max(1, stratum_slots // slots_per_shard)
    mixes = planned.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "slots"))).alias("sources"), F.sum("slots").alias("total"))
    strata = mixes.where(F.col("total") > 0).withColumn("strata", F.ceil(F.col("total") / (per_stratum * slots_per_shard)).cast("long"))
    # A mix has few rows here whatever its size, so they are spread before they are drawn.
    strata = strata.withColumn("stratum", F.explode(F.sequence(F.lit(0), F.col("strata") - 1))).repartition("mix_id", "stratum")

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                all_ = [int(s["slots"]) for s in row.sources]
                low = np.array([n * row.stratum // row.strata for n in all_])
                counts = np.array([n * (row.stratum + 1) // row.strata for n in all_]) - low
                shards = max(1, -(-int(counts.sum()) // slots_per_shard))
                taken = draw(counts, shards, np.random.default_rng([seed, key_of(row.mix_id), row.stratum]))
                first = low + np.cumsum(taken, axis=0) - taken
                # One more shard name than a stratum needs, as its part may be rounded up.
                name = row.stratum * (per_stratum + len(all_)) + np.arange(shards)
                for i, s in enumerate(row.sources):
                    yield pd.DataFrame({"mix_id": row.mix_id, "source": s["source"], "blocks": s["blocks"], "shard": name, "first_slot": first[:, i], "slots": taken[:, i]})

    return strata.mapInPandas(draws, "mix_id string, source string, blocks long, shard long, first_slot long, slots long").where(F.col("slots") > 0)


def drawn_blocks(planned: DataFrame, seed: int = 17, slots_per_shard: int = SLOTS_PER_SHARD, stratum_slots: int = STRATUM_SLOTS) -> DataFrame:
    """(mix_id, shard, source, pass, block_no): the blocks of every output shard of every mix. Pass p
    takes each block of a source at most once, in an order of its own with the last, partly filled block
    at the end, so no block is used more than max_repeats times and uses of one source's blocks differ
    by at most one. `planned` is small and computed; the shards are spread over tasks before they are filled."""
    slots = planned.agg(F.sum("slots")).first()[0] or 0
    counts = shard_counts(planned, seed, slots_per_shard, stratum_slots).repartition(slots // SLOTS_PER_TASK + 1, "mix_id", "source", "shard")

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                slot = np.arange(row.first_slot, row.first_slot + row.slots)
                pass_, at = slot // row.blocks, slot % row.blocks
                keys = {p: key_of(seed, row.mix_id, row.source, p) for p in np.unique(pass_).tolist()}
                key = np.array([keys[p] for p in pass_.tolist()], np.uint64)
                block = np.where(at < row.blocks - 1, permuted(np.minimum(at, max(row.blocks - 2, 0)), max(row.blocks - 1, 1), key), at)
                yield pd.DataFrame({"mix_id": row.mix_id, "shard": row.shard, "source": row.source, "pass": pass_, "block_no": block})

    return counts.mapInPandas(filled, "mix_id string, shard long, source string, pass long, block_no long")


class Mix:
    """The tables of one mixing run: `planned`, `spans`, `drawn`, and what follows from them. Block
    tables grow with the texts but compress so well that they look small; hence the merge hints."""

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, slots_per_shard: int = SLOTS_PER_SHARD, stratum_slots: int = STRATUM_SLOTS, **columns: str):
        wanted = targets.select("source").distinct()
        sized = cut(sized_documents(docs, **columns).join(wanted, "source", "left_semi"))
        self.planned = cut(plan(sized, targets, block_tokens))
        self.spans = block_spans(sized, block_tokens)
        self.drawn = drawn_blocks(self.planned, seed, slots_per_shard, stratum_slots)

    def uses(self) -> DataFrame:
        """(mix_id, source, block_no, uses) of the blocks that were drawn."""
        return self.drawn.groupBy("mix_id", "source", "block_no").agg(F.count(F.lit(1)).alias("uses"))

    def content(self) -> DataFrame:
        """(mix_id, shard, source, pass, block_no, doc_id, span_from, span_tokens): the mixes themselves."""
        return self.drawn.join(self.spans.hint("merge"), ["source", "block_no"])

    def documents(self) -> DataFrame:
        """(mix_id, source, doc_id, repeats, whole_repeats, tokens): how often a text is in a mix, at most
        and at least over its parts (a text that runs over several blocks can be there in part)."""
        whole = self.spans.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("_pieces"))
        used = self.uses().join(self.spans.hint("merge"), ["source", "block_no"])
        told = used.groupBy("mix_id", "source", "doc_id").agg(
            F.max("uses").alias("repeats"), F.min("uses").alias("_least"), F.count(F.lit(1)).alias("_seen"), F.sum(F.col("uses") * F.col("span_tokens")).alias("tokens")
        )
        least = F.when(F.col("_seen") == F.col("_pieces"), F.col("_least")).otherwise(F.lit(0))
        return told.join(whole, ["source", "doc_id"]).select("mix_id", "source", "doc_id", "repeats", least.alias("whole_repeats"), "tokens")

    def report(self) -> DataFrame:
        """The plan with what was drawn: drawn_tokens, actual_share (of all that was drawn for the mix; 0 where
        nothing was), planned_share (of the mix's total size: a short source ends below its target and
        leaves the difference open, so actual shares of the others lie above theirs) and short: every
        block was used max_repeats times and the target isn't reached."""
        block = self.spans.groupBy("source", "block_no").agg(F.sum("span_tokens").alias("tokens"))
        used = self.uses().join(block.hint("merge"), ["source", "block_no"])
        drawn = used.groupBy("mix_id", "source").agg(
            F.sum(F.col("uses") * F.col("tokens")).alias("drawn_tokens"), F.count(F.lit(1)).alias("_seen"), F.min("uses").alias("_least")
        )
        row = self.planned.join(drawn, ["mix_id", "source"], "left").na.fill(0, ["drawn_tokens", "_seen", "_least"])
        used_up = (F.col("_seen") == F.col("blocks")) & ((F.col("_least") == F.col("max_repeats")) | (F.col("blocks") == 0))
        used_up = used_up | (F.col("max_repeats") == 0)
        mix = Window.partitionBy("mix_id")
        share = lambda total: F.coalesce(F.try_divide(F.col("drawn_tokens"), total), F.lit(0.0))
        row = row.withColumn("actual_share", share(F.sum("drawn_tokens").over(mix))).withColumn("planned_share", share(F.sum("own_tokens").over(mix)))
        return row.withColumn("short", used_up & (F.col("target_tokens") > F.col("drawn_tokens"))).drop("_seen", "_least")
