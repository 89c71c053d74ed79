"""Ordered event sequences: positions, collapse, features, transitions, distances, medoids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopa.functions.classify import career_state, category, domain
from prosopa.functions.distances import weighted_distances
from prosopa.functions.exprs import percent
from prosopa.operators.attributes import exact_medians, most_frequent
from prosopa.session import cut, release, slice_join

NO_POSTING = "no_observed_posting"


def posting_table(postings: DataFrame, offices: DataFrame) -> DataFrame:
    """Postings with office_domain, office_category, career_state and what is known of them. Rows that
    repeat exactly count once; a posting of an unknown office keeps its own title."""
    office = offices.select("c_office_id", F.col("c_office_chn").alias("_chn"), F.col("c_office_pinyin").alias("_pinyin"), F.col("c_office_trans").alias("_trans"))
    row = postings.distinct().join(office, "c_office_id", "left")
    kind = domain(F.coalesce("_chn", "c_office_chn"), "_pinyin", "_trans")
    group = category("c_office_category_id")
    return row.select(
        "c_personid", "c_office_id", "c_posting_id", "c_sequence", "c_firstyear", "c_lastyear",
        kind.alias("office_domain"), group.alias("office_category"), career_state(kind, group).alias("career_state"),
        F.when(F.col("c_firstyear") > 0, F.col("c_firstyear")).alias("first_year"), F.when(F.col("c_lastyear") > 0, F.col("c_lastyear")).alias("last_year"),
    ).where(F.col("c_personid").isNotNull())


def positions(rows: DataFrame, key: str, order: Sequence[Column | str], out: str = "sequence_position") -> DataFrame:
    """The place of each row in its group, from 1, by an order that settles all ties."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def career_order() -> list[Column]:
    """Sequence (null last), year (unknown last), posting, office."""
    return [F.asc_nulls_last("c_sequence"), F.asc_nulls_last("first_year"), F.asc("c_posting_id"), F.asc("c_office_id")]


def state_lists(rows: DataFrame, key: str, position: str, state: str) -> DataFrame:
    """(key, states): the states of each group in order. A group is one person's or user's events."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(state).alias("s")))).alias("_rows"))
    return listed.select(key, F.transform("_rows", lambda r: r["s"]).alias("states"))


def collapsed(states: Column | str) -> Column:
    """A list without entries equal to the one before. Null entries are kept as they come."""
    states = F.col(states) if isinstance(states, str) else states
    return F.filter(states, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(states, i - 1)))


def career_features(rows: DataFrame, key: str = "c_personid") -> DataFrame:
    """One row for each person: counts, share with a year, first and last year, span, sequences."""
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("posting_count"),
        F.count_if(F.col("office_domain") != "other").alias("technical_postings"),
        F.count_distinct("career_state").alias("distinct_states"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        F.max(F.when(F.col("office_domain") == "medical", 1).otherwise(0)).alias("ever_medical"),
    )
    listed = state_lists(rows, key, "sequence_position", "career_state").withColumn("_c", collapsed("states"))
    return counted.join(listed, key).select(
        key, "posting_count", "technical_postings", "distinct_states", "first_year", "last_year",
        (F.col("last_year") - F.col("first_year")).alias("span_years"), "ever_medical", percent("technical_postings", "posting_count").alias("technical_pct"),
        F.get("_c", F.lit(0)).alias("first_state"), F.element_at("_c", -1).alias("last_state"),
        F.size("_c").cast("long").alias("collapsed_length"), F.array_join("_c", " > ").alias("collapsed_sequence"),
    )


def transitions(rows: DataFrame, key: str, order: Sequence[Column | str], state: str, cluster: str) -> DataFrame:
    """(cluster, from_state, to_state, transition_count, share_pct): changes between consecutive states
    of each group, whose share is of all changes of the cluster. Repeats are no changes. Rows with a
    null state are left out first."""
    seen = rows.where(F.col(state).isNotNull())
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    moved = seen.select(F.col(cluster).alias("cluster"), before.alias("from_state"), F.col(state).alias("to_state")).where(F.col("from_state") != F.col("to_state"))
    counted = moved.groupBy("cluster", "from_state", "to_state").agg(F.count(F.lit(1)).alias("transition_count"))
    total = F.sum("transition_count").over(Window.partitionBy("cluster"))
    return counted.withColumn("share_pct", percent(F.col("transition_count"), total))


def unique_sequences(lists: DataFrame, states: str = "states") -> DataFrame:
    """(sequence_no, sequence, weight): distinct collapsed sequences and how many groups have them.
    Numbers follow the text order, so they don't depend on partitions; an empty list becomes the
    single state no_observed_posting. Distinct sequences are few compared with groups."""
    seq = F.when(F.size(states) == 0, F.array(F.lit(NO_POSTING))).otherwise(collapsed(states))
    counted = lists.where(F.col(states).isNotNull()).groupBy(seq.alias("sequence")).agg(F.count(F.lit(1)).alias("weight"))
    return counted.withColumn("text", F.array_join("sequence", " > ")).withColumn("sequence_no", F.xxhash64("text")).select("sequence_no", "text", "sequence", "weight")


def encoded(unique: DataFrame) -> DataFrame:
    """`unique` (sequence_no, sequence, ...) with `code`: the token list as text with one character for each token, so
    that edit distances of tokens are native edit distances of texts. Tokens are numbered in their order and
    meet their number in a join. More than 60,000 tokens raise an error in the job, as characters would run out."""
    token = unique.select("sequence_no", F.posexplode("sequence").alias("at", "token"))
    # The distinct tokens are a vocabulary of states: a small table beside the sequences.
    number = token.select("token").distinct().withColumn("no", F.row_number().over(Window.orderBy("token")) + 39)
    point = F.when(F.col("no") < 0xD800, F.col("no")).when(F.col("no") < 0xF000, F.col("no") + 0x800).otherwise(F.raise_error(F.lit("more states than characters")).cast("int"))
    sign = F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")
    coded = token.join(number.withColumn("sign", sign), "token").groupBy("sequence_no").agg(F.array_sort(F.collect_list(F.struct("at", "sign"))).alias("_signs"))
    return unique.join(coded, "sequence_no").withColumn("code", F.array_join(F.transform("_signs", lambda x: x["sign"]), "")).drop("_signs")


#: The greatest distance that `near_sequences` takes: a code of n signs has about n ^ distance rests.
MOST_STEPS = 3


def near_sequences(items: DataFrame, steps: int = 1) -> DataFrame:
    """(a_no < b_no, distance) for coded sequences (sequence_no, code) at most `steps` tokens added, lost or
    changed apart, from 0 to MOST_STEPS. Such sequences share a rest with at most that many tokens left out, so this is
    an equi-join; sequences further apart are not compared."""
    if not 0 <= steps <= MOST_STEPS:
        raise ValueError(f"steps from 0 to {MOST_STEPS}")

    def without_one(code: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda i: F.concat(F.substring(code, F.lit(1), i - 1), F.substring(code, i + 1, F.length(code))))

    part = items.select("sequence_no", "code", F.col("code").alias("rest"))
    for _ in range(steps):
        part = part.select("sequence_no", "code", F.explode(F.array_union(F.array("rest"), without_one(F.col("rest")))).alias("rest")).distinct()
    a = part.select(F.col("sequence_no").alias("a_no"), F.col("code").alias("a"), "rest")
    b = part.select(F.col("sequence_no").alias("b_no"), F.col("code").alias("b"), "rest")
    pair = slice_join(b, a, ["rest"], ["b_no"], 2048).where(F.col("a_no") < F.col("b_no"))
    return pair.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= steps).select("a_no", "b_no", "distance").distinct()


def to_medoids(items: DataFrame, medoids: Sequence[tuple[int, str]]) -> DataFrame:
    """(sequence_no, code, weight, medoid, distance): each item with its nearest medoid. `medoids` are
    the k current centres (number, code), so this compares all rows with k values, not with each other."""
    centre = F.array(*(F.struct(F.lit(no).cast("long").alias("no"), F.lit(code).alias("code")) for no, code in medoids))
    # One constant list instead of constants in the code, so that no round compiles its own.
    near = F.transform(centre, lambda m: F.struct(F.levenshtein("code", m["code"]).alias("distance"), m["no"].alias("m_no")))
    best = items.withColumn("b", F.array_min(near))
    return best.select("sequence_no", "code", "weight", F.col("b.m_no").alias("medoid"), F.col("b.distance").alias("distance"))


def _tokens(items: DataFrame) -> DataFrame:
    """(sequence_no, token): one row for each place of a code; the k-th of one character is another token than the first."""
    upto = lambda i: F.substring("code", F.lit(1), i + 1)
    nth = lambda c, i: F.concat(c, (F.length(upto(i)) - F.length(F.replace(upto(i), c, F.lit("")))).cast("string"))
    return items.where(F.length("code") > 0).select("sequence_no", F.explode(F.transform(F.split("code", ""), nth)).alias("token"))


def _bounded(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """`placed` with a lower bound of each item's cost as medoid of its cluster: d(x, c) is at least the longer
    length less the characters that both have, in any order. Over a cluster that sum needs only the
    weights by length and by token (see `_tokens`), so no two items are compared."""
    row = placed.withColumn("_l", F.length("code"))
    held = row.groupBy("medoid", "_l").agg(F.sum("weight").alias("w"))
    longer = held.select("medoid", F.col("_l").alias("l2"), "w").join(held.drop("w"), "medoid").groupBy("medoid", "_l").agg(F.sum(F.greatest("_l", "l2") * F.col("w")).alias("_longer"))
    own = tokens.join(placed.select("sequence_no", "medoid", "weight"), "sequence_no")
    common = own.groupBy("medoid", "token").agg(F.sum("weight").alias("w"))
    shared = own.join(common, ["medoid", "token"]).groupBy("sequence_no").agg(F.sum("w").alias("_shared"))
    return row.join(longer, ["medoid", "_l"]).join(shared, "sequence_no", "left").withColumn("bound", F.col("_longer") - F.coalesce("_shared", F.lit(0))).drop("_l", "_longer", "_shared")


#: Members that are compared at once with candidates, the least and most of these, and the growth of the blocks of candidates.
MEMBERS, CANDIDATES, GROWTH = 32_768, (256, 4096), 16
#: Pairs of such slices that a block of candidates is cut into, as far as its slices allow.
CELLS = 64


def _costs(packed: DataFrame, offer: DataFrame, width: int, cells: int) -> DataFrame:
    """(medoid, c_no, c_code, cost) of the candidates of `offer`, in slices of `width`, whose members are `packed` by slices."""
    alike = F.row_number().over(Window.partitionBy("medoid").orderBy("code"))  # so that a slice's codes begin alike
    few = offer.withColumn("_r", alike).groupBy("medoid", F.floor((F.col("_r") - 1) / width).alias("_c")).agg(F.collect_list(F.struct("sequence_no", "code")).alias("_few"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for medoid, codes, weights, no, code in batch.itertuples(index=False):
                yield pd.DataFrame({"medoid": medoid, "c_no": no, "c_code": code, "cost": weighted_distances(list(codes), list(weights), list(code))})

    # At most medoids x a block of candidates are offered, so they may be broadcast.
    cell = packed.join(F.broadcast(few.select("medoid", F.col("_few.sequence_no").alias("c_no"), F.col("_few.code").alias("c_code"))), "medoid").repartition(cells)
    part = cell.select("medoid", "codes", "weights", "c_no", "c_code").mapInPandas(told, "medoid long, c_no long, c_code string, cost long")
    return part.groupBy("medoid", "c_no", "c_code").agg(F.sum("cost").alias("cost"))


def best_members(placed: DataFrame, tokens: DataFrame, block: int = 64, most: int = 65_536) -> list[tuple[int, str]]:
    """(number, code) of the member of each cluster of `placed` with the least weighted distance to all
    its members, the smaller number on ties. `tokens` are the `_tokens` of all items.

    Members are tried in blocks by rising bound of their cost (`block`, then GROWTH times as many, up to
    `most`) until no bound beats the best cost, so the result is that of trying every member.
    """
    rank = F.row_number().over(Window.partitionBy("medoid").orderBy("bound", "sequence_no"))
    ranked = cut(_bounded(placed, tokens).withColumn("r", rank))
    packed = cut(ranked.groupBy("medoid", F.floor((F.col("r") - 1) / MEMBERS).alias("_m")).agg(F.collect_list(F.struct("code", "weight")).alias("_all")).select("medoid", F.col("_all.code").alias("codes"), F.col("_all.weight").alias("weights")))
    best, beats, done, width, cells = {}, F.lit(True), 0, CANDIDATES[0], CELLS // 4
    while cells:
        offer = ranked.where(F.col("r").between(done + 1, done + block) & beats)
        for r in _costs(packed, offer, width, min(cells, 512)).groupBy("medoid").agg(F.min(F.struct("cost", "c_no", "c_code")).alias("b")).select("medoid", "b.*").collect():
            best[r["medoid"]] = min(best.get(r["medoid"], tuple(r)[1:]), tuple(r)[1:])
        done, block = done + block, min(GROWTH * block, most)
        limit = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(("m", "cost", "no"), (m, *b)))) for m, b in best.items()))
        beats = F.exists(limit, lambda x: (F.col("medoid") == x["m"]) & (F.struct(F.col("bound").cast("long"), F.col("sequence_no").cast("long")) < F.struct(x["cost"], x["no"])))
        told = ranked.groupBy("medoid").agg(F.ceil(F.max("r") / MEMBERS).alias("slices"), F.least(F.count_if((F.col("r") > done) & beats), F.lit(block)).alias("n")).where("n > 0").collect()
        width = min(max(sum(r["slices"] * r["n"] for r in told) // CELLS, CANDIDATES[0]), CANDIDATES[1])
        cells = sum(r["slices"] * -(-r["n"] // width) for r in told)
    release(ranked, packed)
    return sorted((n, code) for _, n, code in best.values())


def k_medoids(items: DataFrame, k: int, iterations: int = 100, candidates: int = 64) -> DataFrame:
    """Weighted medoids of coded sequences (sequence_no, code, weight), as from `to_medoids`.

    Starts with the heaviest item and adds, k - 1 times, the one with the greatest distance times
    the root of its weight. Then items go to their nearest medoid, and each cluster takes the member
    with the least weighted distance of all its members, until nothing changes. `candidates` is the size of the
    first block of members that are tried (see `best_members`). Ties go to the smaller distance, then number. No
    more medoids than items; only the k centres come to the driver.
    """
    items = cut(items.select("sequence_no", "code", "weight"))
    first = items.orderBy(F.desc("weight"), "sequence_no").select("sequence_no", "code").first()
    if first is None:
        return items.select("sequence_no", "code", "weight", F.lit(None).cast("long").alias("medoid"), F.lit(None).cast("int").alias("distance"))
    centres = [tuple(first)]
    while len(centres) < k:
        far = to_medoids(items, centres).where("distance > 0")
        nxt = far.orderBy(F.desc(F.col("distance") * F.sqrt("weight")), "sequence_no").select("sequence_no", "code").first()
        if nxt is None:
            break
        centres.append(tuple(nxt))
    tokens = cut(_tokens(items))
    for _ in range(iterations):
        placed = cut(to_medoids(items, centres))
        moved = best_members(placed, tokens, candidates)
        release(placed)
        if moved == sorted(centres):
            break
        centres = moved
    release(tokens)
    return to_medoids(items, centres)


def career_types(placed: DataFrame) -> DataFrame:
    """(sequence_no, career_type, distance): clusters named career_type_1, 2 ... by falling weight, the
    smaller medoid first on ties."""
    size = placed.groupBy("medoid").agg(F.sum("weight").alias("_w"))
    named = size.withColumn("career_type", F.concat(F.lit("career_type_"), F.row_number().over(Window.orderBy(F.desc("_w"), "medoid")).cast("string")))
    return placed.join(named, "medoid").select("sequence_no", "career_type", "distance", "weight", "medoid")


def type_summary(rows: DataFrame, type_: str, cluster: str, clusters: Sequence[str], value: str) -> DataFrame:
    """One row for each type: rows, mean of a value, and rows of each cluster (fixed columns)."""
    return rows.groupBy(type_).agg(
        F.count(F.lit(1)).alias("node_count"), F.avg(value).alias(f"mean_{value}"), *(F.count_if(F.col(cluster) == c).alias(f"{c}_count") for c in clusters)
    )


def cluster_summary(features: DataFrame, cluster: str) -> DataFrame:
    """One row for each cluster of `career_features`: persons, mean and median postings, mean share of
    technical postings, persons ever in medicine with their share, mean and median of the known spans (null
    where none is known), and the most frequent first and last state (the smaller on ties)."""
    told = features.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("persons"),
        F.avg("posting_count").alias("mean_postings"),
        F.avg("technical_pct").alias("mean_technical_pct"),
        F.sum("ever_medical").alias("ever_medical"),
        F.count("span_years").alias("spans"),
        F.avg("span_years").alias("mean_span"),
    )
    told = told.withColumn("ever_medical_pct", percent("ever_medical", "persons")).join(exact_medians(features, [cluster], {"median_postings": "posting_count", "median_span": "span_years"}), cluster)
    for state in ("first_state", "last_state"):
        told = told.join(most_frequent(features, [cluster], state, out=f"common_{state}"), cluster, "left")
    return told


def medoid_report(placed: DataFrame) -> DataFrame:
    """(career_type, medoid, sequences, weight, mean_distance): one row for each type of `career_types`;
    the mean distance to the medoid counts each sequence by its weight."""
    return placed.groupBy("career_type", "medoid").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("weight").alias("weight"),
        (F.sum(F.col("distance") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1))).alias("mean_distance"),
    )
