"""Registered queries of the operators for text and sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopa.llm import confusables, mixing, packing, quality, runs
from prosopa.operators import nested
from prosopa.session import cut, slice_join, table


def _disguised_rows(rows: DataFrame, col: str, key: Column, references: DataFrame, ref_col: str, rows_per_slice: int = 65536) -> DataFrame:
    """(field, row_key) of the rows whose value looks like a reference but isn't one. Values are counted once, which
    gives the distinct ones and says which fill so many rows that they are sliced."""
    held = cut(rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_rows")))
    found = cut(confusables.disguised(held, col, references, ref_col).withColumnRenamed("value", col))
    hot = held.where(F.col("_rows") > rows_per_slice).join(found, col, "left_semi").select(col, F.ceil(F.col("_rows") / rows_per_slice).cast("int").alias("_slices"))
    keyed = rows.select(key.alias("row_key"), col)
    return slice_join(keyed, found, [col], ["row_key"], hot=hot).select(F.lit(col).alias("field"), "row_key")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    posted = table(spark, folder, "posted_to_office_data")
    title = _disguised_rows(posted, "c_office_chn", F.col("c_posting_id").cast("string"), table(spark, folder, "office_codes"), "c_office_chn")

    nodes = nested.node_table(nested.shapes(table(spark, folder, "science_network_data_20260516")))
    person = table(spark, folder, "biog_main")
    names = person.select(F.col("c_personid").alias("node_id"), F.explode(F.array("c_name_chn", "c_name")).alias("name"))
    name = confusables.disguised_by_key(nodes, ["record_id", "node_no"], "name_zh", names, "node_id", "name").select(
        F.lit("nameZh").alias("field"), F.concat_ws(":", "record_id", "node_no").alias("row_key")
    )

    top = table(spark, folder, "spatial_cluster_top_locations")
    place = _disguised_rows(top, "addr_name_chn", F.concat_ws(":", "cluster", "rank"), table(spark, folder, "addr_codes"), "c_name_chn")
    return title.unionByName(name).unionByName(place).distinct()


def p4_title_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct titles in use with the class of titles that look the same."""
    return confusables.skeleton_classes(table(spark, folder, "posted_to_office_data"), "c_office_chn")


def _career_entries(spark: SparkSession, folder: str) -> DataFrame:
    careers = table(spark, folder, "career_trajectory_analysis")
    return runs.entries(careers, "id", "collapsed_career_sequence", "state_firstyears", "state_lastyears")


def _matrix_entries(spark: SparkSession, folder: str) -> DataFrame:
    matrix = table(spark, folder, "career_trajectory_transition_matrix")
    none = F.lit(None).cast("int")
    return matrix.select(F.col("transition_id").alias("key"), F.posexplode(F.array("from_state", "to_state")).alias("at", "label")).select(
        "key", (F.col("at") + 1).alias("pos"), "label", none.alias("first_year"), none.alias("last_year")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    states = table(spark, folder, "career_states")
    found = None
    for name, rows in (
        ("career_trajectory_analysis", _career_entries(spark, folder)),
        ("career_trajectory_transition_matrix", _matrix_entries(spark, folder)),
    ):
        run = runs.repeats(runs.collapse_runs(runs.with_states(rows, states)))
        part = run.select(F.lit(name).alias("table_name"), F.col("key").alias("row_key"), F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))
        found = part if found is None else found.unionByName(part)
    return found


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every career as its runs: state, count of entries, first and last known year, duration."""
    states = table(spark, folder, "career_states")
    run = runs.collapse_runs(runs.with_states(_career_entries(spark, folder), states))
    return run.join(states, "state_no", "left").select(
        F.col("key").alias("id"), "start_pos", "end_pos", "state", "entries", "first_year", "last_year",
        (F.col("last_year") - F.col("first_year")).alias("duration"),
    )


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    # pack_limits is a table of settings with one row for each container size.
    limits = [r[0] for r in table(spark, folder, "pack_limits").select("capacity_tokens").distinct().collect()]
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), limits)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that sit in two or more containers."""
    held = _packed(spark, folder).groupBy("capacity_tokens", "doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return held.where(F.col("first") != F.col("last")).select("capacity_tokens", "doc_id")


def p6_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every text with its container."""
    return _packed(spark, folder)


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What every packing must hold: texts, parts and tokens, no container over its capacity, and no text in
    parts that would fit whole."""
    packed = cut(_packed(spark, folder))
    held = packed.groupBy("capacity_tokens", "container").agg(F.sum("tokens").alias("held")).groupBy("capacity_tokens").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    text = packed.groupBy("capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size"))
    told = text.groupBy("capacity_tokens").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("parts"), F.sum("size").alias("tokens"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("split_small"))
    return told.join(held, "capacity_tokens")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and the share of them that is filled."""
    return packing.fill(_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).report().where("short").select("mix_id", "source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    told = _mixed(spark, folder).report().drop("blocks", "slots")
    return told.withColumns({c: F.round(c, 9) for c in ("target_tokens", "actual_share", "planned_share")})


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each mix's documents with their repeat counts."""
    return _mixed(spark, folder).documents()


def p8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of every text, with profiles fitted on labelled pages."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    profiles = quality.fit_profiles(*quality.labelled_sample(docs, table(spark, folder, "page_labels")))
    return quality.quality(docs, profiles=profiles)


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The basic counts of every text."""
    return p8_quality(spark, folder).select("doc_id", "lines", "words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("ends_in_stop", 6).alias("ends_in_stop"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_quality(spark, folder).where(F.col("kind") != "prose").select("doc_id").distinct()


def p8_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by the kind given by hand and the kind found."""
    found = p8_quality(spark, folder).select("doc_id", "kind")
    return table(spark, folder, "page_labels").join(found, "doc_id").groupBy("page_kind", "kind").agg(F.count(F.lit(1)).alias("pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_title_classes": p4_title_classes,
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "p6_found": p6_found,
    "p6_assigned": p6_assigned,
    "p6_fill": p6_fill,
    "p6_totals": p6_totals,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_documents": p7_documents,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
    "p8_counts": p8_counts,
    "p8_agreement": p8_agreement,
}

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_ASCII = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_LOOK, _AS = "аеосріхсуТ", "aeocpixcyT"


def _key(text: str) -> str:
    """SQL for a label's letters and digits, with wide and Cyrillic letters as plain ones."""
    return f"regexp_replace(lower(translate(translate({text}, '{_WIDE}', '{_ASCII}'), '{_LOOK}', '{_AS}')), '[^a-z0-9]', '', 'g')"


_RUNS = f"""state AS (SELECT state_no, {_key('state')} AS k FROM career_states),
career AS (SELECT DISTINCT id, replace(collapsed_career_sequence, '＞', '>') AS seq, state_firstyears AS f, state_lastyears AS l FROM career_trajectory_analysis),
label AS (SELECT 'career_trajectory_analysis' AS t, id AS row_key, unnest(string_split(seq, '>')) AS label, generate_subscripts(string_split(seq, '>'), 1) AS pos, f, l FROM career
    UNION ALL SELECT 'career_trajectory_transition_matrix', transition_id, unnest([from_state, to_state]), unnest([1, 2]), NULL, NULL FROM career_trajectory_transition_matrix),
known AS (SELECT label, min_by(state_no, (damerau_levenshtein({_key('label')}, k), state_no)) AS state_no
    FROM (SELECT DISTINCT label FROM label) JOIN state ON damerau_levenshtein({_key('label')}, k) <= 1 GROUP BY label),
entry AS (SELECT t, row_key, pos, state_no, CASE WHEN f[pos] > 0 THEN f[pos] END AS fy, CASE WHEN l[pos] > 0 THEN l[pos] END AS ly FROM label LEFT JOIN known USING (label)),
flagged AS (SELECT *, CASE WHEN lag(state_no) OVER w = state_no THEN 0 ELSE 1 END AS c FROM entry WINDOW w AS (PARTITION BY t, row_key ORDER BY pos)),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY t, row_key ORDER BY pos) AS run FROM flagged),
runs AS (SELECT t, row_key, min(pos) AS start_pos, max(pos) AS end_pos, min(state_no) AS state_no, count(*) AS entries, min(least(fy, ly)) AS first_year, max(greatest(fy, ly)) AS last_year
    FROM numbered GROUP BY t, row_key, run)"""

_NODE_NAMES = """doc AS (SELECT DISTINCT record_id, payload FROM science_network_data_20260516 WHERE json_valid(payload)),
listed AS (SELECT record_id, coalesce(json_extract(payload, '$.nodes'), json_extract(payload, '$.data.nodes')) AS v FROM doc),
node AS (SELECT record_id, unnest(items) AS node, generate_subscripts(items, 1) AS node_no FROM (
    SELECT record_id, list_filter(from_json(v, '["json"]'), lambda x: json_type(x) = 'OBJECT') AS items FROM listed WHERE json_type(v) = 'ARRAY')),
named AS (SELECT record_id, node_no, TRY_CAST(node ->> 'id' AS BIGINT) AS node_id, node ->> 'nameZh' AS v FROM node WHERE json_type(node -> '$.nameZh') = 'VARCHAR')"""
_ALL_NAMES = """SELECT c_office_chn AS v FROM posted_to_office_data UNION SELECT c_office_chn FROM office_codes UNION SELECT v FROM named
    UNION SELECT c_name_chn FROM biog_main UNION SELECT c_name FROM biog_main UNION SELECT addr_name_chn FROM spatial_cluster_top_locations UNION SELECT c_name_chn FROM addr_codes"""


def _skeletons_sql(values: str) -> str:
    """SQL for the skeletons of a query of distinct values v, as skeleton(v, k)."""
    return f"""value AS ({values}), sign AS (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM value WHERE v IS NOT NULL),
skeleton AS (SELECT v, coalesce(string_agg(coalesce(s, substring(v, i, 1)), '' ORDER BY i), '') AS k FROM sign LEFT JOIN look ON c = substring(v, i, 1) GROUP BY v)"""


@cache
def oracles() -> dict[str, str]:
    """`ORACLES` and the SQL over the look-alike table, which is written out when it is asked for."""
    look = confusables.skeleton_sql()
    return {
        **ORACLES,
        "p4_title_classes": f"""WITH {look}, {_skeletons_sql('SELECT DISTINCT c_office_chn AS v FROM posted_to_office_data')},
            held AS (SELECT c_office_chn AS v, count(*) AS rows FROM posted_to_office_data WHERE c_office_chn IS NOT NULL GROUP BY 1),
            one AS (SELECT v, rows, coalesce(k, '') AS k FROM held LEFT JOIN skeleton USING (v))
            SELECT v AS value, min(v) OVER (PARTITION BY k) AS class_value, count(*) OVER (PARTITION BY k) AS members, rows FROM one""",
        "p4_found": f"""WITH {look}, {_NODE_NAMES}, {_skeletons_sql(_ALL_NAMES)},
            person AS (SELECT c_personid, unnest([c_name_chn, c_name]) AS name FROM biog_main)
            SELECT DISTINCT 'c_office_chn' AS field, CAST(c_posting_id AS VARCHAR) AS row_key FROM posted_to_office_data JOIN skeleton ON v = c_office_chn
                WHERE k <> '' AND k IN (SELECT k FROM office_codes r JOIN skeleton ON v = r.c_office_chn) AND v NOT IN (SELECT c_office_chn FROM office_codes)
            UNION SELECT 'addr_name_chn', cluster || ':' || rank FROM spatial_cluster_top_locations JOIN skeleton ON v = addr_name_chn
                WHERE k <> '' AND k IN (SELECT k FROM addr_codes r JOIN skeleton ON v = r.c_name_chn) AND v NOT IN (SELECT c_name_chn FROM addr_codes)
            UNION SELECT 'nameZh', record_id || ':' || node_no FROM named n JOIN skeleton a ON a.v = n.v WHERE a.k <> ''
                AND EXISTS (SELECT 1 FROM person JOIN skeleton b ON b.v = name WHERE c_personid = node_id AND b.k = a.k) AND NOT EXISTS (SELECT 1 FROM person WHERE c_personid = node_id AND name = n.v)""",
    }


ORACLES: dict[str, str] = {
    "p5_found": f"""WITH {_RUNS} SELECT t AS table_name, row_key, CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos
        FROM runs WHERE state_no IS NOT NULL AND entries >= 2""",
    "p5_runs": f"""WITH {_RUNS} SELECT row_key AS id, CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos, state, entries, first_year, last_year, last_year - first_year AS duration
        FROM runs LEFT JOIN career_states USING (state_no) WHERE t = 'career_trajectory_analysis'""",
    "p6_totals": """WITH d AS (SELECT DISTINCT doc_id, strlen(text) + 1 AS size FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), c AS (SELECT DISTINCT capacity_tokens FROM pack_limits)
        SELECT capacity_tokens, count(DISTINCT doc_id) AS texts, CAST(sum(ceil(size / capacity_tokens::DOUBLE)) AS BIGINT) AS parts, CAST(sum(size) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS split_small, CAST(0 AS BIGINT) AS overfull FROM d, c GROUP BY 1""",
    "p6_found": "SELECT DISTINCT capacity_tokens, doc_id FROM documents, pack_limits WHERE strlen(text) + 1 > capacity_tokens",
    "p8_counts": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), lambda x: trim(x) <> '') AS lines, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM t)
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS lines, CAST(len(words) AS BIGINT) AS words,
            coalesce(round(list_sum(list_transform(words, lambda x: length(x)))::DOUBLE / nullif(len(words), 0), 6), 0) AS mean_word_length,
            coalesce(round(len(list_filter(lines, lambda x: right(x, 1) IN ('.', '!', '?', ':', ';', '”', '"', '’', chr(39))))::DOUBLE / nullif(len(lines), 0), 6), 0) AS ends_in_stop FROM l""",
    "p7_report": f"""WITH own AS (SELECT source, sum(strlen(text) + 1) AS own FROM (SELECT DISTINCT doc_id, source, text FROM documents) WHERE text IS NOT NULL GROUP BY source),
        t AS (SELECT m.*, coalesce(own, 0) AS own, target_share * sum(coalesce(own, 0)) OVER (PARTITION BY mix_id) AS target FROM mix_targets m LEFT JOIN own USING (source)),
        r AS (SELECT *, least(target, max_repeats * own::DOUBLE) AS reach, CASE WHEN own = 0 THEN 0 ELSE floor(least(target, max_repeats * own::DOUBLE) / own)::BIGINT END AS passes FROM t),
        d AS (SELECT *, passes * own + least(round((reach - passes * own) / {mixing.BLOCK_TOKENS})::BIGINT * {mixing.BLOCK_TOKENS}, own) AS drawn FROM r)
        SELECT mix_id, source, target_share, max_repeats, CAST(own AS BIGINT) AS own_tokens, round(target, 9) AS target_tokens, CAST(max_repeats * own AS BIGINT) AS most_tokens, CAST(drawn AS BIGINT) AS drawn_tokens,
            round(drawn::DOUBLE / sum(drawn) OVER (PARTITION BY mix_id), 9) AS actual_share, round(drawn::DOUBLE / sum(own) OVER (PARTITION BY mix_id), 9) AS planned_share,
            target > drawn AND drawn = max_repeats * own AS short FROM d""",
    "p7_found": """WITH own AS (SELECT source, sum(strlen(text) + 1) AS own FROM documents WHERE text IS NOT NULL GROUP BY source),
        t AS (SELECT m.*, coalesce(own, 0) AS own, sum(coalesce(own, 0)) OVER (PARTITION BY mix_id) AS total FROM mix_targets m LEFT JOIN own USING (source))
        SELECT mix_id, source FROM t WHERE target_share * total > max_repeats * own""",
}
