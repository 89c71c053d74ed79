"""Registered report queries: summaries, samples and views of the analytic results, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopa.functions import classify, exprs
from prosopa.operators import attributes, graph, models, sequences
from prosopa.plans import reference as ref
from prosopa.plans.config import TECHNICAL_WORDS
from prosopa.session import cut, table

SHOWN_TYPES = ["astronomical", "medical", "hydraulic"]


def samples_per_bureau(s: SparkSession, d: str) -> DataFrame:
    """The first eight officials of each bureau, by id."""
    who = ref.officials(s, d).select("bureau_type", "id", "name_zh").where("bureau_type is not null and id is not null").distinct()
    return attributes.pick(who, ["bureau_type"], [F.asc("id"), F.asc_nulls_first("name_zh")], 8, "place")


def most_common_titles(s: SparkSession, d: str) -> DataFrame:
    """The thirty most frequent titles as transcribed."""
    return attributes.most_common(ref.postings(s, d), "c_office_chn", 30)


def _network(s: SparkSession, d: str):
    """Roles, edges and paths of the network around all officials, and its summary."""
    edges, official = cut(ref.kin_edges(s, d)), ref.officials(s, d)
    main, paths = official.select("id"), cut(ref.high_paths(s, d))
    role, edge = cut(graph.roles(edges, main, paths)), cut(graph.role_edges(ref.related(s, d), main, paths))
    office = table(s, d, "office_codes").where(classify.any_word("c_office_chn", TECHNICAL_WORDS)).select(F.col("c_office_id").alias("office"))
    held = ref.postings(s, d).join(main.distinct(), F.col("c_personid") == F.col("id"), "left_semi").select(F.col("c_office_id").alias("office"), F.lit(True).alias("used")).distinct()
    offices = office.join(held, "office", "left").na.fill(False, ["used"])
    highs, bureaus = official.where("is_high_official = 1").select("id"), official.select("id", F.col("bureau_type").alias("bureau"))
    return role, edge, paths, graph.network_summary(role, edge, paths, highs, offices, bureaus)


def network_summary(s: SparkSession, d: str) -> DataFrame:
    """The counts of the network around all officials."""
    return _network(s, d)[3]


def network_validation(s: SparkSession, d: str) -> DataFrame:
    """Paths and counts of the network that don't agree with its nodes and edges."""
    role, edge, paths, summary = _network(s, d)
    return graph.check_paths(role, paths, cut(summary), edge)


def network_view(s: SparkSession, d: str) -> DataFrame:
    """Edges of the view of officials of three bureaus."""
    node = ref.officials(s, d).select("id", F.col("bureau_type").alias("node_type"), F.col("name_en").alias("name"), F.col("dynasty_zh").alias("dynasty"))
    return graph.network_view(node, ref.kin_edges(s, d), SHOWN_TYPES)[1]


def network_search(s: SparkSession, d: str) -> DataFrame:
    """Officials of one dynasty whose English name has a text in any case of letters."""
    node = ref.officials(s, d).select("id", F.col("bureau_type").alias("node_type"), F.col("name_en").alias("name"), F.col("dynasty_zh").alias("dynasty"))
    return graph.network_view(node, ref.kin_edges(s, d), text="AN", dynasty="甲朝")[0].select("id", "name")


def career_cluster_summary(s: SparkSession, d: str) -> DataFrame:
    """Careers by era: postings, technical share, spans and common states."""
    era = ref.people(s, d).select("c_personid", classify.era("c_index_year", "break3", "missing_year").alias("era"))
    row = sequences.career_features(ref.careers(s, d)).join(era, "c_personid", "left").withColumn("era", F.coalesce("era", F.lit("missing_year")))
    told = sequences.cluster_summary(row, "era")
    return told.select(*(ref.r6(c).alias(c) if t == "double" else F.col(c) for c, t in told.dtypes))


def career_type_medoids(s: SparkSession, d: str) -> DataFrame:
    """The six career types with their medoids, sizes and mean distances."""
    items = cut(ref.coded_sequences(s, d))
    told = sequences.medoid_report(sequences.career_types(sequences.k_medoids(items, ref.CAREERS_SET.types, ref.CAREERS_SET.iterations)))
    name = items.select(F.col("sequence_no").alias("medoid"), F.col("text").alias("medoid_sequence"))
    return told.join(name, "medoid").select("career_type", "medoid_sequence", "sequences", "weight", ref.r6("mean_distance").alias("mean_distance"))


def logit_diagnostics(s: SparkSession, d: str) -> DataFrame:
    """(metric, value) of the logit of high officials: rows, log-likelihood, criteria, accuracy, rounds."""
    rows = cut(ref.career_modelled(s, d))
    used = exprs.varying(rows.na.fill(0, ref.FEATURES), ref.FEATURES)
    fit = models.logit(cut(models.design(rows, used, "is_high_official")), 1.0, "sum")
    told = models.fit_measures(fit, len(used) + 1) if fit["coefficients"] is not None else {"n": fit["n"]}
    told = told | {"positive": fit["ones"], "iterations": fit["iterations"], "converged": int(fit["converged"])}
    return s.createDataFrame([(k, round(float(v), 4)) for k, v in told.items()], "metric string, value double")


_F = [samples_per_bureau, most_common_titles, network_summary, network_validation, network_view, network_search, career_cluster_summary, career_type_medoids, logit_diagnostics]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _F}

_BY_ERA = f"""n AS (SELECT c_personid, count(*) AS posting_count, count_if(office_domain <> 'other') AS technical, min(first_year) AS a, max(last_year) AS z,
    max(CASE WHEN office_domain = 'medical' THEN 1 ELSE 0 END) AS med FROM state GROUP BY 1),
k AS (SELECT coalesce({ref.case_era('c_index_year', 'break3', 'missing_year')}, 'missing_year') AS era, n.*, z - a AS span, seq[1] AS s1, seq[-1] AS s2 FROM n JOIN person_seq USING (c_personid) LEFT JOIN person USING (c_personid)),
m1 AS (SELECT era, s1 AS common_first_state FROM (SELECT era, s1, count(*) AS c FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY era ORDER BY c DESC, s1) = 1),
m2 AS (SELECT era, s2 AS common_last_state FROM (SELECT era, s2, count(*) AS c FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY era ORDER BY c DESC, s2) = 1)"""

_NETWORK = f"""{ref.EDGES}, {ref._levels(6)}, {ref._ROLES}, {ref._RELATED},
    r AS (SELECT id, id IN (SELECT id FROM main) AS is_main, id IN (SELECT id FROM h) AS is_high, id IN (SELECT id FROM on_path) AND id NOT IN (SELECT id FROM main) AND id NOT IN (SELECT id FROM h) AS is_bridge FROM every),
    step AS (SELECT DISTINCT least(path[i], path[i + 1]) AS source, greatest(path[i], path[i + 1]) AS target FROM path, unnest(range(1, len(path))) u(i)),
    e AS (SELECT related.*, 'direct' AS category FROM related WHERE source IN (SELECT id FROM main) OR target IN (SELECT id FROM main) UNION ALL SELECT related.*, 'path' FROM related JOIN step USING (source, target))"""

ORACLES: dict[str, str] = {
    "samples_per_bureau": """SELECT bureau_type, id, name_zh, CAST(row_number() OVER (PARTITION BY bureau_type ORDER BY id, name_zh NULLS FIRST) AS INTEGER) AS place
        FROM (SELECT DISTINCT bureau_type, id, name_zh FROM alaam_science_officials WHERE bureau_type IS NOT NULL AND id IS NOT NULL) QUALIFY place <= 8""",
    "most_common_titles": f"WITH {ref.POSTINGS} SELECT c_office_chn, count(*) AS count FROM posting WHERE trim(c_office_chn) <> '' GROUP BY 1 ORDER BY count DESC, c_office_chn LIMIT 30",
    "network_summary": f"""WITH {_NETWORK},
        technical AS (SELECT DISTINCT c_office_id FROM office_codes WHERE regexp_matches(c_office_chn, '{ref.in_sql(TECHNICAL_WORDS)}')),
        told AS (SELECT (SELECT count(*) FROM r WHERE is_main) AS mainPersonCount, (SELECT count(*) FROM r WHERE is_high) AS relatedHighOfficialCount, (SELECT count(*) FROM r WHERE is_bridge) AS bridgeCount, (SELECT count(*) FROM r) AS nodeCount,
            (SELECT count(DISTINCT other) FROM near JOIN main ON main.id = near.node) AS directPersonCount, (SELECT count(*) FROM e) AS edgeCount, (SELECT count(*) FROM e WHERE category = 'direct') AS directEdgeCount,
            (SELECT count(*) FROM e WHERE category = 'path') AS pathEdgeCount, (SELECT count(*) FROM path) AS pathCount, (SELECT count(DISTINCT main) FROM path) AS highPathCoveredMainCount,
            (SELECT coalesce(max(distance), 0)::BIGINT FROM path) AS maxHighPathDistanceSeen, (SELECT count(*) FROM main WHERE id IN (SELECT source FROM e WHERE category = 'direct' UNION SELECT target FROM e WHERE category = 'direct')) AS mainWithDirectRelationsCount,
            (SELECT count(DISTINCT id) FROM alaam_science_officials WHERE is_high_official = 1) AS highOfficialCandidateCount, (SELECT count(*) FROM technical) AS scienceOfficeCount,
            (SELECT count(*) FROM technical WHERE c_office_id IN (SELECT c_office_id FROM posted_to_office_data WHERE c_personid IN (SELECT id FROM main))) AS usedScienceOfficeCount)
        SELECT metric, CAST(value AS BIGINT) AS value FROM (UNPIVOT told ON COLUMNS(*) INTO NAME metric VALUE value)
        UNION ALL SELECT 'bureau_' || bureau_type, count(DISTINCT id) FROM alaam_science_officials WHERE bureau_type IS NOT NULL GROUP BY 1""",
    "network_validation": f"""WITH {_NETWORK}, off AS (SELECT 'path_main' AS check_name, main AS id FROM path WHERE main NOT IN (SELECT id FROM r WHERE is_main) UNION ALL SELECT 'path_high', high FROM path WHERE high NOT IN (SELECT id FROM r WHERE is_high)
            UNION ALL SELECT 'path_node', u.id FROM path, unnest(path) u(id) WHERE u.id NOT IN (SELECT id FROM r))
        SELECT k.check_name, count(off.id) AS offenders, min(off.id) AS first FROM (VALUES ('path_main'), ('path_high'), ('path_node'), ('nodeCount'), ('edgeCount'), ('pathCount')) k(check_name) LEFT JOIN off USING (check_name) GROUP BY 1""",
    "network_view": f"""WITH {ref.EDGES}, shown AS (SELECT id FROM alaam_science_officials WHERE bureau_type IN ({', '.join(f"'{t}'" for t in SHOWN_TYPES)}))
        SELECT source, target, CAST(1 AS BIGINT) AS weight FROM edge WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)""",
    "network_search": "SELECT id, name_en AS name FROM (SELECT DISTINCT * FROM alaam_science_officials) WHERE dynasty_zh = '甲朝' AND contains(lower(name_en), 'an')",
    "career_cluster_summary": f"""WITH {ref.CAREERS}, {ref.PEOPLE}, {_BY_ERA}, g AS (SELECT era, count(*) AS persons, round(avg(posting_count), 6) AS mean_postings, round(median(posting_count), 6) AS median_postings,
        round(avg({ref.PCT('technical', 'posting_count')}), 6) AS mean_technical_pct, CAST(sum(med) AS BIGINT) AS ever_medical, count(span) AS spans, round(avg(span), 6) AS mean_span, round(median(span), 6) AS median_span FROM k GROUP BY era)
        SELECT *, {ref.PCT('ever_medical', 'persons')} AS ever_medical_pct FROM g LEFT JOIN m1 USING (era) LEFT JOIN m2 USING (era)""",
}
