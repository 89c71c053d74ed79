"""Registered queries of the analytic operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopa.functions import classify, exprs
from prosopa.operators import attributes, breaks, geo, graph, kinship, models, nested, sequences, spatial
from prosopa.plans.config import BUREAUS, CLUSTERS, DOMAINS, ERAS, HIGH_WORDS, NOT_HIGH_WORDS, TECHNICAL_WORDS, TRANSITION_YEARS, BreakSearch, Careers, Network, Spatial
from prosopa.session import cut, table

CAREERS_SET = Careers()
NETWORK_SET = Network()
SPATIAL_SET = Spatial()
BREAK_SET = BreakSearch()
KIN_SETS = {"has_father": [75, 76], "has_son": [180, 181, 182, 183], "has_wife": [134]}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def people(s, d):
    return table(s, d, "biog_main").distinct()


def officials(s, d):
    return table(s, d, "alaam_science_officials").distinct()


def postings(s, d):
    return table(s, d, "posted_to_office_data").drop("loaded_at").distinct()


def kin_edges(s, d):
    kin = table(s, d, "kin_data")
    return graph.edges_of(kin.where((F.col("c_personid") != 0) & (F.col("c_kin_id") != 0)), "c_personid", "c_kin_id")


def in_sql(words):
    return "|".join(words)


def case_contains(text, rules):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in rules.items()) + " ELSE 'other' END"


def case_match(text, rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{k}'" for k, p in rules.items()) + f" ELSE '{otherwise}' END"


def case_era(year, scheme, missing):
    return f"CASE WHEN {year} IS NULL THEN '{missing}' " + " ".join(f"WHEN {year} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b, _ in ERAS[scheme]) + " ELSE 'out_of_scope' END"


PCT = "CASE WHEN {1} <> 0 THEN round(({0}) * 1.0::DOUBLE / ({1}) * 100, 4) ELSE 0.0 END".format
PEOPLE = "person AS (SELECT DISTINCT * FROM biog_main)"
OFFICIALS = "official AS (SELECT DISTINCT * FROM alaam_science_officials)"
POSTINGS = "posting AS (SELECT DISTINCT c_personid, c_office_id, c_posting_id, c_sequence, c_firstyear, c_lastyear, c_office_category_id, c_dy, c_office_chn FROM posted_to_office_data)"
EDGES = """edge AS (SELECT DISTINCT least(c_personid, c_kin_id) AS source, greatest(c_personid, c_kin_id) AS target FROM kin_data WHERE c_personid <> 0 AND c_kin_id <> 0 AND c_personid <> c_kin_id),
near AS (SELECT source AS node, target AS other FROM edge UNION SELECT target, source FROM edge)"""
VALID = "place AS (SELECT id, cluster, x_coord AS x, y_coord AS y, bureau_medical FROM official WHERE x_coord IS NOT NULL AND y_coord IS NOT NULL AND NOT (x_coord = 0 AND y_coord = 0) AND abs(x_coord) <= 180 AND abs(y_coord) <= 90)"
_TEXT = "lower(coalesce(o.c_office_chn, p.c_office_chn, '') || ' ' || coalesce(o.c_office_pinyin, '') || ' ' || coalesce(o.c_office_trans, ''))"
_CAT = "CASE WHEN trim(coalesce(p.c_office_category_id, '')) = '' THEN 'missing_category' WHEN lower(trim(p.c_office_category_id)) = 'unknown' THEN 'unknown_category' ELSE trim(p.c_office_category_id) END"
CAREERS = f"""{POSTINGS},
state0 AS (SELECT p.*, {case_contains(_TEXT, DOMAINS)} AS office_domain, {_CAT} AS office_category FROM posting p LEFT JOIN office_codes o USING (c_office_id) WHERE c_personid IS NOT NULL),
state AS (SELECT *, CASE WHEN office_domain <> 'other' THEN 'domain_' || office_domain ELSE 'category_' || office_category END AS career_state,
    CASE WHEN c_firstyear > 0 THEN c_firstyear END AS first_year, CASE WHEN c_lastyear > 0 THEN c_lastyear END AS last_year FROM state0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c_personid ORDER BY c_sequence NULLS LAST, first_year NULLS LAST, c_posting_id, c_office_id) AS sequence_position FROM state),
kept AS (SELECT *, CASE WHEN lag(career_state) OVER (PARTITION BY c_personid ORDER BY sequence_position) IS NOT DISTINCT FROM career_state THEN 0 ELSE 1 END AS keep FROM placed),
person_seq AS (SELECT c_personid, list(career_state ORDER BY sequence_position) FILTER (keep = 1) AS seq FROM kept GROUP BY c_personid)"""


def careers(s, d):
    rows = sequences.posting_table(postings(s, d), table(s, d, "office_codes"))
    return sequences.positions(rows, "c_personid", sequences.career_order())


# Filters, classification, projections


@query(f"SELECT DISTINCT c_posting_id, c_office_chn FROM posted_to_office_data WHERE regexp_matches(c_office_chn, '{in_sql(TECHNICAL_WORDS)}')")
def keyword_filter(s, d):
    return postings(s, d).where(classify.any_word("c_office_chn", TECHNICAL_WORDS)).select("c_posting_id", "c_office_chn").distinct()


@query(f"SELECT DISTINCT c_posting_id, c_office_chn FROM posted_to_office_data WHERE regexp_matches(c_office_chn, '{in_sql(TECHNICAL_WORDS)}') AND NOT regexp_matches(c_office_chn, '{in_sql(NOT_HIGH_WORDS)}')")
def include_exclude_filter(s, d):
    """Technical titles without the words of clerks and sections."""
    return postings(s, d).where(classify.included("c_office_chn", TECHNICAL_WORDS, NOT_HIGH_WORDS)).select("c_posting_id", "c_office_chn").distinct()


@query(f"""SELECT DISTINCT c_posting_id, coalesce(regexp_matches(c_office_chn, '{in_sql(HIGH_WORDS)}') AND NOT regexp_matches(c_office_chn, '{in_sql(NOT_HIGH_WORDS)}'), false) AS high FROM posted_to_office_data""")
def high_titles(s, d):
    """Whether a posting's title is that of a high office."""
    return postings(s, d).select("c_posting_id", F.coalesce(classify.included("c_office_chn", HIGH_WORDS, NOT_HIGH_WORDS), F.lit(False)).alias("high")).distinct()


@query(f"WITH {POSTINGS} SELECT {case_match('coalesce(c_office_chn, chr(32))', BUREAUS, 'other_technical')} AS bureau_type, count(*) AS postings FROM posting GROUP BY 1")
def first_match_classify(s, d):
    return postings(s, d).groupBy(classify.bureau("c_office_chn").alias("bureau_type")).agg(F.count(F.lit(1)).alias("postings"))


@query(f"WITH {CAREERS} SELECT office_domain, office_category, career_state, count(*) AS postings FROM state GROUP BY ALL")
def state_synthesis(s, d):
    return sequences.posting_table(postings(s, d), table(s, d, "office_codes")).groupBy("office_domain", "office_category", "career_state").agg(F.count(F.lit(1)).alias("postings"))


@query(f"WITH {PEOPLE} SELECT {case_era('c_index_year', 'break4', 'missing_year')} AS era, count(*) AS people FROM person GROUP BY 1")
def era_lookup(s, d):
    return people(s, d).groupBy(classify.era("c_index_year", "break4", "missing_year").alias("era")).agg(F.count(F.lit(1)).alias("people"))


@query(f"WITH {PEOPLE} SELECT c_personid, {case_era('c_index_year', 'break3', 'out_of_scope')} AS era FROM person")
def era_range_join(s, d):
    eras = s.createDataFrame([e[:3] for e in ERAS["break3"]], "name string, first_year int, last_year int")
    return classify.with_era(people(s, d), "c_index_year", eras).select("c_personid", "era")


@query(f"WITH {PEOPLE} SELECT CAST(floor(c_index_year / 50.0) * 50 AS INTEGER) AS time_bin, count(*) AS people FROM person WHERE c_index_year BETWEEN 600 AND 1912 GROUP BY 1")
def time_bins(s, d):
    return people(s, d).where(F.col("c_index_year").between(600, 1912)).groupBy(classify.time_bin("c_index_year", 50).alias("time_bin")).agg(F.count(F.lit(1)).alias("people"))


@query(f"""WITH {OFFICIALS} SELECT id, x_coord IS NOT NULL AND y_coord IS NOT NULL AS raw_geo, coalesce(x_coord = 0 AND y_coord = 0, false) AND x_coord IS NOT NULL AND y_coord IS NOT NULL AS invalid_zero_coord,
    x_coord IS NOT NULL AND y_coord IS NOT NULL AND NOT coalesce(x_coord = 0 AND y_coord = 0, false) AS valid_geo,
    CASE WHEN x_coord IS NULL OR y_coord IS NULL THEN 'missing_coordinate' WHEN x_coord = 0 AND y_coord = 0 THEN 'zero_zero_coordinate' ELSE 'valid_coordinate' END AS geo_reason FROM official""")
def geo_validity(s, d):
    return officials(s, d).select("id", *classify.geo_validity("x_coord", "y_coord"))


@query(f"WITH {OFFICIALS} SELECT id, " + ", ".join(f"CAST(bureau_type = '{k}' AS INTEGER) AS bureau_{k}" for k in ("astronomical", "medical", "hydraulic", "military_industrial", "construction")) + " FROM official")
def one_hot(s, d):
    return officials(s, d).select("id", *classify.one_hot("bureau_type"))


@query(f"""WITH {OFFICIALS} SELECT id, round(x_coord * x_coord, 6) AS x2, round(y_coord * y_coord, 6) AS y2, round(x_coord * y_coord, 6) AS xy,
    greatest(is_high_official, has_civil_exam) AS high_or_exam FROM official""")
def poly_features(s, d):
    x, y = F.col("x_coord"), F.col("y_coord")
    return officials(s, d).select("id", r6(x * x).alias("x2"), r6(y * y).alias("y2"), r6(x * y).alias("xy"), F.greatest("is_high_official", "has_civil_exam").alias("high_or_exam"))


@query("SELECT c_personid, " + ", ".join(f"max(CASE WHEN c_kin_code IN ({', '.join(map(str, v))}) THEN 1 ELSE 0 END) AS {k}" for k, v in KIN_SETS.items()) + " FROM kin_data WHERE c_personid IS NOT NULL GROUP BY c_personid")
def code_flags(s, d):
    return classify.code_flags(table(s, d, "kin_data"), "c_personid", "c_kin_code", KIN_SETS)


@query(f"""WITH {PEOPLE} SELECT c_personid, coalesce(nullif(trim(c_name_chn), ''), nullif(trim(c_name), ''), CAST(c_personid AS VARCHAR)) AS name_zh,
    coalesce(nullif(trim(c_name), ''), nullif(trim(c_name_chn), ''), CAST(c_personid AS VARCHAR)) AS name_en FROM person""")
def person_names(s, d):
    return people(s, d).select("c_personid", exprs.first_text("c_name_chn", "c_name", "c_personid").alias("name_zh"), exprs.first_text("c_name", "c_name_chn", "c_personid").alias("name_en"))


@query("""SELECT c_kin_code, coalesce(nullif(trim(c_kinrel_chn), ''), nullif(trim(c_kinrel), ''), 'kinship') AS label, count(*) AS rows
    FROM kin_data LEFT JOIN kinship_codes ON c_kincode = nullif(c_kin_code, 0) GROUP BY 1, 2""")
def relation_labels(s, d):
    code = table(s, d, "kinship_codes").select("c_kincode", exprs.first_text("c_kinrel_chn", "c_kinrel").alias("known"))
    kin = table(s, d, "kin_data")
    row = kin.join(code, F.nullif(F.col("c_kin_code"), F.lit(0)) == F.col("c_kincode"), "left")
    return row.groupBy("c_kin_code", F.coalesce("known", F.lit("kinship")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


# Picks and joins


@query(f"""WITH {POSTINGS} SELECT c_personid, c_office_id, c_posting_id, c_sequence FROM posting WHERE c_personid IS NOT NULL AND c_office_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_personid
    ORDER BY c_sequence IS NULL, CASE WHEN c_sequence = 0 THEN 999999 ELSE c_sequence END, c_office_id, c_posting_id) = 1""")
def primary_pick(s, d):
    seq = F.col("c_sequence")
    order = [seq.isNull().asc(), F.when(seq == 0, 999999).otherwise(seq).asc(), F.asc("c_office_id"), F.asc("c_posting_id")]
    rows = postings(s, d).where(F.col("c_personid").isNotNull() & F.col("c_office_id").isNotNull())
    return attributes.pick(rows, ["c_personid"], order).select("c_personid", "c_office_id", "c_posting_id", "c_sequence")


@query("""SELECT DISTINCT c_personid, c_office_id, loaded_at, c_posting_id FROM posted_to_office_data WHERE c_personid IS NOT NULL AND c_office_id IS NOT NULL
    QUALIFY rank() OVER (PARTITION BY c_personid, c_office_id ORDER BY loaded_at DESC, c_posting_id DESC) = 1""")
def last_wins(s, d):
    rows = table(s, d, "posted_to_office_data").where(F.col("c_personid").isNotNull() & F.col("c_office_id").isNotNull())
    return attributes.latest(rows.select("c_personid", "c_office_id", "loaded_at", "c_posting_id"), ["c_personid", "c_office_id"], ["loaded_at", "c_posting_id"])


_TWO_KINDS = """kin AS (SELECT k.*, coalesce(c_kinrel_simplified IN ('F', 'S'), false) AS line FROM kin_data k LEFT JOIN kinship_codes ON c_kin_code = c_kincode
    WHERE c_personid <> 0 AND c_kin_id <> 0 AND c_personid <> c_kin_id)"""
_RELATED = f"""{_TWO_KINDS}, related AS (SELECT least(c_personid, c_kin_id) AS source, greatest(c_personid, c_kin_id) AS target, CASE WHEN line THEN 'lineage' ELSE 'kinship' END AS kind, c_kin_code AS code
    FROM kin QUALIFY row_number() OVER (PARTITION BY least(c_personid, c_kin_id), greatest(c_personid, c_kin_id) ORDER BY NOT line, c_kin_code IS NULL, c_kin_code) = 1)"""


def related(s, d):
    code = table(s, d, "kinship_codes").select(F.col("c_kincode").alias("c_kin_code"), "c_kinrel_simplified")
    kin = table(s, d, "kin_data").join(code, "c_kin_code", "left").withColumn("line", F.coalesce(F.col("c_kinrel_simplified").isin("F", "S"), F.lit(False)))
    return graph.relations((kin.where("line"), "c_personid", "c_kin_id", "c_kin_code", "lineage"), (kin.where("not line"), "c_personid", "c_kin_id", "c_kin_code", "kinship"))


@query(f"WITH {_RELATED} SELECT * FROM related")
def first_wins_edge(s, d):
    return related(s, d)


@query(f"""WITH {POSTINGS}, {PEOPLE}, {OFFICIALS} SELECT p.c_posting_id, p.c_personid, o.c_office_trans, b.c_name, a.cluster FROM posting p LEFT JOIN office_codes o USING (c_office_id)
    LEFT JOIN person b ON b.c_personid = p.c_personid LEFT JOIN official a ON a.id = p.c_personid""")
def left_join_chain(s, d):
    office = table(s, d, "office_codes").select("c_office_id", "c_office_trans")
    person = people(s, d).select("c_personid", "c_name")
    official = officials(s, d).select(F.col("id").alias("c_personid"), "cluster")
    row = postings(s, d).join(office, "c_office_id", "left").join(person, "c_personid", "left").join(official, "c_personid", "left")
    return row.select("c_posting_id", "c_personid", "c_office_trans", "c_name", "cluster")


_PAIRS = """pair0 AS (SELECT DISTINCT CASE WHEN c_kinrel_simplified = 'F' THEN c_kin_id ELSE c_personid END AS father_id, CASE WHEN c_kinrel_simplified = 'F' THEN c_personid ELSE c_kin_id END AS child_id,
        c_personid, c_kin_code, c_kinrel_chn FROM kin_data JOIN kinship_codes ON c_kin_code = c_kincode WHERE c_kinrel_simplified IN ('F', 'S') AND c_personid <> 0 AND c_kin_id <> 0 AND c_personid <> c_kin_id),
pair AS (SELECT father_id, child_id, array_to_string(list_sort(list(DISTINCT c_kin_code)), ';') AS relation_codes, array_to_string(list_sort(list(DISTINCT c_kinrel_chn)), ';') AS relation_labels_chn, count(*) AS record_count FROM pair0 GROUP BY ALL)"""


def pairs(s, d):
    return kinship.pairs(table(s, d, "kin_data"), table(s, d, "kinship_codes"))


@query(f"WITH {_PAIRS} SELECT * FROM pair")
def ordered_distinct_concat(s, d):
    return pairs(s, d)


_DYADS = f"""{_PAIRS}, {PEOPLE}, {OFFICIALS},
trait AS (SELECT p.c_personid, p.c_index_year, p.c_surname_chn, CAST(o.id IS NOT NULL AS INTEGER) AS science FROM person p LEFT JOIN official o ON o.id = p.c_personid),
dyad AS (SELECT pair.*, f.c_index_year AS father_c_index_year, c.c_index_year AS child_c_index_year, f.science AS father_science, c.science AS child_science,
    CAST(trim(coalesce(f.c_surname_chn, '')) <> '' AND f.c_surname_chn IS NOT DISTINCT FROM c.c_surname_chn AS INTEGER) AS same_surname
    FROM pair LEFT JOIN trait f ON f.c_personid = father_id LEFT JOIN trait c ON c.c_personid = child_id)"""


def dyads(s, d):
    science = officials(s, d).select(F.col("id").alias("c_personid"), F.lit(1).alias("science")).distinct()
    trait = people(s, d).select("c_personid", "c_index_year", "c_surname_chn").join(science, "c_personid", "left").na.fill(0, ["science"])
    return kinship.dyads(pairs(s, d), trait).drop("father_c_surname_chn", "child_c_surname_chn")


@query(f"WITH {_DYADS} SELECT * FROM dyad")
def dyad_double_join(s, d):
    return dyads(s, d)


@query(f"""WITH {_DYADS}, flag AS (SELECT coalesce(father_science, 0) AS father_science, coalesce(child_science, 0) AS child_science, same_surname FROM dyad),
    told AS (SELECT 'child_science' AS outcome, f AS father_science, count(*) FILTER (father_science = f) AS pairs, coalesce(sum(child_science) FILTER (father_science = f), 0) AS ones FROM flag, (VALUES (0), (1)) t(f) GROUP BY f
        UNION ALL SELECT 'same_surname', f, count(*) FILTER (father_science = f), coalesce(sum(same_surname) FILTER (father_science = f), 0) FROM flag, (VALUES (0), (1)) t(f) GROUP BY f)
    SELECT outcome, CAST(father_science AS INTEGER) AS father_science, pairs, CAST(ones AS BIGINT) AS ones, {PCT('ones', 'pairs')} AS rate_pct FROM told""")
def conditional_rates(s, d):
    row = dyads(s, d).na.fill(0, ["father_science", "child_science"])
    return attributes.rates(row, "father_science", ["child_science", "same_surname"])


@query(f"""WITH {_DYADS}, c AS (SELECT {case_era('child_c_index_year', 'break3', 'missing_year')} AS cluster, coalesce(father_science, 0) AS f, coalesce(child_science, 0) AS c FROM dyad),
    told AS (SELECT k.cluster, count(c.cluster) AS pairs, CAST(coalesce(sum(f), 0) AS BIGINT) AS father_ones, CAST(coalesce(sum(c), 0) AS BIGINT) AS child_ones, CAST(coalesce(sum(f * c), 0) AS BIGINT) AS both_ones
        FROM (VALUES {', '.join(f"('{c}')" for c in CLUSTERS)}) k(cluster) LEFT JOIN c USING (cluster) GROUP BY 1) SELECT *, {PCT('both_ones', 'father_ones')} AS rate_pct FROM told""")
def cluster_rates(s, d):
    row = dyads(s, d).withColumn("era", classify.era("child_c_index_year", "break3", "missing_year"))
    return kinship.transmission(row, "era", "father_science", "child_science", CLUSTERS)


@query(f"WITH {POSTINGS} SELECT id FROM (SELECT DISTINCT id FROM alaam_science_officials) WHERE id IN (SELECT c_personid FROM posting)")
def semi_filter(s, d):
    who = postings(s, d).select(F.col("c_personid").alias("id"))
    return officials(s, d).select("id").distinct().join(who, "id", "left_semi")


@query("SELECT DISTINCT c_personid FROM posted_to_office_data p WHERE c_personid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM biog_main b WHERE b.c_personid = p.c_personid)")
def anti_filter(s, d):
    who = table(s, d, "posted_to_office_data").select("c_personid").where("c_personid is not null").distinct()
    return who.join(table(s, d, "biog_main"), "c_personid", "left_anti")


@query("SELECT c_personid AS id FROM kin_data WHERE c_personid IS NOT NULL UNION SELECT c_kin_id FROM kin_data WHERE c_kin_id IS NOT NULL")
def set_union(s, d):
    return table(s, d, "kin_data").select(F.explode(F.array("c_personid", "c_kin_id")).alias("id")).where("id is not null").distinct()


@query("SELECT c_personid AS id FROM kin_data WHERE c_personid IS NOT NULL EXCEPT SELECT id FROM alaam_science_officials")
def set_except(s, d):
    return table(s, d, "kin_data").select(F.col("c_personid").alias("id")).where("id is not null").subtract(table(s, d, "alaam_science_officials").select("id"))


# Summaries


@query(f"""WITH {OFFICIALS}, n AS (SELECT cluster, addr_name_chn AS v, count(*) AS n FROM official WHERE trim(coalesce(addr_name_chn, '')) <> '' GROUP BY ALL)
    SELECT cluster, v AS mode FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) = 1""")
def mode_per_group(s, d):
    return attributes.most_frequent(officials(s, d), ["cluster"], "addr_name_chn")


@query(f"""WITH {OFFICIALS}, n AS (SELECT cluster, addr_name_chn, count(*) AS count FROM official WHERE trim(coalesce(addr_name_chn, '')) <> '' GROUP BY ALL),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY count DESC, addr_name_chn) AS INTEGER) AS rank, sum(count) OVER (PARTITION BY cluster) AS total FROM n)
    SELECT cluster, rank, addr_name_chn, count, {PCT('count', 'total')} AS share_pct FROM t WHERE rank <= 10""")
def topn_locations(s, d):
    return attributes.top_values(officials(s, d), "cluster", "addr_name_chn", SPATIAL_SET.top_places)


@query(f"""WITH {PEOPLE}, n AS (SELECT count(*) AS people, count(c_index_year) AS dated, count_if(c_female = 1) AS women, count(DISTINCT c_surname_chn) AS surnames, round(avg(c_index_year), 6) AS mean_year FROM person)
    SELECT 'people' AS metric, CAST(people AS VARCHAR) AS value FROM n UNION ALL SELECT 'dated', CAST(dated AS VARCHAR) FROM n UNION ALL SELECT 'women', CAST(women AS VARCHAR) FROM n
    UNION ALL SELECT 'surnames', CAST(surnames AS VARCHAR) FROM n UNION ALL SELECT 'mean_year', printf('%.6f', mean_year) FROM n""")
def diagnostics_long(s, d):
    row = people(s, d).agg(
        F.count(F.lit(1)).alias("people"), F.count("c_index_year").alias("dated"), F.count_if(F.col("c_female") == 1).alias("women"),
        F.count_distinct("c_surname_chn").alias("surnames"), r6(F.avg("c_index_year")).alias("mean_year"),
    )
    return attributes.long_form(row, ["people", "dated", "women", "surnames", "mean_year"])


@query(f"""WITH {PEOPLE}, m AS (SELECT avg(c_index_year) AS a, stddev_pop(c_index_year) AS s FROM person),
    f AS (SELECT c_personid, c_index_year, coalesce(c_index_year, a) AS y FROM person, m), g AS (SELECT avg(y) AS a, stddev_pop(y) AS s FROM f)
    SELECT c_personid, round((f.c_index_year - m.a) / m.s, 6) AS year_z, round((y - g.a) / g.s, 6) AS filled_z FROM f, m, g""")
def zscore(s, d):
    row = people(s, d).select("c_personid", "c_index_year")
    row = exprs.zscores(row, {"year_z": "c_index_year"})
    row = exprs.zscores(row, {"filled_z": "c_index_year"}, fill_mean=True)
    return row.select("c_personid", r6("year_z").alias("year_z"), r6("filled_z").alias("filled_z"))


@query(f"WITH {PEOPLE}, n AS (SELECT c_dy, count(*) AS people, CAST(count_if(c_female = 1) AS BIGINT) AS women FROM person GROUP BY c_dy) SELECT c_dy, people, women, {PCT('women', 'people')} AS women_pct FROM n")
def pct_safe(s, d):
    row = people(s, d).groupBy("c_dy").agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("c_female") == 1).alias("women"))
    return row.withColumn("women_pct", exprs.percent("women", "people"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_samp(l_quantity), 6) AS sd_quantity,
    round(median(l_extendedprice), 6) AS median_price, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def group_wide_summary(s, d):
    rows, keys = table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    told = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_quantity")).alias("mean_quantity"),
        r6(F.stddev_samp("l_quantity")).alias("sd_quantity"), F.count_distinct("l_suppkey").alias("suppliers"),
    )
    return told.join(attributes.exact_medians(rows, keys, {"median_price": "l_extendedprice"}), keys).withColumn("median_price", r6("median_price"))


# Sequences


@query(f"WITH {CAREERS} SELECT c_posting_id, c_personid, CAST(sequence_position AS INTEGER) AS sequence_position, career_state FROM placed")
def ordered_position(s, d):
    return careers(s, d).select("c_posting_id", "c_personid", "sequence_position", "career_state")


@query(f"WITH {CAREERS} SELECT c_personid, array_to_string(seq, ' > ') AS collapsed_sequence, len(seq) AS states FROM person_seq")
def collapse_adjacent(s, d):
    row = sequences.state_lists(careers(s, d), "c_personid", "sequence_position", "career_state").withColumn("c", sequences.collapsed("states"))
    return row.select("c_personid", F.array_join("c", " > ").alias("collapsed_sequence"), F.size("c").cast("long").alias("states"))


@query(f"""WITH {CAREERS}, n AS (SELECT c_personid, count(*) AS posting_count, CAST(count_if(office_domain <> 'other') AS BIGINT) AS technical_postings, count(DISTINCT career_state) AS distinct_states,
        min(first_year) AS first_year, max(last_year) AS last_year, max(CASE WHEN office_domain = 'medical' THEN 1 ELSE 0 END) AS ever_medical FROM state GROUP BY c_personid)
    SELECT n.*, last_year - first_year AS span_years, {PCT('technical_postings', 'posting_count')} AS technical_pct, seq[1] AS first_state, seq[-1] AS last_state, len(seq) AS collapsed_length,
        array_to_string(seq, ' > ') AS collapsed_sequence FROM n JOIN person_seq USING (c_personid)""")
def career_features(s, d):
    return sequences.career_features(careers(s, d))


@query(f"""WITH e AS (SELECT user_id, event_type, event_type AS s, ts, event_id, 'all' AS cluster, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IS NOT NULL),
    n AS (SELECT cluster, before AS from_state, s AS to_state, count(*) AS transition_count FROM e WHERE before <> s GROUP BY ALL)
    SELECT *, {PCT('transition_count', 'sum(transition_count) OVER (PARTITION BY cluster)')} AS share_pct FROM n""")
def transition_matrix(s, d):
    events = table(s, d, "events").withColumn("cluster", F.lit("all"))
    return sequences.transitions(events, "user_id", ["ts", "event_id"], "event_type", "cluster")


@query(f"""WITH {CAREERS}, {PEOPLE}, k AS (SELECT placed.*, {case_era('c_index_year', 'break3', 'missing_year')} AS cluster FROM placed LEFT JOIN person USING (c_personid)),
    l AS (SELECT cluster, career_state AS to_state, lag(career_state) OVER (PARTITION BY c_personid ORDER BY sequence_position) AS from_state FROM k),
    n AS (SELECT cluster, from_state, to_state, count(*) AS transition_count FROM l WHERE from_state <> to_state GROUP BY ALL)
    SELECT *, {PCT('transition_count', 'sum(transition_count) OVER (PARTITION BY cluster)')} AS share_pct FROM n""")
def career_transitions(s, d):
    era = people(s, d).select("c_personid", classify.era("c_index_year", "break3", "missing_year").alias("era"))
    rows = careers(s, d).join(era, "c_personid", "left").withColumn("era", F.coalesce("era", F.lit("missing_year")))
    return sequences.transitions(rows, "c_personid", ["sequence_position"], "career_state", "era")


def coded_sequences(s, d):
    rows = careers(s, d)
    listed = sequences.state_lists(rows, "c_personid", "sequence_position", "career_state")
    return sequences.encoded(cut(sequences.unique_sequences(listed)))


@query(f"WITH {CAREERS} SELECT coalesce(array_to_string(seq, ' > '), '') AS sequence, count(*) AS weight FROM person_seq GROUP BY 1")
def sequence_histogram(s, d):
    listed = sequences.state_lists(careers(s, d), "c_personid", "sequence_position", "career_state")
    return sequences.unique_sequences(listed).select(F.col("text").alias("sequence"), "weight")


def _near_sql(steps):
    return f"""WITH {CAREERS}, v AS (SELECT career_state, chr(CAST(39 + row_number() OVER (ORDER BY career_state) AS INTEGER)) AS c FROM (SELECT DISTINCT career_state FROM state)),
    coded AS (SELECT sequence, string_agg(c, '' ORDER BY i) AS code FROM (SELECT DISTINCT array_to_string(seq, ' > ') AS sequence, seq FROM person_seq) q, unnest(seq) WITH ORDINALITY u(t, i) JOIN v ON v.career_state = u.t GROUP BY 1)
    SELECT a.sequence AS a, b.sequence AS b, levenshtein(a.code, b.code) AS distance FROM coded a JOIN coded b ON a.sequence < b.sequence AND abs(length(a.code) - length(b.code)) <= {steps} WHERE levenshtein(a.code, b.code) <= {steps}"""


def _near_pairs(s, d, steps):
    items = cut(coded_sequences(s, d).select("sequence_no", "text", "code"))
    pair = sequences.near_sequences(items, steps)
    name = lambda side: items.select(F.col("sequence_no").alias(f"{side}_no"), F.col("text").alias(f"t{side}"))
    row = pair.join(name("a"), "a_no").join(name("b"), "b_no")
    return row.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), F.col("distance").cast("long").alias("distance"))


@query(_near_sql(1))
def edit_distance_pairs(s, d):
    return _near_pairs(s, d, 1)


@query(_near_sql(2))
def edit_distance_two(s, d):
    """Sequences at most two steps apart."""
    return _near_pairs(s, d, 2)


@query()
def k_medoids(s, d):
    items = cut(coded_sequences(s, d))
    placed = sequences.career_types(sequences.k_medoids(items, CAREERS_SET.types, CAREERS_SET.iterations))
    return items.select("sequence_no", "text").join(placed, "sequence_no").select(F.col("text").alias("sequence"), "career_type", "distance", "weight")


@query(f"""WITH {CAREERS}, {PEOPLE}, n AS (SELECT c_personid, count(*) AS posting_count, seq[1] AS first_state FROM state JOIN person_seq USING (c_personid) GROUP BY ALL),
    k AS (SELECT n.*, {case_era('c_index_year', 'break3', 'missing_year')} AS cluster FROM n LEFT JOIN person USING (c_personid))
    SELECT first_state, count(*) AS node_count, round(avg(posting_count), 6) AS mean_posting_count, {', '.join(f"CAST(count_if(cluster = '{c}') AS BIGINT) AS {c}_count" for c in CLUSTERS)} FROM k GROUP BY first_state""")
def type_summary(s, d):
    era = people(s, d).select("c_personid", classify.era("c_index_year", "break3", "missing_year").alias("era"))
    row = sequences.career_features(careers(s, d)).join(era, "c_personid", "left")
    return sequences.type_summary(row, "first_state", "era", CLUSTERS, "posting_count").withColumn("mean_posting_count", r6("mean_posting_count"))


# Graph


@query(f"WITH {EDGES} SELECT source, target FROM edge")
def edge_dedup(s, d):
    return kin_edges(s, d)


@query(f"WITH {EDGES} SELECT source, target, CAST(1 AS BIGINT) AS weight FROM edge WHERE source IN (SELECT c_personid FROM biog_main) AND target IN (SELECT c_personid FROM biog_main)")
def induced_edges(s, d):
    return graph.build_graph(kin_edges(s, d), people(s, d), "induced", "c_personid")


@query(f"""WITH {EDGES}, keep AS (SELECT * FROM near WHERE node IN (SELECT c_personid FROM biog_main))
    SELECT a.node AS source, b.node AS target, count(*) AS weight FROM keep a JOIN keep b ON a.other = b.other AND a.node < b.node GROUP BY ALL""")
def projection_weights(s, d):
    return graph.build_graph(kin_edges(s, d), people(s, d), "projection", "c_personid")


@query(f"WITH {EDGES}, {PEOPLE} SELECT c_personid AS id, count(node) AS degree FROM person LEFT JOIN near ON node = c_personid GROUP BY 1")
def degree(s, d):
    return graph.degrees(kin_edges(s, d), people(s, d), "c_personid")


@query(f"""WITH {EDGES}, t AS (SELECT a.node AS id, count(*) AS triangles FROM near a JOIN near b ON a.node = b.node AND a.other < b.other JOIN edge ON source = a.other AND target = b.other GROUP BY 1),
    g AS (SELECT node AS id, count(*) AS degree FROM near GROUP BY 1)
    SELECT g.id, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree >= 2 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS clustering FROM g LEFT JOIN t USING (id)""")
def clustering_coef(s, d):
    edges = kin_edges(s, d)
    nodes = graph.adjacency(edges).select(F.col("node").alias("id")).distinct()
    return graph.clustering(edges, nodes).withColumn("clustering", r6("clustering"))


_TWO = "two AS (SELECT DISTINCT a.node, b.other FROM near a JOIN near b ON a.other = b.node WHERE a.node <> b.other AND NOT EXISTS (SELECT 1 FROM near c WHERE c.node = a.node AND c.other = b.other))"


@query(f"WITH {EDGES}, {_TWO} SELECT node, other FROM two")
def two_hop(s, d):
    return graph.two_hop(kin_edges(s, d))


_Y = "y AS (SELECT DISTINCT c_personid AS id, CAST(c_female = 1 AS INTEGER) AS v FROM biog_main)"


def outcome_nodes(s, d):
    return people(s, d).select(F.col("c_personid").alias("id"), (F.col("c_female") == 1).cast("int").alias("v"))


@query(f"""WITH {EDGES}, {_TWO}, {_Y} SELECT y.id, CAST(coalesce((SELECT sum(coalesce(o.v, 0)) FROM near JOIN y o ON o.id = near.other WHERE near.node = y.id), 0) AS BIGINT) AS contagion,
    CAST(coalesce((SELECT sum(coalesce(o.v, 0)) FROM two JOIN y o ON o.id = two.other WHERE two.node = y.id), 0) AS BIGINT) AS indirect_contagion FROM y""")
def contagion(s, d):
    return graph.contagion(kin_edges(s, d), outcome_nodes(s, d), "v")


@query(f'WITH {EDGES}, {_Y} SELECT count(*) AS edges, CAST(count_if(a.v = 1 AND b.v = 1) AS BIGINT) AS both_ones FROM edge LEFT JOIN y a ON a.id = source LEFT JOIN y b ON b.id = target')
def co_outcome_edges(s, d):
    return graph.co_outcome_edges(kin_edges(s, d), outcome_nodes(s, d), "v")


def _levels(depth: int) -> str:
    sql = "l0 AS (SELECT DISTINCT id AS main, id AS node, [id] AS path FROM alaam_science_officials)"
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT main, node FROM l{j}" for j in range(i))
        sql += f""", l{i} AS (SELECT main, near.other AS node, min(list_append(path, near.other)) AS path FROM l{i - 1} l JOIN near ON near.node = l.node
            WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.main = l.main AND s.node = near.other) GROUP BY ALL)"""
    hits = " UNION ALL ".join(f"SELECT main, node AS high, {i} AS distance, path FROM l{i} WHERE node IN (SELECT id FROM alaam_science_officials WHERE is_high_official = 1)" for i in range(1, depth + 1))
    return sql + f", path AS (SELECT * FROM ({hits}) QUALIFY row_number() OVER (PARTITION BY main ORDER BY distance, path) <= 8)"


def high_paths(s, d):
    row = officials(s, d)
    return graph.bounded_paths(kin_edges(s, d), row.select("id"), row.where("is_high_official = 1").select("id"), NETWORK_SET.max_distance, NETWORK_SET.max_paths)


@query(f"WITH {EDGES}, {_levels(6)} SELECT main, high, distance, array_to_string(path, '>') AS path FROM path")
def bounded_paths(s, d):
    return high_paths(s, d).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


_ROLES = """main AS (SELECT DISTINCT id FROM alaam_science_officials), h AS (SELECT DISTINCT high AS id FROM path), on_path AS (SELECT DISTINCT unnest(path) AS id FROM path),
every AS (SELECT id FROM main UNION SELECT id FROM h UNION SELECT id FROM on_path UNION SELECT other FROM near JOIN main ON main.id = near.node)"""


@query(f"""WITH {EDGES}, {_levels(6)}, {_ROLES}, r AS (SELECT id, id IN (SELECT id FROM main) AS is_main, id IN (SELECT id FROM h) AS is_high, id IN (SELECT id FROM on_path) AND id NOT IN (SELECT id FROM main) AND id NOT IN (SELECT id FROM h) AS is_bridge,
        id IN (SELECT other FROM near JOIN main ON main.id = near.node) AS is_direct FROM every)
    SELECT *, CASE WHEN is_main THEN 'main' WHEN is_high THEN 'high' WHEN is_bridge THEN 'bridge' ELSE 'other' END AS node_type FROM r""")
def node_roles(s, d):
    return graph.roles(kin_edges(s, d), officials(s, d).select("id"), high_paths(s, d))


@query(f"""WITH {EDGES}, {_levels(6)}, {_RELATED}, main AS (SELECT DISTINCT id FROM alaam_science_officials),
    step AS (SELECT DISTINCT least(path[i], path[i + 1]) AS source, greatest(path[i], path[i + 1]) AS target FROM path, unnest(range(1, len(path))) u(i))
    SELECT related.*, 'direct' AS category FROM related WHERE source IN (SELECT id FROM main) OR target IN (SELECT id FROM main) UNION ALL SELECT related.*, 'path' FROM related JOIN step USING (source, target)""")
def role_edges(s, d):
    return graph.role_edges(related(s, d), officials(s, d).select("id"), high_paths(s, d))


@query("""SELECT 'repeated_node' AS check_name, count(*) AS offenders, min(id) AS first FROM (SELECT c_personid AS id FROM biog_main WHERE c_personid IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'dangling_edge', count(*), min(id) FROM (SELECT c_personid AS id FROM kin_data UNION SELECT c_kin_id FROM kin_data) WHERE id IS NOT NULL AND id NOT IN (SELECT c_personid FROM biog_main)
    UNION ALL SELECT 'self_link', count(*), min(c_personid) FROM kin_data WHERE c_personid = c_kin_id""")
def graph_validation(s, d):
    return graph.check_graph(table(s, d, "biog_main"), table(s, d, "kin_data"), "c_personid", "c_personid", "c_kin_id")


_DOC_EDGES = """doc AS (SELECT DISTINCT record_id, payload FROM science_network_data_20260516 WHERE json_valid(payload)),
e AS (SELECT record_id, unnest(from_json(coalesce(json_extract(payload, '$.edges'), json_extract(payload, '$.data.edges')), '["json"]')) AS edge FROM doc)"""


@query(f"""WITH {_DOC_EDGES}, p AS (SELECT record_id, TRY_CAST(coalesce(edge -> '$.source' ->> 'id', edge ->> 'source') AS BIGINT) AS source, TRY_CAST(coalesce(edge -> '$.target' ->> 'id', edge ->> 'target') AS BIGINT) AS target,
    edge ->> 'kind' AS kind FROM e) SELECT record_id, source, target, kind, count(*) AS rows FROM p WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL""")
def document_edges(s, d):
    root = nested.documents(table(s, d, "science_network_data_20260516"))
    edge = root.select("record_id", F.explode(F.try_variant_get("root", "$.edges", "array<variant>")).alias("e"))
    end = lambda name: F.coalesce(F.try_variant_get("e", f"$.{name}.id", "long"), F.try_variant_get("e", f"$.{name}", "long"))
    row = edge.select("record_id", end("source").alias("source"), end("target").alias("target"), F.try_variant_get("e", "$.kind", "string").alias("kind"))
    return row.where("source is not null and target is not null").groupBy("record_id", "source", "target", "kind").agg(F.count(F.lit(1)).alias("rows"))


def document_graph(s, d):
    """Distinct edges of all network documents, and the nodes they join."""
    edges = cut(graph.edges_of(document_edges(s, d), "source", "target"))
    return edges, graph.adjacency(edges).select(F.col("node").alias("id")).distinct()


@query()
def eigenvector(s, d):
    return graph.eigenvector(*document_graph(s, d), checkpoint_every=15)


@query()
def betweenness_sampled(s, d):
    return graph.betweenness(*document_graph(s, d), pivots=NETWORK_SET.pivots, seed=NETWORK_SET.seed)


# Spatial

HAVERSINE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))".format


def places(s, d):
    row = officials(s, d).where(geo.usable(F.col("x_coord"), F.col("y_coord")))
    return row.select("id", "cluster", F.col("x_coord").alias("x"), F.col("y_coord").alias("y"), "bureau_medical")


@query(f"WITH {OFFICIALS}, {VALID} SELECT id, round({HAVERSINE('x', 'y', '116.4', '39.9')}, 6) AS km FROM place")
def haversine(s, d):
    return places(s, d).select("id", r6(geo.haversine_km(F.col("x"), F.col("y"), F.lit(116.4), F.lit(39.9))).alias("km"))


@query(f"""WITH {OFFICIALS}, {VALID}, m AS (SELECT cluster, avg(x) AS mx, avg(y) AS my FROM place GROUP BY 1), f AS (SELECT place.*, mx, my, {HAVERSINE('x', 'y', 'mx', 'my')} AS d FROM place JOIN m USING (cluster))
    SELECT cluster, count(*) AS points, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north,
        round(coalesce(stddev_samp(x), 0), 6) AS x_std, round(coalesce(stddev_samp(y), 0), 6) AS y_std, round(sqrt(avg(d * d)), 6) AS standard_distance_km, round(avg(d), 6) AS mean_distance_km, round(median(d), 6) AS median_distance_km FROM f GROUP BY cluster""")
def dispersion(s, d):
    row = spatial.dispersion(places(s, d), "cluster")
    exact = {"cluster", "points", "west", "east", "south", "north"}
    return row.select(*(F.col(c) if c in exact else r6(c).alias(c) for c in row.columns))


@query(f"""WITH {OFFICIALS}, {VALID}, m AS (SELECT cluster, avg(x) AS x, avg(y) AS y FROM place GROUP BY 1)
    SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, round({HAVERSINE('a.x', 'a.y', 'b.x', 'b.y')}, 6) AS distance_km FROM m a JOIN m b ON a.cluster < b.cluster AND a.cluster LIKE 'cluster%' AND b.cluster LIKE 'cluster%'""")
def centroid_distance(s, d):
    return spatial.centroid_distances(places(s, d), "cluster", CLUSTERS).withColumn("distance_km", r6("distance_km"))


_KNN = """nn AS (SELECT a.id, b.id AS neighbour, CAST(row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS INTEGER) AS rank FROM place a JOIN place b ON a.id <> b.id QUALIFY rank <= 8)"""


@query(f"WITH {OFFICIALS}, {VALID}, {_KNN} SELECT id, neighbour, rank FROM nn")
def knn(s, d):
    return spatial.nearest(places(s, d), 8).select("id", "neighbour", "rank")


@query(f"""WITH {OFFICIALS}, {VALID}, {_KNN}, c AS (SELECT id, bureau_medical - avg(bureau_medical) OVER () AS c FROM place)
    SELECT count(*) AS n, round((SELECT sum(a.c * b.c / 8) FROM nn JOIN c a ON a.id = nn.id JOIN c b ON b.id = nn.neighbour) / sum(c * c), 6) AS morans_i FROM c""")
def morans_i(s, d):
    row = places(s, d)
    values = row.select("id", F.col("bureau_medical").cast("double").alias("value"))
    return spatial.morans_i(values, spatial.nearest(row, 8)).withColumn("morans_i", r6("morans_i"))


@query()
def centroid_permutation(s, d):
    return spatial.centroid_test(cut(places(s, d)), "cluster", CLUSTERS, SPATIAL_SET.permutations, SPATIAL_SET.seed)


@query()
def moran_permutation(s, d):
    row = cut(places(s, d))
    flags = {c: F.col("cluster") == c for c in CLUSTERS} | {"bureau_medical": F.col("bureau_medical") == 1}
    return spatial.morans_tests(row, flags, spatial.nearest(row, SPATIAL_SET.neighbours), SPATIAL_SET.permutations, SPATIAL_SET.seed)


# Models


@query(f"WITH {OFFICIALS} SELECT id, round(1 / (1 + exp(-least(greatest(degree - 2, -35), 35))), 6) AS p, round(1 / (1 + exp(degree) + exp(clustering)), 6) AS p0, round(exp(degree) / (1 + exp(degree) + exp(clustering)), 6) AS p1, round(exp(clustering) / (1 + exp(degree) + exp(clustering)), 6) AS p2 FROM official")
def softmax_baseline(s, d):
    p = exprs.softmax_baseline(["degree", "clustering"])
    return officials(s, d).select("id", r6(exprs.sigmoid(F.col("degree") - 2)).alias("p"), *(r6(c).alias(f"p{i}") for i, c in enumerate(p)))


ENTRY_CONTROLS = ["has_civil_exam", "has_yin_privilege", "has_recommendation", "has_technical_exam"]
NETWORK_CONTROLS = ["degree_z", "clustering_z", "eigenvector_z", "betweenness_z"]
BUREAU_DUMMIES = ["bureau_astronomical", "bureau_medical", "bureau_hydraulic", "bureau_military_industrial", "bureau_construction"]
CAREER_TERMS = ["cluster2_yuan_ming", "cluster3_qing_after", "log_posting_count_z", "collapsed_sequence_length_z", "career_span_years_z", "technical_domain_share_z"]
FEATURES = [*CAREER_TERMS, *ENTRY_CONTROLS, *NETWORK_CONTROLS, *BUREAU_DUMMIES]
PLACE_TERMS = ["x_model_z", "y_model_z", "x_model_z_sq", "y_model_z_sq", "xy_model_z", "is_high_official"]
MPLE_TERMS = ["contagion", "indirect_contagion", "degree_z", "betweenness_z", "clustering_z", "eigenvector_z", "is_high_official", *ENTRY_CONTROLS, "has_geo", "x_coord_z", "y_coord_z", *BUREAU_DUMMIES]


def modelled(s, d):
    return exprs.zscores(officials(s, d), {f"{c}_z": c for c in ("degree", "clustering", "eigenvector", "betweenness")})


def career_modelled(s, d):
    """The officials with the career terms of the model of high officials."""
    told = sequences.career_features(careers(s, d)).withColumnRenamed("c_personid", "id")
    row = modelled(s, d).join(told, "id", "left")
    middle = attributes.exact_medians(row, [], {"_span": "span_years"})
    row = row.crossJoin(F.broadcast(middle)).withColumns({
        "_postings": F.log1p(F.coalesce("posting_count", F.lit(0))), "_length": F.coalesce("collapsed_length", F.lit(0)), "_years": F.coalesce("span_years", "_span"), "_share": F.coalesce("technical_pct", F.lit(0.0)),
        **{c: (F.col("cluster") == c).cast("int") for c in CLUSTERS[1:]},
    })
    return exprs.zscores(row, {"log_posting_count_z": "_postings", "collapsed_sequence_length_z": "_length", "career_span_years_z": "_years", "technical_domain_share_z": "_share"})


LOGIT = "term string, coefficient double, odds_ratio double"


def _logit_rows(rows, features, outcome, penalty, scale, limit=700.0):
    """(term, coefficient, odds ratio) of a logit on the features that vary; no rows for one class only."""
    used = exprs.varying(rows.na.fill(0, list(features)), features)
    fit = models.logit(cut(models.design(rows, used, outcome)), penalty, scale)
    told = models.coefficient_rows(["intercept", *used], fit["coefficients"], limit) if fit["coefficients"] is not None else []
    return [(t, round(c, 4), None if o is None else round(o, 4)) for t, c, o in told]


@query()
def logit_sum_l2(s, d):
    return s.createDataFrame(_logit_rows(cut(career_modelled(s, d)), FEATURES, "is_high_official", 1.0, "sum"), LOGIT)


@query()
def logit_mean_l2(s, d):
    return s.createDataFrame(_logit_rows(cut(career_modelled(s, d)), FEATURES, "is_high_official", 1e-4, "mean"), LOGIT)


@query()
def mple_logit(s, d):
    row = exprs.zscores(modelled(s, d), {"x_coord_z": "x_coord", "y_coord_z": "y_coord"})
    row = cut(row.withColumns({c: F.coalesce((F.col("cluster") == c).cast("int"), F.lit(0)) for c in CLUSTERS}))
    edges = cut(graph.build_graph(kin_edges(s, d), row, NETWORK_SET.mode).select("source", "target"))
    told = []
    for c in CLUSTERS:
        near = graph.contagion(edges, row.select("id", c), c).withColumnsRenamed({"contagion": "_direct", "indirect_contagion": "_indirect"})
        full = cut(exprs.zscores(row.join(near, "id"), {"contagion": "_direct", "indirect_contagion": "_indirect"}))
        told += [(c, *r) for r in _logit_rows(full, MPLE_TERMS, c, 10.0, "inverse", 50.0)]
    return s.createDataFrame(told, f"cluster string, {LOGIT}")


@query()
def dyad_logits(s, d):
    """The father-child logits of being a science official and of the civil examination."""
    known = officials(s, d).groupBy(F.col("id").alias("c_personid")).agg(F.lit(1).alias("science"), F.max("has_civil_exam").alias("has_civil_exam"), F.max("is_high_official").alias("high"))
    trait = people(s, d).select("c_personid", "c_index_year", "c_surname_chn", F.col("c_female").isNotNull().cast("int").alias("female_known"), F.coalesce("c_female", F.lit(0)).alias("female"))
    trait = trait.join(known, "c_personid", "left").na.fill(0, ["science", "has_civil_exam", "high"])
    row = exprs.zscores(kinship.dyads(pairs(s, d), trait), {"child_index_year_z": "child_c_index_year", "father_index_year_z": "father_c_index_year"})
    row = cut(row.where("child_c_index_year is not null").na.fill(0, ["child_science", "child_has_civil_exam"]))
    shared = ["child_index_year_z", "father_index_year_z", "same_surname", "father_high", "child_female_known", "child_female"]
    told = []
    for model, trait_ in (("science_official_transmission", "science"), ("civil_exam_transmission", "has_civil_exam")):
        told += [(model, *r) for r in _logit_rows(row, [f"father_{trait_}", *shared], f"child_{trait_}", SPATIAL_SET.l2, "sum")]
    return s.createDataFrame(told, f"model string, {LOGIT}")


@query()
def multinomial(s, d):
    row = modelled(s, d).where(geo.usable(F.col("x_coord"), F.col("y_coord")))
    row = row.withColumn("y", F.array_position(F.array(*map(F.lit, CLUSTERS)), F.col("cluster")).cast("int") - 1)
    x, y = F.col("x_model_z"), F.col("y_model_z")
    row = cut(exprs.zscores(row.where("y >= 0"), {"x_model_z": "x_coord", "y_model_z": "y_coord"}).withColumns({"x_model_z_sq": x * x, "y_model_z_sq": y * y, "xy_model_z": x * y}))
    terms = [*PLACE_TERMS, *ENTRY_CONTROLS, *NETWORK_CONTROLS, *BUREAU_DUMMIES]
    used = exprs.varying(row.na.fill(0, terms), terms)
    fit = models.multinomial(cut(models.design(row, used, "y")), len(CLUSTERS), SPATIAL_SET.l2)
    told = [(CLUSTERS[k + 1], t, round(c, 4)) for k, b in enumerate(fit["coefficients"]) for t, c, _ in models.coefficient_rows(["intercept", *used], b)]
    return s.createDataFrame(told, "outcome_cluster string, feature string, coefficient double")


# Structural breaks

_PANEL = """f AS (SELECT c_personid, c_index_year, CAST(c_female = 1 AS INTEGER) AS y FROM (SELECT DISTINCT * FROM biog_main) WHERE c_index_year BETWEEN 600 AND 1912),
b AS (SELECT CAST(floor(c_index_year / 50.0) * 50 AS INTEGER) AS time_bin, count(*) AS n, CAST(sum(coalesce(y, 0)) AS BIGINT) AS ones FROM f GROUP BY 1), p AS (SELECT CAST(row_number() OVER (ORDER BY time_bin) - 1 AS INTEGER) AS bin_no, * FROM b)"""
_COSTS = """c0 AS (SELECT a.bin_no AS start_bin, z.bin_no + 1 AS end_bin, CAST((SELECT sum(n) FROM p WHERE bin_no BETWEEN a.bin_no AND z.bin_no) AS BIGINT) AS n, CAST((SELECT sum(ones) FROM p WHERE bin_no BETWEEN a.bin_no AND z.bin_no) AS BIGINT) AS ones
    FROM p a JOIN p z ON z.bin_no + 1 - a.bin_no >= 2), c AS (SELECT *, CASE WHEN n >= 120 AND ones > 0 AND ones < n THEN round(-2 * (ones * ln(ones / n::DOUBLE) + (n - ones) * ln(1 - ones / n::DOUBLE)), 6) END AS cost FROM c0)"""


def year_panel(s, d):
    return breaks.panel(people(s, d).withColumn("y", (F.col("c_female") == 1).cast("int")), "c_index_year", "y", BREAK_SET.start_year, BREAK_SET.end_year, BREAK_SET.bin_years)


@query(f"WITH {_PANEL} SELECT * FROM p")
def break_panel(s, d):
    return year_panel(s, d)


@query(f"WITH {_PANEL}, {_COSTS} SELECT * FROM c")
def segment_costs(s, d):
    return breaks.segment_costs(year_panel(s, d), BREAK_SET.min_segment_bins, BREAK_SET.min_segment_rows).withColumn("cost", r6("cost"))


def _cover_sql(most: int) -> str:
    """The best covers of all bins by up to `most` segments, grown one segment at a time."""
    sql = "b1 AS (SELECT end_bin, cost AS total, [0] AS starts FROM c WHERE start_bin = 0 AND cost IS NOT NULL)"
    for u in range(2, most + 1):
        sql += f""", b{u} AS (SELECT c.end_bin, min(total + cost) AS total, min_by(list_append(starts, start_bin), (total + cost, start_bin)) AS starts
            FROM b{u - 1} b JOIN c ON c.start_bin = b.end_bin AND cost IS NOT NULL GROUP BY c.end_bin)"""
    all_ = " UNION ALL ".join(f"SELECT {u} AS used, total, starts FROM b{u} WHERE end_bin = (SELECT count(*) FROM p)" for u in range(1, most + 1))
    return sql + f""", cover AS (SELECT used, starts, total + used * ln((SELECT sum(n) FROM p)::DOUBLE) AS bic FROM ({all_}) ORDER BY bic, used LIMIT 1),
    picked AS (SELECT unnest(range(1, used + 1)) AS segment, unnest(starts) AS start_bin, unnest(list_append(starts[2:], (SELECT count(*) FROM p))) AS end_bin, bic FROM cover)"""


_BREAK_COLUMNS = f"""CAST(segment AS INTEGER) AS segment, CAST(picked.start_bin AS INTEGER) AS start_bin, CAST(picked.end_bin AS INTEGER) AS end_bin, time_bin AS first_time_bin, c.n, c.ones, c.cost, round(bic, 4) AS bic,
    CASE WHEN segment > 1 THEN near END AS nearest_transition, CASE WHEN segment > 1 THEN abs(time_bin - near) END AS years_off, CASE WHEN segment > 1 THEN abs(time_bin - near) <= {BREAK_SET.tolerance_years} END AS aligned"""


def _chosen(binned, costs, parameters):
    told = breaks.break_table(binned, costs, parameters, BREAK_SET.max_breaks, BREAK_SET.tolerance_years)
    return told.withColumns({"cost": r6("cost"), "bic": F.round("bic", 4)})


@query(f"""WITH {_PANEL}, {_COSTS}, {_cover_sql(BREAK_SET.max_breaks + 1)}, t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {y})' for i, y in enumerate(TRANSITION_YEARS))}) v(i, y))
    SELECT {_BREAK_COLUMNS} FROM picked JOIN c ON c.start_bin = picked.start_bin AND c.end_bin = picked.end_bin JOIN p ON p.bin_no = picked.start_bin
        JOIN LATERAL (SELECT min_by(y, (abs(time_bin - y), i)) AS near FROM t) ON true""")
def break_select_rates(s, d):
    """The breaks of the rate alone."""
    binned = cut(year_panel(s, d))
    return _chosen(binned, cut(breaks.segment_costs(binned, BREAK_SET.min_segment_bins, BREAK_SET.min_segment_rows)), 1)


PANEL_TERMS = ["log_degree_z", "clustering_z", "is_high_official", "has_posting", "female_known", "female"]


def feature_panel(s, d):
    """Persons with a year: whether they are science officials (y), and what is known of all of them: links
    and their clustering, high offices by title, postings, and sex."""
    person = attributes.earliest(people(s, d).select("c_personid", "c_index_year", "c_female"), ["c_personid"], ["c_index_year", "c_female"]).where(F.col("c_index_year").between(BREAK_SET.start_year, BREAK_SET.end_year))
    edges = cut(kin_edges(s, d))
    node = person.select(F.col("c_personid").alias("id"))
    known = graph.degrees(edges, node).join(graph.clustering(edges, node).select("id", "clustering"), "id").withColumnRenamed("id", "c_personid")
    title = postings(s, d).where("c_personid is not null").groupBy("c_personid").agg(F.lit(1).alias("has_posting"), F.max(F.coalesce(classify.included("c_office_chn", HIGH_WORDS, NOT_HIGH_WORDS), F.lit(False)).cast("int")).alias("is_high_official"))
    science = officials(s, d).select(F.col("id").alias("c_personid"), F.lit(1).alias("y")).distinct()
    row = person.join(known, "c_personid", "left").join(title, "c_personid", "left").join(science, "c_personid", "left").na.fill(0, ["degree", "clustering", "has_posting", "is_high_official", "y"])
    row = row.withColumns({"female_known": F.col("c_female").isNotNull().cast("int"), "female": F.coalesce("c_female", F.lit(0)), "_links": F.log1p("degree")})
    return exprs.zscores(row, {"log_degree_z": "_links", "clustering_z": "clustering"}).select("c_personid", "c_index_year", "y", *PANEL_TERMS)


@query()
def break_features(s, d):
    """The panel of the model-based search."""
    return feature_panel(s, d)


def _model_costs(s, d):
    row = cut(feature_panel(s, d))
    used = exprs.varying(row, PANEL_TERMS)
    window = ("c_index_year", "y", used, BREAK_SET.start_year, BREAK_SET.end_year, BREAK_SET.bin_years)
    return row, used, cut(breaks.model_segment_costs(row, *window, BREAK_SET.min_segment_bins, BREAK_SET.min_segment_rows))


@query()
def model_segment_costs(s, d):
    return _model_costs(s, d)[2].withColumn("cost", r6("cost"))


@query()
def break_select(s, d):
    """The breaks of the penalised logit on the features."""
    row, used, costs = _model_costs(s, d)
    binned = cut(breaks.panel(row, "c_index_year", "y", BREAK_SET.start_year, BREAK_SET.end_year, BREAK_SET.bin_years))
    return _chosen(binned, costs, len(used) + 1)


@query(f"""WITH {PEOPLE}, t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {y})' for i, y in enumerate(TRANSITION_YEARS))}) v(i, y)) SELECT c_personid, c_index_year,
    CASE WHEN c_index_year IS NOT NULL THEN (SELECT min_by(y, (abs(c_index_year - y), i)) FROM t) END AS nearest_transition FROM person""")
def nearest_transition(s, d):
    return people(s, d).select("c_personid", "c_index_year", breaks.nearest_year(F.col("c_index_year")).alias("nearest_transition"))
