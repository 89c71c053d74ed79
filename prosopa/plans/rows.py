"""Registered queries of the operators for single rows, orders, files and fits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosopa.functions import classify, exprs
from prosopa.operators import attributes, graph, models, sequences, spatial
from prosopa.plans import reference as ref
from prosopa.plans.config import CLUSTERS
from prosopa.session import checkpoint_folder, cut, table
from prosopa.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Short labels of relation codes and bureaus, as views show them.
KIN_LABELS = {75: "father", 180: "son", 134: "wife"}
BUREAU_LABELS = {"astronomical": "Astronomy", "medical": "Medicine", "hydraulic": "Water works"}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _fresh(s: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_folder(s)}/files-{uuid4().hex}"


# Single columns


@query(f"WITH {ref.PEOPLE} SELECT c_personid, CAST(c_surname_chn IS NOT NULL AS INTEGER) AS has_surname, CAST(coalesce(c_ethnicity_code > 0, false) AS INTEGER) AS has_ethnicity FROM person")
def known_flags(s, d):
    return ref.people(s, d).select("c_personid", classify.known("c_surname_chn").alias("has_surname"), classify.known("c_ethnicity_code", True).alias("has_ethnicity"))


@query("""SELECT c_posting_id, CASE WHEN regexp_full_match(trim(c_office_category_id), '[+-]?[0-9]+') THEN TRY_CAST(trim(c_office_category_id) AS BIGINT) END AS category_no
    FROM (SELECT DISTINCT c_posting_id, c_office_category_id FROM posted_to_office_data)""")
def whole_numbers(s, d):
    """The category as a number where it is one."""
    return ref.postings(s, d).select("c_posting_id", "c_office_category_id").distinct().select("c_posting_id", exprs.whole_number("c_office_category_id").alias("category_no"))


@query("SELECT c_kin_code, " + "CASE c_kin_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in KIN_LABELS.items()) + " ELSE 'kin' END AS label, count(*) AS rows FROM kin_data GROUP BY ALL")
def kin_code_labels(s, d):
    return table(s, d, "kin_data").groupBy("c_kin_code", exprs.code_label("c_kin_code", KIN_LABELS, "kin").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


_BUREAU = "CASE bureau_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BUREAU_LABELS.items())


@query(f"WITH {ref.OFFICIALS} SELECT bureau_type, {_BUREAU} END AS label, {_BUREAU} ELSE bureau_type END AS shown, count(*) AS officials FROM official GROUP BY ALL")
def bureau_labels(s, d):
    told = exprs.label("bureau_type", BUREAU_LABELS).alias("label"), exprs.label("bureau_type", BUREAU_LABELS, keep_unknown=True).alias("shown")
    return ref.officials(s, d).groupBy("bureau_type", *told).agg(F.count(F.lit(1)).alias("officials"))


@query(f"WITH {ref.OFFICIALS} SELECT id, " + ", ".join(f"CAST(coalesce(cluster = '{c}', false) AS INTEGER) AS cluster_{c}" for c in CLUSTERS) + " FROM official")
def cluster_dummies(s, d):
    return ref.officials(s, d).select("id", *classify.one_hot("cluster", CLUSTERS, "cluster_"))


_TERMS = [*ref.ENTRY_CONTROLS, *ref.BUREAU_DUMMIES, "is_high_official", "degree", "clustering"]


@query(f"WITH {ref.OFFICIALS} " + " UNION ALL ".join(f"SELECT '{t}' AS feature, coalesce(stddev_pop({t}) > 0, false) AS varies FROM official" for t in _TERMS))
def varying_features(s, d):
    """Which features of the officials have any spread."""
    used = exprs.varying(ref.officials(s, d), _TERMS)
    return s.createDataFrame([(t, t in used) for t in _TERMS], "feature string, varies boolean")


# Orders and picks


@query("""SELECT DISTINCT c_dy, CASE WHEN coalesce(c_dy, 0) = 0 THEN 999 ELSE c_dy END AS sort, CAST(dense_rank() OVER (ORDER BY CASE WHEN coalesce(c_dy, 0) = 0 THEN 999 ELSE c_dy END, c_dy NULLS FIRST) AS INTEGER) AS place
    FROM (SELECT DISTINCT c_dy FROM biog_main)""")
def dynasty_order(s, d):
    """The dynasties in use in their order; those without a number come at 999."""
    dynasty = ref.people(s, d).select("c_dy").distinct().withColumn("sort", F.coalesce(F.nullif("c_dy", F.lit(0)), F.lit(999)))
    # A window over the few rows of a vocabulary.
    return dynasty.withColumn("place", F.row_number().over(Window.orderBy("sort", F.asc_nulls_first("c_dy"))))


@query("""SELECT id, coalesce(dynasty_zh, '') || '|' || coalesce(bureau_type, '') AS part, row_number() OVER (ORDER BY coalesce(dynasty_zh, ''), coalesce(bureau_type, ''), id) - 1 AS place
    FROM (SELECT id, any_value(dynasty_zh) AS dynasty_zh, any_value(bureau_type) AS bureau_type FROM alaam_science_officials GROUP BY id)""")
def ordered_nodes(s, d):
    """Officials in the order of dynasty, bureau and id, with their place in it."""
    one = attributes.earliest(ref.officials(s, d).select("id", "dynasty_zh", "bureau_type"), ["id"], ["dynasty_zh", "bureau_type"])
    dynasty, bureau = (F.coalesce(c, F.lit("")) for c in ("dynasty_zh", "bureau_type"))
    row = one.select("id", F.struct(dynasty.alias("a"), bureau.alias("b"), F.col("id").alias("c")).alias("order"), F.concat(dynasty, F.lit("|"), bureau).alias("part"))
    return attributes.in_order(row, "order").select("id", "part", F.col("row_no").alias("place"))


@query("""SELECT transition_id, CAST(row_number() OVER (PARTITION BY cluster ORDER BY transition_count DESC, from_state, to_state, transition_id) AS INTEGER) AS place FROM career_trajectory_transition_matrix""")
def ordered_transitions(s, d):
    """Transitions of each cluster by falling count, then by name."""
    rows = table(s, d, "career_trajectory_transition_matrix")
    return sequences.positions(rows, "cluster", [F.desc("transition_count"), "from_state", "to_state", "transition_id"], "place").select("transition_id", "place")


@query(f"""WITH {ref.POSTINGS} SELECT c_personid, c_office_id, c_posting_id FROM posting WHERE c_personid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_personid
    ORDER BY CASE WHEN regexp_full_match(trim(c_office_category_id), '[+-]?[0-9]+') THEN 0 ELSE 1 END, c_sequence NULLS LAST, c_office_id NULLS LAST, c_posting_id) = 1""")
def primary_office(s, d):
    """Each person's office by priority: one with a known category first, then by sequence and office."""
    rows = ref.postings(s, d).where("c_personid is not null").withColumn("_known", exprs.whole_number("c_office_category_id").isNull())
    order = [F.asc("_known"), F.asc_nulls_last("c_sequence"), F.asc_nulls_last("c_office_id"), F.asc("c_posting_id")]
    return attributes.pick(rows, ["c_personid"], order).select("c_personid", "c_office_id", "c_posting_id")


@query(f"WITH {ref.OFFICIALS} SELECT o.id, a.c_addr_id, a.x_coord AS addr_x, a.y_coord AS addr_y FROM official o LEFT JOIN addr_codes a ON a.c_name_chn = o.addr_name_chn")
def placed_officials(s, d):
    """Officials with the reference place of their place name, where there is one."""
    place = table(s, d, "addr_codes").select(F.col("c_name_chn").alias("addr_name_chn"), "c_addr_id", F.col("x_coord").alias("addr_x"), F.col("y_coord").alias("addr_y"))
    return ref.officials(s, d).select("id", "addr_name_chn").join(place, "addr_name_chn", "left").select("id", "c_addr_id", "addr_x", "addr_y")


@query(f"""WITH {ref.POSTINGS}, n AS (SELECT {ref._CAT} AS office_category, count(*) AS category_postings FROM posting p GROUP BY 1)
    SELECT p.c_posting_id, o.c_office_pinyin, n.office_category, n.category_postings FROM posting p LEFT JOIN office_codes o USING (c_office_id) LEFT JOIN n ON n.office_category = {ref._CAT}""")
def posting_categories(s, d):
    """Postings with their office and with what is known of its category, both by outer joins."""
    rows = ref.postings(s, d).withColumn("office_category", classify.category("c_office_category_id"))
    categories = rows.groupBy("office_category").agg(F.count(F.lit(1)).alias("category_postings"))
    office = table(s, d, "office_codes").select("c_office_id", "c_office_pinyin")
    return rows.join(office, "c_office_id", "left").join(categories, "office_category", "left").select("c_posting_id", "c_office_pinyin", "office_category", "category_postings")


@query(f"""WITH {ref.EDGES}, {ref.PEOPLE}, t AS (SELECT a.node AS id, count(*) AS triangles FROM near a JOIN near b ON a.node = b.node AND a.other < b.other JOIN edge ON source = a.other AND target = b.other GROUP BY 1),
    g AS (SELECT node AS id, count(*) AS degree FROM near GROUP BY 1)
    SELECT p.c_personid, coalesce(degree, 0) AS degree, round(CASE WHEN coalesce(degree, 0) >= 2 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS clustering
    FROM (SELECT DISTINCT c_personid FROM person) p LEFT JOIN g ON g.id = p.c_personid LEFT JOIN t ON t.id = p.c_personid""")
def person_centralities(s, d):
    """Degree and clustering joined back to every person, 0 for those without links."""
    person, edges = ref.people(s, d).select("c_personid").distinct(), cut(ref.kin_edges(s, d))
    told = graph.clustering(edges, graph.adjacency(edges).select(F.col("node").alias("id")).distinct()).join(graph.degrees(edges, person, "c_personid"), "id")
    row = person.join(told.withColumnRenamed("id", "c_personid"), "c_personid", "left").na.fill(0, ["degree", "clustering"])
    return row.select("c_personid", "degree", ref.r6("clustering").alias("clustering"))


# Files


_FILED = "id long, cluster string, bureau_type string, x_coord double, is_high_official int"
_COLUMNS = ["id", "cluster", "bureau_type", "x_coord", "is_high_official"]


@query(f"SELECT {', '.join(_COLUMNS)} FROM (SELECT DISTINCT * FROM alaam_science_officials)")
def csv_round_trip(s, d):
    """Columns of the officials written as CSV and read with a declared schema; an optional file that isn't
    there adds nothing."""
    folder = _fresh(s)
    sinks.write_csv(ref.officials(s, d), folder, _COLUMNS)
    none = readers.read_csv(s, f"{folder}-none", _FILED, _COLUMNS, optional=True)
    return readers.read_csv(s, folder, _FILED, _COLUMNS).unionByName(none)


@query("SELECT c_posting_id, c_office_chn, c_firstyear FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM posted_to_office_data)")
def json_round_trip(s, d):
    """Postings written as JSON lines and read with a declared schema."""
    folder = _fresh(s)
    sinks.write_json(ref.postings(s, d).select("c_posting_id", "c_office_chn", "c_firstyear"), folder)
    return readers.read_json(s, folder, "c_posting_id long, c_office_chn string, c_firstyear int")


_NUMBERED = f"{ref.EDGES}, number AS (SELECT id, row_number() OVER (ORDER BY id) AS node_no, max(cluster) AS cluster FROM alaam_science_officials GROUP BY id)"


@query(f"""WITH {_NUMBERED} SELECT a.node_no || ' ' || b.node_no AS value FROM edge JOIN number a ON a.id = source JOIN number b ON b.id = target""")
def graph_edge_lines(s, d):
    """The links between officials as text lines of dense numbers in the order of ids."""
    return sinks.graph_rows(*_graph(s, d))[0]


@query(f"WITH {_NUMBERED} SELECT node_no, cluster, " + ", ".join(f"CAST(coalesce(cluster = '{c}', false) AS INTEGER) AS cluster_{c}" for c in CLUSTERS) + " FROM number")
def graph_attributes(s, d):
    return sinks.graph_rows(*_graph(s, d))[1]


def _graph(s, d):
    nodes = ref.officials(s, d).groupBy("id").agg(F.max("cluster").alias("cluster"))
    return nodes, ref.kin_edges(s, d), "cluster", CLUSTERS, ["cluster"]


# Fits and searches against closed forms


_GROUPS = f"""{ref.OFFICIALS}, g AS (SELECT has_civil_exam AS x, count(*)::DOUBLE AS n, sum(is_high_official)::DOUBLE AS k FROM official WHERE is_high_official IS NOT NULL GROUP BY 1),
    b AS (SELECT (SELECT ln(k / (n - k)) FROM g WHERE x = 0) AS b0, (SELECT ln(k / (n - k)) FROM g WHERE x = 1) AS b1)"""


def _two_groups(s, d):
    return models.logit(cut(models.design(ref.officials(s, d), ["has_civil_exam"], "is_high_official")), 0.0, "sum")


@query(f"""WITH {_GROUPS} SELECT 'intercept' AS term, round(b0, 4) AS coefficient, round(exp(b0), 4) AS odds_ratio FROM b UNION ALL SELECT 'has_civil_exam', round(b1 - b0, 4), round(exp(b1 - b0), 4) FROM b""")
def logit_two_groups(s, d):
    """The logit of high office on the civil examination alone, whose solution is known in closed form."""
    told = models.coefficient_rows(["intercept", "has_civil_exam"], _two_groups(s, d)["coefficients"])
    return s.createDataFrame([(t, round(c, 4), round(o, 4)) for t, c, o in told], "term string, coefficient double, odds_ratio double")


@query(f"""WITH {_GROUPS}, m AS (SELECT sum(n) AS n, sum(k * ln(k / n) + (n - k) * ln(1 - k / n)) AS ll, sum(CASE WHEN k >= n - k THEN k ELSE n - k END) AS good FROM g)
    SELECT metric, round(value, 4) AS value FROM (SELECT 'n' AS metric, n AS value FROM m UNION ALL SELECT 'log_likelihood', ll FROM m UNION ALL SELECT 'mean_nll', -ll / n FROM m UNION ALL SELECT 'aic', 4 - 2 * ll FROM m
        UNION ALL SELECT 'bic', 2 * ln(n) - 2 * ll FROM m UNION ALL SELECT 'accuracy', good / n FROM m)""")
def fit_measures_two_groups(s, d):
    told = models.fit_measures(_two_groups(s, d), 2)
    return s.createDataFrame([(k, round(float(v), 4)) for k, v in told.items()], "metric string, value double")


@query(f"""WITH {ref.OFFICIALS}, g AS (SELECT cluster, bureau_medical AS x, count(*)::DOUBLE AS n FROM official WHERE cluster IN ({', '.join(f"'{c}'" for c in CLUSTERS)}) AND bureau_medical IS NOT NULL GROUP BY ALL),
    r AS (SELECT a.cluster, a.x, ln(a.n / b.n) AS r FROM g a JOIN g b ON b.x = a.x AND b.cluster = '{CLUSTERS[0]}' WHERE a.cluster <> '{CLUSTERS[0]}')
    SELECT cluster AS outcome_cluster, 'intercept' AS feature, round(r, 4) AS coefficient FROM r WHERE x = 0 UNION ALL SELECT a.cluster, 'bureau_medical', round(b.r - a.r, 4) FROM r a JOIN r b ON a.cluster = b.cluster AND a.x = 0 AND b.x = 1""")
def multinomial_two_groups(s, d):
    """Eras by the medical bureau alone, whose solution is known in closed form."""
    row = ref.officials(s, d).where("bureau_medical is not null").withColumn("y", F.array_position(F.array(*map(F.lit, CLUSTERS)), F.col("cluster")).cast("int") - 1)
    fit = models.multinomial(cut(models.design(row.where("y >= 0"), ["bureau_medical"], "y")), len(CLUSTERS), 0.0)
    told = [(CLUSTERS[k + 1], t, round(c, 4)) for k, b in enumerate(fit["coefficients"]) for t, c, _ in models.coefficient_rows(["intercept", "bureau_medical"], b)]
    return s.createDataFrame(told, "outcome_cluster string, feature string, coefficient double")


@query(f"""WITH {ref.CAREERS}, q AS (SELECT coalesce(array_to_string(seq, ' > '), '') AS sequence, count(*) AS weight FROM person_seq GROUP BY 1)
    SELECT CAST(least({ref.CAREERS_SET.types}, count(*)) AS BIGINT) AS types, count(*) AS sequences, CAST(sum(weight) AS BIGINT) AS weight, true AS all_nearest FROM q""")
def k_medoids_check(s, d):
    """Of the medoid search: types, sequences, their weight, and whether each sequence is with a nearest medoid."""
    items = cut(ref.coded_sequences(s, d))
    placed = cut(sequences.k_medoids(items, ref.CAREERS_SET.types, ref.CAREERS_SET.iterations))
    centre = placed.select("medoid").distinct().join(items.select(F.col("sequence_no").alias("medoid"), F.col("code").alias("m_code")), "medoid")
    # At most as many centres as types.
    best = placed.crossJoin(F.broadcast(centre.select("m_code"))).groupBy("sequence_no", "distance").agg(F.min(F.levenshtein("code", "m_code")).alias("least"))
    told = best.agg(F.bool_and(F.col("least") == F.col("distance")).alias("all_nearest"))
    return placed.agg(F.count_distinct("medoid").alias("types"), F.count(F.lit(1)).alias("sequences"), F.sum("weight").alias("weight")).crossJoin(told)


@query(f"""WITH {ref._DOC_EDGES}, p AS (SELECT TRY_CAST(coalesce(edge -> '$.source' ->> 'id', edge ->> 'source') AS BIGINT) AS source, TRY_CAST(coalesce(edge -> '$.target' ->> 'id', edge ->> 'target') AS BIGINT) AS target FROM e),
    n AS (SELECT source AS id FROM p WHERE source <> target UNION SELECT target FROM p WHERE source <> target) SELECT count(*) AS nodes, true AS unit_length, true AS settled FROM n WHERE id IS NOT NULL""")
def eigenvector_check(s, d):
    """Of the eigenvector centrality: its nodes, whether it has length 1, and whether the links turn it into a
    multiple of itself (to a thousandth)."""
    edges, nodes = ref.document_graph(s, d)
    value = cut(graph.eigenvector(edges, nodes, checkpoint_every=15))
    turned = graph.adjacency(edges).join(value.select(F.col("id").alias("neighbour"), F.col("eigenvector").alias("v")), "neighbour").groupBy(F.col("node").alias("id")).agg(F.sum("v").alias("av"))
    both = cut(value.join(turned, "id", "left").na.fill(0.0, ["av"]))
    v, av = F.col("eigenvector"), F.col("av")
    told = both.agg(F.count(F.lit(1)).alias("nodes"), F.sum(v * v).alias("vv"), F.sum(v * av).alias("va"), F.sum(av * av).alias("aa"))
    off = F.sqrt(F.greatest(F.col("aa") - F.col("va") * F.col("va") / F.col("vv"), F.lit(0.0)))
    return told.select("nodes", (F.abs(F.col("vv") - 1) < 1e-9).alias("unit_length"), (off < 1e-3).alias("settled"))


@query(f"""WITH {ref.OFFICIALS}, {ref.VALID}, {ref._KNN}, f AS (SELECT place.id, k.label, CAST(cluster = k.label AS INTEGER)::DOUBLE AS v FROM place, (VALUES {', '.join(f"('{c}')" for c in CLUSTERS)}) k(label)),
    m AS (SELECT label, avg(v) AS mean, count(*) AS n FROM f GROUP BY 1), dev AS (SELECT f.id, label, v - mean AS dv, n FROM f JOIN m USING (label)),
    up AS (SELECT a.label, sum(a.dv * b.dv / 8) AS up FROM nn JOIN dev a ON a.id = nn.id JOIN dev b ON b.id = nn.neighbour AND b.label = a.label GROUP BY 1)
    SELECT dev.label, max(n) AS n, round(max(up) / sum(dv * dv), 6) AS morans_i FROM dev JOIN up USING (label) GROUP BY dev.label""")
def moran_clusters(s, d):
    """Moran's I of each cluster against the rest."""
    row = cut(ref.places(s, d))
    flags = row.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.coalesce((F.col("cluster") == c).cast("double"), F.lit(0.0)).alias("value")) for c in CLUSTERS))).alias("f")).select("id", "f.*")
    return spatial.morans_i(flags, spatial.nearest(row, 8), ["label"]).withColumn("morans_i", ref.r6("morans_i"))
