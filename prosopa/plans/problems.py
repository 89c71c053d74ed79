"""Registered queries of the operators for points, nested records and hierarchies, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopa.operators import geo, hierarchy, nested
from prosopa.session import table

NEAR_KM = 0.8


def _officials(spark: SparkSession, folder: str) -> DataFrame:
    return geo.usable_points(table(spark, folder, "alaam_science_officials"), "id", "x_coord", "y_coord")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    points = _officials(spark, folder)
    near = geo.near_pairs(points, NEAR_KM).select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = geo.points_in_areas(points, table(spark, folder, "circuit_areas"))
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("id").alias("key_a"), F.col("area").alias("key_b")))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Each placed official with the number of officials close by and the area."""
    points = _officials(spark, folder)
    pair = geo.near_pairs(points, NEAR_KM)
    both = pair.select(F.explode(F.array("key_a", "key_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    area = geo.points_in_areas(points, table(spark, folder, "circuit_areas")).groupBy("id").agg(F.min("area").alias("area_id"))
    return points.select("id").distinct().join(both, "id", "left").join(area, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("near_officials"), "area_id")


def _shapes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.shapes(table(spark, folder, "science_network_data_20260516"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.object_keys(_shapes(spark, folder))


def p2_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.node_table(_shapes(spark, folder))


def p2_bureau_offices(spark: SparkSession, folder: str) -> DataFrame:
    """Offices whose state has bureau fields."""
    return nested.office_table(_shapes(spark, folder), ["office_bureau", "office_bureau_textual"])


def p2_plain_offices(spark: SparkSession, folder: str) -> DataFrame:
    """Offices with an id whose state has no bureau fields."""
    return nested.office_table(_shapes(spark, folder), ["office_plain", "office_plain_textual"])


def p2_unkeyed_offices(spark: SparkSession, folder: str) -> DataFrame:
    """Offices without a usable id."""
    return nested.subtype_tables(_shapes(spark, folder))["office_unkeyed"]


def p2_state_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each subtype table, by list and state."""
    shaped = _shapes(spark, folder)
    node = nested.node_table(shaped).groupBy(F.lit("nodes").alias("list_name"), F.col("node_state").alias("state")).agg(F.count(F.lit(1)).alias("objects"))
    office = nested.office_table(shaped).groupBy("list_name", F.col("office_state").alias("state")).agg(F.count(F.lit(1)).alias("objects"))
    return node.unionByName(office)


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.nested_sets(hierarchy.father_links(table(spark, folder, "kin_data"), table(spark, folder, "kinship_codes")))


def p3_rejected_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links to a second father, which no lineage uses."""
    return hierarchy.rejected_links(hierarchy.father_links(table(spark, folder, "kin_data"), table(spark, folder, "kinship_codes")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sets(spark, folder).select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p3_lineages(spark: SparkSession, folder: str) -> DataFrame:
    """Each person with the path from the root, the number of descendants and the depth."""
    sets = _sets(spark, folder)
    return sets.join(hierarchy.paths(sets), "node").select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "path", (F.col("size") - 1).alias("descendants")
    )


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """The descendants of every person whose id is divisible by 100."""
    sets = _sets(spark, folder)
    return hierarchy.descendants_of(sets, sets.where(F.col("node") % 100 == 0))


def p3_all_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """The descendants of every person."""
    pair = hierarchy.ancestor_pairs(_sets(spark, folder)).where(F.col("ancestor") != F.col("node"))
    return pair.select("ancestor", "node", (F.col("node_depth") - F.col("ancestor_depth")).alias("distance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_nodes": p2_nodes,
    "p2_bureau_offices": p2_bureau_offices,
    "p2_plain_offices": p2_plain_offices,
    "p2_unkeyed_offices": p2_unkeyed_offices,
    "p2_state_counts": p2_state_counts,
    "p3_found": p3_found,
    "p3_lineages": p3_lineages,
    "p3_descendants": p3_descendants,
    "p3_all_descendants": p3_all_descendants,
    "p3_rejected_links": p3_rejected_links,
}

_OFFICIALS = """o AS (SELECT DISTINCT id, x_coord AS x, y_coord AS y FROM alaam_science_officials
    WHERE x_coord IS NOT NULL AND y_coord IS NOT NULL AND NOT (x_coord = 0 AND y_coord = 0) AND abs(x_coord) <= 180 AND abs(y_coord) <= 90),
near AS (SELECT DISTINCT a.id AS key_a, b.id AS key_b FROM o a JOIN o b ON a.id < b.id
    WHERE 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 0.8),
ring AS (SELECT area_id, unnest(rings) AS ring, generate_subscripts(rings, 1) AS no FROM circuit_areas),
corner AS (SELECT area_id, no, ring, unnest(range(1, len(ring))) AS i FROM ring),
side AS (SELECT area_id, no, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM corner),
parity AS (SELECT id, area_id, no, count(*) % 2 = 1 AS odd FROM o JOIN side ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL),
inside AS (SELECT id, area_id FROM parity GROUP BY ALL HAVING bool_or(no = 1 AND odd) AND NOT bool_or(no > 1 AND odd))"""

_NODES = """doc AS (SELECT DISTINCT record_id, payload FROM science_network_data_20260516 WHERE json_valid(payload)),
listed AS (SELECT record_id, coalesce(json_extract(payload, '$.nodes'), json_extract(payload, '$.data.nodes')) AS v FROM doc),
node AS (SELECT record_id, unnest(items) AS node, generate_subscripts(items, 1) AS node_no FROM (
    SELECT record_id, list_filter(from_json(v, '["json"]'), lambda x: json_type(x) = 'OBJECT') AS items FROM listed WHERE json_type(v) = 'ARRAY')),
stored AS (SELECT record_id, node_no, l AS list_name, json_extract(node, '$.' || l) AS v FROM node, (VALUES ('scienceOffices'), ('highOffices')) t(l)),
office AS (SELECT record_id, node_no, list_name, unnest(items) AS office, generate_subscripts(items, 1) AS item_no FROM (
    SELECT record_id, node_no, list_name, list_filter(CASE json_type(v) WHEN 'ARRAY' THEN from_json(v, '["json"]') WHEN 'OBJECT' THEN [v]
        WHEN 'VARCHAR' THEN from_json(v ->> '$', '["json"]') END, lambda x: json_type(x) = 'OBJECT') AS items FROM stored))"""

_OFFICE_STATE = """CASE WHEN TRY_CAST(office ->> 'id' AS BIGINT) IS NULL THEN 'office_unkeyed' ELSE
    CASE WHEN coalesce(office -> 'bureauType', office -> 'bureauZh', office -> 'bureauEn') IS NOT NULL THEN 'office_bureau' ELSE 'office_plain' END
    || CASE WHEN json_type(json_extract(office, '$.id')) = 'VARCHAR' THEN '_textual' ELSE '' END END"""
_OFFICE_KEYS = f"record_id, CAST(node_no AS INTEGER) AS node_no, list_name, CAST(item_no AS INTEGER) AS item_no, {_OFFICE_STATE} AS office_state"
_OFFICE_COLUMNS = """office ->> 'zh' AS zh, office ->> 'pinyin' AS pinyin, office ->> 'en' AS en, CAST(office ->> 'sequence' AS INTEGER) AS sequence,
    CAST(office ->> 'firstYear' AS INTEGER) AS first_year, CAST(office ->> 'lastYear' AS INTEGER) AS last_year"""
_BUREAU_COLUMNS = "office ->> 'bureauType' AS bureau_type, office ->> 'bureauZh' AS bureau_zh, office ->> 'bureauEn' AS bureau_en"
_LIST_STATE = """CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'single' WHEN 'NULL' THEN 'null'
        WHEN 'VARCHAR' THEN 'text_' || CASE WHEN json_valid(v ->> '$') THEN CASE json_type(CAST(v ->> '$' AS JSON)) WHEN 'ARRAY' THEN 'array' ELSE 'other' END ELSE 'absent' END ELSE 'absent' END"""
_NODE_STATES = f"""listing AS (SELECT s.record_id, s.node_no, s.list_name, any_value({_LIST_STATE}) AS form, count(office) AS n, count(DISTINCT {_OFFICE_STATE}) FILTER (office IS NOT NULL) AS kinds
    FROM stored s LEFT JOIN office o ON o.record_id = s.record_id AND o.node_no = s.node_no AND o.list_name = s.list_name GROUP BY ALL),
told AS (SELECT record_id, node_no, list_name, n, form || CASE WHEN n = 0 THEN '_empty' WHEN kinds = 1 THEN '_of_one_kind' ELSE '_mixed' END AS state FROM listing),
both_lists AS (SELECT a.record_id, a.node_no, a.state AS science_state, b.state AS high_state,
    CASE WHEN a.n > 0 AND b.n > 0 THEN 'node_of_both' WHEN a.n > 0 THEN 'node_of_science' WHEN b.n > 0 THEN 'node_of_high' ELSE 'node_without_office' END AS node_state
    FROM told a JOIN told b USING (record_id, node_no) WHERE a.list_name = 'scienceOffices' AND b.list_name = 'highOffices')"""

_LINEAGE = """link AS (SELECT DISTINCT CASE WHEN c_kinrel_simplified = 'F' THEN c_personid ELSE c_kin_id END AS node,
        CASE WHEN c_kinrel_simplified = 'F' THEN c_kin_id ELSE c_personid END AS parent
    FROM kin_data JOIN kinship_codes ON c_kin_code = c_kincode
    WHERE c_kinrel_simplified IN ('F', 'S') AND c_personid <> 0 AND c_kin_id <> 0 AND c_personid <> c_kin_id),
everyone AS (SELECT node FROM link UNION SELECT parent FROM link),
up(node, anc, d) AS (SELECT node, node, 0 FROM everyone UNION SELECT up.node, link.parent, up.d + 1 FROM up JOIN link ON link.node = up.anc WHERE up.d < 150),
looped AS (SELECT DISTINCT node FROM up WHERE d > 0 AND node = anc),
below AS (SELECT up.node, min(up.anc) AS root FROM up JOIN looped ON looped.node = up.anc GROUP BY up.node),
tree AS (SELECT node, max_by(anc, d) AS root, max(d) AS depth FROM up WHERE node NOT IN (SELECT node FROM below) GROUP BY node)"""

ORACLES = {
    "p1_found": f"WITH {_OFFICIALS} SELECT 'near' AS kind, key_a, key_b FROM near UNION ALL SELECT 'inside', id, area_id FROM inside",
    "p1_neighbours": f"""WITH {_OFFICIALS}, n AS (SELECT id, count(*) AS n FROM (SELECT key_a AS id FROM near UNION ALL SELECT key_b FROM near) GROUP BY id)
        SELECT o.id, coalesce(n.n, 0) AS near_officials, a.area_id FROM (SELECT DISTINCT id FROM o) o LEFT JOIN n USING (id) LEFT JOIN (SELECT id, min(area_id) AS area_id FROM inside GROUP BY id) a USING (id)""",
    "p2_found": f"""WITH {_NODES} SELECT record_id, CAST(node_no AS INTEGER) AS node_no, 'nodes' AS list_name, 0 AS item_no FROM node
        UNION ALL SELECT record_id, CAST(node_no AS INTEGER), list_name, CAST(item_no AS INTEGER) FROM office""",
    "p2_nodes": f"""WITH {_NODES}, {_NODE_STATES}, whole AS (SELECT record_id, CASE WHEN json_extract(payload, '$.nodes') IS NOT NULL THEN 'document_flat' ELSE 'document_wrapped' END AS document_state FROM doc)
        SELECT record_id, CAST(node_no AS INTEGER) AS node_no, document_state, node_state, science_state AS scienceOffices_state, high_state AS highOffices_state, TRY_CAST(node ->> 'id' AS BIGINT) AS node_id,
            node ->> 'nameZh' AS name_zh, node ->> 'nameEn' AS name_en, TRY_CAST(node ->> 'indexYear' AS INTEGER) AS index_year, TRY_CAST(node ->> 'dynastyCode' AS INTEGER) AS dynasty_code,
            node ->> 'nodeType' AS node_type, TRY_CAST(node ->> 'isMain' AS BOOLEAN) AS is_main FROM node JOIN both_lists USING (record_id, node_no) JOIN whole USING (record_id)""",
    "p2_bureau_offices": f"""WITH {_NODES} SELECT {_OFFICE_KEYS}, CAST(office ->> 'id' AS BIGINT) AS office_id, {_OFFICE_COLUMNS}, {_BUREAU_COLUMNS} FROM office WHERE office_state LIKE 'office_bureau%'""",
    "p2_plain_offices": f"WITH {_NODES} SELECT {_OFFICE_KEYS}, CAST(office ->> 'id' AS BIGINT) AS office_id, {_OFFICE_COLUMNS} FROM office WHERE office_state LIKE 'office_plain%'",
    "p2_unkeyed_offices": f"WITH {_NODES} SELECT {_OFFICE_KEYS}, {_OFFICE_COLUMNS}, {_BUREAU_COLUMNS} FROM office WHERE office_state = 'office_unkeyed'",
    "p2_state_counts": f"""WITH {_NODES}, {_NODE_STATES} SELECT 'nodes' AS list_name, node_state AS state, count(*) AS objects FROM both_lists GROUP BY ALL
        UNION ALL SELECT list_name, {_OFFICE_STATE} AS state, count(*) FROM office GROUP BY ALL""",
    "p3_found": f"WITH RECURSIVE {_LINEAGE} SELECT node AS node_id, root AS root_id, depth FROM tree UNION ALL SELECT node, root, -1 FROM below",
    "p3_lineages": f"""WITH RECURSIVE {_LINEAGE}
        SELECT node AS node_id, root AS root_id, depth, (SELECT string_agg(CAST(anc AS VARCHAR), '/' ORDER BY d DESC) FROM up WHERE up.node = tree.node) AS path,
            (SELECT count(*) FROM up WHERE up.anc = tree.node) - 1 AS descendants FROM tree
        UNION ALL SELECT node, root, -1, NULL, NULL FROM below""",
    "p3_descendants": f"""WITH RECURSIVE {_LINEAGE} SELECT anc AS ancestor, up.node, d AS distance FROM up JOIN tree ON tree.node = up.node WHERE d > 0 AND anc % 100 = 0""",
    "p3_rejected_links": f"""WITH RECURSIVE {_LINEAGE}, kept AS (SELECT node, min(parent) AS kept_parent FROM link GROUP BY node)
        SELECT node, parent, kept_parent FROM link JOIN kept USING (node) WHERE parent <> kept_parent""",
    "p3_all_descendants": f"""WITH RECURSIVE {_LINEAGE} SELECT anc AS ancestor, up.node, d AS distance FROM up JOIN tree ON tree.node = up.node WHERE d > 0""",
}
