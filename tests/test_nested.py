import json

from prosopa.operators import nested

SCHEMA = "record_id long, payload string, node string"


def keys(spark, payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, p in enumerate(payloads)]
    shaped = nested.shapes(spark.createDataFrame(rows, SCHEMA))
    return shaped, sorted((r.record_id, r.node_no, r.list_name, r.item_no) for r in nested.object_keys(shaped).collect())


def test_every_way_a_list_is_stored(spark):
    office = {"id": 1, "zh": "a"}
    nodes = [
        {"id": 5, "scienceOffices": [office, None, office], "highOffices": office},
        None,
        {"id": "6", "scienceOffices": json.dumps([office, 3]), "highOffices": {"0": office, "1": None}},
        {"scienceOffices": None, "highOffices": "no list"},
        7,
        {},
    ]
    _, got = keys(spark, [{"nodes": nodes}, {"data": {"nodes": nodes[:1]}}, '{"nodes": [{"id": 1}', None, "[]", "3", {"nodes": {"id": 9}}, {"nodes": None}])
    first = [(0, 1, "highOffices", 1), (0, 1, "nodes", 0), (0, 1, "scienceOffices", 1), (0, 1, "scienceOffices", 2)]
    assert got == sorted(
        [*first, (0, 2, "nodes", 0), (0, 2, "scienceOffices", 1), (0, 2, "highOffices", 1), (0, 3, "nodes", 0), (0, 4, "nodes", 0)]
        + [(1, *r[1:]) for r in first] + [(6, 1, "nodes", 0)]
    )


def test_states_route_to_subtypes(spark):
    offices = [{"id": 1, "bureauType": "medical"}, {"id": "2", "firstYear": "900"}, {"id": 3, "bureauType": None}, {"zh": "x"}, {"id": "4", "bureauEn": "y"}, {"id": 5}]
    nodes = [{"id": "5", "nameZh": "x", "isMain": True, "scienceOffices": offices}, {"id": 6, "highOffices": {"id": 1}}, {"id": 7}]
    shaped, keys_ = keys(spark, [{"nodes": nodes}])
    tables = {k: v.collect() for k, v in nested.subtype_tables(shaped).items()}
    assert [(r.node_id, r.is_main, r.scienceOffices_state) for r in tables["node_of_science"]] == [(5, True, "array_mixed")]
    assert [r.node_id for r in tables["node_of_high"]] == [6] and [r.node_id for r in tables["node_without_office"]] == [7] and not tables["node_of_both"]
    assert sorted((r.item_no, r.office_id, r.bureau_type) for r in tables["office_bureau"]) == [(1, 1, "medical"), (3, 3, None)]
    assert [(r.office_id, r.bureau_en) for r in tables["office_bureau_textual"]] == [(4, "y")]
    assert [(r.office_id, r.first_year) for r in tables["office_plain_textual"]] == [(2, 900)] and "bureau_type" not in tables["office_plain"][0]
    assert [(r.item_no, r.zh) for r in tables["office_unkeyed"]] == [(4, "x")]
    routed = [(r.record_id, r.node_no, getattr(r, "list_name", "nodes"), getattr(r, "item_no", 0)) for rows in tables.values() for r in rows]
    assert sorted(routed) == keys_
    assert nested.office_table(shaped).count() == 7 and nested.node_table(shaped).count() == 3


def test_repeated_and_empty_input(spark):
    payload = json.dumps({"nodes": [{"id": 1}]})
    df = spark.createDataFrame([(1, payload, ""), (1, payload, "")], SCHEMA)
    assert nested.object_keys(nested.shapes(df)).count() == 1 and nested.node_table(nested.shapes(df)).count() == 1
    assert nested.documents(df).count() == 1 and nested.documents(df, once=False).count() == 2
    assert nested.object_keys(nested.shapes(df.limit(0))).count() == 0
