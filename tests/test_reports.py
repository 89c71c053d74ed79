from prosopa.operators import attributes, graph, sequences


def test_most_common_settles_ties_and_skips_blanks(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (" ",), (None,)], "v string")
    assert [tuple(r) for r in attributes.most_common(rows, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert attributes.most_common(rows.limit(0), "v", 2).count() == 0


def test_network_view_and_summary(spark):
    nodes = spark.createDataFrame(
        [(1, "main", "Ann", "x"), (2, "high", "Dan", "y"), (3, "bridge", None, "x"), (4, None, "Annex", None)], "id long, node_type string, name string, dynasty string"
    )
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "source long, target long")
    shown, kept = graph.network_view(nodes, edges, ["main", "high"])
    assert {r.id for r in shown.collect()} == {1, 2} and [(r.source, r.target) for r in kept.collect()] == [(1, 2)]
    assert {r.id for r in graph.network_view(nodes, edges, text="AN")[0].collect()} == {1, 2, 4}
    assert {r.id for r in graph.network_view(nodes, edges, text="3")[0].collect()} == {3}
    assert {r.id for r in graph.network_view(nodes, edges, text="an", dynasty="x")[0].collect()} == {1}
    links = spark.createDataFrame([(1, 3), (2, 3), (1, 4)], "source long, target long")
    paths = spark.createDataFrame([(1, 2, 2, [1, 3, 2])], "main long, high long, distance int, path array<long>")
    roles = graph.roles(links, nodes.where("id = 1").select("id"), paths)
    assert {tuple(r) for r in roles.collect()} == {(1, "main", True, False, False, False), (2, "high", False, True, False, False), (3, "bridge", False, False, True, True), (4, "other", False, False, False, True)}
    category = spark.createDataFrame([(1, 3, "direct"), (1, 4, "direct"), (1, 3, "path")], "source long, target long, category string")
    offices = spark.createDataFrame([(7, True), (8, False)], "office long, used boolean")
    bureaus = spark.createDataFrame([(1, "x"), (1, "x"), (5, None)], "id long, bureau string")
    summary = graph.network_summary(roles, category, paths, nodes.where("id = 2").select("id"), offices, bureaus)
    told = dict(map(tuple, summary.collect()))
    assert told["nodeCount"] == 4 and told["directPersonCount"] == 2 and told["edgeCount"] == 3 and told["directEdgeCount"] == 2 and told["pathCount"] == 1
    assert told["mainWithDirectRelationsCount"] == 1 and told["usedScienceOfficeCount"] == 1 and told["scienceOfficeCount"] == 2 and told["bureau_x"] == 1
    clean = graph.check_paths(roles, paths, summary, category).collect()
    assert len(clean) == 6 and all(r.offenders == 0 for r in clean)
    wrong = spark.createDataFrame([(9, 4, 1, [9, 4])], "main long, high long, distance int, path array<long>")
    off = {r.check_name: (r.offenders, r.first) for r in graph.check_paths(roles, wrong.unionByName(paths), summary, category).collect()}
    assert off["path_main"] == (1, 9) and off["path_high"] == (1, 4) and off["path_node"] == (1, 9) and off["pathCount"] == (1, 1) and off["nodeCount"][0] == 0


def test_cluster_summary_with_unknown_spans(spark):
    schema = "c_personid long, era string, posting_count long, technical_pct double, ever_medical int, span_years int, first_state string, last_state string"
    rows = [(1, "e", 2, 50.0, 1, 10, "a", "b"), (2, "e", 4, 0.0, 0, None, "a", "c"), (3, "f", 1, 0.0, 0, None, None, None)]
    got = {r.era: r for r in sequences.cluster_summary(spark.createDataFrame(rows, schema), "era").collect()}
    e, f = got["e"], got["f"]
    assert (e.persons, e.mean_postings, e.spans, e.median_span, e.common_first_state, e.common_last_state, e.ever_medical_pct) == (2, 3.0, 1, 10.0, "a", "b", 50.0)
    assert f.mean_span is None and f.common_first_state is None


def test_medoid_report_weighs_distances(spark):
    placed = spark.createDataFrame([(1, 7, "career_type_1", 0, 3), (2, 7, "career_type_1", 2, 1)], "sequence_no long, medoid long, career_type string, distance int, weight long")
    assert tuple(sequences.medoid_report(placed).first()) == ("career_type_1", 7, 2, 4, 0.5)
