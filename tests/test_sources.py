import pytest

from prosopa.sources import readers, sinks
from prosopa.streaming import transitions


def test_required_tables(spark):
    spark.range(1).createOrReplaceTempView("there")
    readers.require_tables(spark, ["there"])
    with pytest.raises(ValueError, match="missing tables: a, b"):
        readers.require_tables(spark, ["b", "there", "a"])


def test_csv_round_trip_and_optional_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "工", None), (2, "b,c", 2.5)], "id long, t string, x double")
    sinks.write_csv(df, str(tmp_path / "out"), single=True)
    back = readers.read_csv(spark, str(tmp_path / "out"), "id long, t string, x double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert readers.read_csv(spark, str(tmp_path / "no.csv"), "id long, t string", ["id"], optional=True).columns == ["id"]


def test_graph_files_and_views(spark, tmp_path):
    nodes = spark.createDataFrame([(70, "a"), (30, "b"), (50, None)], "id long, c string")
    edges = spark.createDataFrame([(30, 70)], "source long, target long")
    sinks.write_graph_files(nodes, edges, str(tmp_path), "c", ["a", "b"], ["c"])
    line = spark.read.text(str(tmp_path / "edges")).first()[0].split()
    told = {r["node_no"]: r["c"] for r in spark.read.option("header", True).csv(str(tmp_path / "attributes")).collect()}
    assert line == ["1", "3"] and told == {"1": "b", "2": None, "3": "a"}
    sinks.write_graph_files(nodes.limit(0), edges, str(tmp_path / "none"), "c", ["a", "b"], ["c"])
    assert spark.read.text(str(tmp_path / "none" / "edges")).count() == 0
    points = spark.createDataFrame([(0.0, 1.0, "<a>"), (2.0, 3.0, None)], "x double, y double, n string")
    marks = [r.value for r in sinks.svg_marks(points, "n").collect()]
    assert len(marks) == 2 and any("&lt;a&gt;" in m for m in marks) and sinks.svg_marks(points.limit(0), "n").count() == 0


def test_json_and_whole_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "工", None), (2, None, 2.5)], "id long, t string, x double")
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, readers.read_json(spark, str(tmp_path / "j"), "id long, t string, x double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "docs").mkdir()
    for i in range(2):
        (tmp_path / "docs" / f"{i}.json").write_text('{"nodes":\n[]}')
    got = readers.read_documents(spark, str(tmp_path / "docs")).collect()
    assert [r.payload for r in got] == ['{"nodes":\n[]}'] * 2 and len({r.record_id for r in got}) == 2


def test_windowed_counts_on_a_stream(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'b'")
    df.write.parquet(str(tmp_path / "in"))
    stream = transitions.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.events) for r in spark.table("seen").collect()) == [("a", 2), ("b", 1)]
    assert transitions.windowed_counts(df, "ts", "k").count() == 2
