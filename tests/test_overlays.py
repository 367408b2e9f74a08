"""Versions that an overlay is read off are written once, dealt evenly."""

from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.model import POS, GraphDoc, Mapping, first_rows
from loomgraph.operators import overlay, style


def _tasks(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_versions_are_written_once_and_dealt(spark, monkeypatch):
    edges = spark.range(400).selectExpr("concat('a', id) AS s", "concat('b', id % 7) AS t", f"id AS {POS}").coalesce(1)
    nodes = edges.select(F.col("s").alias("id"), POS)
    doc = overlay.held(GraphDoc(edges, Mapping("s", "t"), nodes, "id", True))
    n = spark.sparkContext.defaultParallelism
    assert (_tasks(doc.edges), _tasks(doc.nodes)) == (n, n) and doc.edges.count() == 400 and overlay.held(doc) is doc
    tables, cut = [], overlay.cut
    monkeypatch.setattr(overlay, "cut", lambda df, *more: tables.append(df.columns) or cut(df, *more))
    report = catalog._overlaid(spark, "/root/testdata/sf0.001")[1].first()
    assert report["edits_kept"] == 2 and len(tables) == 19


def test_first_rows_are_found_without_a_join(spark):
    rows = spark.createDataFrame([(" a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("", 0, "no"), (None, 5, "no")], f"id string, {POS} long, v string")
    got = first_rows(rows, "id")
    assert sorted((r["__id"], r["v"]) for r in got.collect()) == [("a", "y"), ("b", "z")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.columns == ["id", POS, "v", "__id"]


def test_layers_read_written_depths(spark, monkeypatch):
    depths = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 2), ("d", 2, 3)], "id string, depth int, pos long")
    links = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "s string, t string")
    read, ranked = [], style.ranked
    monkeypatch.setattr(style, "ranked", lambda df, *order: read.append("LocalTableScan" in df._jdf.queryExecution().executedPlan().toString() or not df.inputFiles()) or ranked(df, *order))
    at = {r["id"]: (r["x"], r["y"]) for r in style.layout_layers(depths, links).collect()}
    assert at == {"a": (-75.0, -130.0), "b": (75.0, -130.0), "c": (0.0, 0.0), "d": (0.0, 130.0)}
    assert read == [False, False, False]
