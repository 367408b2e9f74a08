"""Formats round trip; every registered query gives what its SQL gives."""

import json
import math
import os

import duckdb
import pytest

from loomgraph import catalog
from loomgraph.functions import cells
from loomgraph.sources import formats as f

SF = "/root/testdata/sf0.001"
HEAVY = {"metric_louvain", "layout_force"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - HEAVY))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and rows
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted((tuple(_norm(r[names.index(n)]) for n in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(_norm(r[n]) for n in order) for r in rows), key=str) == expected


@pytest.mark.parametrize("name", ["project_sources", "project_targets"])
def test_projection_spends_its_budget(spark, name):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet'")
    want = sorted(c.execute(catalog.oracle_sql()[name]).fetchall())
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, d).select("s", "t", "weight", "used", "total").collect())
    assert got == want and 0 < got[0][3] < got[0][4]


PARSED = f.Parsed([{"source": "a", "target": "b", "weight": 2, "note": 'say "hi"'}, {"source": "b", "target": "c", "weight": 1.5, "note": None}], [{"id": "a", "big": True}, {"id": "b", "big": False}, {"id": "c", "big": None}], f.Mapping("source", "target"), "id")


@pytest.mark.parametrize("write, read", [(f.write_gexf, f.parse_gexf), (f.write_graphml, f.parse_graphml)])
def test_xml_round_trip(write, read):
    back = read(write(PARSED))
    assert back.edges == PARSED.edges and back.nodes == PARSED.nodes and back.directed


def test_dot():
    back = f.parse_dot(f.write_dot(PARSED))
    assert [(e["source"], e["target"], e["note"]) for e in back.edges] == [("a", "b", 'say "hi"'), ("b", "c", None)]
    g = f.parse_dot('strict graph g { node [shape=box]; a -- {b c} [w=1]; subgraph cluster_1 { label="Left"; d; e } d -- e; a [pos="1,2!"]; /* x */ f:p -- a // y\n }')
    assert [(e["source"], e["target"]) for e in g.edges] == [("a", "b"), ("a", "c"), ("d", "e"), ("f", "a")]
    nodes = {n["id"]: n for n in g.nodes}
    assert nodes["a"]["y"] == -2 and nodes["a"]["shape"] == "box" and nodes["d"]["Cluster"] == "Left" and not g.directed
    with pytest.raises(ValueError):
        f.parse_dot("graph {")


def test_json():
    assert f.parse_json('{"a": 1, "b": {"c": 2}}').edges == [{"a": 1, "b": '{"c": 2}'}]
    assert f.parse_json('{"a": 1}\n{"b": 2}').edges == [{"a": 1, "b": None}, {"a": None, "b": 2}]
    with pytest.raises(ValueError, match="line 2"):
        f.parse_json('{"a": 1}\n{')
    g = f.parse_json(json.dumps({"directed": False, "nodes": [{"name": "x"}, {"name": "y"}], "links": [{"source": 0, "target": 1}]}))
    assert g.edges == [{"source": "x", "target": "y"}] and not g.directed and g.node_id == "name"


def test_text_formats(spark):
    p = f.parse_pasted("from\tto\na\tb\n\nc\td\n")
    assert p.edges == [{"from": "a", "to": "b"}, {"from": "c", "to": "d"}] and p.mapping.source == "from"
    assert list(f.parse_pasted("1,2\n3,4").edges[0]) == ["Column A", "Column B"]
    assert [f.detect(n, t) for n, t in (("x.gexf", ""), ("x", "<graphml>"), ("x.json", "{}"), ("x", "digraph { }"), ("x.csv", "a,b"))] == ["gexf", "graphml", "json", "dot", "delimited"]
    assert f.decode_payload(f.encode_payload("héllo" * 100)) == "héllo" * 100
    doc = f.to_doc(spark, PARSED)
    for kind in ("csv", "workspace", "gexf", "graphml", "dot", "link"):
        assert f.export(doc, kind)
    w = f.parse_workspace(f.export(doc, "workspace"))
    assert len(w.edges) == 2 and w.mapping.source == "source"
    with pytest.raises(ValueError):
        f.parse_workspace('{"version": 99, "edges": []}')
    with pytest.raises(ValueError):
        f.check_source_url("http://user:pw@host/x")
    assert f.csv_text([{"a": "=1+1", "b": "-5", "c": 'q"'}]) == "a,b,c\n'=1+1,-5,\"q\"\"\"\n"


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,w\na,b,1\nb,c,=x\n")
    df = f.read_table(spark, str(tmp_path / "e.csv"))
    assert df.count() == 2 and f.probe(str(tmp_path / "e.csv")) == (2, True)
    f.write_csv(df, str(tmp_path / "out"))
    assert {r["w"] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"1", "'=x"}
    with pytest.raises(ValueError):
        f.read_table(spark, "x.bin")


def test_cells(spark):
    rows = [(" 5 ", "true", 1.0), (".5", "No", 1e8), ("1d", " ", float("nan")), ("NaN", None, 2.5), (" ", "x", None), ("0x10", "YES", -3.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    got = df.select(cells.num(df, "a").alias("n"), cells.coerce(df, "b", "bool").alias("b"), cells.cell_id(df, "c").alias("c"), cells.cell_key(df, "a").alias("k")).collect()
    assert [r["n"] for r in got] == [5.0, 0.5, None, None, None, None]
    assert [r["b"] for r in got] == [True, False, None, None, None, True]
    assert [r["c"] for r in got] == ["1", "100000000", None, "2.5", None, "-3"] and got[4]["k"] == ""
    colors = spark.createDataFrame([("#abc",), ("#AABBCCDD",), ("rgb(255, 0, 16)",), ("Red",), ("nope",)], "c string")
    assert [r[0] for r in colors.select(cells.parse_color(colors["c"])).collect()] == ["#aabbcc", "#aabbcc", "#ff0010", "#ff0000", None]
    x, y = spark.range(1).select(*cells.mercator(*[cells.F.lit(v) for v in (90.0, 180.0)])).first()
    assert math.isclose(x, math.pi) and math.isclose(y, -math.pi, rel_tol=1e-6)
    t = spark.createDataFrame([("2024-01-09",), ("2024",), ("no date",)], "t string")
    assert [r[0] for r in t.select(cells.tms(t, "t")).collect()] == [1704758400000.0, 2024.0, None]


def test_streamed_rows(spark, tmp_path):
    from loomgraph.streaming.updates import append_edges

    spark.createDataFrame([("a", "b")], "s string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t string").parquet(str(tmp_path / "in"))
    append_edges(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
