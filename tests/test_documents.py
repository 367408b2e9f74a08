"""Overlays, columns, styles, projections, layers, chains' plans: on the small cases that the survey lists."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import cells, display
from loomgraph.model import POS, GraphDoc, Mapping, build_doc, first_rows, guess_mapping, with_positions
from loomgraph.operators import arrange, chain, columns, community, details, edits, graph, metrics, overlay, stats, style, transforms, traverse
from loomgraph.operators.chain import Condition, Step, apply_chain
from loomgraph.plans import scratch
from loomgraph.sources import workspace as W
from loomgraph.sources.datasource import DataSource, Selection


@pytest.fixture(scope="module")
def base(spark):
    edges = spark.createDataFrame([("A", "B", 1.0, 0), ("B", "C", 2.0, 1)], f"Source string, Target string, Weight double, {POS} long")
    nodes = spark.createDataFrame([("A", "red", 0), ("B", "red", 1), ("C", "blue", 2)], f"Id string, Team string, {POS} long")
    return build_doc(edges, nodes, Mapping("Source", "Target", ("Weight",)), "Id")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def team(doc, value, *ids):
    return doc.with_(nodes=doc.nodes.withColumn("Team", F.when(F.col("Id").isin(*ids), value).otherwise(F.col("Team"))))


def test_edited_cells_win(base):
    now = team(base, "green", "A")
    file = team(base, "purple", "A", "B")
    file = file.with_(edges=file.edges.withColumn("Weight", F.lit(5.0)))
    doc, report = overlay.merge(now, overlay.diff(base, now), file)
    assert rows(doc.nodes, "Id", "Team") == [("A", "green"), ("B", "purple"), ("C", "blue")]
    assert rows(doc.edges, "Weight") == [(5.0,), (5.0,)]
    assert report.first().asDict() == {"updated": 5, "added": 0, "edits_kept": 1, "deletions_held": 0, "kept_extras": 0}


def test_deletions_hold_and_extras_survive(base):
    now = edits.delete_nodes(base, ["C"])
    doc, report = overlay.merge(now, overlay.diff(base, now), base)
    assert rows(doc.nodes, "Id") == [("A",), ("B",)] and rows(doc.edges, "Target") == [("B",)]
    assert report.first()["deletions_held"] == 2
    now = team(edits.add_row(base, "nodes", {"Id": "D", "Team": "own"}), "edited", "C")
    file = base.with_(nodes=base.nodes.where("Id <> 'C'"), edges=base.edges.where("Target <> 'C'"))
    doc, report = overlay.merge(now, overlay.diff(base, now), file)
    assert rows(doc.nodes, "Id", "Team") == [("A", "red"), ("B", "red"), ("C", "edited"), ("D", "own")]
    assert report.first()["kept_extras"] == 2


def test_renames_and_merges_replay(base):
    now = edits.rename_nodes(base, {"B": "Bee"})
    delta = overlay.diff(base, now)
    assert delta.renames == (("B", "Bee"),) and delta.added.isEmpty() and delta.deleted.isEmpty()
    doc, _ = overlay.merge(now, delta, base)
    assert rows(doc.nodes, "Id") == [("A",), ("Bee",), ("C",)] and rows(doc.edges, "Source", "Target") == [("A", "Bee"), ("Bee", "C")]
    merged = edits.rename_nodes(base, {"C": "A"})
    assert overlay.diff(base, merged).renames == (("C", "A"),)


def test_column_changes_replay(base):
    now = columns.rename(base, "nodes", "Team", "Group")
    delta = overlay.diff(base, now)
    assert delta.column_ops == (("rename", "nodes", "Team", "Group"),) and delta.dirty.isEmpty()
    doc, _ = overlay.merge(now, delta, team(base, "purple", "A"))
    assert rows(doc.nodes, "Id", "Group") == [("A", "purple"), ("B", "red"), ("C", "blue")]
    now = columns.add(columns.delete(base, "nodes", "Team"), "nodes", "Note", "number")
    ops = overlay.diff(base, now).column_ops
    assert ops == (("add", "nodes", "Note", "double"), ("delete", "nodes", "Team"))
    retyped = columns.retype(base, "edges", "Weight", "text")
    assert overlay.diff(base, retyped).column_ops == (("retype", "edges", "Weight", "string"),)


def _stepwise(nodes, edges, renames):
    """The series replayed one by one on plain rows: (id, place, cells...) and (source, target)."""

    def together(rows):
        out = {}
        for i, place, *row in sorted(rows, key=lambda r: r[1]):
            held = out.setdefault(i, [i, place, *[None] * len(row)])
            for k, x in enumerate(row, 2):
                held[k] = x if held[k] is None else held[k]
        return [tuple(r) for r in out.values()]

    for old, new in renames:
        if old != new:
            nodes = together([(new if r[0] == old else r[0], *r[1:]) for r in nodes])
            edges = [tuple(new if e == old else e for e in row) for row in edges]
    return sorted(nodes), sorted(edges)


def _renamed_tables(spark, nodes, edges, renames):
    doc = GraphDoc(with_positions(spark.createDataFrame(edges, "s string, t string").coalesce(1)), Mapping("s", "t"), spark.createDataFrame(nodes, f"id string, {POS} long, a string, b string"), "id", True)
    new = edits.rename_series(doc, renames)
    return new, (sorted(tuple(r) for r in new.nodes.select("id", POS, "a", "b").collect()), sorted(tuple(r) for r in new.edges.select("s", "t").collect()))


def test_a_series_of_renames_is_the_same_as_one_after_the_other(spark):
    rng = random.Random(5)
    for size, count in ((6, 4), (12, 40), (40, 10_000)):
        names = [f"n{k}" for k in range(size)]
        places = rng.sample(range(1000), size)
        cell = lambda: rng.choice([None, None, "x", "y", "z"])
        nodes = [(n, p, cell(), cell()) for n, p in zip(names, places)]
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
        pool = names + [f"new{k}" for k in range(size)]
        renames = [(rng.choice(pool), rng.choice(pool)) for _ in range(count)]
        assert _renamed_tables(spark, nodes, edges, renames)[1] == _stepwise(nodes, edges, renames)


def test_chains_cycles_and_names_that_come_free(spark):
    nodes = [("a", 5, "A", None), ("b", 2, None, "B"), ("c", 3, "C", "CC"), ("d", 9, None, None)]
    edges = [("a", "b"), ("c", "d")]
    for renames in ([("a", "b"), ("b", "c")], [("a", "b"), ("b", "a")], [("a", "x"), ("d", "a"), ("x", "d")], [("a", "a")], [("q", "a")], []):
        assert _renamed_tables(spark, nodes, edges, renames)[1] == _stepwise(nodes, edges, renames)


def test_plans_of_many_renames_are_no_larger(spark):
    nodes, edges = [(f"n{k}", k, "x", None) for k in range(30)], [("n1", "n2")]
    sizes = []
    for count in (3, 2000):
        doc, _ = _renamed_tables(spark, nodes, edges, [(f"n{k % 30}", f"m{k}") for k in range(count)])
        sizes.append(len(doc.nodes._jdf.queryExecution().analyzed().toString()))
    assert sizes[1] < 1.2 * sizes[0]


def test_overlays_add_up_and_are_kept(spark, base):
    one = team(base, "green", "A")
    two = edits.rename_nodes(one, {"A": "Ann"})
    three = edits.add_row(two, "nodes", {"Id": "D"})
    four = edits.delete_nodes(three, ["D", "C"])
    whole = overlay.empty(spark)
    for a, b in ((base, one), (one, two), (two, three), (three, four)):
        whole = overlay.extend(whole, overlay.diff(a, b))
    held = overlay.to_json(whole)
    assert held["cells"] == [["nodes", "Ann", "", 0, "Team"]] and held["added"] == [] and held["renames"] == [{"from": "A", "to": "Ann"}]
    assert [x[:3] for x in held["deleted"]] == [["edges", "B", "C"], ["nodes", "C", ""]]
    again = overlay.from_json(spark, held | {"deleted": [*held["deleted"], "nonsense", ["x"]]})
    assert overlay.to_json(again) == held and not again.is_empty() and overlay.empty(spark).is_empty()
    doc, _ = overlay.merge(four, again, base)
    assert rows(doc.nodes, "Id", "Team") == [("Ann", "green"), ("B", "red")]


def test_columns_follow(base):
    doc = columns.set_role(base, "nodes", "Team", "color")
    doc = columns.rename(doc, "nodes", "Team", " Colour ")
    assert doc.roles == {("nodes", "Colour"): "color"} and columns.rename(doc, "nodes", "Colour", "Id") is doc
    assert columns.rename(base, "edges", "Source", "From").mapping.source == "From" and columns.rename(base, "nodes", "Id", "Key").node_id == "Key"
    assert columns.delete(base, "edges", "Source") is base and "Weight" not in columns.delete(base, "edges", "Weight").mapping.attrs
    assert columns.node_style_columns(base) == ["Team", "Weight"] and columns.edge_style_columns(base) == ["Weight"]
    assert columns.node_detail_columns(base) == ["Team"] and columns.node_detail_columns(base, ()) == [] and columns.edge_detail_columns(base) == ["Weight"]
    assert columns.color_columns(base, "nodes") == ["Team"]  # red and blue are colours
    with pytest.raises(ValueError):
        columns.set_role(base, "nodes", "Team", "smell")
    assert columns.visible(base.nodes, ["Team"], ()).columns == ["Team", "Id"]
    look = style.Style(node_color="cell:Team", node_label="column:Team", node_types=("Team", {"red": style.TypeStyle(label_column="Team", attrs=("Team",))}))
    moved = style.retarget_style(look, doc, "Team", "Colour")
    assert (moved.node_color, moved.node_label, moved.node_types[0], moved.node_types[1]["red"].attrs) == ("cell:Colour", "column:Colour", "Colour", ("Colour",))
    gone = style.retarget_style(look, columns.delete(base, "nodes", "Team"), "Team", None)
    assert (gone.node_color, gone.node_label, gone.node_types) == ("none", "none", None)
    assert edits.set_cell(base, "nodes", 1, "Id", "Bee").edges.where("Source = 'Bee' OR Target = 'Bee'").count() == 2
    assert rows(edits.map_cells(base, "nodes", "Id", F.lower("Id")).edges, "Source") == [("a",), ("b",)]
    assert details.guess_style(columns.set_role(base, "nodes", "Team", "color")).node_color == "cell:Team"


def test_styles(spark, base):
    doc = base.with_(edges=base.edges.withColumn("Paint", F.when(F.col("Source") == "A", "rebeccapurple")))
    g = graph.base_graph(doc)
    nodes, links = style.apply_style(g, doc, style.Style(node_color="cell:Team", node_size="cell:Weight", edge_color="cell:Paint", node_label="column:Team"))
    assert rows(nodes, "id", "color", "radius", "label") == [("A", "#ff0000", 1.0, "red"), ("B", "#ff0000", 1.0, "red"), ("C", "#0000ff", 2.0, "blue")]
    assert rows(links, "s", "color") == [("A", "#663399"), ("B", None)]
    plain, _ = style.apply_style(g, doc, style.Style(node_size="metric:uniform"))
    assert rows(plain, "radius") == [(8.0,)] * 3
    ranked, _ = style.apply_style(g, doc, style.Style(node_color="metric:pagerank", node_size="metric:in"))
    assert all(r["value"] > 0 for r in ranked.collect()) and min(r["radius"] for r in ranked.collect()) == 4.5
    moved = style.spread(spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, x double, y double"), 2.0, spark.createDataFrame([("b", 9.0, 9.0)], "id string, x double, y double"))
    assert rows(moved, "id", "x", "y") == [("a", 2.0, 4.0), ("b", 9.0, 9.0)]


def test_projection_runs_by_first_appearance(spark):
    pairs = [("soup", "onion"), ("soup", "stock"), ("stew", "onion"), ("stew", "stock"), ("stew", "beef"), ("salad", "onion")]
    edges = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], f"Dish string, Ingredient string, {POS} long")
    nodes = spark.createDataFrame([("soup", "first", 0), ("stew", "main", 1), ("onion", None, 2)], f"Id string, Course string, {POS} long")
    doc = build_doc(edges, nodes, Mapping("Dish", "Ingredient"), "Id")
    out, report = transforms.project_doc(doc, "source")
    assert rows(out.edges, "Source", "Target", "Shared count") == [("soup", "salad", 1), ("soup", "stew", 2), ("stew", "salad", 1)]
    assert rows(out.nodes, "Id") == [("soup",), ("stew",)] and report.first().asDict() == {"nodes": 2, "edges": 3, "used": 3, "total": 3}
    assert rows(transforms.project_doc(doc, "target")[0].edges, "Source", "Target", "Shared count") == [("onion", "beef", 1), ("onion", "stock", 2), ("stock", "beef", 1)]
    few, report = transforms.project_doc(doc, "source", 3)
    assert {r["Shared count"] for r in few.edges.collect()} == {1} and report.first()["used"] == 1


def test_layers_follow_their_parents(spark):
    links = spark.createDataFrame([("a", "y"), ("b", "x"), ("x", "z")], "s string, t string")
    depths = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("y", 3, 3), ("x", 3, 2), ("w", 3, 4), ("z", 5, 5)], "id string, depth int, pos long")
    at = {r["id"]: (r["x"], r["y"]) for r in style.layout_layers(depths, links).collect()}
    assert at == {"a": (-75.0, -130.0), "b": (75.0, -130.0), "y": (-150.0, 0.0), "w": (0.0, 0.0), "x": (150.0, 0.0), "z": (0.0, 130.0)}
    assert style.layout_layers(depths.limit(0), links).count() == 0


def test_plans_of_chains_grow_evenly(spark):
    edges = spark.createDataFrame([(f"n{k % 40}", f"n{k * 7 % 41}", k) for k in range(300)], f"s string, t string, {POS} long")
    doc = build_doc(edges, mapping=Mapping("s", "t"))

    def size(n):
        steps = [Step("degree", low=1 + k % 2) if k % 4 else Step("mutual", invert=True) for k in range(n)]
        text = apply_chain(doc, steps).graph.nodes._jdf.queryExecution().optimizedPlan().toString()
        return text.count("Relation") + text.count("LogicalRDD") + text.count("LocalRelation"), text.count("Join")

    two, eight = size(2), size(8)
    assert eight[0] <= two[0] + 2 and eight[1] <= two[1] + 2


def test_steps_start_without_effect(spark, base):
    assert chain.default_step("column", base).condition == Condition("Source", excluded=()) and chain.is_neutral(chain.neutral(base.edges, "Source"))
    assert chain.neutral(base.edges, "Weight").is_range and not chain.is_neutral(chain.neutral(base.edges, "Weight"))
    assert chain.default_step("degree", base).low == 1 and chain.default_step("backbone", base).alpha == 0.3 and chain.default_step("timewindow", base).column == "Weight"
    for bad in (Step("column"), Step("timewindow"), Step("degree", mode="some"), Step("ego", depth=-1), Step("nonsense")):
        with pytest.raises(ValueError):
            chain.validate(bad)


def test_headers():
    m = guess_mapping(["Weight", "Manager name", "Employee"])
    assert (m.source, m.target, m.attrs) == ("Manager name", "Employee", ("Weight",))
    m = guess_mapping(["Source", "Other", "Weight"])  # no target to be seen: the first two
    assert (m.source, m.target) == ("Source", "Other")


def test_values_as_typed_and_shown(spark):
    assert [display.parse_cell("number", x) for x in ("4", " 2.5 ", "word", "", "1e3")] == [4, 2.5, "word", None, 1000]
    assert [display.parse_cell("bool", x) for x in ("Yes", "0", "maybe")] == [True, False, "maybe"]
    assert [display.format_metric(x) for x in (None, 3.0, 0.012345, 12.345, float("inf"))] == ["–", "3", "0.012", "12.3", "–"]
    assert display.display_cell(0.5) == "0.5" and display.display_cell(1.0) == "1" and display.display_cell(True) == "true" and display.format_number(2.25) == "2.2"
    assert display.url_file_name("https://x.org/a/b%20c.csv?d#e") == "b c.csv" and display.url_file_name("https://x.org/") == "x.org"
    df = spark.createDataFrame([(" 4.0 ", "YES"), ("word", "maybe"), ("", None)], "a string, b string")
    got = df.select(display.parse_cells(F.col("a"), "number").alias("a"), display.parse_cells(F.col("b"), "bool").alias("b")).collect()
    assert [tuple(r) for r in got] == [("4", "true"), ("word", "maybe"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("RebeccaPurple",), ("#abc",), ("none",)], "c string").select(cells.parse_color(F.col("c"))).collect()] == ["#663399", "#aabbcc", None]


def test_long_walks_and_samples(spark):
    n = 45
    ring = spark.createDataFrame([(f"n{k:02d}", f"n{(k + 1) % n:02d}") for k in range(n)], "s string, t string")
    found = traverse.reach(ring, spark.createDataFrame([("n00",)], "id string"), None, "out")
    assert {r["id"]: r["depth"] for r in found.collect()} == {f"n{k:02d}": k for k in range(n)}
    nodes = spark.createDataFrame([(f"n{k:02d}", k) for k in range(n)], "id string, pos long")
    assert sorted(r["id"] for r in metrics.sources(nodes, 10).collect()) == [f"n{k:02d}" for k in range(0, n, 5)]
    assert metrics.network(nodes, ring.withColumn("w", F.lit(1.0)), most=10).first()["approximate"]
    assert metrics.counts(nodes.unionByName(spark.createDataFrame([("alone", 99)], "id string, pos long")), ring).first().asDict() == {"nodes": 46, "edges": 45, "average_links": 90 / 46, "components": 2}


def test_selection_is_read_again(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 0), ("b", "c", 2.0, 1), ("c", "d", 3.0, 2)], f"src string, dst string, w double, {POS} long")
    source, seeds = DataSource(edges, Mapping("src", "dst")), Selection(("a",), 2)
    assert source.size(seeds).first().asDict() == {"nodes": 3, "edges": 2, "truncated": False}
    first = source.materialize(seeds)
    doc = build_doc(first.edges.drop("__s", "__t"), first.nodes.select("id").withColumn(POS, F.monotonically_increasing_id()), Mapping("src", "dst"), "id")
    now = doc.with_(edges=doc.edges.withColumn("w", F.when(F.col("src") == "a", 9.0).otherwise(F.col("w"))))
    new, report = source.rematerialize(Selection(("a",), 3), now, overlay.diff(doc, now), [details.Recipe("degree")])
    assert rows(new.edges, "src", "w") == [("a", 9.0), ("b", 2.0), ("c", 3.0)] and report.first()["edits_kept"] == 1
    assert rows(new.nodes, "id", "degree") == [("a", 1), ("b", 2), ("c", 2), ("d", 1)]


def test_history_keeps_within_its_budget(base):
    history = edits.History(base, depth=50, least=2, budget=9)
    for k in range(6):
        history.push(base.with_(node_id=base.node_id, mapping=base.mapping))
    assert len(history.past) == 2 and history.undo() is not None and history.redo() is history.now


def test_scratch_is_removed(spark):
    with scratch.scope():
        kept = scratch.cut(spark.range(5).toDF("id"))
        path = kept._cut_path
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert first_rows(spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], f"id string, x int, {POS} long"), "id").collect()[0]["x"] == 1


def test_workspaces(spark, base):
    look = style.Style(node_color="cell:Team", node_types=("Team", {"red": style.TypeStyle(color="#112233", attrs=("Team",))}))
    steps = [Step("column", table="nodes", condition=Condition("Team", selected=("red",))), Step("ego", centers=("A",), depth=2, invert=True)]
    doc = columns.set_role(base, "nodes", "Team", "color")
    delta = overlay.diff(base, team(base, "green", "A"))
    held = W.Workspace(doc, steps, look, "grid", True, {"A": (1.239, 2.0)}, ("A",), (details.Recipe("degree"),), delta, {"url": "https://x.org/a.parquet", "depth": 99, "edgeLimit": 0})
    text = W.write(held)
    back = W.read(spark, text)
    assert back.chain == steps and back.style == look and (back.layout, back.show_isolated, back.pinned, back.recipes) == ("grid", True, ("A",), (details.Recipe("degree"),))
    assert back.positions == {"A": (1.24, 2.0)} and back.doc.roles == doc.roles and back.doc.mapping == doc.mapping and overlay.to_json(back.edits) == overlay.to_json(delta)
    assert (back.source["depth"], back.source["edgeLimit"]) == (6, 1)
    assert rows(back.doc.edges, "Source", "Weight") == rows(base.edges, "Source", "Weight") and back.doc.edges.dtypes == base.edges.select("Source", "Target", "Weight", POS).dtypes
    odd = json.loads(text) | {"chain": [{"kind": "smell"}, {"kind": "degree", "low": 2}, 5], "layout": "nowhere", "style": {"node_color": 5}, "computed": [{"metric": "x"}], "source": {"url": "https://u:p@x.org/"}}
    back = W.read(spark, json.dumps(odd))
    assert back.chain == [Step("degree", low=2)] and back.layout == "force" and back.style == style.Style() and back.recipes == () and back.source is None
    for bad in ("no", "{}", json.dumps(odd | {"version": 99}), json.dumps(odd | {"doc": {"edges": {}}})):
        with pytest.raises(ValueError):
            W.read(spark, bad)
    made = W.build(base.edges, base.nodes, roles={"Team": "color"}, color="Team", edge_width="Weight", layout="circle")
    assert made.style.node_color == "cell:Team" and made.style.edge_width == "column:Weight"
    for wrong in ({"color": "Smell"}, {"layout": "nowhere"}, {"roles": {"Team": "smell"}}, {"label": "Weight"}):
        with pytest.raises(ValueError):
            W.build(base.edges, base.nodes, **wrong)
    now, report = W.update(W.replace(held, doc=team(doc, "green", "A")), base.edges.drop("Weight"), team(base, "purple", "A", "B").nodes)
    assert rows(now.doc.nodes, "Id", "Team", "degree") == [("A", "green", 1), ("B", "purple", 2), ("C", "blue", 1)] and report.first()["edits_kept"] == 1 and now.doc.mapping.attrs == ()
    assert W.same_source(W.source_ref("a", 3), {"name": "a", "size": 3}) and not W.same_source(W.source_ref("a", 3), W.source_ref("a", 3, "https://x.org/a"))


def test_tables_and_pictures(spark):
    df = spark.createDataFrame([("item 10", 1.0, 0), ("item 9", 3.0, 1), (None, 2.0, 2), ("Item 2", None, 3)], f"a string, b double, {POS} long")
    assert [r["a"] for r in stats.sort_rows(df, "a").collect()] == ["Item 2", "item 9", "item 10", None]
    assert [r["b"] for r in stats.sort_rows(df, "b", True).collect()] == [3.0, 2.0, 1.0, None] and stats.search_only(df, ["a"], "ITEM 9").count() == 1
    one = stats.group_tables(df.withColumn("g", F.lit("x")), "g", ["b", "a"]).first()
    assert (one["n"], one["b_sum"], one["b_avg"], one["a_max"]) == (4, 6.0, 2.0, None)
    calls, held = [], stats.Remembered(1)
    work = lambda t: calls.append(1) or stats.numeric_range(t, "b")
    assert held.get(df, "b", work).first()["high"] == held.get(df, "b", work).first()["high"] == 3.0 and len(calls) == 1
    assert [r["b"] for r in edits.replace_in_column(df, "b", "3", "7").orderBy(POS).collect()] == [1.0, 7.0, 2.0, None]
    cells_ = ["data:image/png;base64,AAAA", "data:text/plain,x", "https://x.org/a.png", "<svg width='1'></svg>", "iVBORw0KGgo" + "A" * 30, "word", None]
    got = [r[0] for r in spark.createDataFrame([(c, k) for k, c in enumerate(cells_)], "c string, k int").orderBy("k").select(cells.image_source(F.col("c"))).collect()]
    assert got == [cells_[0], None, cells_[2], "data:image/svg+xml;charset=utf-8,%3Csvg%20width%3D%271%27%3E%3C%2Fsvg%3E", f"data:image/png;base64,{cells_[4]}", None, None]
    dates = spark.createDataFrame([("2024-01-02",), ("1/2/2024",), ("2024/01/02",), ("Jan 2, 2024",), ("2 January 2024",), ("no date 5",)], "c string")
    assert [r[0] for r in dates.select(cells.tms(dates, "c")).collect()] == [1704153600000.0] * 5 + [None]


def test_drawings_and_large_graphs(spark):
    pairs = [(f"n{k}", f"n{(k * 3 + 1) % 30}") for k in range(30)]
    links = spark.createDataFrame(pairs, "s string, t string").withColumn("w", F.lit(1.0))
    nodes = spark.createDataFrame([(f"n{k}", f"a label {k}", 5.0) for k in range(30)], "id string, group string, radius double")
    for kind in ("springs", "force labels"):
        at = np.array([(r["x"], r["y"]) for r in arrange.layout(nodes, kind, links).collect()])
        gaps = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) + 99 * np.eye(30)
        assert np.isfinite(at).all() and gaps.min() > 9.5
    placed = nodes.select("id", F.monotonically_increasing_id().alias("pos"))
    large = community.communities(placed, links, most_pairs=1).collect()
    labels = {r["id"]: int(r["community"]) for r in large}
    ids = sorted(labels)
    held = {tuple(sorted((ids.index(a), ids.index(b)))) for a, b in pairs if a != b}
    weight = lambda a, b: sum(1.0 for x, y in pairs if {x, y} == {ids[a], ids[b]})
    want = community.modularity(30, [(a, b, weight(a, b)) for a, b in held], [labels[i] for i in ids])
    assert large[0]["method"] == "label spreading" and abs(large[0]["modularity"] - want) < 1e-9
    with pytest.raises(ValueError):
        community.communities(placed, links, stable=True, most_pairs=1)
    chain_ = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(10)], "s string, t string")
    assert traverse.reach(chain_, spark.createDataFrame([("n0",)], "id string"), None, "out", budget=3).count() == 4


def test_communities_are_optimal_and_drawn_apart(spark):
    four = ["a", "b", "c", "d"]
    edges = [(f"{x}{g}", f"{y}{g}") for g in "12" for x in four for y in four if x < y] + [("a1", "a2")]
    links = spark.createDataFrame(edges, "s string, t string").withColumn("w", F.lit(1.0))
    nodes = spark.createDataFrame([(f"{x}{g}", k) for k, (g, x) in enumerate((g, x) for g in "12" for x in four)], "id string, pos long")
    got = community.communities(nodes, links, stable=True).collect()
    label = {r["id"]: r["community"] for r in got}
    assert len(set(label.values())) == 2 and len({label[f"{x}1"] for x in four}) == 1 and {r["stability"] for r in got} == {1.0}

    def modularity(of):
        degree = {n: sum(n in e for e in edges) for n in of}
        m = len(edges)
        inside = sum(of[x] == of[y] for x, y in edges) / m
        return inside - sum(degree[x] * degree[y] for x in of for y in of if of[x] == of[y]) / (4 * m * m)

    best = modularity(label)
    assert abs(got[0]["modularity"] - best) < 1e-9 and 0.3 < best < 0.5
    assert all(modularity(label | {n: c}) <= best + 1e-12 for n in label for c in set(label.values()))
    packed = arrange.layout(nodes.select("id", F.substring("id", 2, 1).alias("group"), (F.lit(4.0) + F.col("pos")).alias("radius")), "circlepack").collect()
    at, r = np.array([(p["x"], p["y"]) for p in packed]), np.array([4.0 + {x["id"]: x["pos"] for x in nodes.collect()}[p["id"]] for p in packed])
    far = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) + 999 * np.eye(8)
    assert (far >= r[:, None] + r[None] - 1e-9).all()


def test_sheets_and_shown_tables(spark, tmp_path):
    import pandas as pd

    from loomgraph.sources import formats

    tables = formats.sheet_tables(spark, {"Edges": pd.DataFrame({"a": ["x", None], "b": ["y", "z"]}), "One": pd.DataFrame({"a": ["x"]}), "None": pd.DataFrame()})
    assert list(tables) == ["Edges"] and rows(tables["Edges"], "a", "b") == [("x", "y"), (None, "z")]
    with pytest.raises(ValueError):
        formats.sheet_tables(spark, {"One": pd.DataFrame({"a": ["x"]})})
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "a string, b double").coalesce(1).write.parquet(path)
    few, total, cut_off = formats.read_capped(spark, path, 2)
    assert (few.count(), total, cut_off) == (2, 3, True) and formats.read_capped(spark, path)[2] is False
    shown = spark.createDataFrame([("=1+1", 2.0, 0), ("plain, cell", 10.0, 1)], f"a string, b double, {POS} long")
    assert formats.visible_csv(shown, ["b", "a"], by="b", descending=True) == 'b,a\r\n10,"plain, cell"\r\n2,\'=1+1\r\n'
    assert formats.visible_csv(shown, [], hidden=("b",)).splitlines()[0] == "a"
    assert formats.parse_pasted("\n".join("\t".join("1" for _ in range(28)) for _ in range(2))).mapping.source == "Column A"
    book = formats.parse_json(json.dumps({"Edges": [{"from": "a", "to": "b"}], "Nodes": [{"id": "a"}], "note": "x"}))
    assert book.edges == [{"from": "a", "to": "b"}] and book.nodes == [{"id": "a"}]
