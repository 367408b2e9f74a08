"""Graph building, the filter chain, the source and metrics on small graphs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.model import POS, Mapping, build_doc, guess_mapping, reconcile, unique_name
from loomgraph.operators import arrange, community, details, edits, graph, metrics, scripts, stats, style, transforms, traverse
from loomgraph.operators.chain import Condition, Step, apply_chain, describe, expand_center, playback, retarget, split_seed_list, step_counts, toggle_value, validate
from loomgraph.sources.datasource import DataSource, Selection

ROWS = [("a", "b", 1.0, "x"), ("a", "b", 3.0, "y"), ("b", "a", 2.0, "x"), ("b", "c", 1.0, "x"), ("c", "d", 4.0, "y"), ("d", "d", 1.0, "x"), (" ", "e", 1.0, "x"), ("e", "f", 5.0, "z"), ("c", "a", 1.0, "y")]


@pytest.fixture(scope="module")
def doc(spark):
    rows = [(*r, k) for k, r in enumerate(ROWS)]
    nodes = spark.createDataFrame([("a", "red", 0), ("b", None, 1), ("a", "blue", 2), ("z", "red", 3)], f"id string, hue string, {POS} long")
    return build_doc(spark.createDataFrame(rows, f"s string, t string, w double, kind string, {POS} long"), nodes, Mapping("s", "t"), "id")


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def links(applied):
    return {(r["s"], r["t"]): r["n_rows"] for r in applied.graph.links.collect()}


def test_base_graph(doc):
    g = graph.base_graph(doc)
    assert {(r["s"], r["t"]): r["n_rows"] for r in g.links.collect()} == {("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1, ("c", "d"): 1, ("e", "f"): 1, ("c", "a"): 1}
    assert graph.skipped_rows(g.ends).first()[0] == 2
    degrees = {r["id"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in g.nodes.collect()}
    assert degrees["a"] == (2, 1, 3) and degrees["z"] == (0, 0, 0) and set(degrees) == set("abcdefz")
    assert "z" not in ids(graph.base_graph(doc, show_isolated=False).nodes)
    assert {(r["s"], r["t"]) for r in graph.reciprocal(g.links).where("curve").collect()} == {("a", "b"), ("b", "a")}


def test_reconcile_keeps_rows(doc):
    new = reconcile(doc).nodes
    assert new.count() == 4 + 4 and new.agg(F.count_distinct(POS)).first()[0] == 8


def test_chain_steps(doc):
    assert links(apply_chain(doc, [Step("column", condition=Condition("kind", selected=("y",)))])) == {("a", "b"): 1, ("c", "d"): 1, ("c", "a"): 1}
    assert links(apply_chain(doc, [Step("column", condition=Condition("kind", selected=()))])) == {}
    assert links(apply_chain(doc, [Step("column", condition=Condition("w", low=3), invert=True)]))[("a", "b")] == 1
    assert set(links(apply_chain(doc, [Step("mutual")]))) == {("a", "b"), ("b", "a")}
    assert set(links(apply_chain(doc, [Step("kcore", k=2)]))) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")}
    assert set(links(apply_chain(doc, [Step("component", count=1)], show_isolated=False))) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("c", "a")}
    assert ids(apply_chain(doc, [Step("column", table="nodes", condition=Condition("hue", selected=("blue",)))]).graph.nodes) == {"a"}
    assert ids(apply_chain(doc, [Step("degree", low=3)]).graph.nodes) == {"a", "b", "c"}
    off = Step("degree", low=99, enabled=False)
    told = step_counts(apply_chain(doc, [off, Step("mutual")]))
    assert told[0][1:] == (7, 6) and told[1][2] == 2
    long = Condition("kind", excluded=tuple(map(str, range(2000))) + ("x",))
    assert ("b", "c") not in links(apply_chain(doc, [Step("column", condition=long)]))


def test_ego(doc):
    out = lambda **k: set(links(apply_chain(doc, [Step("ego", centers=("b",), **k)])))
    assert out() == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")}
    assert out(walked_only=True) == {("a", "b"), ("b", "a"), ("b", "c")}
    assert out(direction="in") == {("a", "b"), ("b", "a")}
    assert out(where=Condition("kind", selected=("y",))) == {("a", "b"), ("b", "a")}
    assert ids(apply_chain(doc, [Step("ego", centers=("b",), invert=True)]).graph.nodes) == {"e", "f", "z"}  # an undeclared node is one by its links only


def test_chain_tools():
    step = Step("timewindow", column="t")
    assert [(s.low, s.high) for s in playback(step, 0, 10, 4, 5)] == [(0, 4), (5, 9), (10, 10)]
    assert split_seed_list("a, b c;d") == ["a", "b c", "d"] and split_seed_list("a b") == ["a", "b"] and split_seed_list("a") is None
    chain = expand_center(expand_center([], "a"), "b")
    assert chain[0].centers == ("a", "b")
    assert toggle_value(toggle_value([], "edges", "k", "x"), "edges", "k", "x") == []
    chain = [Step("column", condition=Condition("k", selected=("x",)))]
    assert retarget(chain, "edges", "k", "q")[0].condition.column == "q" and retarget(chain, "edges", "k", None) == []
    assert describe(Step("kcore", k=3, invert=True)) == "not 3-core"
    with pytest.raises(ValueError):
        validate(Step("nothing"))
    with pytest.raises(ValueError):
        validate(Step("column", condition=Condition("k", selected=(), excluded=())))


def test_source(doc):
    source = DataSource(doc.edges, doc.mapping)
    got = source.materialize(Selection(("a", "nobody"), 2, edge_limit=3))
    assert got.hops == [(0, 1), (1, 2), (2, 1)] and got.truncated and got.edges.count() == 3 and got.total == 7
    assert [r["id"] for r in source.lookup(["f", "nobody", "a", "f"]).collect()] == ["f", "a"]
    assert source.node_count().first()[0] == 6
    top, nodes = source.selected(Selection(edge_limit=2))
    assert top.count() == 2 and ids(nodes) == {"a", "b"}
    only = source.materialize(Selection(("a",), 3, predicates=(Condition("kind", excluded=("y",)),)))
    assert "d" not in ids(only.nodes)


def test_metrics(doc):
    g = graph.base_graph(doc, show_isolated=False)
    nodes, w = g.nodes.select("id", "pos"), graph.weighted_links(g)
    value = lambda df, c: {r["id"]: r[c] for r in df.collect()}
    assert value(metrics.degree(nodes, g.links), "degree") == {"a": 2, "b": 2, "c": 3, "d": 1, "e": 1, "f": 1}
    assert value(metrics.coreness(nodes, w), "coreness") == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1}
    assert value(metrics.triangles(nodes, w), "triangles") == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 0, "f": 0}
    comp = value(metrics.components(nodes, g.links), "component")
    assert comp == {"a": "0", "b": "0", "c": "0", "d": "0", "e": "1", "f": "1"}
    between = value(metrics.betweenness(nodes, w), "betweenness")
    assert math.isclose(between["c"], 2 * 2 / (5 * 4)) and between["a"] == 0
    assert math.isclose(sum(value(metrics.pagerank(nodes, w), "pagerank").values()), 1)
    eigen = value(metrics.eigenvector(nodes, w), "eigenvector")
    assert max(eigen.values()) == 1 and eigen["c"] == 1
    hits = metrics.hits(nodes, w)
    assert math.isclose(max(value(hits, "hub").values()), 1)
    close = value(metrics.closeness(nodes, w), "closeness")
    assert math.isclose(close["c"], 3 / 5 * 3 / 3) and math.isclose(value(metrics.harmonic(nodes, w), "harmonic")["e"], 1 / 5)
    net = metrics.network(nodes, w).first()
    assert math.isclose(net["density"], 6 / 30) and net["diameter"] == 2
    assert {(r["s"], r["t"]): r["embeddedness"] for r in metrics.embeddedness(g.links).collect()}[("a", "b")] == 1
    count, routes = traverse.shortest_routes(g.links, "a", "d")
    assert count.first()["n_routes"] == 1 and routes.first()["route"] == ["a", "c", "d"]
    assert traverse.shortest_routes(g.links, "a", "f")[0].count() == 0
    assert traverse.shortest_routes(g.links, "a", "a")[1].first()["route"] == ["a"]


def test_disparity(spark):
    rows = spark.createDataFrame([("h", "a", 9.0), ("h", "b", 0.5), ("h", "c", 0.5), ("a", "b", 1.0)], "s string, t string, w double")
    alpha = {(r["s"], r["t"]): r["alpha"] for r in metrics.disparity(rows).collect()}
    assert math.isclose(alpha["h", "a"], min(0.1**2, 0.1)) and math.isclose(alpha["h", "c"], 0.0)


def test_projection_budget(spark):
    rows = [("s1", "t1"), ("s2", "t1"), ("s3", "t1"), ("s1", "t2"), ("s2", "t2"), ("s1", "t2")]
    ends = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rows)], f"__s string, __t string, {POS} long")
    pairs, used = transforms.project(ends, "source")
    assert {(r["s"], r["t"]): r["weight"] for r in pairs.collect()} == {("s1", "s2"): 2, ("s1", "s3"): 1, ("s2", "s3"): 1}
    pairs, used = transforms.project(ends, "source", 3)
    assert used.first()[:] == (1, 2) and pairs.count() == 3
    assert transforms.pair_bound(ends, "source").first()[0] == 4


def test_communities(spark):
    clique = lambda x: [(f"{x}{i}", f"{x}{j}", 1.0) for i in range(5) for j in range(i)]
    held = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", 1.0)], "s string, t string, w double")
    nodes = held.selectExpr("explode(array(s, t)) AS id").distinct().withColumn("pos", F.struct(F.lit(0).alias("late"), F.lit(0).alias("pos")))
    out = community.communities(nodes, held, stable=True).collect()
    parts = {}
    for r in out:
        parts.setdefault(r["community"], set()).add(r["id"][0])
    assert sorted(parts) == ["0", "1"] and all(len(p) == 1 for p in parts.values())
    assert all(r["stability"] == 1 for r in out) and out[0]["modularity"] > 0.4
    spread = community.communities(nodes, held, most_pairs=1)
    assert spread.count() == 10 and spread.first()["method"] == "label spreading"


def test_style_and_layouts(spark):
    values = spark.createDataFrame([("a", 0.0, 0), ("b", 4.0, 1), ("c", None, 2)], "id string, value double, pos long")
    size = {r["id"]: r["radius"] for r in style.node_radius(values).collect()}
    assert size == {"a": 4.5, "b": 21.5, "c": 4.5}
    named = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "y", 2), ("d", None, 3)], "id string, value string, pos long")
    assert {r["id"]: r["color"] for r in style.category_color(named, ("#111111",)).collect()} == {"a": "#111111", "b": "#111111", "c": style.NEUTRAL, "d": style.NEUTRAL}
    assert [(r["label"], r["n"]) for r in style.legend(named, ("#111111",)).collect()] == [("x", 2), ("Other", 1), ("Unassigned", 1)]
    nodes = spark.createDataFrame([(f"n{k}", f"g{k % 3}", 6.0) for k in range(40)], "id string, group string, radius double")
    at = arrange.layout(nodes, "circlepack").collect()
    assert all((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 >= 144 for i, p in enumerate(at) for q in at[:i])
    held = spark.createDataFrame([("n0", "n1", 1.0), ("n1", "n2", 1.0)], "s string, t string, w double")
    assert all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in arrange.layout(nodes, "force", held).collect())


def test_edits(doc):
    new = edits.rename_nodes(doc, {"b": "a"})
    row = new.nodes.where("id = 'a'").first()
    assert new.nodes.count() == 2 and row["hue"] == "red"
    assert edits.delete_nodes(doc, ["a"]).edges.count() == 5
    assert edits.set_cell(doc, "edges", 0, "w", 9.0).edges.where("w = 9").count() == 1
    assert edits.add_row(doc, "nodes", {"id": "q"}).nodes.where("id = 'q'").first()[POS] == 4
    assert edits.replace_count(doc.edges, "kind", "X", "q").first()[0] == 5
    assert edits.rename_values(doc.edges, "kind", {"x": "q"}).where("kind = 'q'").count() == 5
    assert edits.duplicate_column(doc.edges, "kind").columns[4] == "kind copy"
    assert edits.diff_cells(doc, doc.edges, edits.set_cell(doc, "edges", 0, "w", 9.0).edges).collect()[0]["new"] == "9"
    table, computed = edits.apply_computed(doc.nodes, doc.nodes.selectExpr("id AS k", "'v' AS hue").distinct(), {"id": "k"}, frozenset())
    assert "hue 2" in table.columns and computed == {"hue 2"}
    history = edits.History(doc)
    history.push(new)
    assert history.undo() is doc and history.redo() is new
    assert unique_name("x", {"x", "x 2"}) == "x 3" and guess_mapping(["From", "weight", "to"]).target == "to"


def test_scripts(spark):
    g = {"nodes": [{"id": "a"}], "edges": [], "neighbors": {"a": []}, "directed": True}
    assert scripts.run_script("def run(graph):\n    return {n['id']: len(graph['edges']) for n in graph['nodes']}", g) == {"a": 0}
    with pytest.raises(TimeoutError):
        scripts.run_script("def run(graph):\n    while True: pass", g, seconds=1)
    with pytest.raises(ValueError):
        scripts.run_script("def run(graph):\n    return open('/etc/passwd')", g)


def test_statistics(doc):
    assert stats.infer_types(doc.edges, ["w", "kind"]) == {"w": "number", "kind": "text"}
    assert {r["value"]: r["n"] for r in stats.value_counts(doc.nodes, "hue").collect()} == {"red": 2, "": 1, "blue": 1}
    assert stats.search_first(doc.edges, ["kind"], "Z").first()["hit"]


def test_details(doc):
    g = graph.base_graph(doc)
    assert details.incident_rows(g.ends, ["d"]).count() == 2 and details.pair_rows(g.ends, [("a", "b")]).count() == 2
    assert details.forward_steps(g.links, ["a", "c", "d"]) == [False, True]
    new = details.replay(doc, [details.Recipe("pagerank"), details.Recipe("coreness"), details.Recipe("disparity", "w")])
    assert {"pagerank", "coreness"} <= set(new.nodes.columns) and "alpha" in new.edges.columns and new.edges.count() == 9
    assert details.without_computed(new).nodes.columns == doc.nodes.columns
    assert {r["id"]: r["depth"] for r in details.node_depths(g.nodes, g.links).collect()} == {"z": 0, "e": 0, "f": 1, "b": 0, "a": 1, "c": 1, "d": 2}
    assert details.guess_style(doc).edge_color == "uniform"
    assert ids(details.centrality(g.nodes.select("id", "pos"), graph.weighted_links(g), "degree")) == set("abcdefz")
    assert details.in_view(doc.edges, g.rows, False).count() == 2
