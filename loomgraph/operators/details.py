"""Details, rankings and recipes on top of the other operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..model import POS, GraphDoc
from ..plans.scratch import cut
from . import community, edits, graph, metrics, stats, style, traverse


def incident_rows(ends: DataFrame, ids: list[str]) -> DataFrame:
    """Edge rows at any of the nodes, with `side`: 'out', 'in' or 'both'."""
    s, t = F.coalesce(F.col("__s").isin(ids), F.lit(False)), F.coalesce(F.col("__t").isin(ids), F.lit(False))
    return ends.where(s | t).withColumn("side", F.when(s & t, "both").when(s, "out").otherwise("in"))


#: Listed pairs up to which a list is broadcast.
LONG_LIST = 100_000


def pair_rows(ends: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """All rows behind the directed pairs."""
    wanted = ends.sparkSession.createDataFrame(pairs, "__s string, __t string")
    return ends.join(F.broadcast(wanted) if len(pairs) <= LONG_LIST else wanted, ["__s", "__t"], "left_semi")


def in_view(rows: DataFrame, view: DataFrame, inside: bool = True) -> DataFrame:
    """Rows that are (or aren't) in the result of a chain."""
    return rows.join(view.select(POS), POS, "left_semi" if inside else "left_anti")


def in_keyboard_order(nodes: DataFrame) -> DataFrame:
    """Nodes as the keyboard walks them: most links first, then by id."""
    return nodes.orderBy(F.desc("degree"), "id")


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """Rows of one page (from 0) in position order."""
    return df.orderBy(POS).offset(number * size).limit(size)


def sorted_page(df: DataFrame, column: str, number: int, size: int = 50, descending: bool = False) -> DataFrame:
    """Rows of one page (from 0) of the table as it is sorted by a column, with their places. Tasks keep the rows up to the
    page's end only."""
    head = stats.sort_rows(df, column, descending).limit((number + 1) * size)
    order = Window.orderBy(*stats.sort_keys(df, column, descending))  # of one page's rows and those before it
    return head.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") >= number * size)


def forward_steps(links: DataFrame, route: list[str]) -> list[bool]:
    """For each step of a route: does a link lead that way?"""
    steps = list(zip(route, route[1:]))
    if not steps:
        return []
    there = {(r["s"], r["t"]) for r in links.join(F.broadcast(links.sparkSession.createDataFrame(steps, "s string, t string")), ["s", "t"], "left_semi").select("s", "t").collect()}
    return [x in there for x in steps]


#: Rankings by name: each gives id and one value column.
CENTRALITIES = {
    "degree": lambda n, w: metrics.degree(n, w).select("id", F.col("degree").alias("value")),
    "pagerank": lambda n, w: metrics.pagerank(n, w).select("id", F.col("pagerank").alias("value")),
    "authority": lambda n, w: metrics.hits(n, w).select("id", F.col("authority").alias("value")),
    "betweenness": lambda n, w: metrics.betweenness(n, w).select("id", F.col("betweenness").alias("value")),
    "closeness": lambda n, w: metrics.closeness(n, w).select("id", F.col("closeness").alias("value")),
    "eigenvector": lambda n, w: metrics.eigenvector(n, w).select("id", F.col("eigenvector").alias("value")),
}


def centrality(nodes: DataFrame, weighted: DataFrame, kind: str) -> DataFrame:
    return CENTRALITIES[kind](nodes, weighted)


@dataclass(frozen=True)
class Recipe:
    """A metric run that can be replayed: its name, weight column and resolution."""

    metric: str
    weight: str | None = None
    resolution: float = 1.0


_NODE_METRICS = {
    "degree": lambda n, w, r: metrics.degree(n, w),
    "pagerank": lambda n, w, r: metrics.pagerank(n, w),
    "hits": lambda n, w, r: metrics.hits(n, w),
    "betweenness": lambda n, w, r: metrics.betweenness(n, w),
    "closeness": lambda n, w, r: metrics.closeness(n, w).join(metrics.harmonic(n, w), "id"),
    "eigenvector": lambda n, w, r: metrics.eigenvector(n, w),
    "coreness": lambda n, w, r: metrics.coreness(n, w),
    "triangles": lambda n, w, r: metrics.triangles(n, w),
    "components": lambda n, w, r: metrics.components(n, w.select("s", "t")),
    "communities": lambda n, w, r: community.communities(n, w, r.resolution).select("id", "community"),
}
_LINK_METRICS = {"embeddedness": lambda w: metrics.embeddedness(w), "simmelian": lambda w: metrics.simmelian(w), "disparity": lambda w: metrics.disparity(w)}


def replay(doc: GraphDoc, recipes: list[Recipe]) -> GraphDoc:
    """The document with each recipe's columns, worked out over the whole graph with isolated nodes; equal recipes
    run once. Columns of the user are never overwritten."""
    base = graph.base_graph(doc, show_isolated=True)
    nodes = base.nodes.select("id", "pos")
    for recipe in dict.fromkeys(recipes):
        weighted = graph.weighted_links(base, recipe.weight)
        if recipe.metric in _NODE_METRICS:
            table, computed = edits.apply_computed(doc.nodes, _NODE_METRICS[recipe.metric](nodes, weighted, recipe), {doc.node_id: "id"}, doc.computed)
            doc = doc.with_(nodes=cut(table), computed=computed)
        else:
            keys = {doc.mapping.source: "s", doc.mapping.target: "t"}
            values = _LINK_METRICS[recipe.metric](weighted).withColumnRenamed("s", "__ks").withColumnRenamed("t", "__kt")
            table, computed = edits.apply_computed(doc.edges, values, {k: f"__k{v}" for k, v in keys.items()}, doc.computed)
            doc = doc.with_(edges=cut(table), computed=computed)
    return doc


def without_computed(doc: GraphDoc) -> GraphDoc:
    drop = lambda df: None if df is None else df.drop(*[c for c in df.columns if c in doc.computed])
    return doc.with_(edges=drop(doc.edges), nodes=drop(doc.nodes), computed=frozenset())


def node_depths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, depth: directed hops from nodes without links to them; what those don't reach is seeded by the node that
    leads most, again and again. nodes: id, in_degree, out_degree, pos."""
    found = cut(traverse.reach(links, nodes.where("in_degree = 0"), None, "out"))
    while True:
        rest = nodes.join(found, "id", "left_anti")
        seed = rest.orderBy(F.desc(F.col("out_degree") - F.col("in_degree")), "pos").limit(1)
        if seed.isEmpty():
            return found
        more = traverse.reach(links.join(rest.select(F.col("id").alias("t")), "t", "left_semi").select("s", "t"), seed, None, "out")
        found = cut(found.unionByName(more.join(found.select("id"), "id", "left_anti")))


# Parts of headers of columns that group nodes.
_GROUP_PARTS = ("group", "department", "dept", "team", "type", "category", "role", "org", "unit")


def guess_style(doc: GraphDoc) -> style.Style:
    """A colour column of the nodes paints them, else the first text column of the edges whose header names a group
    colours them; a colour column of the edges paints those."""
    edge_names = [c for c in doc.edges.columns if c not in (POS, doc.mapping.source, doc.mapping.target)]
    node_cell = next((c for c in doc.nodes.columns if doc.roles.get(("nodes", c)) == "color"), None)
    edge_cell = next((c for c in edge_names if doc.roles.get(("edges", c)) == "color"), None)
    text = lambda c: isinstance(doc.edges.schema[c].dataType, T.StringType)
    grouping = next((c for c in edge_names if text(c) and any(p in c.lower() for p in _GROUP_PARTS)), None)
    color = f"cell:{node_cell}" if node_cell else f"column:{grouping}" if grouping else "none"
    return style.Style(node_color=color, edge_color=f"cell:{edge_cell}" if edge_cell else "uniform")
