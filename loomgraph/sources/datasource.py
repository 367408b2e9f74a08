"""Queries over an edge source of any size: schema, values, searches, and neighbourhoods carved out of it.

Endpoints are compared trimmed; predicates narrow the source before anything else; a limit cuts the final rows in
position order only, never a walk."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..model import POS, GraphDoc, Mapping, endpoints, with_positions
from ..operators import stats, traverse
from ..operators.chain import Condition, walked_rows
from ..operators.details import Recipe, replay
from ..operators.overlay import Overlay, merge
from ..plans.scratch import cut
from .directory import NodeDirectory


@dataclass(frozen=True)
class Selection:
    seeds: tuple[str, ...] = ()
    depth: int = 1
    direction: str = "any"
    where: Condition | None = None
    walked_only: bool = False
    predicates: tuple[Condition, ...] = ()
    edge_limit: int = 200_000
    #: A walk that has reached more nodes than this goes no further hop.
    budget: int | None = None


@dataclass(frozen=True)
class Materialized:
    """edges with __s and __t, nodes (id, depth), hops [(depth, new nodes)], rows there were, truncated."""

    edges: DataFrame
    nodes: DataFrame
    hops: list[tuple[int, int]]
    total: int
    truncated: bool


class DataSource:
    def __init__(self, edges: DataFrame, mapping: Mapping, pos: str | None = None):
        self.mapping, self._given, self._directory = mapping, edges, None
        edges = with_positions(edges, pos)
        self.edges = edges.withColumn("__s", cells.cell_id(edges, mapping.source)).withColumn("__t", cells.cell_id(edges, mapping.target))

    def columns(self) -> list[str]:
        return [c for c in self.edges.columns if not c.startswith("__")]

    def schema(self) -> tuple[list[tuple[str, str]], int]:
        return [(n, k) for n, k in self.edges.dtypes if not n.startswith("__")], self.edges.count()

    def distinct(self, column: str, limit: int) -> DataFrame:
        return stats.value_counts(self.edges, column, limit)

    def range(self, column: str) -> DataFrame:
        return stats.numeric_range(self.edges, column)

    def bins(self, column: str, n: int = 24) -> DataFrame:
        return stats.histogram(self.edges, column, n)

    def directory(self) -> NodeDirectory:
        """The source's nodes with postings of their parts, made by the first call and kept with the source's files."""
        if self._directory is None:
            self._directory = NodeDirectory.of(self._given, self.mapping)
        return self._directory

    def ids(self) -> DataFrame:
        return endpoints(self.edges, self.mapping).select("id").distinct()

    def node_count(self, exact: bool = True) -> DataFrame:
        e = endpoints(self.edges, self.mapping)
        return e.agg((F.count_distinct("id") if exact else F.approx_count_distinct("id")).alias("nodes"))

    def search(self, query: str, limit: int = 12) -> DataFrame:
        """id: those that begin with the text, then those that contain it, by id. Where the directory has been made, from
        its postings."""
        if self._directory is not None:
            return self._directory.search(query, limit)
        return stats.search_nodes(self.ids().withColumn("label", F.col("id")), query, limit).select("id")

    def lookup(self, ids: list[str]) -> DataFrame:
        """id: which of the ids are there, in the order asked."""
        if self._directory is not None:
            return self._directory.lookup(ids)
        asked = [(k, i.strip()) for k, i in enumerate(dict.fromkeys(ids)) if i.strip()]
        wanted = self.edges.sparkSession.createDataFrame(asked, "place int, id string")
        found = endpoints(self.edges, self.mapping).select("id").join(F.broadcast(wanted.select("id")), "id", "left_semi").distinct()
        return wanted.join(found, "id", "left_semi").orderBy("place").select("id")

    def narrowed(self, selection: Selection) -> DataFrame:
        rows = self.edges
        for p in selection.predicates:
            rows = p.apply(rows)
        return rows

    def reached(self, selection: Selection) -> DataFrame:
        rows = self.narrowed(selection)
        walkable = rows if selection.where is None else selection.where.apply(rows)
        good = F.col("__s").isNotNull() & F.col("__t").isNotNull() & (F.col("__s") != F.col("__t"))
        links = walkable.where(good).select(F.col("__s").alias("s"), F.col("__t").alias("t"))
        seeds = self.edges.sparkSession.createDataFrame([(s.strip(),) for s in dict.fromkeys(selection.seeds)], "id string")
        known = seeds.join(endpoints(rows, self.mapping).select("id").join(F.broadcast(seeds), "id", "left_semi").distinct(), "id", "left_semi")
        return traverse.reach(links, known, selection.depth, selection.direction, selection.budget)

    def selected(self, selection: Selection) -> tuple[DataFrame, DataFrame]:
        """Rows and nodes (id, depth) of a neighbourhood, or the first rows in position order without seeds."""
        rows = self.narrowed(selection)
        if not selection.seeds:
            rows = rows if selection.where is None else selection.where.apply(rows)
            taken = cut(rows.where(F.col("__s").isNotNull() & F.col("__t").isNotNull()).orderBy(POS).limit(selection.edge_limit))
            return taken, endpoints(taken, self.mapping).select("id").distinct().withColumn("depth", F.lit(0))
        nodes = self.reached(selection)
        if selection.walked_only:
            passing = rows if selection.where is None else selection.where.apply(rows)
            return walked_rows(passing, nodes, selection.direction).drop("__ds", "__dt"), nodes
        one = nodes.select(F.col("id").alias("__s"))
        two = nodes.select(F.col("id").alias("__t"))
        return rows.join(one, "__s", "left_semi").join(two, "__t", "left_semi"), nodes

    def materialize(self, selection: Selection) -> Materialized:
        rows, nodes = self.selected(selection)
        total = rows.count()
        hops = [(r["depth"], r["n"]) for r in nodes.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect()]
        return Materialized(rows.orderBy(POS).limit(selection.edge_limit), nodes, hops, total, total > selection.edge_limit)

    def neighborhood(self, selection: Selection) -> DataFrame:
        """depth, new_nodes of the walk."""
        return self.reached(selection).groupBy("depth").agg(F.count("*").alias("new_nodes"))

    def size(self, selection: Selection) -> DataFrame:
        """One row: nodes, edges (counted up to one more than the limit) and truncated of what would be read."""
        rows, nodes = self.selected(replace(selection, edge_limit=selection.edge_limit + 1))
        edges = rows.limit(selection.edge_limit + 1).agg(F.count("*").alias("edges"))
        return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges).withColumn("truncated", F.col("edges") > selection.edge_limit)

    def rematerialize(self, selection: Selection, current: GraphDoc, overlay: Overlay, recipes: list[Recipe]) -> tuple[GraphDoc, DataFrame]:
        """The selection read anew, with the edits of the document that came of it laid over and its metrics run again."""
        fresh = self.materialize(selection)
        doc = GraphDoc(cut(fresh.edges.drop("__s", "__t")), self.mapping, cut(with_positions(fresh.nodes.select("id"))), "id", False)
        doc, report = merge(current, overlay, doc)
        return replay(doc, recipes), report
