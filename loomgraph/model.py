"""The document: an edge table and a node table with their mapping. Immutable; operators return new ones."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import cells
from .plans import positions
from .plans.scratch import cut

#: Name of the column that holds a row's position in its table.
POS = "__pos"


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    attrs: tuple[str, ...] = ()
    #: Node columns shown as details; None for all.
    node_attrs: tuple[str, ...] | None = None


@dataclass(frozen=True)
class GraphDoc:
    edges: DataFrame
    mapping: Mapping
    nodes: DataFrame | None = None
    node_id: str | None = None
    nodes_declared: bool = False
    computed: frozenset[str] = field(default_factory=frozenset)
    #: What cells are for, by (table, column).
    roles: dict[tuple[str, str], str] = field(default_factory=dict)

    def with_(self, **changes) -> "GraphDoc":
        return replace(self, **changes)


def with_positions(df: DataFrame, by: str | None = None) -> DataFrame:
    """Adds row positions: a unique column of the table, the rows' places in their files (Parquet), or the order of
    reading, which holds for a table that is written or cached."""
    if POS in df.columns:
        return df
    if by is not None:
        return df.withColumn(POS, F.col(by).cast("long"))
    if positions.is_parquet_scan(df):
        return positions.of_parquet(df, POS)
    return df.withColumn(POS, F.monotonically_increasing_id())


# Headers that mappings are guessed from, as whole names and as parts of names.
_SOURCES = ("source", "from", "supervisor", "manager", "parent", "origin", "start", "head")
_TARGETS = ("target", "to", "supervisee", "report", "child", "destination", "end", "employee")
_SOURCE_PARTS = ("source", "from", "supervisor", "manager", "parent")
_TARGET_PARTS = ("target", "supervisee", "report", "child", "dest")
_ID = re.compile(r"^(id|name|key|label|node)$", re.I)


def _hinted(names: list[str], whole: tuple[str, ...], parts: tuple[str, ...]) -> str | None:
    named = [c for c in names if c.lower() in whole]
    return next(iter(named or [c for c in names if any(p in c.lower() for p in parts)]), None)


def guess_mapping(columns: list[str]) -> Mapping:
    """By header, if both ends are hinted at, else the first two columns."""
    names = [c for c in columns if c != POS]
    source = _hinted(names, _SOURCES, _SOURCE_PARTS)
    target = _hinted([c for c in names if c != source], _TARGETS, _TARGET_PARTS) if source else None
    if target is None:
        source = names[0]
        target = next((c for c in names if c != source), source)
    return Mapping(source, target, tuple(c for c in names if c not in (source, target)))


def guess_node_id(columns: list[str]) -> str:
    names = [c for c in columns if c != POS]
    return next((c for c in names if _ID.match(c.strip())), names[0])


def endpoints(edges: DataFrame, mapping: Mapping) -> DataFrame:
    """id, place: every endpoint, source before target of a row."""
    both = F.array(
        F.struct(cells.cell_id(edges, mapping.source).alias("id"), (F.col(POS) * 2).alias("place")),
        F.struct(cells.cell_id(edges, mapping.target).alias("id"), (F.col(POS) * 2 + 1).alias("place")),
    )
    return edges.select(F.explode(both).alias("e")).select("e.*").where("id IS NOT NULL")


def derive_nodes(edges: DataFrame, mapping: Mapping) -> DataFrame:
    """id, __pos: the distinct endpoints; positions are those of first appearance."""
    return endpoints(edges, mapping).groupBy("id").agg(F.min("place").alias(POS))


def first_rows(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node table with `__id`, one row an id: the first."""
    known = nodes.withColumn("__id", cells.cell_id(nodes, node_id)).where("__id IS NOT NULL")
    return known.withColumn("__first", F.rank().over(Window.partitionBy("__id").orderBy(POS))).where("__first = 1").drop("__first")


def reconcile(doc: GraphDoc) -> GraphDoc:
    """Adds a node row for each endpoint without one, after the others."""
    if doc.nodes is None:
        return doc.with_(nodes=derive_nodes(doc.edges, doc.mapping), node_id="id")
    known = doc.nodes.select(cells.cell_id(doc.nodes, doc.node_id).alias("id")).where("id IS NOT NULL").distinct()
    missing = derive_nodes(doc.edges, doc.mapping).join(known, "id", "left_anti")
    last = doc.nodes.agg(F.coalesce(F.max(POS), F.lit(-1)).alias("__last"))
    added = missing.crossJoin(F.broadcast(last)).select(F.col("id").alias(doc.node_id), (F.col(POS) + F.col("__last") + 1).alias(POS))
    return doc.with_(nodes=doc.nodes.unionByName(added, allowMissingColumns=True))


def build_doc(edges: DataFrame, nodes: DataFrame | None = None, mapping: Mapping | None = None, node_id: str | None = None, pos: str | None = None) -> GraphDoc:
    edges = with_positions(edges, pos)
    mapping = mapping or guess_mapping(edges.columns)
    if nodes is None:
        return GraphDoc(edges, mapping, derive_nodes(edges, mapping), "id", False)
    nodes = with_positions(nodes)
    return GraphDoc(edges, mapping, nodes, node_id or guess_node_id(nodes.columns), True)


def unique_name(name: str, taken: set[str]) -> str:
    """The name, or with the first free suffix from ' 2'."""
    if name not in taken:
        return name
    k = 2
    while f"{name} {k}" in taken:
        k += 1
    return f"{name} {k}"


#: Parallel rows of one pair of ends that one task numbers; where a pair has more, rows are numbered by ranges.
HOT_PAIR = 1_000_000


def occurrence(edges: DataFrame, mapping: Mapping) -> DataFrame:
    """__s, __t and __occ: which of the parallel rows a row is, from 0."""
    keyed = edges.withColumn("__s", cells.cell_id(edges, mapping.source)).withColumn("__t", cells.cell_id(edges, mapping.target))
    most = keyed.groupBy("__s", "__t").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) > HOT_PAIR:
        return _occurrence_by_ranges(keyed)
    return keyed.withColumn("__occ", F.row_number().over(Window.partitionBy("__s", "__t").orderBy(POS)) - 1)


def _occurrence_by_ranges(keyed: DataFrame) -> DataFrame:
    """The same by range partitions of ends and place: a pair may lie in many of them. Each partition's first pair goes on
    from the partitions before, of which the driver needs the first and the last pair and how many rows these have."""
    order = ["__s", "__t", POS]
    dealt = cut(keyed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    pair = F.struct("__s", "__t")
    ends = dealt.groupBy("__part").agg(F.min(pair).alias("first"), F.max(pair).alias("last"))
    count = lambda end: F.sum(pair.eqNullSafe(F.col(end)).cast("long")).alias(f"n_{end}")
    facts = dealt.join(F.broadcast(ends), "__part").groupBy("__part", "first", "last").agg(count("first"), count("last")).orderBy("__part").collect()
    before, held, offsets = None, 0, []
    for r in facts:
        start = held if before is not None and before == r["first"] else 0
        offsets.append((r["__part"], start))
        before, held = r["last"], r["n_last"] + (start if r["first"] == r["last"] else 0)
    lookup = keyed.sparkSession.createDataFrame(offsets, "__part int, __start long")
    own = F.row_number().over(Window.partitionBy("__part", "__s", "__t").orderBy(POS)) - 1
    numbered = dealt.withColumn("__occ", own).join(F.broadcast(ends.select("__part", "first").join(F.broadcast(lookup), "__part")), "__part")
    goes_on = F.when(pair.eqNullSafe(F.col("first")), F.col("__start")).otherwise(0)
    return numbered.withColumn("__occ", (F.col("__occ") + goes_on).cast("int")).drop("__part", "first", "__start")
