"""What a user changed, as tables of keys, and how it is laid over a fresh version of the data.

Rows are known by keys: a node row by its id, an edge row by its ends and how many rows with the same ends come before
it. An overlay has the keys of edited cells, of deleted and of added rows, the renames of nodes and the changes of
columns in the order they were made. `diff` reads one off two versions of a document, `extend` adds a later one,
`merge` lays one over new data: edited cells win, others follow the data, edited and added rows survive, deletions
hold, and so do the deletions of edges at deleted nodes. All of it is joins on keys; only renames and column changes,
which are made by hand, are on the driver (`MOST_RENAMES`, checked)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..model import POS, GraphDoc, first_rows, occurrence, reconcile
from ..plans.scratch import cut, dealt
from . import columns, edits

KEY = ["tbl", "k1", "k2", "occ"]
_KEYS = "tbl string, k1 string, k2 string, occ long"
#: Renames of one overlay.
MOST_RENAMES = 100_000
#: Edited cells, deleted or added rows that are written as one document.
MOST_KEYS = 1_000_000


@dataclass(frozen=True)
class Overlay:
    """dirty: KEY and column_name; deleted, added: KEY; renames: (from, to) in order; column_ops: in order, each
    ('add', table, name, type), ('rename', table, old, new), ('delete', table, name) or ('retype', table, name, type)."""

    dirty: DataFrame
    deleted: DataFrame
    added: DataFrame
    renames: tuple[tuple[str, str], ...] = ()
    column_ops: tuple[tuple[str, ...], ...] = ()

    def is_empty(self) -> bool:
        return not self.renames and not self.column_ops and self.dirty.isEmpty() and self.deleted.isEmpty() and self.added.isEmpty()


def empty(spark: SparkSession) -> Overlay:
    return Overlay(spark.createDataFrame([], f"{_KEYS}, column_name string"), spark.createDataFrame([], _KEYS), spark.createDataFrame([], _KEYS))


def _node_keys(df: DataFrame, node_id: str) -> DataFrame:
    return df.select("*", F.lit("nodes").alias("tbl"), cells.cell_id(df, node_id).alias("k1"), F.lit("").alias("k2"), F.lit(0).cast("long").alias("occ"))


def _edge_keys(doc: GraphDoc) -> DataFrame:
    keyed = occurrence(doc.edges, doc.mapping)
    whole = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    out = keyed.withColumns({"tbl": F.lit("edges"), "k1": F.when(whole, F.col("__s")), "k2": F.when(whole, F.col("__t")), "occ": F.col("__occ").cast("long")})
    return out.drop("__s", "__t", "__occ")


def _own(df: DataFrame, doc: GraphDoc) -> list[str]:
    """Columns that aren't computed ones."""
    return [c for c in df.columns if c != POS and c not in doc.computed]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _column_changes(table: str, before: DataFrame, after: DataFrame, old: list[str], new: list[str]) -> tuple[list[tuple[str, ...]], dict[str, str]]:
    """Changes, and new names by old ones. One column gone and one come, of a type and with the same cells, is a rename."""
    came, gone = [c for c in new if c not in old], [c for c in old if c not in new]
    if len(came) == len(gone) == 1 and _kind(before, gone[0]) == _kind(after, came[0]):
        x, y = before.select(POS, F.col(gone[0]).alias("x")), after.select(POS, F.col(came[0]).alias("y"), F.lit(True).alias("there"))
        other = x.join(y, POS, "full").where(~F.col("x").eqNullSafe(F.col("y")) | F.col("there").isNull())
        if before.count() == after.count() and other.isEmpty():
            return [("rename", table, gone[0], came[0])], {gone[0]: came[0]}
    ops = [("add", table, c, _kind(after, c)) for c in came] + [("delete", table, c) for c in gone]
    return ops + [("retype", table, c, _kind(after, c)) for c in new if c in old and _kind(before, c) != _kind(after, c)], {}


def _renames(before: GraphDoc, after: GraphDoc) -> tuple[tuple[str, str], ...]:
    """Renamed nodes: with as many node rows, a new id in an old place; with fewer node rows and all edge rows, a new
    id at an edge's end whose old one is gone (merged nodes)."""
    ids = lambda doc: doc.nodes.select(POS, cells.cell_id(doc.nodes, doc.node_id).alias("id"))
    old, new = ids(before), ids(after)
    known = old.select("id").where("id IS NOT NULL").distinct()
    gone = known.join(new.select("id"), "id", "left_anti")
    if gone.isEmpty():
        return ()
    if old.count() == new.count():
        both = old.select(POS, F.col("id").alias("was")).join(new.select(POS, F.col("id").alias("now")), POS).where("was IS NOT NULL AND now IS NOT NULL AND was <> now")
        found = both.join(known.withColumnRenamed("id", "now"), "now", "left_anti").select("was", "now")
    elif before.edges.count() == after.edges.count():
        ends = lambda doc, names: doc.edges.select(POS, cells.cell_id(doc.edges, doc.mapping.source).alias(names[0]), cells.cell_id(doc.edges, doc.mapping.target).alias(names[1]))
        both = ends(before, ("s0", "t0")).join(ends(after, ("s1", "t1")), POS)
        each = both.select(F.explode(F.array(F.struct(F.col("s0").alias("was"), F.col("s1").alias("now")), F.struct(F.col("t0").alias("was"), F.col("t1").alias("now")))).alias("e")).select("e.*")
        found = each.where("was <> now").join(gone.withColumnRenamed("id", "was"), "was", "left_semi").select("was", "now").distinct()
    else:
        return ()
    got = found.orderBy("was", "now").limit(MOST_RENAMES + 1).collect()
    if len(got) > MOST_RENAMES:
        raise ValueError(f"more than {MOST_RENAMES} renames in one overlay")
    return tuple((r["was"], r["now"]) for r in got)


def _row_changes(a: DataFrame, b: DataFrame, compared: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edited cells, deleted and added rows of keyed versions a and b. compared: column of b by column of a."""
    names = list(compared.items())
    side = lambda df, x, of: df.where("k1 IS NOT NULL").select(*KEY, F.lit(True).alias(f"{x}_"), *[cells.text(df, c).alias(f"{x}{k}") for k, c in enumerate(of)])
    both = cut(side(a, "a", [o for o, _ in names]).join(side(b, "b", [n for _, n in names]), KEY, "full"))
    cell = [F.struct(F.lit(n).alias("column_name"), (~F.col(f"a{k}").eqNullSafe(F.col(f"b{k}"))).alias("changed")) for k, (_, n) in enumerate(names)]
    matched = both.where("a_ AND b_")
    dirty = matched.select(*KEY, F.explode(F.array(*cell)).alias("c")).where("c.changed").select(*KEY, "c.column_name") if names else matched.select(*KEY, F.lit("").alias("column_name")).limit(0)
    return dirty, both.where("b_ IS NULL").select(*KEY), both.where("a_ IS NULL").select(*KEY)


def held(doc: GraphDoc) -> GraphDoc:
    """The document with its tables written once, dealt evenly, for all that is to be read off it."""
    if hasattr(doc.edges, "_cut_path") and hasattr(doc.nodes, "_cut_path"):
        return doc
    return doc.with_(edges=cut(dealt(doc.edges, POS)), nodes=cut(dealt(doc.nodes, POS)))


def diff(before: GraphDoc, after: GraphDoc) -> Overlay:
    """The overlay of one edit, from the versions before and after it."""
    before, after = held(before), held(after)
    node_ops, node_names = _column_changes("nodes", before.nodes, after.nodes, _own(before.nodes, before), _own(after.nodes, after))
    edge_ops, edge_names = _column_changes("edges", before.edges, after.edges, _own(before.edges, before), _own(after.edges, after))
    renames = _renames(before, after)
    moved = edits.rename_nodes(before, dict(renames)) if renames else before

    def compared(old: list[str], new: list[str], names: dict[str, str], structural: set[str]) -> dict[str, str]:
        pairs = {c: names.get(c, c) for c in old}
        return {o: n for o, n in pairs.items() if n in new and n not in structural}

    nodes = _row_changes(
        _node_keys(first_rows(moved.nodes, before.node_id).drop("__id"), before.node_id), _node_keys(first_rows(after.nodes, after.node_id).drop("__id"), after.node_id),
        compared(_own(before.nodes, before), _own(after.nodes, after), node_names, {after.node_id}),
    )
    edges = _row_changes(_edge_keys(moved), _edge_keys(after), compared(_own(before.edges, before), _own(after.edges, after), edge_names, {after.mapping.source, after.mapping.target}))
    dirty, deleted, added = (x.unionByName(y) for x, y in zip(nodes, edges))
    return Overlay(dirty, deleted, added, renames, tuple(node_ops + edge_ops))


def _moved(df: DataFrame, renames: tuple[tuple[str, str], ...]) -> DataFrame:
    """Keys after the renames, made one after the other."""
    to = edits.closed(renames)
    if not to:
        return df
    lookup = df.sparkSession.createDataFrame(list(to.items()), "__old string, __new string")
    lookup = F.broadcast(lookup) if len(to) <= edits.LONG_LIST else lookup
    for k in ("k1", "k2"):
        df = df.join(lookup, F.col(k) == F.col("__old"), "left").withColumn(k, F.coalesce("__new", k)).drop("__old", "__new")
    return df.distinct()


def extend(now: Overlay, later: Overlay) -> Overlay:
    """One overlay for both. What was added and then deleted is forgotten, and a deleted row's edited cells with it."""
    dirty, deleted, added = (_moved(x, later.renames) for x in (now.dirty, now.deleted, now.added))
    dirty = dirty.unionByName(later.dirty).distinct().join(later.deleted, KEY, "left_anti")
    added = added.unionByName(later.added).distinct()
    deleted = deleted.unionByName(later.deleted.join(added, KEY, "left_anti")).distinct()
    return Overlay(cut(dirty), cut(deleted), cut(added.join(later.deleted, KEY, "left_anti")), now.renames + later.renames, now.column_ops + later.column_ops)


def _laid(staged: DataFrame, current: DataFrame, overlay: Overlay, names: list[str], held_back: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of one table after the merge (names and POS), and its counts. Both tables are keyed; `held_back` tells rows
    that go for another reason than their own deletion."""
    dirty = overlay.dirty.groupBy(*KEY).agg(F.collect_set("column_name").alias("__dirty"))
    marks = overlay.deleted.withColumn("__deleted", F.lit(True))
    came = staged.join(marks, KEY, "left").join(dirty, KEY, "left")
    held = current.where("k1 IS NOT NULL").select(*KEY, F.lit(True).alias("__held"), F.col(POS).alias("__hpos"), *[F.col(c).alias(f"__h_{c}") if c in current.columns else F.lit(None).alias(f"__h_{c}") for c in names])
    came = came.join(held, KEY, "left")
    gone = F.col("k1").isNotNull() & (F.coalesce(F.col("__deleted"), F.lit(False)) | (held_back if held_back is not None else F.lit(False)))
    edited = F.coalesce(F.col("__dirty"), F.array().cast("array<string>"))
    came = cut(came.withColumn("__gone", gone).withColumn("__n", F.when(F.col("__held"), F.size(F.array_intersect(edited, F.array(*map(F.lit, names))))).otherwise(0)))
    value = lambda c: F.when(F.col("__held") & F.array_contains("__dirty", c), F.col(f"__h_{c}").cast(staged.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    rows = came.where(~F.col("__gone")).select(POS, *[value(c) for c in names])
    # Rows that only the current version has survive if they were added or edited.
    seen = came.where(~F.col("__gone") & F.col("k1").isNotNull()).select(*KEY)
    changed = overlay.added.select(*KEY).unionByName(overlay.dirty.select(*KEY)).distinct()
    extra = held.join(seen, KEY, "left_anti").join(changed, KEY, "left_semi")
    last = staged.agg(F.coalesce(F.max(POS), F.lit(-1)).alias("__last"))
    extra = cut(extra.crossJoin(F.broadcast(last)).select((F.col("__hpos") + F.col("__last") + 1).alias(POS), *[F.col(f"__h_{c}").cast(staged.schema[c].dataType).alias(c) for c in names]))
    there = F.col("k1").isNotNull()
    count = lambda cond: F.count(F.when(cond, 1))
    counts = came.agg(
        count(there & ~F.col("__gone") & F.col("__held").isNotNull()).alias("updated"), count(there & ~F.col("__gone") & F.col("__held").isNull()).alias("added"),
        F.coalesce(F.sum(F.when(~F.col("__gone"), F.col("__n"))), F.lit(0)).cast("long").alias("edits_kept"), count(F.col("__gone")).alias("deletions_held"),
    ).crossJoin(extra.agg(F.count("*").alias("kept_extras")))
    return rows.unionByName(extra), counts


def merge(current: GraphDoc, overlay: Overlay, incoming: GraphDoc) -> tuple[GraphDoc, DataFrame]:
    """The incoming document with what the overlay holds of the current one, and a report of one row: updated, added,
    edits_kept, deletions_held, kept_extras."""
    if len(overlay.renames) > MOST_RENAMES:
        raise ValueError(f"more than {MOST_RENAMES} renames in one overlay")
    staged = edits.rename_series(incoming, overlay.renames)
    current = held(current)
    for op, table, *what in overlay.column_ops:
        staged = {"add": columns.add, "rename": columns.rename, "delete": columns.delete, "retype": columns.retype}[op](staged, table, *what)
    staged = held(staged)
    node_names, edge_names = ([c for c in df.columns if c != POS] for df in (staged.nodes, staged.edges))
    nodes, node_counts = _laid(_node_keys(staged.nodes, staged.node_id), _node_keys(first_rows(current.nodes, current.node_id).drop("__id"), current.node_id), overlay, node_names)

    keyed = _edge_keys(staged)
    off = overlay.deleted.where("tbl = 'nodes'").select(F.col("k1").alias("__off")).distinct()
    for end in ("k1", "k2"):
        keyed = keyed.join(off.select(F.col("__off").alias(f"__off_{end}")), F.col(end) == F.col(f"__off_{end}"), "left")
    edges, edge_counts = _laid(keyed, _edge_keys(current), overlay, edge_names, F.col("__off_k1").isNotNull() | F.col("__off_k2").isNotNull())
    report = reduce(DataFrame.unionByName, (node_counts, edge_counts))
    report = report.agg(*[F.sum(c).cast("long").alias(c) for c in report.columns])
    doc = staged.with_(nodes=nodes.select(*staged.nodes.columns), edges=edges.select(*staged.edges.columns), nodes_declared=staged.nodes_declared or current.nodes_declared)
    return reconcile(doc), report


def to_json(overlay: Overlay) -> dict:
    """Plain lists; an overlay is what a person changed, so it fits into one document (`MOST_KEYS`, checked)."""

    def rows(df: DataFrame, *more: str) -> list[list]:
        got = df.limit(MOST_KEYS + 1).collect()
        if len(got) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} rows of one kind in an overlay")
        return sorted([r[c] for c in (*KEY, *more)] for r in got)

    return {"cells": rows(overlay.dirty, "column_name"), "deleted": rows(overlay.deleted), "added": rows(overlay.added), "renames": [{"from": a, "to": b} for a, b in overlay.renames], "columns": [list(op) for op in overlay.column_ops]}


def from_json(spark: SparkSession, held: dict) -> Overlay:
    """What to_json gave; entries of another shape are left out."""

    def rows(name: str, width: int) -> list[tuple]:
        good = lambda x: isinstance(x, list) and len(x) == width and x[0] in ("nodes", "edges") and isinstance(x[3], int) and all(isinstance(x[k], str) for k in (1, 2, *range(4, width)))
        return [tuple(x) for x in held.get(name) or [] if good(x)]

    renames = tuple((x["from"], x["to"]) for x in held.get("renames") or [] if isinstance(x, dict) and isinstance(x.get("from"), str) and isinstance(x.get("to"), str))
    widths = {"add": 4, "rename": 4, "delete": 3, "retype": 4}
    ops = tuple(tuple(x) for x in held.get("columns") or [] if isinstance(x, list) and x and widths.get(x[0]) == len(x) and all(isinstance(y, str) for y in x))
    return Overlay(spark.createDataFrame(rows("cells", 5), f"{_KEYS}, column_name string"), spark.createDataFrame(rows("deleted", 4), _KEYS), spark.createDataFrame(rows("added", 4), _KEYS), renames, ops)
