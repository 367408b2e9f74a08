"""Edits as transforms of the document, and their replay on incoming data.

Every edit gives a new document; cells are addressed by row position or node id. `merge` puts the edits of one
version of an edge table on another: edited cells win, cells that weren't edited follow the incoming table, edited
rows survive, deletions hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import POS, GraphDoc, occurrence, reconcile


#: Names or positions up to which a list is broadcast or tested in place.
LONG_LIST = 100_000


def _listed(df: DataFrame, rows: list[int]) -> DataFrame:
    listed = df.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(rows)], "__listed long")
    return F.broadcast(listed) if len(rows) <= LONG_LIST else listed


def _positions(df: DataFrame, rows: list[int] | None) -> tuple[DataFrame, Column]:
    """The table with what is needed to tell the rows at these positions, and the condition that does."""
    if rows is None:
        return df, F.lit(True)
    return df.join(_listed(df, rows), F.col(POS) == F.col("__listed"), "left"), F.col("__listed").isNotNull()


def set_cell(doc: GraphDoc, table: str, pos: int, column: str, value) -> GraphDoc:
    df = doc.edges if table == "edges" else doc.nodes
    if table == "nodes" and column == doc.node_id:
        # An id cell renames its node, where there is an old and a new id.
        row = df.where(F.col(POS) == pos).select(cells.cell_id(df, column).alias("id")).first()
        old, fresh = (row["id"] if row else None), (str(value).strip() if value is not None else "")
        return doc if not fresh or old is None or fresh == old else rename_nodes(doc, {old: fresh})
    kind = df.schema[column].dataType
    new = df.withColumn(column, F.when(F.col(POS) == pos, F.lit(value).cast(kind)).otherwise(F.col(column)))
    return reconcile(doc.with_(edges=new)) if table == "edges" else doc.with_(nodes=new)


def _renamed(df: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """The column with its ids' new names. lookup: __old, __new, and what else is to stay beside the rows."""
    keyed = df.withColumn("__id", cells.cell_id(df, column))
    joined = keyed.join(lookup, F.col("__id") == F.col("__old"), "left")
    return joined.withColumn(column, F.coalesce("__new", cells.text(df, column))).drop("__id", "__old", "__new")


def _with_names(doc: GraphDoc, lookup: DataFrame, by: Column) -> GraphDoc:
    ends = lookup.select("__old", "__new")
    edges = _renamed(_renamed(doc.edges, doc.mapping.source, ends), doc.mapping.target, ends)
    if doc.nodes is None:
        return doc.with_(edges=edges)
    return doc.with_(edges=edges, nodes=coalesce_by_id(_renamed(doc.nodes, doc.node_id, lookup), doc.node_id, by).select(*doc.nodes.columns))


def rename_nodes(doc: GraphDoc, names: dict[str, str]) -> GraphDoc:
    """Renames ids in both tables, all at once; rows that then share an id become one, its first non-blank cells winning."""
    lookup = doc.edges.sparkSession.createDataFrame(list(names.items()), "__old string, __new string")
    return _with_names(doc, F.broadcast(lookup) if len(names) <= LONG_LIST else lookup, F.col(POS))


def closed(renames: Sequence[tuple[str, str]]) -> dict[str, str]:
    """What each id is called after the renames, made one after the other: a rename sees only those before it."""
    last: dict[str, str] = {}
    for old, new in reversed(renames):
        last[old] = last.get(new, new)
    return last


def merge_ranks(renames: Sequence[tuple[str, str]], places: dict[str, int]) -> dict[str, int]:
    """For each id with a place (the position of its first row): its rank among those that end up as one. Where two rows
    met, what was made of the row that stood first comes before what was made of the other, whatever merged before."""
    at = {i: (place, i, i) for i, place in places.items()}  # by name: place, first and last id of a linked list
    after: dict[str, str] = {}
    for old, new in renames:
        if old == new or old not in at:
            continue
        moved, there = at.pop(old), at.get(new)
        if there is not None:
            moved, there = sorted((moved, there))
            after[moved[2]] = there[1]
            moved = (moved[0], moved[1], there[2])
        at[new] = moved
    ranks = {}
    for _, first, _ in at.values():
        rank, i = 0, first
        while i is not None:
            ranks[i], rank, i = rank, rank + 1, after.get(i)
    return ranks


def rename_series(doc: GraphDoc, renames: Sequence[tuple[str, str]]) -> GraphDoc:
    """The same as one `rename_nodes` after the other, as one join a table: the series is closed first, and rows that
    become one give their cells in the order in which they would have met. What the driver holds are the renames and
    the places of the ids that they name."""
    renames = [(old, new) for old, new in renames if old != new]
    if not renames:
        return doc
    last = closed(renames)
    spark, names = doc.edges.sparkSession, sorted({i for pair in renames for i in pair})
    ranks: dict[str, int] = {}
    if doc.nodes is not None:
        listed = spark.createDataFrame([(i,) for i in names], "__named string")
        listed = F.broadcast(listed) if len(names) <= LONG_LIST else listed
        rows = doc.nodes.select(cells.cell_id(doc.nodes, doc.node_id).alias("__id"), POS).join(listed, F.col("__id") == F.col("__named"))
        ranks = merge_ranks(renames, {r["__id"]: r["place"] for r in rows.groupBy("__id").agg(F.min(POS).alias("place")).collect()})
    lookup = spark.createDataFrame([(i, last.get(i, i), ranks.get(i, 0)) for i in names], "__old string, __new string, __rank long")
    return _with_names(doc, F.broadcast(lookup) if len(names) <= LONG_LIST else lookup, F.struct(F.coalesce("__rank", F.lit(0)), F.col(POS)))


def coalesce_by_id(nodes: DataFrame, node_id: str, by: Column | None = None) -> DataFrame:
    """One row an id, at the first one's place, each cell the first that isn't null, in the order of `by` (places)."""
    by, names = F.col(POS) if by is None else by, [c for c in nodes.columns if c != "__rank"]
    whole = F.col("__id").isNotNull()
    # A blank row stands for itself: its place keys it.
    keyed = nodes.withColumn("__id", cells.cell_id(nodes, node_id)).withColumn("__own", F.when(~whole, F.col(POS))).withColumn("__by", by)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__by")))
    blank = F.first(F.col(node_id).cast("string"))
    merged = keyed.groupBy("__id", "__own").agg(F.min(POS).alias(POS), blank.alias("__blank"), *[first(c).alias(c) for c in names if c not in (node_id, POS)])
    return merged.withColumn(node_id, F.coalesce("__id", "__blank")).select(*names)


def delete_nodes(doc: GraphDoc, ids: list[str]) -> GraphDoc:
    """The rows of the ids, and the edges at them."""
    listed = doc.edges.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "__gone string")
    listed = F.broadcast(listed) if len(ids) <= LONG_LIST else listed
    without = lambda df, c: df.join(listed, cells.cell_id(df, c) == F.col("__gone"), "left_anti")
    nodes = None if doc.nodes is None else without(doc.nodes, doc.node_id)
    return doc.with_(edges=without(without(doc.edges, doc.mapping.source), doc.mapping.target), nodes=nodes)


def delete_rows(doc: GraphDoc, table: str, positions: list[int]) -> GraphDoc:
    df = doc.edges if table == "edges" else doc.nodes
    left = df.join(_listed(df, positions), F.col(POS) == F.col("__listed"), "left_anti")
    return doc.with_(edges=left) if table == "edges" else doc.with_(nodes=left)


def add_row(doc: GraphDoc, table: str, values: dict) -> GraphDoc:
    df = doc.edges if table == "edges" else doc.nodes
    last = df.agg(F.max(POS)).first()[0]
    row = df.sparkSession.range(1).select(*[F.lit((last or 0) + 1 if c == POS and last is not None else 0 if c == POS else values.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    new = df.unionByName(row)
    return reconcile(doc.with_(edges=new)) if table == "edges" else doc.with_(nodes=new)


def free_node_id(doc: GraphDoc, stem: str = "node") -> str:
    ids = cells.cell_id(doc.nodes, doc.node_id)
    n = doc.nodes.select(F.regexp_extract(ids, rf"^{stem} (\d+)$", 1).try_cast("long").alias("k")).agg(F.max("k")).first()[0]
    return f"{stem} {(n or 0) + 1}"


def map_column(df: DataFrame, column: str, value: Column, rows: list[int] | None = None) -> DataFrame:
    marked, there = _positions(df, rows)
    return marked.withColumn(column, F.when(there, value).otherwise(F.col(column))).select(*df.columns)


def fill_column(df: DataFrame, column: str, value, only_blanks: bool = True) -> DataFrame:
    kind = df.schema[column].dataType
    new = F.lit(value).cast(kind)
    return df.withColumn(column, F.when(cells.cell_id(df, column).isNull(), new).otherwise(F.col(column)) if only_blanks else new)


def replace_in_column(df: DataFrame, column: str, find: str, by: str, **how) -> DataFrame:
    """Text cells with what was found replaced; blank cells stay."""
    kind = df.schema[column].dataType
    new = cells.replace_expr(cells.text(df, column), find, by, **how)
    new = new if isinstance(kind, T.StringType) else new.try_cast(kind)  # read again as the column's type
    return df.withColumn(column, F.when(cells.cell_id(df, column).isNull(), F.col(column)).otherwise(new))


def replace_count(df: DataFrame, column: str, find: str, by: str, **how) -> DataFrame:
    changed = cells.replace_expr(cells.text(df, column), find, by, **how)
    return df.agg(F.count(F.when(cells.cell_id(df, column).isNotNull() & (changed != cells.text(df, column)), 1)).alias("changed"))


def map_cells(doc: GraphDoc, table: str, column: str, value: Column, rows: list[int] | None = None) -> GraphDoc:
    """A column's cells mapped, and what follows: new ids rename their nodes in both tables, new ends get node rows."""
    df = doc.edges if table == "edges" else doc.nodes
    new = map_column(df, column, value, rows)
    if table == "edges":
        out = doc.with_(edges=new)
        return reconcile(out) if column in (doc.mapping.source, doc.mapping.target) else out
    if column != doc.node_id:
        return doc.with_(nodes=new)
    both = df.select(POS, cells.cell_id(df, column).alias("old")).join(new.select(POS, cells.cell_id(new, column).alias("new")), POS)
    moved = both.where("old IS NOT NULL AND new IS NOT NULL AND old <> new").groupBy("old").agg(F.min_by("new", POS).alias("new"))
    names = {r["old"]: r["new"] for r in moved.limit(LONG_LIST + 1).collect()}
    if len(names) > LONG_LIST:
        raise ValueError(f"more than {LONG_LIST} ids renamed at once")
    return rename_nodes(doc, names) if names else doc


def rename_values(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(names, cells.cell_key(df, column)), cells.text(df, column)))


def retype_column(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumn(column, cells.coerce(df, column, to))


def retype_losses(df: DataFrame, column: str, to: str) -> DataFrame:
    """losses: filled cells that the new type can't hold."""
    return df.agg(F.count(F.when(cells.cell_id(df, column).isNotNull() & cells.coerce(df, column, to).isNull(), 1)).alias("losses"))


def duplicate_column(df: DataFrame, column: str) -> DataFrame:
    from ..model import unique_name

    name = unique_name(f"{column} copy", set(df.columns))
    at = df.columns.index(column) + 1
    return df.select(*df.columns[:at], F.col(column).alias(name), *df.columns[at:])


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    known = [c for c in order if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def add_column(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    name = name.strip()
    return df if not name or name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def apply_computed(df: DataFrame, values: DataFrame, on: dict[str, str], computed: frozenset[str]) -> tuple[DataFrame, frozenset[str]]:
    """Joins metric values to rows. on: row column -> key of the values. A user's column is never overwritten, the
    computed one gets a suffix; computed columns are."""
    from ..model import unique_name

    new = [c for c in values.columns if c not in on.values()]
    df = df.drop(*[c for c in new if c in df.columns and c in computed])
    names = {c: unique_name(c, set(df.columns)) for c in new}
    side = values.select(*[F.col(v).alias(f"__k_{v}") for v in on.values()], *[F.col(c).alias(names[c]) for c in new])
    keyed = df.select("*", *[cells.cell_id(df, k).alias(f"__c_{v}") for k, v in on.items()])
    cond = None
    for v in on.values():
        one = F.col(f"__c_{v}") == F.col(f"__k_{v}")
        cond = one if cond is None else cond & one
    out = keyed.join(side, cond, "left").drop(*[f"__k_{v}" for v in on.values()], *[f"__c_{v}" for v in on.values()])
    return out, computed | set(names.values())


def edge_keys(doc: GraphDoc, edges: DataFrame | None = None) -> DataFrame:
    return occurrence(doc.edges if edges is None else edges, doc.mapping)


def diff_cells(doc: GraphDoc, before: DataFrame, after: DataFrame) -> DataFrame:
    """__s, __t, __occ, column_name, old, new: cells that differ between two versions of the edge rows, as text."""
    a, b = edge_keys(doc, before), edge_keys(doc, after)
    shared = [c for c in before.columns if c in after.columns and c not in (POS, "__s", "__t", "__occ")]
    keys = ["__s", "__t", "__occ"]
    old = a.select(*keys, *[cells.text(a, c).alias(f"o_{k}") for k, c in enumerate(shared)])
    new = b.select(*keys, *[cells.text(b, c).alias(f"n_{k}") for k, c in enumerate(shared)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"o_{k}").alias("old"), F.col(f"n_{k}").alias("new")) for k, c in enumerate(shared)]))
    return old.join(new, keys).select(*keys, each.alias("e")).select(*keys, "e.*").where(~F.col("old").eqNullSafe(F.col("new")))


def merge(doc: GraphDoc, base: DataFrame, current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming edge rows with the edits that made `current` of `base`; __from: 'both', 'incoming' or 'edited'."""
    keys = ["__s", "__t", "__occ"]
    parts = {n: edge_keys(doc, df) for n, df in (("b", base), ("c", current), ("i", incoming))}
    columns = [c for c in incoming.columns if c != POS]
    side = {n: df.select(*keys, F.lit(True).alias(f"{n}_"), F.col(POS).alias(f"{n}_pos"), *[F.col(c).alias(f"{n}_{k}") for k, c in enumerate(columns)]) for n, df in parts.items()}
    own = side["c"].join(side["b"], keys, "full")
    whole = side["i"].join(own, keys, "full")
    edited = lambda k: F.col("b_") & F.col("c_") & ~F.col(f"c_{k}").eqNullSafe(F.col(f"b_{k}"))
    touched = F.lit(False)
    for k in range(len(columns)):
        touched = touched | F.coalesce(edited(k), F.lit(False))
    touched = touched | (F.col("c_").isNotNull() & F.col("b_").isNull())
    deleted = F.col("b_").isNotNull() & F.col("c_").isNull()
    stays = (F.col("i_").isNotNull() & ~deleted) | (F.col("i_").isNull() & touched)
    value = lambda k: F.when(F.coalesce(edited(k), F.lit(False)) | F.col("i_").isNull() | (F.col("c_").isNotNull() & F.col("b_").isNull()), F.col(f"c_{k}")).otherwise(F.col(f"i_{k}"))
    origin = F.when(F.col("i_").isNull(), "edited").when(touched, "both").otherwise("incoming")
    return whole.where(stays).select(*[value(k).alias(c) for k, c in enumerate(columns)], origin.alias("__from"))


class History:
    """Undo and redo over immutable documents: `depth` steps, fewer (but `least`) where their rows exceed `budget`."""

    def __init__(self, doc: GraphDoc, depth: int = 50, least: int = 5, budget: int = 3_000_000):
        self.past: list[GraphDoc] = []
        self.now, self.future, self.depth, self.least, self.budget = doc, [], depth, least, budget
        self._rows: dict[int, int] = {}

    def _size(self, doc: GraphDoc) -> int:
        if id(doc) not in self._rows:
            self._rows[id(doc)] = doc.edges.count() + (doc.nodes.count() if doc.nodes is not None else 0)
        return self._rows[id(doc)]

    def push(self, doc: GraphDoc) -> None:
        self.past = [*self.past, self.now][-self.depth :]
        while len(self.past) > self.least and sum(map(self._size, self.past)) > self.budget:
            self.past = self.past[1:]
        self.now, self.future = doc, []

    def undo(self) -> GraphDoc:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        return self.now

    def redo(self) -> GraphDoc:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        return self.now
