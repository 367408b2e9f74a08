"""Columns of a document: changes that everything naming them follows, their roles, and which column serves for what."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import POS, GraphDoc, reconcile
from . import edits

ROLES = ("color", "url", "image", "markup", "time")


def _of(doc: GraphDoc, table: str) -> DataFrame:
    return doc.edges if table == "edges" else doc.nodes


def _with(doc: GraphDoc, table: str, df: DataFrame) -> GraphDoc:
    return doc.with_(edges=df) if table == "edges" else doc.with_(nodes=df)


def structural(doc: GraphDoc, table: str) -> set[str]:
    """Columns that nothing works without."""
    return {doc.mapping.source, doc.mapping.target} if table == "edges" else {doc.node_id}


def add(doc: GraphDoc, table: str, name: str, kind: str = "string") -> GraphDoc:
    return _with(doc, table, edits.add_column(_of(doc, table), name, {"text": "string", "number": "double", "bool": "boolean"}.get(kind, kind)))


def rename(doc: GraphDoc, table: str, old: str, new: str) -> GraphDoc:
    """The id column, the mapping and the roles follow; a blank or taken name changes nothing."""
    df, new = _of(doc, table), new.strip()
    if not new or new == old or old not in df.columns or new in df.columns or old == POS:
        return doc
    swap = lambda c: new if c == old else c
    out = _with(doc, table, df.withColumnRenamed(old, new)).with_(roles={(t, swap(c) if t == table else c): r for (t, c), r in doc.roles.items()}, computed=frozenset(map(swap, doc.computed)))
    m = doc.mapping
    if table == "nodes":
        return out.with_(node_id=swap(doc.node_id), mapping=replace(m, node_attrs=m.node_attrs and tuple(map(swap, m.node_attrs))))
    return out.with_(mapping=replace(m, source=swap(m.source), target=swap(m.target), attrs=tuple(map(swap, m.attrs))))


def delete(doc: GraphDoc, table: str, name: str) -> GraphDoc:
    """Structural columns stay."""
    df = _of(doc, table)
    if name not in df.columns or name == POS or name in structural(doc, table):
        return doc
    m, rest = doc.mapping, lambda names: names and tuple(c for c in names if c != name)
    m = replace(m, attrs=rest(m.attrs)) if table == "edges" else replace(m, node_attrs=rest(m.node_attrs))
    return _with(doc, table, df.drop(name)).with_(mapping=m, roles={k: r for k, r in doc.roles.items() if k != (table, name)})


def retype(doc: GraphDoc, table: str, name: str, kind: str) -> GraphDoc:
    """Cells that the type can't hold are emptied; ids that go this way get their node rows back."""
    df = _of(doc, table)
    if name not in df.columns:
        return doc
    out = _with(doc, table, edits.retype_column(df, name, {"string": "text", "double": "number", "boolean": "bool"}.get(kind, kind)))
    return reconcile(out) if name in structural(doc, table) else out


def set_role(doc: GraphDoc, table: str, name: str, role: str | None) -> GraphDoc:
    """What the cells are for; None takes it back."""
    if role is not None and role not in ROLES:
        raise ValueError(f"no such role: {role}")
    if name not in _of(doc, table).columns:
        return doc
    roles = {k: r for k, r in doc.roles.items() if k != (table, name)}
    return doc.with_(roles=roles | ({(table, name): role} if role else {}))


def visible(df: DataFrame, order: list[str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """The columns as they are shown: in the given order, new ones at the end, without the hidden ones."""
    known = [c for c in order if c in df.columns]
    return df.select(*[c for c in [*known, *(c for c in df.columns if c not in known and c != POS)] if c not in hidden])


# ---- which column serves for what


def edge_style_columns(doc: GraphDoc) -> list[str]:
    return [c for c in doc.edges.columns if c != POS and c not in structural(doc, "edges")]


def node_style_columns(doc: GraphDoc) -> list[str]:
    """The node table's own first, then what the edges can tell of the nodes."""
    taken = structural(doc, "edges") | structural(doc, "nodes") | {POS}
    return [c for c in dict.fromkeys([*doc.nodes.columns, *doc.edges.columns]) if c not in taken]


def node_detail_columns(doc: GraphDoc, chosen: tuple[str, ...] | None = None) -> list[str]:
    """All but the id, or those chosen (for a type of nodes, else for all)."""
    chosen = doc.mapping.node_attrs if chosen is None else chosen
    return [c for c in doc.nodes.columns if c not in (doc.node_id, POS) and (chosen is None or c in chosen)]


def edge_detail_columns(doc: GraphDoc, chosen: tuple[str, ...] | None = None) -> list[str]:
    """Those of the mapping, or those chosen for a type of edges."""
    return list(doc.mapping.attrs) if chosen is None else [c for c in edge_style_columns(doc) if c in chosen]


def color_columns(doc: GraphDoc, table: str) -> list[str]:
    """Text columns that are colours: by their role, else where half of the filled cells are; one pass a table."""
    names = edge_style_columns(doc) if table == "edges" else node_style_columns(doc)
    of = {c: "nodes" if table == "nodes" and c in doc.nodes.columns else "edges" for c in names}
    names = [c for c in names if isinstance(_of(doc, of[c]).schema[c].dataType, T.StringType)]
    found = {c for c in names if doc.roles.get((of[c], c)) == "color"}
    for side in ("nodes", "edges"):
        asked = [c for c in names if of[c] == side and (side, c) not in doc.roles]
        if asked:
            df = _of(doc, side)
            marks = [x for k, c in enumerate(asked) for x in (F.count(cells.cell_id(df, c)).alias(f"n{k}"), F.count(cells.parse_color(cells.text(df, c))).alias(f"c{k}"))]
            row = df.agg(*marks).first()
            found |= {c for k, c in enumerate(asked) if row[f"n{k}"] and 2 * row[f"c{k}"] >= row[f"n{k}"]}
    return [c for c in names if c in found]
