"""A whole session as one JSON document: tables, mapping, chain, style, layout, positions, metric recipes, edits, source.

Writing leaves out what is empty. Reading trusts nothing: a document without tables or of a newer version is refused,
steps, styles, layouts, recipes and edits of another shape are dropped, depths and limits are clamped."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..model import POS, GraphDoc, Mapping, build_doc, guess_mapping, guess_node_id, reconcile
from ..operators import columns, overlay
from ..operators.chain import KINDS, Condition, Step, validate
from ..operators.details import _LINK_METRICS, _NODE_METRICS, Recipe, replay
from ..operators.overlay import Overlay
from ..operators.style import Style, TypeStyle

FORMAT, VERSION = "loomgraph-workspace", 1
LAYOUTS = ("force", "forceatlas2", "circle", "grid", "hierarchy", "radial", "geo", "circlepack")
#: Rows that a document may hold, hops that a source walk may go.
MOST_ROWS, MOST_DEPTH = 200_000, 6


@dataclass(frozen=True)
class Workspace:
    doc: GraphDoc
    chain: list[Step] = field(default_factory=list)
    style: Style = field(default_factory=Style)
    layout: str = "force"
    show_isolated: bool | None = None
    positions: dict[str, tuple[float, float]] = field(default_factory=dict)
    pinned: tuple[str, ...] = ()
    recipes: tuple[Recipe, ...] = ()
    edits: Overlay | None = None
    source: dict[str, Any] | None = None


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    got = [r.asDict(recursive=True) for r in df.orderBy(POS).drop(POS).limit(MOST_ROWS + 1).collect()]
    if len(got) > MOST_ROWS:
        raise ValueError(f"a workspace holds up to {MOST_ROWS} rows a table: narrow the graph first")
    return got


def write(w: Workspace) -> str:
    def table(name: str, df: DataFrame) -> dict[str, Any]:
        kinds = [{"name": c, "type": k} | ({"role": w.doc.roles[name, c]} if (name, c) in w.doc.roles else {}) for c, k in df.dtypes if c != POS]
        return {"columns": kinds, "rows": _rows(df)}

    m = w.doc.mapping
    mapping = {"source": m.source, "target": m.target, "attrs": list(m.attrs)} | ({} if m.node_attrs is None else {"nodeAttrs": list(m.node_attrs)})
    doc = {"edges": table("edges", w.doc.edges), "nodes": table("nodes", w.doc.nodes), "nodeIdColumn": w.doc.node_id, "mapping": mapping, "nodesDeclared": w.doc.nodes_declared}
    optional = {
        "positions": {k: [round(x, 2), round(y, 2)] for k, (x, y) in w.positions.items()}, "pinned": list(w.pinned), "computed": [asdict(r) for r in w.recipes],
        "edits": overlay.to_json(w.edits) if w.edits is not None and not w.edits.is_empty() else None, "source": w.source,
    }
    out = {"format": FORMAT, "version": VERSION, "doc": doc, "chain": [asdict(s) for s in w.chain], "style": asdict(w.style), "layout": w.layout, "showIsolated": w.show_isolated}
    return json.dumps(out | {k: v for k, v in optional.items() if v}, ensure_ascii=False, default=str)


def _known(kind: type, held: Any) -> dict[str, Any]:
    return {f.name: held[f.name] for f in fields(kind) if f.name in held} if isinstance(held, dict) else {}


def _condition(held: Any) -> Condition | None:
    if held is None:
        return None
    got = _known(Condition, held)
    texts = lambda v: None if v is None else tuple(str(x) for x in v)
    numbers = [got.get(k) for k in ("low", "high")]
    if not isinstance(got.get("column"), str) or any(not (v is None or isinstance(v, (int, float)) and math.isfinite(v)) for v in numbers):
        raise ValueError("a condition needs a column and finite bounds")
    return Condition(**got | {k: texts(got.get(k)) for k in ("selected", "excluded")})


def read_step(held: Any) -> Step | None:
    """A step, or None for what is none."""
    try:
        got = _known(Step, held)
        if got.get("kind") not in KINDS:
            return None
        got |= {"condition": _condition(got.get("condition")), "where": _condition(got.get("where")), "centers": tuple(str(c) for c in got.get("centers") or ())}
        step = Step(**got)
        return validate(replace(step, depth=min(max(int(step.depth), 0), 1_000)))
    except (TypeError, ValueError, AttributeError):
        return None


def read_style(held: Any) -> Style:
    got = {k: v for k, v in _known(Style, held).items() if isinstance(v, str)}

    def types(block: Any) -> tuple[str, dict[str, TypeStyle]] | None:
        if not (isinstance(block, (list, tuple)) and len(block) == 2 and isinstance(block[0], str) and isinstance(block[1], dict)):
            return None
        made = {}
        for kind, look in block[1].items():
            own = {k: v for k, v in _known(TypeStyle, look).items() if v is None or isinstance(v, (int, float) if k in ("size", "width") else (list, tuple) if k == "attrs" else str)}
            made[str(kind)] = TypeStyle(**own | ({"attrs": tuple(map(str, own["attrs"]))} if own.get("attrs") is not None else {}))
        return block[0], made

    held = held if isinstance(held, dict) else {}
    return Style(**got, node_types=types(held.get("node_types")), edge_types=types(held.get("edge_types")))


def check_source_url(url: str) -> str | None:
    """The url, if it is http(s) and carries no credentials."""
    parts = urlsplit(url)
    return url if parts.scheme in ("http", "https") and parts.hostname and parts.username is None and parts.password is None else None


def source_ref(name: str, size: int | None = None, url: str | None = None) -> dict[str, Any]:
    """How a source is known again: by its url, else by its file's name and size."""
    return {"url": url} if url else {"name": name, "size": size}


def same_source(a: dict[str, Any], b: dict[str, Any]) -> bool:
    return a.get("url") == b.get("url") if a.get("url") or b.get("url") else (a.get("name"), a.get("size")) == (b.get("name"), b.get("size"))


def read_source(held: Any) -> dict[str, Any] | None:
    if not isinstance(held, dict):
        return None
    ref = held.get("ref") if isinstance(held.get("ref"), dict) else held
    if ref.get("url") is not None and not (isinstance(ref["url"], str) and check_source_url(ref["url"])):
        return None
    if ref.get("url") is None and not isinstance(ref.get("name"), str):
        return None
    number = lambda v, low, high, default: min(high, max(low, int(v))) if isinstance(v, (int, float)) and math.isfinite(v) else default
    return held | {"depth": number(held.get("depth"), 0, MOST_DEPTH, 1), "edgeLimit": number(held.get("edgeLimit"), 1, MOST_ROWS, MOST_ROWS)}


def _table(spark: SparkSession, held: Any) -> DataFrame | None:
    if not (isinstance(held, dict) and isinstance(held.get("columns"), list) and isinstance(held.get("rows"), list)):
        return None
    kinds = {"text": "string", "number": "double", "bool": "boolean"}
    named = [(c["name"], kinds.get(c.get("type"), c.get("type", "string"))) for c in held["columns"] if isinstance(c, dict) and isinstance(c.get("name"), str)]
    if not named:
        return None
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list, bool)) else str(v)
    rows = [(*(text(r.get(n)) for n, _ in named), k) for k, r in enumerate(held["rows"]) if isinstance(r, dict)]
    names = [f"c{k}" for k in range(len(named))]
    df = spark.createDataFrame(rows, ", ".join([*(f"{n} string" for n in names), f"{POS} long"]))
    try:
        return df.select(*[df[c].try_cast(kind).alias(n) for c, (n, kind) in zip(names, named)], POS)
    except Exception as e:
        raise ValueError("the workspace has a column type that is none") from e


def read(spark: SparkSession, text: str) -> Workspace:
    try:
        held = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("the workspace is no JSON") from e
    if not isinstance(held, dict) or held.get("format") != FORMAT or not isinstance(held.get("doc"), dict):
        raise ValueError("no workspace")
    if held.get("version", 0) > VERSION:
        raise ValueError("the workspace is of a newer version")
    doc = held["doc"]
    edges, nodes, m = _table(spark, doc.get("edges")), _table(spark, doc.get("nodes")), doc.get("mapping")
    if edges is None or nodes is None or not isinstance(m, dict) or not {m.get("source"), m.get("target")} <= set(edges.columns) or doc.get("nodeIdColumn") not in nodes.columns:
        raise ValueError("the workspace is damaged: a table, the id column or the mapping is missing")
    strings = lambda v: tuple(x for x in v if isinstance(x, str)) if isinstance(v, list) else None
    mapping = Mapping(m["source"], m["target"], strings(m.get("attrs")) or (), strings(m.get("nodeAttrs")))
    roles = {(t, c["name"]): c["role"] for t in ("edges", "nodes") for c in doc[t]["columns"] if isinstance(c, dict) and c.get("role") in columns.ROLES}
    declared = doc.get("nodesDeclared") is True
    graph = GraphDoc(edges, mapping, nodes, doc["nodeIdColumn"], declared, roles=roles)
    metric = lambda r: isinstance(r, dict) and r.get("metric") in {**_NODE_METRICS, **_LINK_METRICS}
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    places = held.get("positions") if isinstance(held.get("positions"), dict) else {}
    shown = held.get("showIsolated")
    return Workspace(
        graph, [s for s in map(read_step, held.get("chain") or []) if s is not None], read_style(held.get("style")),
        held["layout"] if held.get("layout") in LAYOUTS else "force", shown if isinstance(shown, bool) else declared,
        {k: (float(v[0]), float(v[1])) for k, v in places.items() if isinstance(v, list) and len(v) == 2 and all(map(number, v))},
        strings(held.get("pinned")) or (), tuple(Recipe(**_known(Recipe, r)) for r in held.get("computed") or [] if metric(r)),
        overlay.from_json(spark, held["edits"]) if isinstance(held.get("edits"), dict) else None, read_source(held.get("source")),
    )


def build(
    edges: DataFrame, nodes: DataFrame | None = None, source: str | None = None, target: str | None = None, node_id: str | None = None, node_attrs: tuple[str, ...] | None = None,
    roles: dict[str, str] | None = None, color: str | None = None, size: str | None = None, image: str | None = None, label: str | None = None, edge_color: str | None = None,
    edge_width: str | None = None, layout: str = "force", show_isolated: bool | None = None, positions: dict[str, tuple[float, float]] | None = None, pinned: tuple[str, ...] = (),
) -> Workspace:
    """A workspace from tables; unknown columns, roles and layouts are errors."""
    if layout not in LAYOUTS:
        raise ValueError(f"no such layout: {layout}; there are {', '.join(LAYOUTS)}")
    guess = guess_mapping(edges.columns)
    mapping = Mapping(source or guess.source, target or guess.target)
    here = lambda df, *names: [n for n in names if n is not None and n not in df.columns]
    missing = here(edges, mapping.source, mapping.target, edge_color, edge_width)
    mapping = replace(mapping, attrs=tuple(c for c in edges.columns if c not in (mapping.source, mapping.target, POS)), node_attrs=node_attrs)
    doc = reconcile(build_doc(edges, nodes, mapping, node_id or (guess_node_id(nodes.columns) if nodes is not None else None)))
    missing += here(doc.nodes, doc.node_id, label, *(node_attrs or ()))
    missing += [c for c in (color, size, image) if c is not None and c not in doc.nodes.columns and c not in edges.columns and not c.startswith("metric:")]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    for name, role in (roles or {}).items():
        table = "nodes" if name in doc.nodes.columns else "edges"
        if name not in doc.nodes.columns and name not in edges.columns:
            raise ValueError(f"no such column: {name}")
        doc = columns.set_role(doc, table, name, role)

    def token(c: str | None, table: str, default: str) -> str:
        if c is None or c.startswith("metric:"):
            return c or default
        return f"{'cell' if doc.roles.get((table, c)) == 'color' else 'column'}:{c}"

    look = Style(token(color, "nodes", "none"), token(size, "nodes", "metric:degree"), token(label, "nodes", "none"), token(image, "nodes", "none"), token(edge_width, "edges", "uniform"), token(edge_color, "edges", "uniform"))
    return Workspace(doc, style=look, layout=layout, show_isolated=show_isolated, positions=positions or {}, pinned=pinned)


def update(w: Workspace, edges: DataFrame, nodes: DataFrame | None = None) -> tuple[Workspace, DataFrame]:
    """The session over new data: the mapping stays where its columns do, edits are laid over, metrics run again, steps
    and style follow what is there. With the report of the merge."""
    m, held = w.doc.mapping, set(edges.columns)
    mapping = replace(m, attrs=tuple(c for c in m.attrs if c in held)) if {m.source, m.target} <= held else guess_mapping(edges.columns)
    declared = nodes is not None and w.doc.node_id in nodes.columns
    doc = reconcile(build_doc(edges, nodes, mapping, w.doc.node_id if declared else None)).with_(roles={k: r for k, r in w.doc.roles.items() if k[1] in held or nodes is not None and k[1] in nodes.columns})
    report = None
    if w.edits is not None:
        doc, report = overlay.merge(w.doc, w.edits, doc)
    return remap(replace(w, doc=replay(doc, list(w.recipes))), mapping), report


def remap(w: Workspace, mapping: Mapping) -> Workspace:
    """The session under another mapping: node rows for new ends, steps on columns that are gone dropped, style fallen back."""
    from ..operators.chain import retarget
    from ..operators.style import column_of, retarget_style

    doc, chain, style = reconcile(w.doc.with_(mapping=mapping)), w.chain, w.style
    names = {t: set(df.columns) for t, df in (("edges", doc.edges), ("nodes", doc.nodes))}
    for step in w.chain:
        for c in (step.column, step.condition and step.condition.column, step.where and step.where.column):
            if c and c not in names[step.table]:
                chain = retarget(chain, step.table, c, None)
    for f in fields(Style):
        token = getattr(w.style, f.name)
        if isinstance(token, str) and (c := column_of(token)) and c not in names["edges"] | names["nodes"]:
            style = retarget_style(style, doc, c, None)
    return replace(w, doc=doc, chain=chain, style=style)
