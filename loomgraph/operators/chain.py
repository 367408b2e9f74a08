"""The filter chain: ordered steps, each narrowing the graph that its predecessor left; any may be inverted.

The state is the edge rows and the ids that may stay. A step gives fewer rows or fewer ids; which of the two an
inverted step complements is a property of its kind. Ids, and rows that a join chose, are written down after the step,
so that what a step reads doesn't depend on how many steps came before it: the plans of a chain grow by the same
amount with each step."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import POS, GraphDoc
from ..plans.scratch import cut
from . import graph as g
from . import metrics, stats, traverse

KINDS = ("column", "degree", "kcore", "component", "ego", "mutual", "backbone", "timewindow")
#: Listed values beyond which a values condition joins instead of testing a list.
LONG_LIST = 1000


@dataclass(frozen=True)
class Condition:
    """Values selected or excluded (one of them), or a numeric range (inclusive, None is open)."""

    column: str
    selected: tuple[str, ...] | None = None
    excluded: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None

    @property
    def is_range(self) -> bool:
        return self.selected is None and self.excluded is None

    def expr(self, df: DataFrame) -> Column:
        if self.is_range:
            v = cells.num(df, self.column)
            out = v.isNotNull()
            out = out & (v >= self.low) if self.low is not None else out
            return out & (v <= self.high) if self.high is not None else out
        key = cells.cell_key(df, self.column)
        if self.selected is not None:
            return key.isin(list(self.selected)) if self.selected else F.lit(False)
        return ~key.isin(list(self.excluded)) if self.excluded else F.lit(True)

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows that meet it; long lists are joined."""
        values = self.selected if self.selected is not None else self.excluded
        if values is None or len(values) <= LONG_LIST:
            return df.where(self.expr(df))
        listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "__v string")
        keyed = df.withColumn("__v", cells.cell_key(df, self.column))
        return keyed.join(listed, "__v", "left_semi" if self.selected is not None else "left_anti").drop("__v")


@dataclass(frozen=True)
class Step:
    kind: str
    table: str = "edges"
    condition: Condition | None = None
    column: str | None = None
    mode: str = "all"
    low: float | None = None
    high: float | None = None
    k: int = 2
    count: int = 1
    centers: tuple[str, ...] = ()
    depth: int = 1
    direction: str = "any"
    where: Condition | None = None
    walked_only: bool = False
    alpha: float = 0.3
    invert: bool = False
    enabled: bool = True
    name: str = field(default="")


def validate(step: Step) -> Step:
    if step.kind not in KINDS:
        raise ValueError(f"no such step: {step.kind}")
    if step.kind == "column" and step.condition is None:
        raise ValueError("a column step needs a condition")
    if step.kind == "timewindow" and not step.column:
        raise ValueError("a time window needs a column")
    if step.table not in ("edges", "nodes") or step.mode not in ("all", "in", "out") or step.direction not in ("any", "in", "out"):
        raise ValueError("no such table, mode or direction")
    if step.depth < 0 or step.count < 0 or not 0 <= step.alpha <= 1:
        raise ValueError("depth and count can't be negative, alpha is between 0 and 1")
    for c in (step.condition, step.where):
        if c is not None and c.selected is not None and c.excluded is not None:
            raise ValueError("a condition selects or excludes values, not both")
    return step


def neutral(df: DataFrame, column: str) -> Condition:
    """A condition to start from: every value of a text column, every number of a number column."""
    return Condition(column) if isinstance(df.schema[column].dataType, T.NumericType) else Condition(column, excluded=())


def is_neutral(condition: Condition) -> bool:
    """Does it let every row through, whatever the data? An open range doesn't: it drops what is no number."""
    return condition.excluded is not None and not condition.excluded


def default_step(kind: str, doc: GraphDoc) -> Step:
    """A new step with its usual settings; a column step or time window starts without narrowing anything."""
    names = [c for c in doc.edges.columns if c != POS and not c.startswith("__")]
    if kind == "column":
        return Step("column", condition=neutral(doc.edges, names[0]))
    if kind == "degree":
        return Step("degree", low=1)
    if kind == "timewindow":
        for table, df in (("edges", doc.edges), ("nodes", doc.nodes)):
            if df is not None and (found := stats.time_columns(df, [c for c in df.columns if c != POS and not c.startswith("__")])):
                return Step("timewindow", table=table, column=found[0])
        numbers = [c for c in names if isinstance(doc.edges.schema[c].dataType, T.NumericType)]
        return Step("timewindow", column=(numbers or names)[0])
    return validate(Step(kind))


def describe(step: Step) -> str:
    text = {
        "column": lambda: f"{step.condition.column} " + ("in range" if step.condition.is_range else "selected" if step.condition.selected is not None else "excluded"),
        "degree": lambda: f"degree ({step.mode})",
        "kcore": lambda: f"{step.k}-core",
        "component": lambda: f"{step.count} largest components",
        "ego": lambda: f"within {step.depth} of {', '.join(step.centers)}",
        "mutual": lambda: "mutual ties",
        "backbone": lambda: f"backbone at {step.alpha:g}",
        "timewindow": lambda: f"{step.column} in window",
    }[step.kind]()
    return f"not {text}" if step.invert else text


@dataclass(frozen=True)
class Applied:
    graph: g.BaseGraph
    rows: DataFrame
    keep: DataFrame | None
    steps: list[tuple[str, g.BaseGraph]]


def apply_chain(doc: GraphDoc, chain: list[Step], show_isolated: bool | None = None) -> Applied:
    rows, keep = g.with_ends(doc), None
    graph, told = g.base_graph(doc, rows, keep, show_isolated), []
    for step in chain:
        validate(step)
        if step.enabled:
            fewer, ids = _apply(doc, graph, rows, keep, step)
            if fewer is not rows:
                rows = fewer if step.kind in ("column", "timewindow") and not step.invert else cut(fewer)
            keep = keep if ids is keep else cut(ids)
            graph = g.base_graph(doc, rows, keep, show_isolated)
        told.append((describe(step), graph))
    return Applied(graph, rows, keep, told)


def step_counts(applied: Applied) -> list[tuple[str, int, int]]:
    """Name, nodes and links after each step."""
    return [(name, graph.nodes.count(), graph.links.count()) for name, graph in applied.steps]


def input_before(doc: GraphDoc, chain: list[Step], at: int, show_isolated: bool | None = None) -> Applied:
    """The state that enters the step at this place."""
    return apply_chain(doc, chain[:at], show_isolated)


def _apply(doc: GraphDoc, graph: g.BaseGraph, rows: DataFrame, keep: DataFrame | None, step: Step) -> tuple[DataFrame, DataFrame | None]:
    by_rows = step.kind in ("mutual", "backbone") or (step.kind in ("column", "timewindow") and step.table == "edges")
    if by_rows:
        kept = _kept_rows(graph, rows, step)
        if step.invert:
            kept = rows.join(kept.select(POS), POS, "left_anti")
        return kept, keep
    ids, fewer = _kept_ids(doc, graph, rows, step)
    if step.invert:
        ids, fewer = graph.nodes.select("id").join(ids, "id", "left_anti"), None
    if keep is not None:
        ids = ids.join(keep, "id", "left_semi")
    return (rows if fewer is None else fewer), ids


def _kept_rows(graph: g.BaseGraph, rows: DataFrame, step: Step) -> DataFrame:
    if step.kind == "column":
        return step.condition.apply(rows)
    if step.kind == "timewindow":
        return rows.where(_window(rows, step))
    if step.kind == "mutual":
        return g.mutual_rows(graph)
    alpha = metrics.disparity(g.weighted_links(graph, step.column)).where(F.col("alpha") <= step.alpha)
    return graph.rows.join(alpha.select(F.col("s").alias("__s"), F.col("t").alias("__t")), ["__s", "__t"], "left_semi")


def _window(df: DataFrame, step: Step) -> Column:
    t = cells.tms(df, step.column)
    out = t.isNotNull()
    out = out & (t >= step.low) if step.low is not None else out
    return out & (t <= step.high) if step.high is not None else out


def _kept_ids(doc: GraphDoc, graph: g.BaseGraph, rows: DataFrame, step: Step) -> tuple[DataFrame, DataFrame | None]:
    """ids that stay, and rows if the step itself also narrows those."""
    if step.kind in ("column", "timewindow"):
        kept = step.condition.apply(doc.nodes) if step.kind == "column" else doc.nodes.where(_window(doc.nodes, step))
        return kept.select(cells.cell_id(kept, doc.node_id).alias("id")).where("id IS NOT NULL").distinct(), None
    if step.kind == "degree":
        d = F.col({"all": "degree", "in": "in_degree", "out": "out_degree"}[step.mode])
        ok = F.lit(True)
        ok = ok & (d >= step.low) if step.low is not None else ok
        ok = ok & (d <= step.high) if step.high is not None else ok
        return graph.nodes.where(ok).select("id"), None
    if step.kind == "kcore":
        if step.k <= 0:
            return graph.nodes.select("id"), None
        return metrics.kcore(g.weighted_links(graph), step.k), None
    if step.kind == "component":
        comp = metrics.components(graph.nodes.select("id", "pos"), graph.links)
        return comp.where(F.col("component").cast("long") < step.count).select("id"), None
    return _ego(doc, graph, rows, step)


def _ego(doc: GraphDoc, graph: g.BaseGraph, rows: DataFrame, step: Step) -> tuple[DataFrame, DataFrame | None]:
    links = graph.links
    passing = graph.rows if step.where is None else step.where.apply(graph.rows)
    if step.where is not None:
        links = passing.select(F.col("__s").alias("s"), F.col("__t").alias("t")).distinct()
    centers = doc.edges.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(step.centers)], "id string")
    seeds = graph.nodes.select("id").join(F.broadcast(centers), "id", "left_semi")
    reached = cut(traverse.reach(links, seeds, step.depth, step.direction))
    ids = reached.select("id")
    if not step.walked_only or step.invert:
        return ids, None
    return ids, walked_rows(passing, reached, step.direction).drop("__ds", "__dt")


def walked_rows(rows: DataFrame, reached: DataFrame, direction: str) -> DataFrame:
    """Rows that carry a step from one depth to the next, in the direction of the walk."""
    a = reached.select(F.col("id").alias("__s"), F.col("depth").alias("__ds"))
    b = reached.select(F.col("id").alias("__t"), F.col("depth").alias("__dt"))
    both = rows.join(a, "__s").join(b, "__t")
    out, back = F.col("__dt") == F.col("__ds") + 1, F.col("__ds") == F.col("__dt") + 1
    return both.where({"out": out, "in": back, "any": out | back}[direction])


def retarget(chain: list[Step], table: str, old: str, new: str | None) -> list[Step]:
    """Follows a renamed column; steps on a deleted one go."""
    out = []
    for step in chain:
        uses = step.table == table and (step.column == old or (step.condition and step.condition.column == old)) or (table == "edges" and step.where and step.where.column == old)
        if not uses:
            out.append(step)
        elif new is not None:
            out.append(replace(
                step,
                column=new if step.column == old else step.column,
                condition=replace(step.condition, column=new) if step.condition and step.condition.column == old else step.condition,
                where=replace(step.where, column=new) if step.where and step.where.column == old else step.where,
            ))
    return out


def split_seed_list(text: str) -> list[str] | None:
    """Ids in pasted text: new lines, commas and semicolons part them if there are any, else white space; fewer than two is none."""
    parts = re.split(r"[\n,;]" if re.search(r"[\n,;]", text) else r"\s+", text.strip())
    parts = [p.strip() for p in parts if p.strip()]
    return parts if len(parts) >= 2 else None


def narrows(df: DataFrame, condition: Condition) -> bool:
    """Does the condition drop any row?"""
    return not df.where(~F.coalesce(condition.expr(df), F.lit(False))).isEmpty()


def expand_center(chain: list[Step], center: str) -> list[Step]:
    """Adds a centre to the last enabled ego step, or such a step."""
    for k in range(len(chain) - 1, -1, -1):
        if chain[k].kind == "ego" and chain[k].enabled:
            own = chain[k].centers
            return [*chain[:k], replace(chain[k], centers=own if center in own else (*own, center)), *chain[k + 1 :]]
    return [*chain, Step("ego", centers=(center,))]


def toggle_value(chain: list[Step], table: str, column: str, value: str) -> list[Step]:
    """Adds a value to the column's selected values or takes it away; a step without values goes."""
    for k, step in enumerate(chain):
        if step.kind == "column" and step.table == table and step.condition.column == column and step.condition.selected is not None:
            own = step.condition.selected
            new = tuple(v for v in own if v != value) if value in own else (*own, value)
            return [*chain[:k], *([replace(step, condition=replace(step.condition, selected=new))] if new else []), *chain[k + 1 :]]
    return [*chain, Step("column", table=table, condition=Condition(column, selected=(value,)))]


def playback(step: Step, low: float, high: float, width: float, bin_width: float) -> list[Step]:
    """A time window slid bin by bin over the range; the last ones are clipped at its end."""
    out, start = [], low
    while start <= high:
        out.append(replace(step, low=start, high=min(start + width, high)))
        start += bin_width
    return out
