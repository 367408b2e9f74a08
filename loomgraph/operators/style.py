"""Appearance as columns: sizes, colours, widths, labels; and coordinates of the static layouts."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import POS, GraphDoc
from ..plans.scratch import cut, dealt
from .graph import BaseGraph, category_attribute, first_number_attribute, labels, numeric_attribute, weighted_links
from .metrics import ranked

# Palettes and the neutral colour.
PALETTE = ("#2a78d6", "#eb6834", "#2f9e6e", "#b453c6", "#d9a514", "#4fb3bf", "#c2456b", "#7a6ff0")
RAMP = ("#dbe9fb", "#a9cbf3", "#6fa8e8", "#3d82d4", "#1c5cab", "#0d3a78")
NEUTRAL = "#898781"
#: Layers of a layout.
MOST_LAYERS = 1000


def _with_extent(df: DataFrame, value: str) -> DataFrame:
    """The rows with the column's least and greatest value: one aggregate row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))))


def node_radius(values: DataFrame, curve: str = "sqrt", image: bool = False) -> DataFrame:
    """id, radius from id, value (null counts as 0)."""
    v = values.select("id", F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0))).alias("m"))
    sized = _with_extent(v, "m")
    low, span = (8.0, 20.0) if image else (4.5, 17.0)
    return sized.select("id", (low + span * cells.curve(F.col("m") / F.greatest(F.col("__hi"), F.lit(1e-9)), curve)).alias("radius"))


def ranking_color(values: DataFrame, ramp: tuple[str, ...] = RAMP) -> DataFrame:
    """id, color from id, value along a ramp."""
    ranged = _with_extent(values.where("value IS NOT NULL"), "value")
    width = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    return ranged.select("id", cells.ramp_color((F.col("value") - F.col("__lo")) / width, list(ramp)).alias("color"))


def group_ranks(values: DataFrame) -> DataFrame:
    """value, n, rank (from 0) of the non-null values of id, value, pos: most frequent first, then first to appear."""
    counts = values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranks = ranked(counts.withColumn("id", F.col("value")), F.desc("n"), F.asc("first"), F.asc("value"))
    return counts.join(ranks.select(F.col("id").alias("value"), "rank"), "value")


def category_color(values: DataFrame, palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """id, color: the slot of the value's rank, else neutral."""
    ranks = group_ranks(values).select("value", "rank")
    slot = F.when(F.col("rank") < len(palette), F.element_at(F.array(*map(F.lit, palette)), F.col("rank").cast("int") + 1))
    return values.join(ranks, "value", "left").select("id", F.coalesce(slot, F.lit(NEUTRAL)).alias("color"))


def legend(values: DataFrame, palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """label, color, n: a slot each, then Other, then Unassigned."""
    ranks = group_ranks(values)
    k = len(palette)
    named = ranks.where(F.col("rank") < k).select(F.col("value").alias("label"), F.element_at(F.array(*map(F.lit, palette)), F.col("rank").cast("int") + 1).alias("color"), "n")
    other = ranks.where(F.col("rank") >= k).agg(F.sum("n").alias("n")).where("n IS NOT NULL").select(F.lit("Other").alias("label"), F.lit(NEUTRAL).alias("color"), "n")
    none = values.where("value IS NULL").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("Unassigned").alias("label"), F.lit(NEUTRAL).alias("color"), "n")
    return named.unionByName(other).unionByName(none)


def edge_width(values: DataFrame, keys: list[str], curve: str = "linear", pixels: bool = False) -> DataFrame:
    """keys, width from keys, value."""
    if pixels:
        return values.select(*keys, F.coalesce(F.least(F.lit(24.0), F.greatest(F.lit(0.2), "value")), F.lit(1.0)).alias("width"))
    ranged = _with_extent(values, "value")
    t = (F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    width = F.when(F.col("__hi").isNull(), 1.4).when(F.col("__hi") == F.col("__lo"), F.when(F.col("value").isNull(), 1.0).otherwise(2.0)).when(F.col("value").isNull(), 1.0).otherwise(1 + 5 * cells.curve(t, curve))
    return ranged.select(*keys, width.alias("width"))


def override(values: DataFrame, kind: str, channel: str, by_kind: dict[str, object]) -> DataFrame:
    """The channel's column with what is set for a row's kind."""
    if not by_kind:
        return values
    names = F.create_map(*[F.lit(x) for kv in by_kind.items() for x in kv])
    return values.withColumn(channel, F.coalesce(F.try_element_at(names, F.col(kind)), F.col(channel)))


def _places(nodes: DataFrame, *order: Column) -> DataFrame:
    placed = ranked(nodes, *order, F.asc("id")).withColumnRenamed("rank", "k")
    return nodes.join(placed, "id").crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n"))))


def layout_circle(nodes: DataFrame) -> DataFrame:
    """id, x, y from id, group, degree, pos: groups together (none last), heavier first, on one circle."""
    placed = _places(nodes, F.asc_nulls_last("group"), F.desc("degree"), F.asc("pos"))
    r = F.greatest(F.lit(150.0), F.col("n") * 42 / (2 * math.pi))
    angle = -math.pi / 2 + 2 * math.pi * F.col("k") / F.col("n")
    return placed.select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def layout_grid(nodes: DataFrame, spacing: float = 92.0) -> DataFrame:
    """id, x, y from id, degree: row by row, heavier first, centred."""
    placed = _places(nodes, F.desc("degree"), F.asc("id"))
    cols = F.ceil(F.sqrt(1.4 * F.col("n")))
    rows = F.ceil(F.col("n") / cols)
    x = (F.col("k") % cols - (cols - 1) / 2) * spacing
    y = (F.floor(F.col("k") / cols) - (rows - 1) / 2) * spacing
    return placed.select("id", x.alias("x"), y.alias("y"))


def layout_geo(nodes: DataFrame, span: float = 900.0, gap: float = 60.0) -> DataFrame:
    """id, x, y from id, lat, lon: a web map fitted into a square; rows without coordinates in a strip below."""
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    mx, my = cells.mercator(F.col("lat"), F.col("lon"))
    on = nodes.where(ok).select("id", mx.alias("mx"), my.alias("my"))
    ext = on.agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    scale = F.when(wide > 0, span / wide).otherwise(1.0)
    fitted = on.crossJoin(F.broadcast(ext)).select("id", ((F.col("mx") - (F.col("x0") + F.col("x1")) / 2) * scale).alias("x"), ((F.col("my") - (F.col("y0") + F.col("y1")) / 2) * scale).alias("y"))
    off = nodes.where(~F.coalesce(ok, F.lit(False))).select("id")
    strip = ranked(off, F.asc("id")).withColumnRenamed("rank", "k").select("id", (-span / 2 + (F.col("k") % 16) * gap).alias("x"), (span / 2 + gap * (1 + F.floor(F.col("k") / 16))).alias("y"))
    return fitted.unionByName(strip)


def layout_layers(depths: DataFrame, links: DataFrame | None = None, row: float = 130.0, radial: bool = False) -> DataFrame:
    """id, x, y from id, depth, pos: a line (centred, with the others below each other) or a ring for each depth.

    With links (s, t), a layer is ordered by the mean place of its nodes' parents in the layer before it, without
    parents there by half of that layer's size, ties by id; the first layer, and all without links, by pos. Empty
    depths take no line."""
    depths = cut(dealt(depths.select("id", "depth", "pos"), "id"))
    layers = {d: (k, n) for k, (d, n) in enumerate(sorted((r["depth"], r["n"]) for r in depths.groupBy("depth").agg(F.count("*").alias("n")).limit(MOST_LAYERS + 1).collect()))}
    if len(layers) > MOST_LAYERS:
        raise ValueError(f"more than {MOST_LAYERS} layers")
    out, before, m_before = [], None, 0
    parents = None if links is None else cut(links.select(F.col("s").alias("parent"), F.col("t").alias("id")).distinct())
    for depth, (k, m) in layers.items():
        layer = depths.where(F.col("depth") == depth).select("id", "pos")
        if parents is None or before is None:
            placed = ranked(layer)
        else:
            score = parents.join(before.select(F.col("id").alias("parent"), F.col("rank").alias("p")), "parent").groupBy("id").agg(F.avg("p").alias("score"))
            scored = layer.join(score, "id", "left").withColumn("score", F.coalesce("score", F.lit(m_before / 2)))
            placed = ranked(scored, F.asc("score"), F.asc("id"))
        before, m_before = placed, m
        out.append(placed.select("id", "rank", F.lit(k).alias("k"), F.lit(m).alias("m")))
    if not out:
        return depths.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    placed = reduce(DataFrame.unionByName, out)
    if radial:
        r = F.when((F.col("k") == 0) & (F.col("m") == 1), 0.0).otherwise(F.greatest(140.0 * F.col("k"), 40.0 * F.col("m") / (2 * math.pi)))
        angle = -math.pi / 2 + 2 * math.pi * F.col("rank") / F.col("m")
        return placed.select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
    gap = F.greatest(F.lit(70.0), F.least(F.lit(150.0), 1100.0 / F.col("m")))
    return placed.select("id", ((F.col("rank") - (F.col("m") - 1) / 2) * gap).alias("x"), (row * F.col("k") - row * (len(layers) - 1) / 2).alias("y"))


# ---- all of it


@dataclass(frozen=True)
class TypeStyle:
    """What one kind of nodes or links looks like instead; None leaves what the rest of the style gives."""

    color: str | None = None
    size: float | None = None
    image: str | None = None
    label_column: str | None = None
    width: float | None = None
    attrs: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Style:
    """How marks look. Tokens: 'column:NAME' encodes a column's values, 'cell:NAME' takes its cells as they are,
    'metric:NAME' a centrality (degree, in, out, uniform among sizes); 'none' and 'uniform' are neither."""

    node_color: str = "none"
    node_size: str = "metric:degree"
    node_label: str = "none"
    node_image: str = "none"
    edge_width: str = "uniform"
    edge_color: str = "uniform"
    size_curve: str = "sqrt"
    node_types: tuple[str, dict[str, TypeStyle]] | None = None
    edge_types: tuple[str, dict[str, TypeStyle]] | None = None


# Bounds of sizes and widths that cells give.
CELL_RADIUS, CELL_WIDTH = (1.0, 100.0), (0.2, 24.0)


def column_of(token: str) -> str | None:
    kind, _, name = token.partition(":")
    return name if kind in ("column", "cell") else None


def _clamped(c: Column, bounds: tuple[float, float]) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(bounds[1]), F.greatest(F.lit(bounds[0]), c)))


def _is_number(doc: GraphDoc, column: str) -> bool:
    df = doc.nodes if column in doc.nodes.columns else doc.edges
    return column in df.columns and isinstance(df.schema[column].dataType, T.NumericType)


def _per_kind(styles: dict[str, TypeStyle], field: str, kind: Column) -> Column:
    """What the styles set for a row's kind, or null."""
    known = {k: getattr(s, field) for k, s in styles.items() if getattr(s, field) is not None}
    if not known:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), kind)


def _centrality(graph: BaseGraph, kind: str) -> DataFrame:
    from .details import centrality

    return centrality(graph.nodes.select("id", "pos"), weighted_links(graph), kind)


def _with_value(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    return nodes.join(values.select("id", F.col("value").alias(name)), "id", "left")


def style_nodes(graph: BaseGraph, doc: GraphDoc, style: Style) -> DataFrame:
    """id, grp (a colour column's value), value (what a colour ramp reads), color (set by a cell or a type), radius,
    label, image (with the kind of its source)."""
    ends, nodes = graph.ends, graph.nodes
    color, size, image = column_of(style.node_color), column_of(style.node_size), column_of(style.node_image)
    null = lambda kind: F.lit(None).cast(kind)
    nodes = nodes.withColumns({"grp": null("string"), "value": null("double"), "color": null("string"), "label": null("string"), "image": null("string")})
    if color and style.node_color.startswith("cell:"):
        nodes = _with_value(nodes, category_attribute(doc, ends, color), "__c").withColumn("color", F.coalesce(cells.parse_color(F.col("__c")), F.lit(NEUTRAL)))
    elif color and not _is_number(doc, color):
        nodes = _with_value(nodes, category_attribute(doc, ends, color), "__g").withColumn("grp", F.col("__g"))
    elif color or style.node_color.startswith("metric:"):
        values = numeric_attribute(doc, ends, color) if color else _centrality(graph, style.node_color.partition(":")[2])
        nodes = _with_value(nodes, values, "__v").withColumn("value", F.coalesce(F.col("__v").cast("double"), F.lit(0.0)))
    label = column_of(style.node_label)
    own_label = lambda c: labels(doc, c) if c in doc.nodes.columns else None
    if label and (told := own_label(label)) is not None:
        nodes = nodes.drop("label").join(told, "id", "left").withColumn("label", F.coalesce("label", "id"))
    if image:
        nodes = _with_value(nodes, category_attribute(doc, ends, image), "__i").withColumn("image", cells.image_source(F.col("__i")))

    floor, span, uniform = (8.0, 20.0, 13.0) if image else (4.5, 17.0, 8.0)
    if size and style.node_size.startswith("cell:"):
        own = doc.nodes is not None and size in doc.nodes.columns
        values = numeric_attribute(doc, ends, size) if own else first_number_attribute(ends, size)
        nodes = _with_value(nodes, values, "__s").withColumn("radius", F.coalesce(_clamped(F.col("__s"), CELL_RADIUS), F.lit(uniform)))
    elif style.node_size in ("metric:uniform", "uniform"):
        nodes = nodes.withColumn("radius", F.lit(uniform))
    else:
        kind = style.node_size.partition(":")[2]
        if size is None and kind in ("degree", "in", "out"):
            nodes = nodes.withColumn("__s", F.col({"degree": "degree", "in": "in_degree", "out": "out_degree"}[kind]).cast("double"))
        else:
            values = numeric_attribute(doc, ends, size) if size else _centrality(graph, kind)
            nodes = _with_value(nodes, values, "__s").withColumn("__s", F.greatest(F.lit(0.0), F.coalesce(F.col("__s").cast("double"), F.lit(0.0))))
        nodes = nodes.crossJoin(F.broadcast(nodes.agg(F.max("__s").alias("__hi"))))
        nodes = nodes.withColumn("radius", floor + span * cells.curve(F.col("__s") / F.greatest(F.col("__hi"), F.lit(1e-9)), style.size_curve))

    if style.node_types:
        column, styles = style.node_types
        nodes = _with_value(nodes, category_attribute(doc, ends, column), "__kind")
        kind = F.col("__kind")
        nodes = nodes.withColumns({
            "color": F.coalesce(_per_kind(styles, "color", kind), "color"),
            "radius": F.coalesce(_clamped(_per_kind(styles, "size", kind).cast("double"), CELL_RADIUS), "radius"),
            "image": F.coalesce(cells.image_source(_per_kind(styles, "image", kind).cast("string")), "image"),
        })
        for c in dict.fromkeys(s.label_column for s in styles.values() if s.label_column):
            if (told := own_label(c)) is not None:
                asked = [k for k, s in styles.items() if s.label_column == c]
                nodes = nodes.join(told.withColumnRenamed("label", "__l"), "id", "left").withColumn("label", F.when(kind.isin(asked), F.coalesce("__l", "id")).otherwise(F.col("label"))).drop("__l")
    return nodes.select("id", "pos", "in_degree", "out_degree", "degree", "grp", "value", "color", "radius", "label", "image")


def first_category(rows: DataFrame, column: str, name: str) -> DataFrame:
    """s, t, name: of each link the first cell in row order that isn't blank."""
    key = F.nullif(cells.cell_key(rows, column), F.lit(""))
    return rows.groupBy(F.col("__s").alias("s"), F.col("__t").alias("t")).agg(F.min_by(key, F.when(key.isNotNull(), F.col(POS))).alias(name))


def style_links(graph: BaseGraph, doc: GraphDoc, style: Style) -> DataFrame:
    """s, t, weight (mean of a width column's numbers), color_value, color, width (set by a type)."""
    links, rows = graph.links.select("s", "t"), graph.rows
    width, color = column_of(style.edge_width), column_of(style.edge_color)
    null = lambda kind: F.lit(None).cast(kind)
    links = links.withColumns({"weight": null("double"), "color_value": null("string"), "color": null("string"), "width": null("double")})
    if width:
        means = rows.groupBy(F.col("__s").alias("s"), F.col("__t").alias("t")).agg(F.avg(cells.num(rows, width)).alias("weight"))
        links = links.drop("weight").join(means, ["s", "t"], "left")
    if color:
        links = links.join(first_category(rows, color, "__c"), ["s", "t"], "left")
        cell = style.edge_color.startswith("cell:")
        links = links.withColumn("color" if cell else "color_value", cells.parse_color(F.col("__c")) if cell else F.col("__c"))
    if style.edge_types:
        column, styles = style.edge_types
        links = links.join(first_category(rows, column, "__kind"), ["s", "t"], "left")
        links = links.withColumn("color", F.coalesce(_per_kind(styles, "color", F.col("__kind")), "color"))
        links = links.withColumn("width", _clamped(_per_kind(styles, "width", F.col("__kind")).cast("double"), CELL_WIDTH))
    return links.select("s", "t", "weight", "color_value", "color", "width")


def apply_style(graph: BaseGraph, doc: GraphDoc, style: Style) -> tuple[DataFrame, DataFrame]:
    """Styled nodes and links."""
    return style_nodes(graph, doc, style), style_links(graph, doc, style)


# What a token falls back to when its column goes.
_FALLBACK = {"node_color": "none", "node_size": "metric:degree", "node_image": "none", "node_label": "none", "edge_width": "uniform", "edge_color": "uniform"}


def retarget_style(style: Style, after: GraphDoc, old: str, new: str | None) -> Style:
    """Follows a renamed column, or falls back from a deleted one, where the document after the change doesn't answer
    the old name any more."""
    on_nodes, on_edges = old in after.nodes.columns, old in after.edges.columns
    answered = {"node_label": on_nodes, "edge_width": on_edges, "edge_color": on_edges}
    moved = {}
    for field, fallback in _FALLBACK.items():
        token = getattr(style, field)
        if column_of(token) == old and not answered.get(field, on_nodes or on_edges):
            moved[field] = fallback if new is None else f"{token.partition(':')[0]}:{new}"

    def types(block: tuple[str, dict[str, TypeStyle]] | None, here: bool, own: bool) -> tuple[str, dict[str, TypeStyle]] | None:
        if block is None:
            return None
        column, styles = block
        if column == old and not here:
            if new is None:
                return None
            column = new
        if not own:
            swap = lambda names: names and tuple(new if a == old else a for a in names if a != old or new is not None)
            styles = {k: replace(s, label_column=new if s.label_column == old else s.label_column, attrs=swap(s.attrs)) for k, s in styles.items()}
        return column, styles

    return replace(style, **moved, node_types=types(style.node_types, on_nodes or on_edges, on_nodes), edge_types=types(style.edge_types, on_edges, on_edges))


def spread(places: DataFrame, factor: float, pinned: DataFrame | None = None) -> DataFrame:
    """id, x, y moved apart by a factor from the origin; pinned nodes (id, x, y) stay where they are put."""
    out = places.select("id", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y"))
    if pinned is None:
        return out
    put = pinned.select("id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    return out.join(put, "id", "left").select("id", F.coalesce("__x", "x").alias("x"), F.coalesce("__y", "y").alias("y"))
