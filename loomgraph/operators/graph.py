"""Building graphs: links merged from rows, nodes with degrees, merged and directed views, projected attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..model import POS, GraphDoc, first_rows


@dataclass(frozen=True)
class BaseGraph:
    """nodes: id, pos, in_degree, out_degree, degree (of links). links: s, t, pos, n_rows. rows: the edge rows behind
    the links, with __s and __t. ends: the edge rows that were looked at, with __s and __t."""

    nodes: DataFrame
    links: DataFrame
    rows: DataFrame
    ends: DataFrame


def with_ends(doc: GraphDoc, rows: DataFrame | None = None) -> DataFrame:
    rows = doc.edges if rows is None else rows
    if "__s" in rows.columns:
        return rows
    return rows.withColumn("__s", cells.cell_id(rows, doc.mapping.source)).withColumn("__t", cells.cell_id(rows, doc.mapping.target))


def usable() -> Column:
    """A row with both endpoints that isn't a loop."""
    return F.col("__s").isNotNull() & F.col("__t").isNotNull() & (F.col("__s") != F.col("__t"))


def skipped_rows(ends: DataFrame) -> DataFrame:
    return ends.agg(F.count(F.when(~F.coalesce(usable(), F.lit(False)), 1)).alias("skipped_rows"))


def build_links(rows: DataFrame) -> DataFrame:
    """One directed link for each pair of endpoints. Rows are combined before the shuffle."""
    return rows.groupBy(F.col("__s").alias("s"), F.col("__t").alias("t")).agg(F.min(POS).alias("pos"), F.count("*").alias("n_rows"))


def link_degrees(links: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree, first: one pass over both ends."""
    ends = F.array(F.struct(F.col("s").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("pos") * 2).alias("p")), F.struct(F.col("t").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), (F.col("pos") * 2 + 1).alias("p")))
    each = links.select(F.explode(ends).alias("e")).select("e.*")
    return each.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"), F.min("p").alias("first"))


def base_graph(doc: GraphDoc, rows: DataFrame | None = None, keep: DataFrame | None = None, show_isolated: bool | None = None) -> BaseGraph:
    """`keep`: a table of ids that may stay, or None for all."""
    ends = with_ends(doc, rows)
    good = ends.where(usable())
    if keep is not None:
        ids = keep.select("id").distinct()
        good = good.join(ids.withColumnRenamed("id", "__k"), F.col("__s") == F.col("__k"), "left_semi").join(ids.withColumnRenamed("id", "__k"), F.col("__t") == F.col("__k"), "left_semi")
    links = build_links(good)
    degrees = link_degrees(links)
    show = doc.nodes_declared if show_isolated is None else show_isolated
    if doc.nodes is not None:
        declared = first_rows(doc.nodes, doc.node_id).select(F.col("__id").alias("id"), F.col(POS).alias("declared"))
        if keep is not None:
            declared = declared.join(keep.select("id").distinct(), "id", "left_semi")
        nodes = declared.join(degrees, "id", "full" if show else "right")
    else:
        nodes = degrees.withColumn("declared", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nodes = nodes.select("id", F.struct(F.col("declared").isNull().cast("int").alias("late"), F.coalesce("declared", "first").alias("pos")).alias("pos"), zero("in_degree"), zero("out_degree"), zero("degree"))
    return BaseGraph(nodes, links, good, ends)


def reciprocal(links: DataFrame) -> DataFrame:
    """links with `curve`: is there a link back?"""
    back = links.select(F.col("t").alias("s"), F.col("s").alias("t"), F.lit(True).alias("curve"))
    return links.join(back, ["s", "t"], "left").withColumn("curve", F.coalesce("curve", F.lit(False)))


def mutual_rows(graph: BaseGraph) -> DataFrame:
    back = graph.links.select(F.col("t").alias("__s"), F.col("s").alias("__t"))
    return graph.rows.join(back, ["__s", "__t"], "left_semi")


def weighted_links(graph: BaseGraph, weight: str | None = None) -> DataFrame:
    """s, t, w: the mean of the numeric weights of the rows, at least 0; 1 without any."""
    if weight is None:
        return graph.links.select("s", "t", F.lit(1.0).alias("w"))
    mean = F.avg(cells.num(graph.rows, weight))
    return graph.rows.groupBy(F.col("__s").alias("s"), F.col("__t").alias("t")).agg(F.coalesce(F.greatest(F.lit(0.0), mean), F.lit(1.0)).alias("w"))


def undirected(weighted: DataFrame) -> DataFrame:
    """v, n, w: each neighbour once, weights of both directions added; both orientations are there."""
    both = F.array(F.struct(F.col("s").alias("v"), F.col("t").alias("n")), F.struct(F.col("t").alias("v"), F.col("s").alias("n")))
    return weighted.select(F.explode(both).alias("e"), "w").groupBy("e.v", "e.n").agg(F.sum("w").alias("w"))


def numeric_attribute(doc: GraphDoc, rows: DataFrame, column: str) -> DataFrame:
    """id, value: the node table's numbers if it has the column, else the sum over incident rows of both ends."""
    if doc.nodes is not None and column in doc.nodes.columns:
        known = first_rows(doc.nodes, doc.node_id)
        return known.select(F.col("__id").alias("id"), cells.num(known, column).alias("value"))
    v = rows.select("__s", "__t", cells.num(rows, column).alias("v"))
    return v.select(F.explode(F.array("__s", "__t")).alias("id"), "v").where("id IS NOT NULL").groupBy("id").agg(F.sum("v").alias("value"))


def category_attribute(doc: GraphDoc, rows: DataFrame, column: str) -> DataFrame:
    """id, value: the node table's keys if it has the column, else of the first row that names the node as target."""
    if doc.nodes is not None and column in doc.nodes.columns:
        known = first_rows(doc.nodes, doc.node_id)
        return known.select(F.col("__id").alias("id"), F.nullif(cells.cell_key(known, column), F.lit("")).alias("value"))
    key = F.nullif(cells.cell_key(rows, column), F.lit(""))
    return rows.select(F.col("__t").alias("id"), key.alias("v"), POS).where("id IS NOT NULL").groupBy("id").agg(F.min_by("v", POS).alias("value"))


def first_number_attribute(rows: DataFrame, column: str) -> DataFrame:
    """id, value: of the first incident row, either end."""
    v = rows.select(F.explode(F.array("__s", "__t")).alias("id"), cells.num(rows, column).alias("v"), POS).where("id IS NOT NULL")
    return v.groupBy("id").agg(F.min_by("v", POS).alias("value"))


def labels(doc: GraphDoc, column: str | None) -> DataFrame:
    """id, label: the label column's text, else the id; the first row wins."""
    known = first_rows(doc.nodes, doc.node_id)
    own = cells.cell_id(known, column) if column else F.lit(None).cast("string")
    return known.select(F.col("__id").alias("id"), F.coalesce(own, F.col("__id")).alias("label"))
