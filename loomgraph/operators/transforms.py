"""One-mode projection of bipartite graphs, and previews of what an expansion would add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells
from ..model import POS, GraphDoc, Mapping, first_rows, with_positions
from ..plans.scratch import cut
from .graph import usable, with_ends

#: Pairs that a projection gives at most: whole counterparts are taken, in order of appearance, while they fit.
PAIR_LIMIT = 250_000


def _incidence(ends: DataFrame, keep: str) -> DataFrame:
    """kept, other, kp, op: distinct pairs, with first positions of kept nodes and counterparts."""
    kept, other = ("__s", "__t") if keep == "source" else ("__t", "__s")
    rows = ends.where("__s IS NOT NULL AND __t IS NOT NULL").select(F.col(kept).alias("kept"), F.col(other).alias("other"), F.col(POS).alias("p"))
    return rows.groupBy("kept", "other").agg(F.min("p").alias("p"))


def pair_bound(ends: DataFrame, keep: str) -> DataFrame:
    """pairs: the sum over counterparts of k (k - 1) / 2."""
    per = _incidence(ends, keep).groupBy("other").agg(F.count("*").alias("k"))
    return per.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))


def project(ends: DataFrame, keep: str, pair_limit: int = PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(s, t, weight: shared counterparts), (used, total counterparts). The budget is spent in order of the
    counterparts' first rows and stops at the first that doesn't fit. Links run from the kept node that appears first:
    under an earlier counterpart, or under the same one in an earlier row."""
    inc = cut(_incidence(ends, keep))
    per = inc.groupBy("other").agg(F.count("*").alias("k"), F.min("p").alias("op")).withColumn("pairs", F.col("k") * (F.col("k") - 1) / 2)
    total = per.agg(F.sum("pairs").alias("pairs")).first()["pairs"] or 0
    if total <= pair_limit:
        used = per
    else:
        # Running sums over ranges of positions first, so that no task sees all counterparts.
        dealt = cut(per.repartitionByRange("op", "other").withColumn("part", F.spark_partition_id()))
        before = dealt.groupBy("part").agg(F.sum("pairs").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inner = F.sum("pairs").over(Window.partitionBy("part").orderBy("op", "other").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        used = dealt.withColumn("run", inner).join(F.broadcast(before.select("part", "before")), "part").where(F.col("run") + F.col("before") <= pair_limit)
    chosen = inc.join(used.select("other"), "other", "left_semi")
    first = per.select("other", "op")
    appears = inc.join(first, "other").groupBy("kept").agg(F.min(F.struct("op", "other", "p", "kept")).alias("at"))
    placed = chosen.join(appears, "kept")
    one, two = (placed.select("other", F.col("kept").alias(x), F.col("at").alias(f"at_{x}")) for x in ("a", "b"))
    pairs = one.join(two, "other").where("at_a < at_b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    counts = per.agg(F.count("*").alias("total")).crossJoin(used.agg(F.count("*").alias("used")))
    return pairs.select(F.col("a").alias("s"), F.col("b").alias("t"), "weight"), counts.select("used", "total")


def project_doc(doc: GraphDoc, keep: str, pair_limit: int = PAIR_LIMIT) -> tuple[GraphDoc, DataFrame]:
    """The projection as a document with the kept side's node rows, and a report of one row: nodes, edges, used, total."""
    ends = with_ends(doc)
    pairs, counts = project(ends, keep, pair_limit)
    pairs = cut(pairs)
    kept = ends.select(F.col("__s" if keep == "source" else "__t").alias("__kept")).where("__kept IS NOT NULL").distinct()
    nodes = doc.nodes.join(kept, cells.cell_id(doc.nodes, doc.node_id) == F.col("__kept"), "left_semi")
    edges = pairs.select(F.col("s").alias("Source"), F.col("t").alias("Target"), F.col("weight").alias("Shared count"))
    out = doc.with_(edges=cut(with_positions(edges)), nodes=nodes, mapping=Mapping("Source", "Target", ("Shared count",)), nodes_declared=True, computed=frozenset(), roles={})
    report = nodes.agg(F.count("*").alias("nodes")).crossJoin(pairs.agg(F.count("*").alias("edges"))).crossJoin(counts)
    return out, report


def expansion_by_node_type(doc: GraphDoc, ends: DataFrame, visible: DataFrame, center: str, column: str) -> DataFrame:
    """kind, nodes: one-hop arrivals at the centre that are not visible, by their type: of their own row if the node
    table has the column, else of the first row that names them."""
    incident = ends.where(usable() & ((F.col("__s") == center) | (F.col("__t") == center)))
    arrived = incident.withColumn("id", F.when(F.col("__s") == center, F.col("__t")).otherwise(F.col("__s")))
    new = arrived.join(visible.select("id").distinct(), "id", "left_anti")
    if column in doc.nodes.columns:
        rows = first_rows(doc.nodes, doc.node_id)
        kinds = new.select("id").distinct().join(rows.select(F.col("__id").alias("id"), cells.cell_key(rows, column).alias("kind")), "id", "left").na.fill("", ["kind"])
    else:
        kinds = new.groupBy("id").agg(F.min_by(cells.cell_key(new, column), POS).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("nodes"))


def expansion_preview(ends: DataFrame, visible: DataFrame, center: str, edge_kind: str) -> DataFrame:
    """kind, nodes, edges: one-hop arrivals at the centre that are not visible (id), by the kind of their rows."""
    incident = ends.where(usable() & ((F.col("__s") == center) | (F.col("__t") == center)))
    arrived = incident.withColumn("id", F.when(F.col("__s") == center, F.col("__t")).otherwise(F.col("__s")))
    new = arrived.join(visible.select("id").distinct(), "id", "left_anti")
    return new.groupBy(cells.cell_key(new, edge_kind).alias("kind")).agg(F.count_distinct("id").alias("nodes"), F.count("*").alias("edges"))
