"""Triangles, listed once and credited to their nodes and links.

Each pair of neighbours is oriented from the node with fewer neighbours to the one with more. A node then has few
successors (at most the square root of twice the pairs), whatever its degree: a hub with 100,000 leaves has none of
them. For every oriented pair the successors that both ends have are found by intersecting their lists, which are cut into
blocks, so that no list outgrows a row. A triangle comes up at its least pair alone, and what is counted by node, by link
or by mutual tie is counted from that one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut

#: Successors in a row, about.
BLOCK = 20_000


def oriented(pairs: DataFrame) -> DataFrame:
    """a, b: each pair of neighbours (v, n, both ways round) once, from fewer neighbours to more, then by id."""
    degrees = pairs.groupBy("v").agg(F.count("*").alias("d"))
    both = pairs.where("v < n").join(degrees, "v").join(degrees.select(F.col("v").alias("n"), F.col("d").alias("dn")), "n")
    low = F.struct("d", "v") < F.struct("dn", "n")
    return both.select(F.when(low, F.col("v")).otherwise(F.col("n")).alias("a"), F.when(low, F.col("n")).otherwise(F.col("v")).alias("b"))


def listing(pairs: DataFrame) -> DataFrame:
    """a, b, c: every triangle among the pairs of neighbours (v, n, both ways round) once, written as a table. Nodes are
    numbered in the order of `oriented`, so lists are of numbers, and a pair meets with what comes after its second end."""
    from .metrics import ranked

    names = ranked(pairs.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("d")), F.col("d"), F.col("id")).select("id", F.col("rank").alias("k"))
    number = "int" if (names.agg(F.max("k")).first()[0] or 0) < 1 << 31 else "long"
    at = lambda c: names.select(F.col("id").alias(c), F.col("k").cast(number).alias(f"_{c}"))
    edge = cut(pairs.where("v < n").join(at("v"), "v").join(at("n"), "n").select(F.least("_v", "_n").alias("a"), F.greatest("_v", "_n").alias("b")))
    widest = edge.groupBy("a").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    block = F.pmod(F.xxhash64("b"), F.lit(-(-widest // BLOCK) or 1))
    lists = edge.repartition("a").groupBy("a", block.alias("block")).agg(F.collect_set("b").alias("after"))
    # A node with one successor has no second one to close a triangle with.
    several = edge.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
    first = edge.join(several, "a", "left_semi").join(lists.withColumnRenamed("after", "of_a"), "a")
    first = first.select("a", "b", "block", F.filter("of_a", lambda c: c > F.col("b")).alias("of_a")).where("size(of_a) > 0")
    second = lists.select(F.col("a").alias("b"), "block", F.col("after").alias("of_b"))
    shared = cut(first.join(second, ["b", "block"]).select("a", "b", F.explode(F.array_intersect("of_a", "of_b")).alias("c")))
    for c in ("a", "b", "c"):
        shared = shared.join(names.select(F.col("k").alias(c), F.col("id").alias(f"_{c}")), c)
    return cut(shared.select(*[F.col(f"_{c}").alias(c) for c in ("a", "b", "c")]))


def by_node(triangles: DataFrame) -> DataFrame:
    """id, n: triangles at each node that has any."""
    return triangles.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def by_pair(triangles: DataFrame) -> DataFrame:
    """x, y, n: triangles over each pair of neighbours that has any, x < y."""
    pair = lambda one, two: F.struct(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    each = F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c")))
    return triangles.select(each.alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n"))


def credited(links: DataFrame, triangles: DataFrame, name: str) -> DataFrame:
    """s, t and the number of triangles over the link."""
    keyed = links.select("s", "t", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"))
    return keyed.join(by_pair(triangles), ["x", "y"], "left").select("s", "t", F.coalesce("n", F.lit(0)).cast("long").alias(name))
