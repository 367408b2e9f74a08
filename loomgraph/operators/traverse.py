"""Breadth-first walks as frontier joins, and components by union-find.

Every hop joins the frontier (distinct, small against the edges) with the links, drops what was reached (anti
join), and writes the new frontier only: what was reached is the union of the hops' tables, which are put together
every `_MERGE` hops. Stop rules read one number a hop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.forests import components
from ..plans.scratch import Scratch, cut, dropped

#: Frontiers that are read one by one before they are written as one table.
_MERGE = 16


class Seen:
    """What a walk has reached: a table of older hops and the frontiers since. Frontiers that are wanted by themselves
    stay when they are put together (`keep`)."""

    def __init__(self, start: DataFrame, keep: bool = False):
        self.parts, self.keep, self.whole = [start], keep, None

    def add(self, frontier: DataFrame) -> None:
        self.parts.append(frontier)
        if len(self.parts) > _MERGE:
            whole = cut(self.rows())
            # The last one is still walked from.
            dropped(*([self.whole] if self.whole is not None else []) if self.keep else self.parts[:-1])
            self.parts, self.whole = [whole], whole

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def arms(links: DataFrame, direction: str) -> DataFrame:
    """a, b: steps along the links ('out'), against them ('in') or both ('any')."""
    out = links.select(F.col("s").alias("a"), F.col("t").alias("b"))
    back = links.select(F.col("t").alias("a"), F.col("s").alias("b"))
    return {"out": out, "in": back, "any": out.unionByName(back)}[direction].distinct()


def reach(links: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "any", budget: int | None = None) -> DataFrame:
    """id, depth of what is reached from the seeds (a table with id) in `depth` hops, or in any number. A walk that has
    reached more than `budget` nodes goes no further hop."""
    steps = cut(arms(links, direction))
    frontier, hop = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0))), 0
    seen, n = Seen(frontier), 0
    while depth is None or hop < depth:
        if budget is not None and (n := n + frontier.count()) > budget:
            break
        hop += 1
        new = steps.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen.rows().select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.rows()


def source_levels(links: DataFrame, sources: DataFrame, direction: str = "any") -> list[DataFrame]:
    """For every source of `sources` (id) at once, a table a distance: src, id, dist, sigma (shortest paths there are)."""
    steps = cut(arms(links, direction))
    frontier, hop = cut(sources.select(F.col("id").alias("src"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma"))), 0
    levels, seen = [frontier], Seen(frontier.select("src", "id"), keep=True)
    while True:
        hop += 1
        moved = frontier.join(steps, frontier["id"] == steps["a"]).groupBy("src", F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma"))
        new = moved.join(seen.rows(), ["src", "id"], "left_anti")
        frontier = cut(new.select("src", "id", F.lit(hop).alias("dist"), "sigma"))
        if frontier.isEmpty():
            return levels
        levels.append(frontier)
        seen.add(frontier.select("src", "id"))


def many_sources(links: DataFrame, sources: DataFrame, direction: str = "any") -> DataFrame:
    """id, word, bits, dist: bit k of a word tells that source 64 * word + k is `dist` away. sources: id, number. A node
    has a row for 64 sources and distance, not for each source: frontiers meet by OR."""
    return walk_many(cut(arms(links, direction)), sources).rows()


def walk_many(steps: DataFrame, sources: DataFrame) -> Seen:
    """The rows of `many_sources`, over given steps (a, b)."""
    word, bit = F.floor(F.col("number") / 64).cast("int"), F.expr("shiftleft(1L, CAST(number % 64 AS INT))")
    frontier, hop = cut(sources.groupBy("id", word.alias("word")).agg(F.bit_or(bit).alias("bits")).withColumn("dist", F.lit(0))), 0
    seen = Seen(frontier)
    while True:
        hop += 1
        moved = frontier.join(steps, frontier["id"] == steps["a"]).groupBy(F.col("b").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        old = seen.rows().groupBy("id", "word").agg(F.bit_or("bits").alias("old"))
        new = moved.join(old, ["id", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))))
        frontier = cut(new.where("bits <> 0").select("id", "word", "bits", F.lit(hop).alias("dist")))
        if frontier.isEmpty():
            return seen
        seen.add(frontier)


def component_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, comp: the least `rank` reachable. nodes: id, rank. Tasks join the links that they hold by a union-find of their
    own first, so what is shuffled after the links got their numbers is a forest, and rounds are few on long paths too."""
    scratch = Scratch(nodes.sparkSession, "components")
    at = lambda end, name: nodes.select(F.col("id").alias(end), F.col("rank").cast("long").alias(name))
    edges = scratch.save(links.select("s", "t").join(at("s", "a"), "s").join(at("t", "b"), "t").select("a", "b"), "numbered")
    joined = components(edges, scratch, "links")
    return nodes.join(joined, nodes["rank"] == joined["node"], "left").select("id", F.coalesce("comp", "rank").alias("comp"))


def _next_level(frontier: DataFrame, steps: DataFrame, seen: DataFrame, hop: int) -> DataFrame:
    moved = frontier.join(steps, frontier["id"] == steps["a"]).groupBy(F.col("b").alias("id")).agg(F.sum("sigma").alias("sigma"))
    return cut(moved.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("depth"), "sigma"))


def meeting_levels(links: DataFrame, source: str, target: str, directed: bool = False) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Levels (id, depth, sigma) around the source and around the target, walked from both ends, the smaller frontier
    first, until the last levels share a node: shortest routes go through the shared ones. None if they never do."""
    spark = links.sparkSession
    ahead = cut(arms(links, "out" if directed else "any"))
    steps = (ahead, ahead.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = [[cut(spark.createDataFrame([(i, 0, 1.0)], "id string, depth int, sigma double"))] for i in (source, target)]
    seen, sizes = [Seen(s[0].select("id"), keep=True) for s in sides], [1, 1]
    if source == target:
        return sides[0], sides[1]
    while True:
        one = 0 if sizes[0] <= sizes[1] else 1
        new = _next_level(sides[one][-1], steps[one], seen[one].rows(), len(sides[one]))
        sizes[one] = new.count()
        if not sizes[one]:
            return None
        sides[one].append(new)
        seen[one].add(new.select("id"))
        if not new.join(sides[1 - one][-1].select("id"), "id", "left_semi").isEmpty():
            return sides[0], sides[1]


def shortest_routes(links: DataFrame, source: str, target: str, directed: bool = False, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """(count: n_routes, length), (routes: route as an array of ids, at most `limit`, in order of the ids)."""
    spark = links.sparkSession
    met = meeting_levels(links, source, target, directed)
    if met is None:
        return spark.createDataFrame([], "n_routes long, length long"), spark.createDataFrame([], "route array<string>")
    near, far = met
    meeting = cut(near[-1].select("id", "sigma").join(far[-1].select("id", F.col("sigma").alias("rest")), "id"))
    count = meeting.agg(F.sum(F.col("sigma") * F.col("rest")).cast("long").alias("n_routes")).withColumn("length", F.lit(len(near) + len(far) - 2).cast("long"))
    steps = cut(arms(links, "out" if directed else "any"))
    # By distance from the source, the nodes that routes may go through: beyond the meeting level only those that it leads to.
    through = [level.select("id") for level in near[:-1]] + [meeting.select("id")]
    for level in far[-2::-1]:
        reached = through[-1].select(F.col("id").alias("a")).join(steps, "a").select(F.col("b").alias("id")).distinct()
        through.append(cut(level.select("id").join(reached, "id", "left_semi")))
    routes = spark.createDataFrame([(target, [target])], "at string, route array<string>")
    for level in through[-2::-1]:
        back = routes.join(steps, routes["at"] == steps["b"]).join(level.select(F.col("id").alias("prev")), F.col("a") == F.col("prev"))
        routes = cut(back.select(F.col("a").alias("at"), F.concat(F.array("a"), "route").alias("route")).orderBy("route").limit(limit))
    return count, routes.select("route")
