"""Network metrics as columns by node or link id.

Inputs are weighted links (s, t, w) and a node table (id, pos) in document order; results are tables by id. Loops
cut their lineage each round and read one number for the stop rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.bucketed import ROWS_A_BUCKET, Buckets, arcs, count_for
from ..plans.scratch import cut, dropped
from . import triads, waves
from .graph import undirected
from .traverse import arms, component_labels

#: Sources where path metrics are asked to start from every n/600th node only.
ALL_SOURCES = 600
#: Bytes that all nodes have for the sources of one turn, about.
TURN_BYTES = 500_000_000
#: Sources of a turn in steps of so many, where each is a bit.
TURN = 4096
#: On request, 2 ** COUNTER_BITS registers a node estimate how many are near: a standard error of 1.6 percent.
COUNTER_BITS = 12


def degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, degree (distinct neighbours), in_degree, out_degree (links)."""
    near = undirected(links.select("s", "t", F.lit(1.0).alias("w"))).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("degree"))
    into = links.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("in_degree"))
    out = links.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(near, "id", "left").join(into, "id", "left").join(out, "id", "left").select("id", zero("degree"), zero("in_degree"), zero("out_degree"))


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 100, close: float = 1e-9) -> DataFrame:
    """id, pagerank: weighted, the rank of nodes that hand nothing on is spread evenly. Links and ranks are dealt to the
    same buckets once; a round exchanges summed messages only."""
    spark = nodes.sparkSession
    out = links.groupBy(F.col("s").alias("o")).agg(F.sum("w").alias("strength"))
    shares = cut(links.join(out, F.col("s") == F.col("o")).where("strength > 0").select(F.col("s").alias("id"), "t", (F.col("w") / F.col("strength")).alias("share")))
    senders = shares.select("id", F.lit(True).alias("sends")).distinct()
    base = cut(nodes.select("id").join(senders, "id", "left").select("id", F.coalesce("sends", F.lit(False)).alias("sends")))
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("pagerank"))
    m = shares.count()
    dealt = Buckets(spark, count_for(spark, m))
    near = arcs(dealt, shares, m)
    state = dealt.save(base.withColumn("rank", F.lit(1.0 / n)).withColumn("was", F.lit(0.0)), "id")
    for _ in range(rounds):
        idle = state.where(~F.col("sends")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = near.sent(state, F.col("rank") * F.col("share"))
        new = state.join(got, "id", "left").select("id", "sends", ((1 - damping) / n + damping * idle / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("was"))
        held, state = state, dealt.save(new, "id", dealt=True)
        dealt.drop(held)
        if state.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < close:
            break
    out = cut(state.select("id", F.col("rank").alias("pagerank")))
    dealt.close()
    return out


def hits(nodes: DataFrame, links: DataFrame, rounds: int = 100, close: float = 1e-9) -> DataFrame:
    """id, hub, authority: scaled to a maximum of 1. Links are in buckets of either end."""
    spark = nodes.sparkSession
    links = cut(links)
    m = links.count()
    dealt = Buckets(spark, count_for(spark, m))
    ahead = arcs(dealt, links.select(F.col("s").alias("id"), "t", "w"), m)
    back = arcs(dealt, links.select(F.col("t").alias("id"), F.col("s").alias("t"), "w"), m)
    state = dealt.save(nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"), F.lit(0.0).alias("h0"), F.lit(0.0).alias("a0")), "id")
    for _ in range(rounds):
        a = dealt.save(ahead.sent(state, F.col("hub") * F.col("w")).withColumnRenamed("got", "a"), "id")
        h = back.sent(a, F.col("a") * F.col("w")).withColumnRenamed("got", "h")
        raw = dealt.save(state.join(a, "id", "left").join(h, "id", "left").na.fill(0.0, ["a", "h"]).select("id", "hub", "authority", "a", "h"), "id", dealt=True)
        na, nh = raw.agg(F.sqrt(F.sum(F.col("a") ** 2)), F.sqrt(F.sum(F.col("h") ** 2))).first()
        new = raw.select("id", (F.col("h") / (nh or 1.0)).alias("hub"), (F.col("a") / (na or 1.0)).alias("authority"), F.col("hub").alias("h0"), F.col("authority").alias("a0"))
        held, state = state, dealt.save(new, "id", dealt=True)
        dealt.drop(held, a, raw)
        moved = state.agg(F.sum(F.abs(F.col("hub") - F.col("h0")) + F.abs(F.col("authority") - F.col("a0")))).first()[0]
        if moved is None or moved < close:
            break
    top = state.agg(F.max("hub"), F.max("authority")).first()
    out = cut(state.select("id", (F.col("hub") / (top[0] or 1.0)).alias("hub"), (F.col("authority") / (top[1] or 1.0)).alias("authority")))
    dealt.close()
    return out


def eigenvector(nodes: DataFrame, links: DataFrame, rounds: int = 100, close: float = 1e-7) -> DataFrame:
    """id, eigenvector: unweighted, undirected; scaled to a maximum of 1; zeros without links."""
    spark = nodes.sparkSession
    pairs = cut(undirected(links).select(F.col("v").alias("id"), F.col("n").alias("t")))
    n = nodes.count()
    m = pairs.count()
    dealt = Buckets(spark, count_for(spark, m))
    near = arcs(dealt, pairs, m)
    state = dealt.save(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("x"), F.lit(0.0).alias("was")), "id")
    for _ in range(rounds):
        raw = dealt.save(state.join(near.sent(state, F.col("x")), "id", "left").select("id", "x", F.coalesce("got", F.lit(0.0)).alias("y")), "id", dealt=True)
        norm = raw.agg(F.sqrt(F.sum(F.col("y") ** 2))).first()[0]
        if not norm:
            dealt.close()
            return nodes.select("id", F.lit(0.0).alias("eigenvector"))
        held, state = state, dealt.save(raw.select("id", (F.col("y") / norm).alias("x"), F.col("x").alias("was")), "id", dealt=True)
        dealt.drop(held, raw)
        if state.agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] < close:
            break
    top = state.agg(F.max("x")).first()[0]
    out = cut(state.select("id", (F.col("x") / (top or 1.0)).alias("eigenvector")))
    dealt.close()
    return out


def sources(nodes: DataFrame, most: int = ALL_SOURCES) -> DataFrame:
    """id: all nodes, or of more than `most` every ceil(n / most)-th in document order."""
    n = nodes.count()
    if n <= most:
        return nodes.select("id")
    return ranked(nodes).where(F.col("rank") % -(-n // most) == 0).select("id")


def ranked(nodes: DataFrame, *order: Column) -> DataFrame:
    """id, rank: places from 0 in document order (or another, in which no two rows are equal), by range partitions and
    their running counts: no task sees all rows."""
    order = order or (F.col("pos"), F.col("id"))
    dealt = cut(nodes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return cut(dealt.withColumn("k", inner).join(F.broadcast(before.select("part", "before")), "part").select("id", (F.col("before") + F.col("k")).alias("rank")))


def _with_sources(nodes: DataFrame, most: int | None) -> tuple[DataFrame, int, int]:
    """id, number (in document order), source (its number, null where a node is none); how many nodes and sources: all
    nodes, or, where it is asked for, of more than `most` every ceil(n / most)-th."""
    ranks = ranked(nodes)
    n = ranks.count()
    step = 1 if most is None else max(1, -(-n // most))
    source = F.when(F.col("rank") % step == 0, F.floor(F.col("rank") / step))
    return ranks.select("id", F.col("rank").alias("number"), source.alias("source")), n, -(-n // step)


def _turns(numbered: DataFrame, sources: int, a_turn: int) -> Iterator[DataFrame]:
    """The numbered nodes with the sources of a turn, from 0 on, turn by turn: what a walk writes is bounded by a turn."""
    for low in range(0, sources, a_turn):
        mine = F.col("source").between(low, min(low + a_turn, sources) - 1)
        yield numbered.select("id", "number", F.when(mine, F.col("source") - low).alias("source"))


def _by_node(rows: DataFrame, of: Callable[[list[bytes]], dict[str, np.ndarray]], columns: str) -> DataFrame:
    """number and values of the nodes of each block. rows: b, v (what `of` makes the block's values from)."""
    side = waves.SIDE

    def run(table: pa.Table) -> pa.Table:
        values = of(table["v"].to_pylist())
        return pa.table({"number": np.arange(len(next(iter(values.values())))) + table["b"][0].as_py() * side, **values})

    return rows.groupBy("b").applyInArrow(run, f"number long, {columns}")


def betweenness(nodes: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """id, betweenness: forward levels with path counts, then dependencies level by level backwards. Nodes have a cell for
    each source of a turn, in blocks (waves), so that none is sent along a link by itself. Every node is a source, unless
    `most` asks for a sample."""
    numbered, n, k = _with_sources(nodes, most)
    if n <= 2:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    a_turn = min(k, max(waves.COUNTED, TURN_BYTES // (8 * n) // waves.COUNTED * waves.COUNTED))
    ahead, back = waves.paths(a_turn)
    walk, total = waves.Walk(cut(arms(links, "any")), numbered, n, ahead), None
    start = waves.at_sources(np.float64, ahead.cells * ahead.slices, False)
    for turn in _turns(numbered, k, a_turn):
        levels = [walk.start(["source"], start, ahead, turn)]
        while not waves.still(levels[-1]):
            levels.append(walk.round(levels[-1], levels[-1], ahead))
        sent = levels.pop()  # the last level has nothing, and sends nothing
        while len(levels) > 1:  # level 0 are the sources themselves
            level = levels.pop()
            now = walk.round(level.where("fresh IS NOT NULL").select("b", "s", F.col("fresh").alias("own")), sent, back)
            told, held = now.select("b", F.col("tally").alias("v")), total
            total = cut((told if held is None else told.unionByName(held)).groupBy("b").applyInArrow(_summed, "b int, v binary"), waves.TOGETHER)
            dropped(level, sent, *([held] if held is not None else []))
            sent = now
        dropped(sent, *levels)
    walk.close()
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    scale = (n / k / 2) * (2 / ((n - 1) * (n - 2)))
    per = numbered.join(_by_node(total, lambda v: {"sum": np.frombuffer(v[0])}, "sum double"), "number").select("id", (F.col("sum") * scale).alias("betweenness"))
    return nodes.select("id").join(per, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _summed(table: pa.Table) -> pa.Table:
    """b, v: the rows of a block added up."""
    return pa.table({"b": table["b"][:1], "v": pa.array([sum(map(np.frombuffer, table["v"].to_pylist())).tobytes()], pa.binary())})


def _numbered(chosen: DataFrame) -> DataFrame:
    """id, number: the sources from 0 on."""
    return ranked(chosen.select("id", F.lit(0).alias("pos"))).select("id", F.col("rank").alias("number"))


def _path_sums(nodes: DataFrame, links: DataFrame, most: int | None) -> tuple[DataFrame, int, int, int]:
    """id, source (its number or null), reached (by how many other sources), sum (of their distances), inverse (the sum of
    1 / distance); how many nodes and sources, and the greatest distance. Nodes hold a bit for each source of a turn, in
    blocks (waves)."""
    numbered, n, k = _with_sources(nodes, most)
    a_turn = min(k, max(TURN, 8 * TURN_BYTES // max(1, n) // TURN * TURN))
    first, kind = waves.reached(a_turn)
    walk, furthest, total = waves.Walk(cut(arms(links, "any")), numbered, n, first), 0, None
    start = waves.at_sources(np.uint64, first.cells * first.slices, True)

    def of(values: list[bytes]) -> dict[str, np.ndarray]:
        rows = [first.kept_rows(v)[:, -3:] for v in values]
        return {"reached": sum(r[:, 0] for r in rows).astype(np.int64), "sum": sum(r[:, 1] for r in rows).astype(np.int64), "inverse": sum(r[:, 2].view(np.float64) for r in rows)}

    for turn in _turns(numbered, k, a_turn):
        state, hop = walk.start(["source"], start, first, turn), 0
        while not waves.still(state):
            hop += 1
            held, state = state, walk.round(state, state, kind(hop))
            dropped(held)
        furthest = max(furthest, hop - 1)
        told, held = _by_node(state.select("b", F.col("own").alias("v")), of, "reached long, sum long, inverse double"), total
        total = cut(told if held is None else told.unionByName(held).groupBy("number").agg(*[F.sum(c).alias(c) for c in ("reached", "sum", "inverse")]))
        dropped(state, *([held] if held is not None else []))
    walk.close()
    if total is None:
        return numbered.select("id", "source", F.lit(0).alias("reached"), F.lit(0).alias("sum"), F.lit(0.0).alias("inverse")), n, k, 0
    return numbered.join(total, "number").select("id", "source", "reached", "sum", "inverse"), n, k, furthest


def closeness(nodes: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """id, closeness (of nodes that sources reach, with the share reached). Every node is a source, unless `most` asks for
    a sample."""
    per, _, k, _ = _path_sums(nodes, links, most)
    among = F.lit(k) - F.col("source").isNotNull().cast("int")
    value = F.when(F.col("sum") > 0, (F.col("reached") / among) * (F.col("reached") / F.col("sum"))).otherwise(0.0)
    return per.select("id", value.alias("closeness"))


def harmonic(nodes: DataFrame, links: DataFrame, exact: bool = True) -> DataFrame:
    """id, harmonic. Every node is a source, in turns; on request (exact: False) the nodes within each distance are
    estimated by counters."""
    nodes = cut(nodes.select("id"))
    if exact:
        per, n, _, _ = _path_sums(nodes.withColumn("pos", F.lit(0)), links, None)
        return per.select("id", (F.col("inverse") / max(n - 1, 1)).alias("harmonic"))
    n = nodes.count()
    return nodes.select("id").join(_counted_harmonic(nodes, links), "id", "left").select("id", (F.coalesce("h", F.lit(0.0)) / max(n - 1, 1)).alias("harmonic"))


def _counted_harmonic(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, h: each round a node's counter takes in those of its neighbours that changed; what a round adds to its
    estimate lies at that round's distance; the first, the neighbours, are counted. Counters are met in blocks (waves), so that none is sent along a link."""
    numbered = cut(_numbered(nodes).withColumn("hash", F.xxhash64("id")))
    n = numbered.count()
    schema, known = "b int, size binary, h binary", None
    steps = cut(arms(links, "any"))
    walk = waves.rounds(steps, numbered, n, ["hash"], waves.hashed(COUNTER_BITS), waves.registers(COUNTER_BITS))

    def folded(hop: int):
        def fold(table: pa.Table) -> pa.Table:
            told = [np.frombuffer(x).reshape(-1, 2) for x in table["tally"].drop_null().to_pylist()]
            size = waves.estimates(sum(told), COUNTER_BITS)
            h = np.zeros(len(size))
            if hop:
                before, h = (np.frombuffer(table[c].drop_null()[0].as_py()) for c in ("size", "h"))
                size = np.maximum(size, before)
                h = h + (size - before) / hop if hop > 1 else h  # neighbours are counted
            return pa.table({"b": pa.array([table["b"][0].as_py()], pa.int32()), "size": pa.array([size.tobytes()], pa.binary()), "h": pa.array([h.tobytes()], pa.binary())})

        return fold

    for hop, tallies in enumerate(walk):
        none = F.lit(None).cast("binary")
        rows = tallies.select("b", "tally", none.alias("size"), none.alias("h"))
        if known is not None:
            rows = rows.unionByName(known.select("b", none.alias("tally"), "size", "h"))
        held, known = known, cut(rows.groupBy("b").applyInArrow(folded(hop), schema), waves.TOGETHER)
        dropped(*([held] if held is not None else []))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, h in zip(batch.column("b").to_pylist(), batch.column("h").to_pylist()):
                h = np.frombuffer(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(h)) + b * waves.SIDE), pa.array(h)], ["number", "h"])

    near = steps.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("near"))
    further = numbered.join(known.select("b", "h").mapInArrow(each, "number long, h double"), "number")
    return further.join(near, "id", "left").select("id", (F.col("h") + F.coalesce("near", F.lit(0))).alias("h"))


def _neighbours(links: DataFrame) -> DataFrame:
    return undirected(links.select("s", "t", F.lit(1.0).alias("w"))).select("v", "n")


def triangle_listing(links: DataFrame) -> DataFrame:
    """a, b, c: all triangles, for the measures that count them (given to several, it is made once)."""
    return triads.listing(_neighbours(links))


def triangles(nodes: DataFrame, links: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """id, triangles."""
    per = triads.by_node(triangle_listing(links) if listed is None else listed)
    return nodes.select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("triangles"))


def coreness(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, coreness: h-indices of the neighbours' values until nothing changes. Pairs and values are in the same buckets, as
    many as the pairs need. A round lowers a bucket's values until they hold within it, and exchanges those that another
    bucket's pairs ask for: values only fall, and to the same ones in any order."""
    spark = nodes.sparkSession
    ranks = ranked(nodes)
    at = lambda c: ranks.select(F.col("id").alias(c), F.col("rank").alias(f"_{c}"))
    pairs = cut(undirected(links).join(at("v"), "v").join(at("n"), "n").select(F.col("_v").alias("a"), F.col("_n").alias("b")))
    n = max(1, -(-pairs.count() // ROWS_A_BUCKET))
    dealt, own = Buckets(spark, n), lambda c: F.pmod(F.col(c), F.lit(n)).cast("int")
    held = dealt.save(pairs.select(own("a").alias("g"), "a", "b"), "g")
    known = dealt.save(pairs.groupBy("a").agg(F.count("*").alias("c")).select(own("a").alias("g"), F.col("a").alias("id"), "c"), "g")
    dropped(pairs)
    asked = cut(held.where(F.col("g") != own("b")).select(F.col("g").alias("by"), F.col("b").alias("of")).distinct())
    first = True
    while True:
        new = dealt.save(held.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(_lowered(first), "g int, id long, c long, fell boolean"), "g", dealt=True)
        dealt.drop(known)
        told = new.where("fell").join(asked.hint("merge"), F.col("id") == F.col("of")).select(F.col("by").alias("g"), "id", "c")
        if n == 1 or told.isEmpty():
            break
        known, first = dealt.save(new.select("g", "id", "c").unionByName(told), "g"), False
        dealt.drop(new)
    out = cut(ranks.join(new.where(F.col("g") == own("id")).select(F.col("id").alias("rank"), "c"), "rank", "left").select("id", F.coalesce("c", F.lit(0)).alias("coreness")))
    dealt.close()
    dropped(asked)
    return out


def _lowered(first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's values (of several of a node the least; none is no bound yet) lowered along its pairs, and whether
    they fell; at first all are new to others."""

    def run(pairs: pa.Table, known: pa.Table) -> pa.Table:
        a, b = (pairs[c].to_numpy() for c in ("a", "b"))
        ids = np.unique(np.concatenate((a, b)))
        c = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(c, np.searchsorted(ids, known["id"].to_numpy()), known["c"].to_numpy())
        order = np.argsort(a, kind="stable")
        a, b = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order])
        start, before = np.searchsorted(a, np.arange(len(ids) + 1)), c.copy()
        size = np.diff(start)
        own = size > 0
        open_ = np.flatnonzero(own)
        while len(open_):
            many, of = size[open_], np.repeat(np.arange(len(open_)), size[open_])
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            values = c[b[start[open_][of] + place]]
            values = values[np.lexsort((-values, of))]
            h = np.bincount(of[values > place], minlength=len(open_))
            fell = open_[h < c[open_]]
            c[open_] = np.minimum(c[open_], h)
            again = np.zeros(len(ids), bool)
            many = size[fell]
            of = np.repeat(np.arange(len(fell)), many)
            again[b[start[fell][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]] = True
            open_ = np.flatnonzero(again & own)
        told = c < np.iinfo(np.int64).max
        return pa.table({"g": pa.array(np.full(int(told.sum()), pairs["g"][0].as_py()), pa.int32()), "id": ids[told], "c": c[told], "fell": (own & (first | (c < before)))[told]})

    return run


def kcore(links: DataFrame, k: int) -> DataFrame:
    """id of the k-core: peels nodes of less than k neighbours until none is left to peel."""
    near = cut(undirected(links).select("v", "n"))
    while True:
        ok = near.groupBy("v").agg(F.count("*").alias("d")).where(F.col("d") >= k).select("v")
        new = cut(near.join(ok, "v", "left_semi").join(ok.select(F.col("v").alias("n")), "n", "left_semi").select("v", "n"))
        if new.count() == near.count():
            return new.select(F.col("v").alias("id")).distinct()
        dropped(near)
        near = new


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, component (text: 0 is the largest, of equal ones that with the first node), component_size."""
    ranks = ranked(nodes)
    comp = component_labels(ranks, links)
    sizes = comp.groupBy("comp").agg(F.count("*").alias("component_size"))
    numbers = ranked(sizes.withColumn("id", F.col("comp")), F.desc("component_size"), F.asc("comp"))
    numbered = sizes.join(numbers.select(F.col("id").alias("comp"), F.col("rank").cast("string").alias("component")), "comp")
    return comp.join(numbered, "comp").select("id", "component", "component_size")


def component_count(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """components: how many there are, directions aside; a node without links is one."""
    return component_labels(ranked(nodes), links).agg(F.count_distinct("comp").alias("components"))


def counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges (links), average_links (2 m / n, null without nodes), components."""
    sizes = nodes.agg(F.count("*").alias("nodes")).crossJoin(links.agg(F.count("*").alias("edges")))
    average = F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes"))
    return sizes.withColumn("average_links", average).crossJoin(component_count(nodes, links))


def embeddedness(links: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """s, t, embeddedness: common neighbours of a link's ends, besides themselves."""
    return triads.credited(links, triangle_listing(links) if listed is None else listed, "embeddedness")


def simmelian(links: DataFrame) -> DataFrame:
    """s, t, simmelian: for links with a link back, third nodes tied both ways to both ends."""
    pairs = links.select("s", "t").distinct()
    mutual = pairs.join(pairs.select(F.col("t").alias("s"), F.col("s").alias("t")), ["s", "t"], "left_semi")
    return triads.credited(pairs, triads.listing(mutual.select(F.col("s").alias("v"), F.col("t").alias("n"))), "simmelian")


def disparity(links: DataFrame) -> DataFrame:
    """s, t, alpha: the lesser of both ends' chances that so heavy a tie is random."""
    near = undirected(links)
    per = near.groupBy("v").agg(F.count("*").alias("k"), F.sum("w").alias("strength"))
    alpha = F.when(F.col("k") < 2, 0.0).when(F.col("strength") <= 0, 1.0).otherwise(F.pow(1 - F.col("w") / F.col("strength"), F.col("k") - 1))
    each = near.join(per, "v").select("v", "n", alpha.alias("alpha"))
    one = each.select(F.col("v").alias("s"), F.col("n").alias("t"), F.col("alpha").alias("a1"))
    two = each.select(F.col("n").alias("s"), F.col("v").alias("t"), F.col("alpha").alias("a2"))
    return links.select("s", "t").join(one, ["s", "t"]).join(two, ["s", "t"]).select("s", "t", F.least("a1", "a2").alias("alpha"))


def network(nodes: DataFrame, links: DataFrame, most: int | None = None, most_neighbours: int = 300) -> DataFrame:
    """One row: density, clustering, diameter, average_path, and approximate: did path lengths come from some sources
    only, as `most` may ask for?"""
    n = nodes.count()
    m = links.count()
    d = undirected(links).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("k"))
    local = triangles(nodes, links).join(d, "id").where((F.col("k") >= 2) & (F.col("k") <= most_neighbours)).agg(F.avg(2 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).alias("clustering"))
    seen, _, _, furthest = _path_sums(nodes, links, most)
    paths = seen.agg(F.lit(furthest or None).cast("long").alias("diameter"), (F.sum("sum") / F.nullif(F.sum("reached"), F.lit(0))).alias("average_path"))
    dense = F.lit(m / (n * (n - 1)) if n > 1 else None).cast("double").alias("density")
    return local.crossJoin(paths).select(dense, "clustering", "diameter", "average_path", F.lit(most is not None and n > most).alias("approximate"))
