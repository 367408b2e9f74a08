"""Hard-negative mining over inverted lists of k-means clusters.

Vectors become whole numbers (floor of `scale` times each component) and scores are their inner products. An anchor's
positives are the best rows of its label; for each positive, its hard negatives are the best rows of other labels
whose score lies in a window that is a share of the positive's score. The search is exact: a row's score is at most
the anchor's product with the row's centroid plus the anchor's length times the cluster's stored radius (the
Cauchy-Schwarz bound), so clusters are visited by falling bound, those whose scores can't reach any window are skipped,
and a visit ends where the bound falls strictly below the k-th score found.

Centroids are fitted on the driver to a bounded sample of rows (`per_cluster` rows for each of `most_clusters` at most);
all rows are assigned in one scan and written with their cluster's number and distance. A cluster is cut into pieces
of `PIECE_ROWS` rows, about, so one that holds a third of all rows is many pieces. Visits go in rounds (the first 8
clusters of each anchor, the next 56, the rest): a round sends every open anchor to the pieces of the clusters it has
to see, meets anchors and rows in tasks that hold one piece and stream anchors by it, and lets through only what beats
the k-th score so far. What tasks find is cut to the k best of each search before it is kept.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of unequal
length are filled up with zeros; an empty vector has only zero scores; ties go to the smaller id; rows that repeat each
take a place of their own, but no row with the anchor's id is its positive; anchors that repeat whole are asked once;
an anchor without other rows of its label, or a window without rows, gives no rows; an empty table gives an empty result;
components that don't fit 32 bits once scaled, or scores beyond 2^53, are an error; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, claim, small_batches

PIECE_ROWS = 65_536
#: Scores that a task holds at once.
CELLS = 2_000_000
#: Clusters that an anchor has seen after each round; the last round sees all.
ROUNDS = (8, 64, None)
_LEAST, _MOST = -(1 << 62), 1 << 62


@dataclass
class Index:
    """Centroids, radii and pieces by cluster, and `lists`: cluster, piece, id, label, vector (32-bit numbers)."""

    centroids: np.ndarray
    radii: np.ndarray
    pieces: np.ndarray
    lists: DataFrame

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By vector: clusters by falling bound, and all clusters' upper and lower bounds."""
        d = min(vectors.shape[1], self.centroids.shape[1])
        middle = vectors[:, :d] @ self.centroids[:, :d].T
        size = np.linalg.norm(vectors, axis=1)[:, None]
        spread = size * self.radii
        spread += 1e-9 * (size * np.linalg.norm(self.centroids, axis=1) + spread) + 1e-6
        return np.argsort(-(middle + spread), axis=1, kind="stable"), middle + spread, middle - spread


def _lists(column: pa.Array, dtype: type) -> np.ndarray:
    """A column of lists or packed numbers as rows of one matrix, filled up with zeros."""
    if pa.types.is_binary(column.type):
        rows = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    else:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
        rows = [flat[a:z] for a, z in zip(ends, ends[1:])]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.float64)
    if rows and all(len(r) == out.shape[1] for r in rows):
        out[:] = np.stack(rows)
    else:
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
    return out


def k_means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of distinct rows by Lloyd's rounds; a centroid that loses its rows stays."""
    distinct = np.unique(sample, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(0).permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        nearest = np.concatenate([_nearest(sample[a : a + 4096], centroids) for a in range(0, len(sample), 4096)])
        order, counts = np.argsort(nearest, kind="stable"), np.bincount(nearest, minlength=k)
        there = np.flatnonzero(counts)
        sums = np.add.reduceat(sample[order], np.concatenate(([0], np.cumsum(counts[there])[:-1])), axis=0)
        centroids[there] = sums / counts[there, None]
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = min(vectors.shape[1], centroids.shape[1])
    return np.argmin((centroids**2).sum(1) - 2 * vectors[:, :d] @ centroids[:, :d].T, axis=1)


def _whole(column: pa.Array, scale: float) -> np.ndarray:
    out = np.floor(scale * _lists(column, np.float64))
    if out.size and np.abs(out).max() >= 2**31:
        raise ValueError("components have to fit 32 bits once they are scaled")
    return out


def build_index(spark: SparkSession, rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0, most_clusters: int = 1024, per_cluster: int = 64) -> Index | None:
    """The inverted lists of all rows that take part, or None without any."""
    small_batches(rows)
    label = F.col(label) if isinstance(label, str) else label
    rows = rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    n = rows.count()
    if not n:
        return None
    wanted = min(most_clusters, int(np.ceil(np.sqrt(n))))
    most = per_cluster * wanted
    chance = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30) < min(1.0, most / n)
    sample = rows.select("vector").where(chance).limit(2 * most).toArrow() if most < n else rows.select("vector").toArrow()
    if not sample.num_rows:
        sample = rows.select("vector").limit(most).toArrow()
    centroids = k_means(_whole(sample["vector"].combine_chunks(), scale), wanted)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("negatives")
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_pylist()
            vectors = _whole(batch.column("vector"), scale)
            nearest = _nearest(vectors, shared.value)
            d = max(vectors.shape[1], shared.value.shape[1])
            away = _filled(vectors, d) - _filled(shared.value, d)[nearest]
            packed = [v[:size].tobytes() for v, size in zip(vectors.astype(np.int32), lengths)]
            columns = [pa.array(nearest.astype(np.int32)), pa.array(np.linalg.norm(away, axis=1)), batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "away", "id", "label", "vector"])

    found = rows.mapInArrow(assign, "cluster int, away double, id long, label long, vector binary").withColumn("row", F.monotonically_increasing_id())
    lists = Scratch(spark, "negatives-lists").save(found, "lists")
    radii, pieces = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in lists.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():
        radii[r["cluster"]], pieces[r["cluster"]] = r["radius"], -(-r["n"] // PIECE_ROWS)
    offsets, counts = (F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast("array<bigint>") for x in (np.cumsum(pieces) - pieces, pieces))
    at = F.col("cluster") + 1
    piece = F.element_at(offsets, at) + F.pmod(F.xxhash64("row"), F.element_at(counts, at))
    return Index(centroids, radii, pieces, lists.select(piece.alias("piece"), "id", "label", "vector"))


def _filled(vectors: np.ndarray, d: int) -> np.ndarray:
    return vectors if vectors.shape[1] >= d else np.pad(vectors, ((0, 0), (0, d - vectors.shape[1])))


_MET = "piece long, kind int, qid long, id long, label long, vector binary, bounds array<long>"


def _send(index: Index, queries: DataFrame, seen: int, until: int | None) -> DataFrame:
    """Every query at every piece that it has to see in this round. bounds: low, high, k-th score and its id, for each
    of a query's searches."""
    centre = Index(index.centroids, index.radii, index.pieces, None)
    shared = index.lists.sparkSession.sparkContext.broadcast(centre)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        first = np.cumsum(own.pieces) - own.pieces
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                part = batch.slice(k, 32)
                order, upper, lower = own.visits(_lists(part.column("vector"), np.int32))
                rows, places = [], []
                for row, bounds in enumerate(part.column("bounds").to_pylist()):
                    low, high, kth, _ = np.array(bounds, np.float64).reshape(-1, 4).T[:, :, None]
                    some = order[row, seen:until]
                    above, below = upper[row, some], lower[row, some]
                    for c in some[((above >= np.maximum(low, kth)) & (below <= high)).any(0)].tolist():
                        places += range(first[c], first[c] + own.pieces[c])
                    rows += [row] * (len(places) - len(rows))
                to = part.take(pa.array(rows, pa.int64()))
                kind = pa.array(np.ones(len(rows), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), kind, *(to.column(c) for c in ("qid", "id", "label", "vector", "bounds"))], ["piece", "kind", "qid", "id", "label", "vector", "bounds"])

    return queries.select("qid", "id", "label", "vector", "bounds").mapInArrow(send, _MET)


class _Piece:
    """The rows of one piece, met by queries."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.vectors = _lists(rows["vector"].combine_chunks(), np.int32)
        self.size = float(np.linalg.norm(self.vectors, axis=1).max(initial=0.0))
        self.light = self.vectors.astype(np.float32)

    def search(self, queries: pa.RecordBatch, k: int, same: bool) -> Iterator[pa.RecordBatch]:
        own = _lists(queries.column("vector"), np.int32)
        most = self.size * float(np.linalg.norm(own, axis=1).max(initial=0.0))
        if most >= 2**53:
            raise ValueError("scores have to be below 2^53")
        d = min(own.shape[1], self.vectors.shape[1])
        mine, theirs = (own.astype(np.float32), self.light) if most < 2**24 else (own, self.vectors)  # whole numbers, exact either way
        bounds = [np.array(b, np.int64).reshape(-1, 4) for b in queries.column("bounds").to_pylist()]
        slots = max(map(len, bounds))
        table = np.tile(np.array([_MOST, _LEAST, _MOST, 0], np.int64), (len(bounds), slots, 1))  # of searches that aren't there
        for row, b in enumerate(bounds):
            table[row, : len(b)] = b
        label, anchor, qid = (queries.column(c).to_numpy() for c in ("label", "id", "qid"))
        step = max(1, CELLS // max(1, len(self.ids)))
        for a in range(0, len(own), step):
            some = slice(a, a + step)
            scores = mine[some, :d] @ theirs[:, :d].T
            alike = label[some, None] == self.labels
            able = alike & (anchor[some, None] != self.ids) if same else ~alike
            able &= scores >= np.maximum(table[some, :, 0], table[some, :, 2]).min(1)[:, None].astype(np.float64)
            q, x = np.nonzero(able)
            score, id = scores[q, x].astype(np.int64), self.ids[x]
            for slot in range(slots):
                low, high, kth, kth_id = table[some, slot][q].T
                fits = (score >= low) & (score <= high) & ((score > kth) | ((score == kth) & (id < kth_id)))
                order = np.flatnonzero(fits)
                order = order[np.lexsort((id[order], -score[order], q[order]))]
                who = q[order]
                start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
                place = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
                order, who = order[place < k], who[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(qid[some][who]), pa.array(np.full(len(who), slot, np.int32)), pa.array(score[order]), pa.array(id[order])], ["qid", "slot", "score", "found"])


def _meet(index: Index, sent: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, slot, score, found: the k best of each search and piece."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("negatives")
        at, held, piece = None, [], None
        for batch in batches:
            places, kinds = batch.column("piece").to_numpy(), batch.column("kind").to_numpy()
            ends = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *ends], [*ends, batch.num_rows]):
                if a == z:
                    continue
                run = batch.slice(a, z - a)
                if places[a] != at:
                    at, held, piece = places[a], [], None
                if kinds[a] == 0:
                    held.append(run)
                else:
                    if piece is None:
                        piece, held = _Piece(held), []
                    yield from piece.search(run, k, same)

    spark = sent.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(index.pieces.sum()) // 64)
    rows = index.lists.select("piece", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qid"), "id", "label", "vector", F.lit(None).cast("array<long>").alias("bounds"))
    both = rows.unionByName(sent).repartition(parts, "piece").sortWithinPartitions("piece", "kind")
    return both.mapInArrow(meet, "qid long, slot int, score long, found long")


def search(spark: SparkSession, index: Index, queries: DataFrame, searches: DataFrame, k: int, same: bool) -> DataFrame:
    """qid, slot, rank, score, found: of each search the k best rows with the query's label, or with another.
    queries: qid, id, label, vector; searches: qid, slot (from 0), low, high."""
    scratch, best, seen = Scratch(spark, "negatives-search"), None, 0
    by_score = Window.partitionBy("qid", "slot").orderBy(F.desc("score"), "found")
    for until in ROUNDS:
        if seen and seen >= len(index.centroids):
            break
        if best is None:
            open_ = searches.select("*", F.lit(_LEAST).alias("kth"), F.lit(_MOST).alias("kth_id"))
        else:
            last = best.where(F.col("rank") == k).select("qid", "slot", F.col("score").alias("kth"), F.col("found").alias("kth_id"))
            open_ = searches.join(last, ["qid", "slot"], "left").fillna({"kth": _LEAST, "kth_id": _MOST})
        grouped = open_.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high", "kth", "kth_id"))).alias("s"))
        bounds = F.flatten(F.transform("s", lambda s: F.array(s["low"], s["high"], s["kth"], s["kth_id"])))
        sent = _send(index, queries.join(grouped.select("qid", bounds.alias("bounds")), "qid"), seen, until)
        found = _meet(index, sent, k, same)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = scratch.save(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), f"best{seen}")
        seen = until
    return best


def _share(score: Column, percent: int, up: bool) -> Column:
    """A whole percentage of a score, rounded up or down."""
    times = score * percent if not up else -score * percent
    down = F.call_function("div", times - F.pmod(times, F.lit(100)), F.lit(100))
    return -down if up else down


def mine(
    spark: SparkSession, rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, most_clusters: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: a condition on `id`, the row's
    id; least, most: the window in hundredths of the positive's score."""
    index = build_index(spark, rows, id, vector, label, scale, most_clusters)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return spark.createDataFrame([], schema)
    scratch = Scratch(spark, "negatives")
    queries = index.lists.where(anchors).select("id", "label", "vector").distinct().withColumn("qid", F.monotonically_increasing_id())
    queries = scratch.save(queries, "queries")
    all_scores = queries.select("qid", F.lit(0).alias("slot"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    positives = search(spark, index, queries, all_scores, n_positives, same=True)
    windows = positives.select("qid", (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), _share(F.col("score"), least, True).alias("low"), _share(F.col("score"), most, False).alias("high")).where("low <= high")
    windows = scratch.save(windows, "windows")
    negatives = search(spark, index, queries, windows.select("qid", "slot", "low", "high"), n_negatives, same=False)
    out = negatives.join(windows, ["qid", "slot"]).join(queries.select("qid", F.col("id").alias("anchor_id")), "qid")
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
