"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and white space is made single spaces. An item of m characters that occurs in a document
with at most k = budget * m edits shares at least m + 1 - q (k + 1) q-grams with it, whose diagonals (place in the
document less place in the item) lie within 2k + 1 of each other. So the shared q-grams of each item are counted in
bands of diagonals 2 (2k + 1) wide that overlap by half; regions that reach the bound are retained, and a banded
alignment of the item with the region gives the number of edits. q depends on the item's length: it is the largest of
QS for which the bound is q at least, so the whole budget holds at every length. Items to which the budget allows no
edit (under 10 characters at a tenth) have to occur exactly and as whole words.

The q-grams of a block of items (`broadcast_chars` characters together at most) are indexed and broadcast. Of a larger
benchmark all q-grams go into one bit map of fixed size first, and one scan keeps the documents that hit it as often
as the least bound of any item asks; the blocks then take turns on these documents, each turn writing what it found, so
what is broadcast at a time doesn't grow with the benchmark. That least bound keeps most documents of ordinary text, so
a benchmark of many blocks reads them about as many times. Documents aren't shuffled: a document's regions are judged where it is read, so a hot source or a passage that many share is no bottleneck.

Cases: null and empty documents have no matches, null and empty items match nothing; equal items match alike; of
several matches of an item in a document the one with the fewest edits, then the first, is given; repeated rows are
judged each; empty tables give empty results; texts are taken whole; other columns are not carried by `find_leaks`,
and carried as they are by `drop_leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, claim, small_batches

#: Characters of a q-gram: what an item may take, the largest first.
QS = (8, 6, 5, 4, 3)
#: Edits allowed for each character of an item.
BUDGET = 0.1
#: Characters of items that one index holds.
BROADCAST_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """The q-gram that starts at each place, as the low bytes of its characters: a filter that misses none."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    one = codes.astype(np.uint8).astype(np.uint64)
    out = one[:n].copy()
    for k in range(1, q):
        out |= one[k : k + n] << np.uint64(8 * k)
    return out


def _slots(grams: np.ndarray, q: int, power: int) -> np.ndarray:
    return ((grams + np.uint64(q)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - power)).astype(np.int64)


def bounds(sizes: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items of these sizes: edits allowed, q (0 for items that have to occur exactly) and q-grams needed."""
    edits = (budget * sizes + 1e-9).astype(np.int64)
    q, need = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for choice in reversed(QS):
        enough = sizes + 1 - choice * (edits + 1)
        take = (edits > 0) & (enough >= (choice if choice > QS[-1] else 1))
        q[take], need[take] = choice, enough[take]
    return edits, q, need


class _Grams:
    """The q-grams of the items of one q."""

    def __init__(self, q: int, owners: list[int], texts: list[str]):
        self.q = q
        grams = [_grams(_codes(t), q) for t in texts]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.array(owners, np.int64), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g), dtype=np.int64) for g in grams])[order]
        self.grams, self.first, self.n = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_slots(self.grams, q, 22)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the document, item, and place in the item of each q-gram that both have."""
        grams = _grams(codes, self.q)
        maybe = np.flatnonzero(self.bits[_slots(grams, self.q, 22)])
        wanted = grams[maybe]
        at = np.searchsorted(self.grams, wanted).clip(max=len(self.grams) - 1)
        hit = self.grams[at] == wanted
        maybe, at = maybe[hit], at[hit]
        n = self.n[at]
        entry = np.arange(int(n.sum())) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        return np.repeat(maybe, n), self.item[entry], self.place[entry]


class ItemIndex:
    """The q-grams of a block of items, and how far each item may be edited."""

    def __init__(self, items: list[tuple[Any, str]], budget: float = BUDGET):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits, q, self.need = bounds(size, budget)
        self.half = 2 * self.edits + 1
        self.by_q = [_Grams(c, own.tolist(), [self.texts[k] for k in own]) for c in QS if len(own := np.flatnonzero(q == c))]
        self.exact = [(k, re.compile(rf"(?<!\w){re.escape(self.texts[k])}(?!\w)")) for k in np.flatnonzero(q == 0).tolist() if self.texts[k]]

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, and the first and last diagonal of a band that shares enough q-grams with it."""
        for grams in self.by_q:
            yield from self._regions(*grams.shared(codes))

    def _regions(self, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if not len(at):
            return
        band = (at - place) // self.half[item]
        width = int(band.max() - band.min()) + 3
        low = int(band.min()) - 1
        own = item * width + (band - low)
        keys, counts = np.unique(own, return_counts=True)
        # A band reaches over its own half and the next one.
        follows = np.flatnonzero(keys[1:] == keys[:-1] + 1)
        both = counts.copy()
        both[follows] += counts[follows + 1]
        lead = np.flatnonzero(np.diff(keys, prepend=keys[0] - 2) != 1)
        starts, sums = np.concatenate((keys, keys[lead] - 1)), np.concatenate((both, counts[lead]))
        starts = starts[sums >= self.need[starts // width]]
        if not len(starts):
            return
        # What is left is counted again, each q-gram of the item once.
        order = np.argsort(own, kind="stable")
        own, place = own[order], place[order]
        for key, a, z in zip(starts.tolist(), np.searchsorted(own, starts), np.searchsorted(own, starts + 2)):
            k, b = key // width, key % width + low
            if len(np.unique(place[a:z])) >= self.need[k]:
                yield k, b * int(self.half[k]), (b + 2) * int(self.half[k]) - 1

    def matches(self, text: str) -> list[tuple[Any, int, int, int]]:
        """(item id, edits, start, end) of each item that occurs, best first place, by item."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, low, high in self.regions(_codes(text)):
            edits = int(self.edits[k])
            start, end = max(0, low - edits), min(len(text), high + edits + len(self.texts[k]) + 1)
            if found := aligned(self.texts[k], text[start:end], edits):
                cost, a, b = found
                best[k] = min(best.get(k, (1 << 60, 0, 0)), (cost, start + a, start + b))
        for k, pattern in self.exact:
            if found := pattern.search(text):
                best[k] = (0, *found.span())
        return [(self.ids[k], *best[k]) for k in sorted(best)]


def aligned(item: str, region: str, edits: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most `edits`) that make the item of a part of the region, with the part's start and end.

    Row by row over the item; only cells that a path with so few edits can reach from a free start are kept, which
    is the band of diagonals from -edits to the region's surplus length + edits."""
    if (at := region.find(item)) >= 0:
        return 0, at, at + len(item)
    if not edits:
        return None
    b, m, n = _codes(region), len(item), len(region)
    if n < m - edits:
        return None
    big = 1 << 30
    column = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), column.copy()
    for i, c in enumerate(_codes(item), 1):
        lo, hi = max(0, i - edits), min(n, n - m + edits + i)
        took = np.full(n + 1, big, np.int64)
        took[0] = i if lo == 0 else big
        kept = np.concatenate(([big], cost[:-1] + (b != c)))
        down = cost + 1
        new = np.minimum(kept, down)
        began = np.where(kept <= down, np.concatenate(([0], start[:-1])), start)
        new[0], began[0] = took[0], 0
        new[:lo], new[hi + 1 :] = big, big
        # Characters of the region that the item lacks: the best cell to the left, plus the way from it.
        lifted = new - column
        least = np.minimum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == least, column, 0))
        cost, start = least + column, began[source]
        cost[:lo], cost[hi + 1 :] = big, big
        if cost.min() > edits:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= edits else None


@dataclass(frozen=True)
class _Block:
    """Keys of a block of items, and their index (whose ids are places among the keys)."""

    keys: pa.Array
    index: ItemIndex


def _item_rows(items: DataFrame, key: str, text: str, limit: int) -> tuple[DataFrame, int]:
    """k, t of the items that are there, and how many blocks of about `limit` characters they make."""
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    return rows, -(-total // limit)


def _block(rows: DataFrame, b: int, n: int, budget: float) -> _Block:
    part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
    got = part.orderBy("k", "t").toArrow().combine_chunks()
    texts = [normalised(t) for t in got["t"].to_pylist()]
    there = [k for k, t in enumerate(texts) if t]
    keys = got["k"].combine_chunks() if isinstance(got["k"], pa.ChunkedArray) else got["k"]
    return _Block(keys.take(pa.array(there, pa.int64())), ItemIndex([(place, texts[k]) for place, k in enumerate(there)], budget))


#: Bits of the map of all items' q-grams, as a power of two.
_MAP = 28


def _suspects(docs: DataFrame, text: str, rows: DataFrame, budget: float) -> DataFrame:
    """The documents that hit the map of all items' q-grams as often as the least bound asks, or may hold an item that
    has to occur exactly."""
    spark = docs.sparkSession

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in map(normalised, batch.column("t").to_pylist()) if t]
            edits, q, need = bounds(np.array([len(t) for t in texts], np.int64), budget)
            found = [np.empty(0, np.int64), *(_slots(_grams(_codes(t), k), k, _MAP) for t, k in zip(texts, q.tolist()) if k)]
            slots = np.unique(np.concatenate(found))
            words, first = np.unique(slots >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.int64(1) << (slots & 63), first) if len(slots) else np.empty(0, np.int64)
            n = len(words) + len(texts)
            column = lambda x, before: pa.array([None] * before + x + [None] * (n - before - len(x)), pa.int64())
            yield pa.RecordBatch.from_arrays([column(words.tolist(), 0), column(bits.tolist(), 0), column(q.tolist(), len(words)), column(need.tolist(), len(words))], ["w", "b", "q", "need"])

    made = rows.select("t").mapInArrow(mapped, "w long, b long, q long, need long")
    got = made.where("w IS NOT NULL").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (_MAP - 6), np.int64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    least = {r["q"]: r["need"] for r in made.where("q IS NOT NULL").groupBy("q").agg(F.min("need").alias("need")).collect()}
    shared = spark.sparkContext.broadcast((bits, least))

    def hits(t: str | None) -> bool:
        if not t:
            return False
        bits, least = shared.value
        codes = _codes(normalised(t))
        for q, need in least.items():
            if not q:
                return True
            slots = _slots(_grams(codes, q), q, _MAP)
            if np.count_nonzero(bits[slots >> 6] >> (slots & 63) & 1) >= need:
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text):
            yield part.filter(pa.array([hits(t) for t in part.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _leaks_of(rows: DataFrame, block: _Block, schema: str, names: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("leaks")
        for part in blocks(batches, "__text"):
            index = shared.value.index
            found = [(row, *m) for row, t in enumerate(part.column("__text").to_pylist()) if t for m in index.matches(normalised(t))]
            row, item, *numbers = [list(c) for c in zip(*found)] or [[], [], [], [], []]
            take = lambda column, places: column.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([take(part.column("__key"), row), take(shared.value.keys, item), *[pa.array(c, pa.int32()) for c in numbers]], names)

    return rows.mapInArrow(run, schema)


def find_leaks(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    budget: float = BUDGET,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """key, item, edits, start, end: places in the normalised text of the document."""
    small_batches(docs)
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    names = [key, item_key, "edits", "start", "end"]
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, edits int, start int, end int"
    rows = docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text")
    listed, n = _item_rows(items, item_key, item_text, broadcast_chars)
    if n == 0:
        return spark.createDataFrame([], schema)
    if n == 1:
        return _leaks_of(rows, _block(listed, 0, 1, budget), schema, names)
    scratch = Scratch(spark, "leaks")
    rows = scratch.save(_suspects(rows, "__text", listed, budget), "suspects")
    found = [scratch.save(_leaks_of(rows, _block(listed, b, n, budget), schema, names), f"block-{b}") for b in range(n)]
    return reduce(DataFrame.unionByName, found)


def drop_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", budget: float = BUDGET, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows, with all their columns, in which no item occurs."""
    small_batches(docs)
    listed, n = _item_rows(items, item_key, item_text, broadcast_chars)
    if n == 0:
        return docs
    if n > 1:
        # Rows have no key here: equal texts leak alike.
        rows = docs.select(F.xxhash64(text).alias("__key"), F.col(text).alias("__text"))
        leaked = find_leaks(spark, rows, items, "__key", "__text", item_key, item_text, budget, broadcast_chars).select(F.col("__key").alias("__leaked")).distinct()
        return docs.join(leaked, F.xxhash64(docs[text]) == leaked["__leaked"], "left_anti")
    shared = spark.sparkContext.broadcast(_block(listed, 0, 1, budget))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("leaks")
        for part in blocks(batches, text):
            index = shared.value.index
            yield part.filter(pa.array([not (t and index.matches(normalised(t))) for t in part.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
