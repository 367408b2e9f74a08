"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the tokenizer's own pattern; in a piece, the lowest-rank adjacent pair is popped
from a heap again and again and joined in a linked list of symbols. The count of a piece is its initial symbols
less the merges made: no identifiers are looked up or emitted. Strings of added special tokens count one each,
as the library's default has it.

Pieces don't depend on their neighbours where one space stands between two other characters, so texts are cut
there first and the counts of the cuts are memoised (bounded; the memory of a task doesn't grow with its input).

Runs in Arrow batches, one scan, no shuffle. Cases: a null text is an empty one (0 bytes, 0 tokens); texts of
any length are taken whole; repeated rows are counted each; an empty table gives an empty result; only the key
is carried, so other columns can't clash.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .classes import Pieces, differing
from .common import blocks, claim, small_batches

# Fixed value: the pattern that a byte-level pre-tokenizer cuts by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries in a generation of a memo.
MEMO = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Memo(dict):
    """Values by string, made when first asked for. Of two generations of `limit` entries, the older is dropped
    when the younger is full, so frequent keys stay; long keys aren't kept."""

    def __init__(self, make: Callable[[str], Any], limit: int, longest: int = 200):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class MergeCounter:
    """Counts tokens with the merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, memo: int = MEMO, differ: Sequence[tuple[int, int, str]] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        ids = model["vocab"]
        self.symbol = {b: ids[c] for b, c in byte_alphabet().items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = Pieces(BYTE_LEVEL, differ)
        self.pieces = Memo(lambda piece: self.merge_count(piece.encode("utf-8")), memo // 2)
        self.rest = Memo(lambda cut: self._plain(f" {cut}"), memo)

    def merge_count(self, piece: bytes) -> int:
        """Initial symbols less merges."""
        merges, n = self.merges, len(piece)
        symbols: list[int | None] = [self.symbol[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*hit, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (hit := merges.get((symbols[k], symbols[k + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, joined, k, left, right = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != left or j >= n or symbols[j] != right:
                continue
            symbols[k], symbols[j] = joined, None
            done += 1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if hit := merges.get((joined, symbols[j])):
                    heapq.heappush(heap, (*hit, k, joined, symbols[j]))
            if (i := before[k]) >= 0 and (hit := merges.get((symbols[i], joined))):
                heapq.heappush(heap, (*hit, i, symbols[i], joined))
        return n - done

    def _plain(self, text: str) -> int:
        """Of a text without special strings, by the pattern."""
        return sum(map(self.pieces.__getitem__, self.cut(text)))

    def _by_cuts(self, text: str) -> int:
        first, *rest = cuts(text)
        return self._plain(first) + sum(map(self.rest.__getitem__, rest))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._by_cuts(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._by_cuts, filter(None, parts)))


_DOUBLE = re.compile(r"\s\s|^\s|\s\Z")


def cuts(text: str) -> list[str]:
    """What stands between single spaces that have no white space on either side; all but the first lost a space."""
    parts = text.split(" ")
    if not _DOUBLE.search(text):
        return parts
    out, held = [], [parts[0]]
    for part in parts[1:]:
        last = held[-1]
        if last and part and not last[-1].isspace() and not part[0].isspace():
            out.append(" ".join(held))
            held = []
        held.append(part)
    return [*out, " ".join(held)]


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit. `vocabulary`: a path that executors can open, or a file's name that was
    given to SparkContext.addFile."""
    small_batches(docs)
    kind, differ = dict(docs.dtypes)[key], differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for block in blocks(batches, "__text"):
            counter = counter or _counter(vocabulary, differ)
            texts = block.column("__text")
            n_bytes = pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(texts), 0), pa.int64())
            n_tokens = pa.array([counter.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("__key"), n_bytes, n_tokens, pa.compute.greater(n_tokens, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


_counters: dict[str, MergeCounter] = {}


def _counter(vocabulary: str, differ: Sequence[tuple[int, int, str]]) -> MergeCounter:
    """One for each Python worker and vocabulary."""
    claim("counts", _counters.clear)
    if vocabulary not in _counters:
        _counters[vocabulary] = MergeCounter(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary), differ=differ)
    return _counters[vocabulary]
