"""N-gram Jaccard join by a blocked sparse matrix product, exact at the threshold.

The incidence matrix has a row for each distinct set of word shingles and a column for each shingle. Columns are
dealt to blocks by their hash; the product of the matrix with its transpose is worked out block by block, one numpy
task each, and the overlap counts of pairs are added up over the blocks.

* Only a row's leading columns take part: of n columns the first n - ceil(t n) + 1 in an order that all rows share.
  Two sets that reach the threshold t share one of those. The order puts columns that few rows have first (column
  counts over all documents), so what many documents share, such as a passage, doesn't lead.
* Pairs are discarded when their sizes or their overlap so far bound the similarity below t: what the leading columns
  share, plus all that follow them, has to reach t / (1 + t) of both sizes.
* A column of more than `crowd` rows isn't multiplied out. Rows tied by such columns are a crowd. Two of them that
  share nothing but crowded columns reach the threshold only if the crowded columns of either are t / (1 + t) of both
  sizes; so a row has a largest size of its partners, and rows that no other row's size suits leave the crowd: pages
  that share a template, and not enough else, don't meet. What is left is cut into parts of some hundred rows, each
  part is multiplied with itself, and rows that are then not in the crowd's main component with every part. Tasks give
  only links that join components: none between components is lost, and a group of many near copies doesn't give all
  its pairs. (With more than `most_crowded` columns not all are known, and the bound is the looser one of sizes.)
* Other candidate pairs are verified on whole sets. Sets are sent to groups of at most some dozen rows of a candidate
  component, so a component of any size is dealt to many tasks.

Equal sets are one row, whatever number of documents has them. Components of the verified links are found by
distributed union-find. Texts are scanned three times (column counts, leading columns, sets of candidates) instead of
keeping their shingles: the scans cost less than the disk. What reaches the driver or every executor is bounded:
the hashes of `most_crowded` columns at most, and a bit map of 32 MB at most that tells which sets are needed.

Cases: a null text or one without words has no set, size 0 and is a component of its own; with fewer words than a
shingle the whole sequence is the only shingle; keys are integers (others are refused; of equal keys a row each is given);
texts are taken whole; ties don't matter, as a component's id is its least key; an empty table gives an empty result;
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.forests import components
from .common import Scratch, blocks, claim, integer_key, text_bytes

#: Bytes of text for each block of columns; blocks at least and at most.
BYTES_A_BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 4_000_000, 256, 1 << 20
#: Rows of a column beyond which its pairs aren't multiplied out.
CROWD = 32
#: Crowded columns that are put last at most (the most crowded of them).
MOST_CROWDED = 4_000_000
#: Candidate pairs that are verified together, about.
GROUP_PAIRS = 2000
#: Rows of a key table that is broadcast at most; a larger one is joined by shuffling.
BROADCAST_KEYS = 200_000

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(31)) * _U(0x7FB5D329728EA185)
    h = (h ^ h >> _U(27)) * _U(0x81DADEF4BC2DD44D)
    return h ^ h >> _U(33)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, ends: np.ndarray, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of texts laid end to end, and where each text's words start."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    first[heads] = ~space[heads]
    starts = np.flatnonzero(first)
    out, at, n = [], 0, len(data)
    while at < len(starts):
        # Whole words of about `chunk` bytes.
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + chunk)))
        begin, end = int(starts[at]), int(starts[to]) if to < len(starts) else n
        up, down = _powers_to(end - begin)
        local = starts[at:to] - begin
        out.append(_mix(np.add.reduceat(_BYTE[data[begin:end]] * up[: end - begin], local) * down[local]))
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its word shingles."""
    whole = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    body = whole.buffers()[2]
    if body is None or ends[-1] == ends[0]:
        return [np.empty(0, np.uint64)] * len(whole)
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]
    words, at = word_hashes(data, ends - ends[0])
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= width:
            found = np.sort(rolled[a : b - width + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        elif b > a:
            out.append(_mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _PLACE[32 + b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_name(found: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    total = _mix(found ^ _PLACE[40]).sum(keepdims=True, dtype=np.uint64) + np.array([len(found)], np.uint64) * _PLACE[41]
    return int(_mix(total).astype(np.int64)[0])


def _leading(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _split(found: np.ndarray, n_blocks: int) -> np.ndarray:
    """block << 32 | 32 more bits of each hash."""
    return (found & _U(n_blocks - 1)) << _U(32) | found >> _U(20) & _U(0xFFFFFFFF)


class _Crowded:
    """Which columns are crowded."""

    def __init__(self, columns: np.ndarray):
        self.columns = np.sort(columns)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(self.columns)] = True

    @staticmethod
    def _slot(columns: np.ndarray) -> np.ndarray:
        return (columns * _U(_BASE) >> _U(42)).astype(np.int64)

    def has(self, columns: np.ndarray) -> np.ndarray:
        out = self.bits[self._slot(columns)]
        if len(maybe := np.flatnonzero(out)):
            at = np.searchsorted(self.columns, columns[maybe]).clip(max=len(self.columns) - 1)
            out[maybe] = self.columns[at] == columns[maybe]
        return out


#: Gives name and set of each distinct row of a task's batches.
Named = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int, forget: int = 200_000) -> Iterator[tuple[int, np.ndarray]]:
    claim("near duplicates")
    seen: set[int] = set()
    for block in blocks(batches, "__text", 1_000_000):
        for found in shingle_sets(block.column("__text"), width):
            if len(found):
                name = set_name(found)
                if name not in seen:
                    if len(seen) >= forget:
                        seen.clear()
                    seen.add(name)
                    yield name, found


def crowded_columns(source: DataFrame, named: Named, scratch: Scratch, n_blocks: int, crowd: int, most: int) -> tuple[np.ndarray, bool]:
    """Columns that more than `crowd` distinct rows have (of too many, the more crowded ones), and if these are all."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            columns = np.sort(np.concatenate(held))
            run = np.arange(len(columns)) - np.repeat(*_runs(columns))
            columns = columns[run <= crowd]  # more of a column in one task doesn't tell more
            cut = np.searchsorted(columns, np.arange(n_blocks + 1, dtype=np.uint64) << _U(32))
            full = np.flatnonzero(np.diff(cut))
            low = columns.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], ["block", "columns"])

        for _, found in named(batches):
            held.append(_split(found, n_blocks))
            n += len(found)
            if n >= 2_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        columns = np.sort(np.frombuffer(b"".join(table["columns"].to_pylist()), np.uint32))
        first, sizes = _runs(columns)
        large = sizes > crowd
        found = (np.uint64(table["block"][0].as_py()) << _U(32) | columns[first[large]].astype(np.uint64)).astype(np.int64)
        return pa.table({"c": found, "n": sizes[large].astype(np.int64)})

    counts = scratch.save(source.mapInArrow(gather, "block int, columns binary").groupBy("block").applyInArrow(count, "c long, n long"), "crowded")
    least = crowd
    while counts.where(F.col("n") > least).count() > most:
        least *= 2
    return counts.where(F.col("n") > least).select("c").toArrow()["c"].to_numpy().astype(np.uint64), least == crowd


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of equal values."""
    if not len(ordered):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return first, np.diff(np.append(first, len(ordered)))


#: Entries carry a size as its logarithm's step in eleven bits; five more bits tell, where a row leads with crowded
#: columns, which share of its columns is crowded, in 31sts.
_STEP_BITS, _SHARES = 2047, 31
_PAIRS = "kind int, a long, b long, n int, qa int, qb int, part int, names binary"
#: Rows of a crowded column that are sent on together.
_PART = 4096


def _product(table: pa.Table, crowd: int, slack: int) -> pa.Table:
    """Of one block: pairs with overlap counts (kind 0), and the rows of crowded columns (kind 1) in parts, with the
    column's first row as a."""
    join = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    columns, names, sizes = join("columns", np.uint32), join("names", np.int64), join("sizes", np.uint16)
    order = np.lexsort((names, columns))
    columns, names, sizes = columns[order], names[order], sizes[order].astype(np.int32)
    fresh = np.concatenate(([True], (columns[1:] != columns[:-1]) | (names[1:] != names[:-1])))
    columns, names, sizes = columns[fresh], names[fresh], sizes[fresh]
    first, run = _runs(columns)
    lefts, rights = [], []
    for size in np.unique(run[(run > 1) & (run <= crowd)]).tolist():
        at = first[run == size]
        i, j = np.triu_indices(size, 1)
        lefts.append((at[:, None] + i).ravel())
        rights.append((at[:, None] + j).ravel())
    out = []
    if lefts:
        i, j = np.concatenate(lefts), np.concatenate(rights)
        near = np.abs((sizes[i] & _STEP_BITS) - (sizes[j] & _STEP_BITS)) <= slack
        i, j = i[near], j[near]
        order = np.lexsort((names[j], names[i]))
        i, j = i[order], j[order]
        if len(i):
            new = np.flatnonzero(np.concatenate(([True], (names[i][1:] != names[i][:-1]) | (names[j][1:] != names[j][:-1]))))
            n = np.diff(np.append(new, len(i)))
            out.append((np.zeros(len(new), np.int64), names[i[new]], names[j[new]], n, sizes[i[new]], sizes[j[new]]))
    flat = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 6
    first_rows, parts, blobs = [], [], []
    for c in np.flatnonzero(run > crowd).tolist():
        rows = names[first[c] : first[c] + run[c]]
        part = _mix(rows.astype(np.uint64)) % _U(-(-len(rows) // _PART))
        for k in range(int(part.max()) + 1):
            first_rows.append(rows[0])
            parts.append(k)
            blobs.append(rows[part == k].tobytes())
    m, n = len(flat[0]), len(blobs)
    none = lambda k, kind: pa.nulls(k, kind)
    long, int_ = pa.int64(), pa.int32()
    pairs = [pa.array(flat[0], int_), pa.array(flat[1], long), pa.array(flat[2], long), *[pa.array(x, int_) for x in flat[3:]], none(m, int_), none(m, pa.binary())]
    crowds = [pa.array([1] * n, int_), pa.array(first_rows, long), none(n, long), none(n, int_), none(n, int_), none(n, int_), pa.array(parts, int_), pa.array(blobs, pa.binary())]
    columns = ["kind", "a", "b", "n", "qa", "qb", "part", "names"]
    return pa.concat_tables([pa.table(pairs, columns), pa.table(crowds, columns)])


#: Steps of a size's logarithm: sizes are compared by them before they are known exactly.
_STEPS = 64


class BlockWriter:
    """Collects (column, name, size) entries and gives them as batches with a row for each block."""

    def __init__(self, n_blocks: int, entries: int = 1_000_000):
        self.n_blocks, self.entries, self.held, self.n = n_blocks, entries, [], 0

    def add(self, columns: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((columns, names, sizes))
        self.n += len(columns)
        if self.n >= self.entries:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        columns, names, sizes = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        block = columns >> _U(32)
        order = np.argsort(block, kind="stable")
        columns, names, sizes, block = columns[order], names[order], sizes[order], block[order]
        cut = np.searchsorted(block, np.arange(self.n_blocks + 1, dtype=np.uint64))
        full, low = np.flatnonzero(np.diff(cut)), columns.astype(np.uint32)
        each = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), each(low), each(names), each(sizes.astype(np.uint16))], ["block", "columns", "names", "sizes"])


def block_count(n_bytes: int) -> int:
    return 1 << int(np.ceil(np.log2(min(MOST_BLOCKS, max(LEAST_BLOCKS, n_bytes / BYTES_A_BLOCK)))))


def _slack(percent: int) -> int:
    """Steps of size that two sets of this similarity may differ by."""
    return int(-_STEPS * np.log2(percent / 100)) + 1


def block_product(source: DataFrame, named: Named, crowded, n_blocks: int, percent: int, crowd: int) -> DataFrame:
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, all_known, _), writer = crowded.value, BlockWriter(n_blocks)
        for name, found in named(batches):
            columns, n_lead = _split(found, n_blocks), _leading(len(found), percent)
            late = last.has(columns)
            size, n_late = int(_STEPS * np.log2(len(found))), int(late.sum())
            if n_late:
                columns = np.concatenate((columns[~late], columns[late]))
                if all_known and len(columns) - n_late < n_lead:
                    size |= -(-_SHARES * n_late // len(columns)) << 11
            columns = columns[:n_lead]
            yield from writer.add(columns, np.full(len(columns), name, np.int64), np.full(len(columns), size, np.uint16))
        yield from writer.close()

    led = source.mapInArrow(lead, "block int, columns binary, names binary, sizes binary")
    return led.groupBy("block").applyInArrow(lambda t: _product(t, crowd, _slack(percent)), _PAIRS)


@dataclass(frozen=True)
class Crowds:
    """edges (a, b) that tie rows by crowded columns; these columns, broadcast; and how to get the rows' columns:
    a table with name, and sets of a batch of it."""

    edges: DataFrame
    columns: Any
    source: DataFrame
    sets_of: Callable[[pa.RecordBatch], list[np.ndarray]]


def exact_candidates(source: DataFrame, named: Named, scratch: Scratch, n_blocks: int, percent: int, crowd: int, most: int) -> tuple[DataFrame, DataFrame, Any]:
    """pairs (a, b) that sizes and overlaps leave, edges (a, b) that tie crowds, and the broadcast crowded columns:
    two rows that reach the threshold are a pair, or in a crowd."""
    found, all_known = crowded_columns(source, named, scratch, n_blocks, crowd, most)
    crowded = source.sparkSession.sparkContext.broadcast((_Crowded(found), all_known, n_blocks))
    found = scratch.save(block_product(source, named, crowded, n_blocks, percent, crowd), "found")

    # Sizes by their steps: from 2 ** (q / steps) to 2 ** ((q + 1) / steps).
    steps = lambda q: F.col(q).bitwiseAND(_STEP_BITS)
    low, high = (lambda q: F.pow(F.lit(2.0), steps(q) / float(_STEPS))), (lambda q: F.pow(F.lit(2.0), (steps(q) + 1) / float(_STEPS)))
    t = percent / 100
    # What may be shared beyond the counted columns: what follows the leading ones, or of a row that leads with
    # crowded columns (which aren't counted) the crowded ones.
    crowded_part = lambda q: F.when(F.col(q) > _STEP_BITS, high(q) * F.shiftright(q, 11) / float(_SHARES))
    beyond = F.coalesce(F.least(crowded_part("qa"), crowded_part("qb")), t * F.greatest(high("qa"), high("qb")))
    bound = F.col("n") + beyond >= t / (1 + t) * (low("qa") + low("qb")) - 1e-6
    counted = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("qa").alias("qa"), F.first("qb").alias("qb")).where(bound)
    pairs = scratch.save(counted.select("a", "b"), "pairs")
    edges = scratch.save(crowd_edges(found), "edges")
    scratch.drop("found")
    return pairs, edges, crowded


def _bit_map(names: DataFrame, column: str) -> np.ndarray:
    """A bit for each leading part of the names (which are hashes); a fixed size at most."""
    n = names.count()
    power = min(28, max(16, int(np.log2(n + 1)) + 5))
    place = F.shiftrightunsigned(column, 64 - power)
    words = names.select(place.alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p & 63 AS int)) AS b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(max(1, 1 << (power - 6)), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def unpacked(found: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(f, np.uint64) for f in found]


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, percent: int, unpack=unpacked) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold, with the components of all pairs that do."""
    # Pairs meet by the least neighbour of either end: those of a clique meet at once. A key with few pairs shares its
    # group with others; one with many is cut into a square of groups.
    total = pairs.count()
    least = ends(pairs, both=True).groupBy("name").agg(F.min(F.least("name", "other")).alias("key"))
    least = scratch.save(least, f"{name}-keys")
    at = lambda c: least.select(F.col("name").alias(c), F.col("key").alias(f"key_{c}"))
    keyed = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.least("key_a", "key_b").alias("key"))
    keyed = scratch.save(keyed, f"{name}-keyed")
    sides = keyed.groupBy("key").agg(F.ceil(F.sqrt(F.count("*") / float(GROUP_PAIRS))).alias("side")).where("side > 1")
    sides = scratch.save(sides, f"{name}-sides")  # few: at most a row for each GROUP_PAIRS pairs
    if sides.count() <= BROADCAST_KEYS:
        sides = F.broadcast(sides)
    part = lambda c: F.pmod(F.xxhash64(c, F.lit("part")), F.col("side"))
    shared = F.xxhash64(F.pmod(F.xxhash64("key", F.lit("group")), F.lit(1 + total // GROUP_PAIRS)))
    group = F.when(F.col("side") > 1, F.xxhash64("key", part("a"), part("b"))).otherwise(shared)
    dealt = scratch.save(keyed.join(sides, "key", "left").select("a", "b", group.alias("g")), f"{name}-dealt")
    side = lambda c: dealt.select(F.col("g").alias("h"), F.col(c).alias("name"))
    sent = side("a").unionByName(side("b")).distinct().join(sets, "name").select("h", "name", "found")

    def verify(pairs_: pa.Table, sets_: pa.Table) -> pa.Table:
        known = dict(zip(sets_["name"].to_pylist(), unpack(sets_["found"].to_pylist())))
        kept, up = [], {n: n for n in known}

        def root(n: int) -> int:
            while up[n] != n:
                up[n] = n = up[up[n]]
            return n

        for a, b in sorted(zip(pairs_["a"].to_pylist(), pairs_["b"].to_pylist())):
            if (i := root(a)) == (j := root(b)):
                continue  # joined by other links: one more tells nothing
            x, y = known[a], known[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            shared = _shared(x, y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                kept.append((a, b))
                up[i] = j
        return pa.table({"a": pa.array([k[0] for k in kept], pa.int64()), "b": pa.array([k[1] for k in kept], pa.int64())})

    linked = dealt.groupBy("g").cogroup(sent.groupBy("h")).applyInArrow(verify, "a long, b long")
    return scratch.save(linked, f"{name}-linked")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two runs are merged
    return int(np.count_nonzero(both[1:] == both[:-1]))


def crowd_edges(found: DataFrame) -> DataFrame:
    """a, b: the first row of each crowded column with each other row, once."""

    def once(table: pa.Table) -> pa.Table:
        names = np.unique(np.frombuffer(b"".join(table["names"].to_pylist()), np.int64))
        return pa.table({"a": pa.array(np.full(len(names), table["a"][0].as_py()), pa.int64()), "b": pa.array(names, pa.int64())})

    return found.where("kind = 1").select("a", "part", "names").groupBy("a", "part").applyInArrow(once, "a long, b long").where("a <> b")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two lists of sets: a matrix product, block of columns by block of columns."""
    sets = [*x, *y]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1])))
    shared = np.bincount(column) > 1
    column, row = (np.cumsum(shared) - 1)[column][shared[column]], row[shared[column]]
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, int(shared.sum()), 2048):
        here = slice(*np.searchsorted(column, [low, low + 2048]))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[here], column[here] - low] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out.astype(np.int64)


def _linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    shared = _overlaps(x, y)
    both = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - shared
    return 100 * shared >= percent * both


def _sets_of(table: pa.Table, unpack) -> tuple[list[int], list[np.ndarray]]:
    return table["name"].to_pylist(), unpack(table["found"].to_pylist())


#: Rows, and members of their sets, that a part of a crowd holds, about.
_CROWD_ROWS, _CROWD_SHINGLES = 512, 1_500_000


def _suited(crowd: DataFrame, crowds: Crowds, scratch: Scratch, percent: int) -> DataFrame:
    """node, comp, n (size) of the crowds' rows that some other row's size suits."""
    columns, sets_of = crowds.columns, crowds.sets_of

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, all_known, n_blocks = columns.value
        for batch in batches:
            found = sets_of(batch)
            n = np.array([len(f) for f in found], np.int64)
            shared = n
            if all_known and len(found):
                late = last.has(_split(np.concatenate(found), n_blocks))
                shared = np.add.reduceat(np.append(late, False).astype(np.int64), np.cumsum(n) - n) * (n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), pa.array(n), pa.array(shared * (100 + percent) // percent - n)], ["node", "comp", "n", "most"])

    rows = crowd.join(crowds.source, F.col("node") == F.col("name")).mapInArrow(measure, "node long, comp long, n long, most long")
    rows = scratch.save(rows, "crowd-sizes")
    for _ in range(2):
        limits = rows.groupBy("comp").agg(F.min("n").alias("lo"), F.max("most").alias("hi"))
        rows = rows.join(limits, "comp").where("most >= lo AND n <= hi").drop("lo", "hi")
    return scratch.save(rows.select("node", "comp", "n"), "crowd-suited")


def _crowd_components(crowds: Crowds, sets: DataFrame, links: DataFrame, scratch: Scratch, percent: int, unpack=unpacked) -> DataFrame:
    """Components of the links and of what is linked within crowds (components of their edges).

    Each part of a crowd is multiplied with itself and with a few rows that all parts get; what is then not in the
    crowd's main component is multiplied with every part. So each pair of rows in different components has been
    looked at, and only links that join components are given."""
    crowd = scratch.save(components(crowds.edges, scratch, "crowd-edges"), "crowd-nodes")
    crowd = _suited(crowd, crowds, scratch, percent)
    parts = crowd.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / float(_CROWD_ROWS), F.sum("n") / float(_CROWD_SHINGLES))).alias("parts"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    dealt = crowd.join(parts, "comp").select("node", "comp", "parts", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).alias("part"))
    dealt = scratch.save(dealt, "crowd-dealt")
    common = dealt.where("parts > 1").groupBy("comp", "parts", F.pmod(F.xxhash64("node", F.lit("common")), F.lit(8)).alias("k")).agg(F.min("node").alias("node"))
    common = common.select("node", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    sent = dealt.select("node", "comp", "part").unionByName(common).distinct().join(sets, F.col("node") == F.col("name")).select("comp", "part", "name", "found")

    def within(table: pa.Table) -> pa.Table:
        names, own = _sets_of(table, unpack)
        near = _linked(own, own, percent)
        label = np.arange(len(own))
        while True:
            new = np.where(near, label, len(own)).min(1)
            new = np.minimum(new, label)
            new = new[new]
            if (new == label).all():
                break
            label = new
        joined = np.flatnonzero(label != np.arange(len(own)))
        names = np.array(names, np.int64)
        return pa.table({"a": pa.array(names[joined]), "b": pa.array(names[label[joined]])})

    first = scratch.save(sent.groupBy("comp", "part").applyInArrow(within, "a long, b long").unionByName(links), "crowd-first")
    known = scratch.save(components(first, scratch, "crowd-known"), "crowd-comps").select("node", F.col("comp").alias("label"))
    placed = scratch.save(dealt.where("parts > 1").join(known, "node", "left").select("node", "comp", "part", "parts", F.coalesce("label", "node").alias("label")), "crowd-placed")
    main = placed.groupBy("comp", "label").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    rest = placed.join(main.select("comp", "main"), "comp").where("label <> main").drop("main")
    turns = rest.groupBy("comp").agg(F.ceil(F.count("*") / float(_CROWD_ROWS)).alias("turns"))
    rest = rest.join(turns, "comp").withColumn("turn", F.pmod(F.xxhash64("node", F.lit("turn")), F.col("turns")))
    keys = ["comp", "turn", "part"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.select("node", "label", "comp", "turn", each("parts").alias("part"))
    right = placed.join(turns, "comp").select("node", "label", "comp", "part", each("turns").alias("turn"))
    # A few bytes of a file hold many of these rows (a node stands with every part), so Spark, which goes by the file's size,
    # would broadcast them through the driver.
    with_sets = lambda x, y: x.hint("merge").join(sets, F.col("node") == F.col("name")).select(*[F.col(k).alias(f"{y}{k}") for k in keys], F.col("name").alias("name"), "label", F.col("found").alias("found"))

    def across(x_: pa.Table, y_: pa.Table) -> pa.Table:
        (xn, x), (yn, y) = _sets_of(x_, unpack), _sets_of(y_, unpack)
        out: list[tuple[int, int]] = []
        if x and y:
            a, b = x_["label"].to_numpy(), y_["label"].to_numpy()
            i, j = np.nonzero(_linked(x, y, percent) & (a[:, None] != b))
            _, one = np.unique(np.stack((a[i], b[j])), axis=1, return_index=True)
            out = [(xn[i[k]], yn[j[k]]) for k in one.tolist()]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    left = scratch.save(left, "crowd-left")
    right = scratch.save(right, "crowd-right")
    grouped = lambda x, y: with_sets(x, y).groupBy(*[f"{y}{k}" for k in keys])
    second = grouped(left, "x_").cogroup(grouped(right, "y_")).applyInArrow(across, "a long, b long")
    second = scratch.save(second, "crowd-second")
    if second.isEmpty():
        return scratch.spark.read.parquet(f"{scratch.root}/crowd-comps")
    return components(first.unionByName(second), scratch, "links")


def ends(*edges: DataFrame, both: bool = False) -> DataFrame:
    """name: all that the edges (a, b) have; with `both`, name and other, in both directions."""
    out = None
    for e in edges:
        one, two = (e.select(F.col(x).alias("name"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a")))
        out = one.unionByName(two) if out is None else out.unionByName(one).unionByName(two)
    return out if both else out.select("name").distinct()


def resolve(pairs: DataFrame, crowds: Crowds | None, sets: DataFrame, scratch: Scratch, percent: int, unpack=unpacked) -> DataFrame:
    """node, comp: components of the links among candidate pairs (a, b) and within crowds.
    sets: name, found, a row each; `unpack` makes sets of a list of what is found."""
    links = _verified(pairs, sets, scratch, "pairs", percent, unpack)
    crowded = crowds is not None and not crowds.edges.isEmpty()
    found = _crowd_components(crowds, sets, links, scratch, percent, unpack) if crowded else components(links, scratch, "links")
    return scratch.save(found, "comps")


def jaccard_components(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 75,
    crowd: int = CROWD,
    most_crowded: int = MOST_CROWDED,
) -> DataFrame:
    """key, n_shingles, component_id: the least key reachable by links of `percent` percent Jaccard similarity. Besides,
    text_hash (Spark's xxhash64 of the text) and stays: the row is what its component is known by, the one with the least key,
    and among texts of that key with the least hash. Repeated rows stay or go together; so do those without a set, which
    stay."""
    scratch = Scratch(spark, "near-duplicates")
    rows = docs.select(integer_key(docs, key).alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
    texts = rows.select("__text")
    n_blocks = block_count(text_bytes(texts, "__text"))
    pairs, edges, crowded = exact_candidates(texts, lambda batches: _distinct_sets(batches, width), scratch, n_blocks, percent, crowd, most_crowded)
    wanted = spark.sparkContext.broadcast((_bit_map(ends(pairs, edges), "name"),))
    sets_table = scratch.save(_with_sets(rows, wanted, width), "sets")
    # A name may have several equal rows: one is taken, as rows meet for the joins.
    sets = sets_table.where("found IS NOT NULL").select("name", "found").dropDuplicates(["name"])
    crowds = Crowds(edges, crowded, sets, lambda batch: unpacked(batch.column("found").to_pylist()))
    comps = resolve(pairs, crowds, sets, scratch, percent)

    row = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__hash").alias("hash"))
    least = sets_table.where("size > 0").groupBy("name").agg(F.min(row).alias("least"))
    placed = scratch.save(least.join(comps, least["name"] == comps["node"], "left").select("name", "least", F.coalesce("comp", "name").alias("comp")), "placed")
    final = placed.join(placed.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("name", "component")
    every = sets_table.select("__key", "__hash", "size", "name").join(final, "name", "left")
    component = F.when(F.col("size") > 0, F.coalesce("component.key", "__key")).otherwise(F.col("__key"))
    stays = (F.col("size") == 0) | (F.col("__key").eqNullSafe(F.col("component.key")) & (F.col("__hash") == F.col("component.hash")))
    return every.select(F.col("__key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("__hash").alias("text_hash"), F.coalesce(stays, F.lit(True)).alias("stays"))


def _with_sets(rows: DataFrame, wanted, width: int) -> DataFrame:
    """__key, __hash, size, name, and the set itself where it may be needed, once a task."""
    named = "__key long, __hash long, size long, name long, found binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value[0], set()
        power = len(bits).bit_length() - 1 + 6
        for block in blocks(batches, "__text", 1_000_000):
            sets = shingle_sets(block.column("__text"), width)
            names = np.array([set_name(s) if len(s) else 0 for s in sets], np.int64)
            place = (names.astype(np.uint64) >> _U(64 - power)).astype(np.int64)
            hit = (bits[place >> 6] >> (place & 63)) & 1
            found = []
            for s, name, h in zip(sets, names.tolist(), hit.tolist()):
                if h and len(s) and name not in seen:
                    seen.add(name)
                    found.append(s.tobytes())
                else:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([block.column("__key"), block.column("__hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names), pa.array(found, pa.binary())], ["__key", "__hash", "size", "name", "found"])

    return rows.mapInArrow(run, named)
