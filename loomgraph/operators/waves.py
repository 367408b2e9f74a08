"""Walks from many nodes at once, in which each node has a row of cells (registers, bits of sources) and takes in those of
its neighbours.

Nodes are numbered; those of `SIDE` numbers are a block, and a block's cells, cut into slices of `WIDTH` bytes a node, are
one value. A round deals to each task one slice of a bucket of nodes: the slice's own cells there, of every block those
that the last round changed, and the links into the bucket, packed. The rows arrive in the order of the blocks, so that a
task holds its bucket's slice and one block, and what is shuffled a round is the links once a slice and the changed cells
once a bucket, not a row a link."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, dropped

#: Nodes of a block, bytes of a node's slice at most, bytes of a bucket's slice, links in a row.
SIDE, WIDTH, BUCKET_BYTES, PACKED = 2048, 512, 128_000_000, 300_000
#: Tasks of a round at least, rows that go to Python together, links that are met together.
TASKS, TOGETHER, CHUNK = 16, 8, 1 << 16

_STATE = "b int, s int, own binary, fresh binary, tally binary"


@dataclass(frozen=True)
class Kind:
    """How cells meet (a ufunc of two rows), their type, how many a slice of a node has, and what a node does with those it
    got: (own, got) -> own, fresh (those to send on, 0 where nothing changed), a tally of the node (float64 columns). What
    a node keeps (own) are cells too, unless `kept` has their type and number."""

    meet: np.ufunc
    cell: type
    cells: int
    slices: int
    turn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    kept: tuple[type, int] | None = None

    def rows(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, self.cell).reshape(-1, self.cells)

    def kept_rows(self, value: bytes) -> np.ndarray:
        cell, n = self.kept or (self.cell, self.cells)
        return np.frombuffer(value, cell).reshape(-1, n)

    def nothing(self, n: int) -> np.ndarray:
        cell, k = self.kept or (self.cell, self.cells)
        return np.zeros((n, k), cell)


def _packed(links: DataFrame, blocks_a_bucket: int, tasks: int) -> DataFrame:
    """b, j, src, dst: links (a, b: numbers) of a block into a bucket, the end as a place in the bucket, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, None

        def flush() -> pa.RecordBatch:
            src, dst = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([src.astype(np.uint16).tobytes()], pa.binary()), pa.array([dst.astype(np.int32).tobytes()], pa.binary())], ["b", "j", "src", "dst"])

        for batch in batches:
            b, j, src, dst = (batch.column(k).to_numpy() for k in range(4))
            cuts = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (j[1:] != j[:-1])))) if len(b) else np.empty(0, int)
            for at, to in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                here = (int(b[at]), int(j[at]))
                if held and (here != key or n >= PACKED):
                    yield flush()
                    held, n = [], 0
                key = here
                held.append((src[at:to].copy(), dst[at:to].copy()))
                n += to - at
        if held:
            yield flush()

    block = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    bucket = F.floor(block("b") / blocks_a_bucket).cast("int")
    dealt = links.select(block("a").alias("b"), bucket.alias("j"), (F.col("a") % SIDE).cast("int").alias("src"), (F.col("b") - bucket.cast("long") * blocks_a_bucket * SIDE).cast("int").alias("dst"))
    return dealt.repartition(tasks, "b", "j").sortWithinPartitions("b", "j", "dst").mapInArrow(run, "b int, j int, src binary, dst binary")


def _meet(kind: Kind, held: np.ndarray, fresh: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
    """Takes the fresh cells of a block in along its links, which are in the order of their ends."""
    going = fresh.any(1)[src]
    src, dst = src[going], dst[going]
    step = max(1024, CHUNK * 512 // (fresh.itemsize * fresh.shape[1]))
    for low in range(0, len(src), step):
        here, to = src[low : low + step], dst[low : low + step]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        size = np.diff(np.append(first, len(to)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        # The ends' first links, then their second ones, and so on; what few ends have many of, end by end. (`reduceat` over
        # rows takes ten times as long.)
        k, many = 0, len(first)
        while many >= 16:
            at = first[:many] + k
            ends = to[at]
            held[ends] = kind.meet(held[ends], fresh[here[at]])
            k += 1
            many = int(np.searchsorted(-size, -k, side="left"))
        for at, n in zip(first[:many].tolist(), size[:many].tolist()):
            held[to[at]] = kind.meet(held[to[at]], kind.meet.reduce(fresh[here[at + k : at + n]], axis=0))


def _round(own_rows: DataFrame, fresh_rows: DataFrame, links: DataFrame, needed: DataFrame, kind: Kind, blocks_a_bucket: int, tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, held, sent = None, {}, None, (None, None)

        def finish() -> Iterator[pa.RecordBatch]:
            j, s = key
            for b in list(own):
                rows = kind.kept_rows(own.pop(b))
                at = (b - j * blocks_a_bucket) * SIDE
                got = held[at : at + len(rows)] if held is not None else np.zeros((len(rows), kind.cells), kind.cell)
                new, fresh, tally = kind.turn(rows, got)
                none = not fresh.any()
                values = [[b], [s], [new.tobytes()], [None if none else fresh.tobytes()], [np.ascontiguousarray(tally, np.float64).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["b", "s", "own", "fresh", "tally"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["j"], row["s"]) != key:
                    if key is not None:
                        yield from finish()
                    key, own, held, sent = (row["j"], row["s"]), {}, None, (None, None)
                if row["kind"] == 0:
                    own[row["b"]] = row["one"]
                elif row["kind"] == 1:
                    sent = (row["b"], kind.rows(row["one"]))
                elif sent[0] == row["b"]:
                    if held is None:
                        held = np.zeros((blocks_a_bucket * SIDE, kind.cells), kind.cell)
                    _meet(kind, held, sent[1], np.frombuffer(row["one"], np.uint16), np.frombuffer(row["two"], np.int32))
        if key is not None:
            yield from finish()

    none = F.lit(None).cast("binary")
    kept = own_rows.select(F.floor(F.col("b") / blocks_a_bucket).cast("int").alias("j"), "s", F.lit(0).alias("late"), "b", F.lit(0).alias("kind"), F.col("own").alias("one"), none.alias("two"))
    # A block goes to the buckets that it has links into, and links go with blocks that send something.
    sent = fresh_rows.where("fresh IS NOT NULL")
    fresh = sent.join(F.broadcast(needed), "b").select("j", "s", F.lit(1).alias("late"), "b", F.lit(1).alias("kind"), F.col("fresh").alias("one"), none.alias("two"))
    along = links.join(F.broadcast(sent.select("b", "s")), "b").select("j", "s", F.lit(1).alias("late"), "b", F.lit(2).alias("kind"), F.col("src").alias("one"), F.col("dst").alias("two"))
    rows = kept.unionByName(fresh).unionByName(along).repartition(tasks, "j", "s").sortWithinPartitions("j", "s", "late", "b", "kind")
    return rows.mapInArrow(run, _STATE)


class Walk:
    """Links packed once, for rounds over them. steps: a, b (ids). numbered: id, number (from 0 to n - 1)."""

    def __init__(self, steps: DataFrame, numbered: DataFrame, n: int, kind: Kind):
        buckets = max(1, -(-n * kind.cells * np.dtype(kind.cell).itemsize // BUCKET_BYTES), -(-TASKS // kind.slices))
        blocks = max(1, -(-n // SIDE))
        self.blocks_a_bucket = -(-blocks // buckets)
        self.tasks = 4 * -(-blocks // self.blocks_a_bucket) * kind.slices
        self.numbered = numbered
        at = lambda c: numbered.select(F.col("id").alias(c), F.col("number").alias(f"_{c}"))
        ends = steps.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        self.links = cut(_packed(ends, self.blocks_a_bucket, max(TASKS, blocks)))
        self.needed = cut(self.links.select("b", "j").distinct().coalesce(1))

    def start(self, extra: list[str], cells: Callable[[pa.Table, int], np.ndarray], kind: Kind, numbered: DataFrame | None = None) -> DataFrame:
        """b, s, own, fresh, tally of the start: `cells` makes those of a block's nodes in all slices from the columns
        `extra` of the numbered nodes (those given, where a walk starts several times)."""

        def first(table: pa.Table) -> pa.Table:
            table = table.sort_by("number")
            made = cells(table, len(table)).reshape(len(table), kind.slices, kind.cells)
            b, out = int(table["number"][0].as_py()) // SIDE, {c: [] for c in ("b", "s", "own", "fresh", "tally")}
            for s in range(kind.slices):
                own, fresh, tally = kind.turn(kind.nothing(len(table)), np.ascontiguousarray(made[:, s]))
                for c, v in zip(out, (b, s, own.tobytes(), fresh.tobytes() if fresh.any() else None, np.ascontiguousarray(tally, np.float64).tobytes())):
                    out[c].append(v)
            return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))})

        given = (self.numbered if numbered is None else numbered).select(F.floor(F.col("number") / SIDE).cast("int").alias("b"), "number", *extra)
        return cut(given.groupBy("b").applyInArrow(first, _STATE))

    def round(self, own: DataFrame, fresh: DataFrame, kind: Kind) -> DataFrame:
        """The next b, s, own, fresh, tally of those rows that `own` (b, s, own) has, from what `fresh` (b, s, fresh) sends."""
        return cut(_round(own, fresh, self.links, self.needed, kind, self.blocks_a_bucket, self.tasks), TOGETHER)

    def close(self) -> None:
        dropped(self.links, self.needed)


def still(state: DataFrame) -> bool:
    """Does nothing go on from here?"""
    return state.where("fresh IS NOT NULL").isEmpty()


def rounds(steps: DataFrame, numbered: DataFrame, n: int, extra: list[str], start: Callable[[pa.Table, int], np.ndarray], kind: Kind) -> Iterator[DataFrame]:
    """Tables b, s, tally of a round each, the start first, until no cell changes; one goes when the next is asked for. steps: a, b (ids). numbered: id, number (from
    0 to n - 1) and the columns `extra`, from which `start` makes the cells of a block's nodes in all slices."""
    walk = Walk(steps, numbered, n, kind)
    state = walk.start(extra, start, kind)
    while True:
        yield state.select("b", "s", "tally")
        if still(state):
            dropped(state)
            walk.close()
            return
        held, state = state, walk.round(state, state, kind)
        dropped(held)


def at_sources(cell: type, cells: int, bits: bool) -> Callable[[pa.Table, int], np.ndarray]:
    """Cells that are 0 but for each source's own (or its bit), from the column `source` (its number, else null)."""

    def start(table: pa.Table, n: int) -> np.ndarray:
        made = np.zeros((n, cells), cell)
        given = table["source"].to_numpy()
        at = np.flatnonzero(~np.isnan(given.astype(float)))
        k = given[at].astype(np.int64)
        made[at, k // 64 if bits else k] = np.uint64(1) << (k % 64).astype(np.uint64) if bits else 1
        return made

    return start


def reached(sources: int) -> tuple[Kind, Callable[[int], Kind]]:
    """Which of so many sources have reached a node, in bits; the kind of the start and that of a round. A node keeps the
    bits, how many there are besides its own, the sum of their distances and (as a float) that of 1 / distance."""
    words = max(1, -(-sources // 64))
    slices = -(-words // (WIDTH // 8))
    words = -(-words // slices)

    def kind(hop: int) -> Kind:
        def turn(own: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            fresh = got & ~own[:, :words]
            new = own.copy()
            new[:, :words] |= fresh
            if hop:
                n = np.bitwise_count(fresh).sum(1, dtype=np.uint64)
                new[:, words] += n
                new[:, words + 1] += n * np.uint64(hop)
                new[:, words + 2].view(np.float64)[:] += n / hop
            return new, fresh, np.zeros((len(own), 0))

        return Kind(np.bitwise_or, np.uint64, words, slices, turn, (np.uint64, words + 3))

    return kind(0), kind


#: Sources of a slice whose paths are counted.
COUNTED = 128


def paths(sources: int) -> tuple[Kind, Kind]:
    """How many shortest paths lead from so many sources to a node: the kind that walks ahead, in which a node keeps which
    sources have reached it and sends the paths of those that just did; and the kind that goes back, in which a node of a
    level has its paths, gets (1 + dependency) / paths of the nodes that they lead on to, and tells its dependencies' sum."""
    cells = min(COUNTED, -(-max(1, sources) // 8) * 8)
    slices = -(-max(1, sources) // cells)

    def ahead(own: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = np.unpackbits(own, axis=1).view(bool)
        fresh = np.where(known, 0.0, got)
        return np.packbits(known | (fresh > 0), axis=1), fresh, np.zeros((len(own), 0))

    def back(own: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        delta = own * got
        return np.zeros((len(own), 0)), np.divide(1 + delta, own, out=np.zeros_like(own), where=own > 0), delta.sum(1, keepdims=True)

    return Kind(np.add, np.float64, cells, slices, ahead, (np.uint8, cells // 8)), Kind(np.add, np.float64, cells, slices, back)


def _registers(own: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grown = got > own
    new = np.where(grown, got, own)
    powers = np.ldexp(1.0, -np.arange(256))
    powers[0] = 0.0
    return new, np.where(grown, got, np.zeros_like(got)), np.stack((powers[new].sum(1), (new == 0).sum(1)), 1)


def registers(bits: int) -> Kind:
    """2 ** bits registers a node, the greater of two stays; the tally is what an estimate needs of a slice."""
    width = min(WIDTH, 1 << bits)
    return Kind(np.maximum, np.uint8, width, (1 << bits) // width, _registers)


def hashed(bits: int) -> Callable[[pa.Table, int], np.ndarray]:
    """Cells of nodes that hold only themselves, from the column `hash`."""

    def start(table: pa.Table, n: int) -> np.ndarray:
        h = table["hash"].to_numpy().astype(np.uint64)
        cells = np.zeros((n, 1 << bits), np.uint8)
        rest = (h << np.uint64(bits) | np.uint64(1 << bits - 1)).astype(np.uint64)
        zeros = 63 - np.floor(np.log2(rest.astype(np.longdouble))).astype(np.int64)
        cells[np.arange(n), (h >> np.uint64(64 - bits)).astype(np.int64)] = zeros + 1
        return cells

    return start


def estimates(tally: np.ndarray, bits: int) -> np.ndarray:
    """How many were put in, by sums of 2 ** -register over the registers that aren't 0, and the number of those that are
    (Ertl's estimator, without corrections by size)."""
    m = float(1 << bits)
    x = tally[:, 1] / m
    sigma, power, y = x.copy(), x.copy(), 1.0
    for _ in range(64):
        power = power * power
        sigma = sigma + power * y
        y *= 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x >= 1, 0.0, m * m / (2 * np.log(2)) / (tally[:, 0] + m * np.where(x >= 1, 1.0, sigma)))
