"""Communities by modularity, and how stable they are.

Greedy moves depend on the order of visits, so the exact method runs in one task over the graph's distinct pairs, as
arrays of numbers without ids, whatever their number. Only where `most_pairs` asks for it, graphs of more pairs get
distributed label spreading, which is another method and is named so in the result. Runs in other orders, which tell the stability, are
tasks of their own."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bucketed import Buckets, arcs, count_for
from ..plans.scratch import cut
from .graph import undirected
from .metrics import ranked

#: Distinct pairs up to which stability is told: its runs are several times the exact method's arrays.
MOST_STABLE_PAIRS = 12_000_000
#: Nodes whose labels are sent to every task in a round of label spreading; more are joined by shuffling.
MOST_TOLD = 4_000_000
#: Runs in other orders, and the tasks that they are dealt to, each of which holds the arrays of one run at a time.
RUNS, RUN_TASKS = 8, 3
_LEAST_GAIN = 1e-12


class _Links:
    """Neighbours of n nodes in flat arrays: those of v are to[start[v]:start[v + 1]], in the order in which they came
    first, with the sums of their weights."""

    def __init__(self, n: int, v: np.ndarray, u: np.ndarray, w: np.ndarray):
        key = v.astype(np.int64) * n + u
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool))
        if len(fresh) < len(key):
            # bincount adds in the order of coming, as one weight after the other would.
            w = np.bincount(np.repeat(np.arange(len(fresh)), np.diff(np.r_[fresh, len(key)])), w[order], len(fresh))
        else:
            w = w[order]
        first = order[fresh]
        del key, order, fresh
        came = np.lexsort((first, v[first]))
        first = first[came]
        self.w = array("d", w[came].tobytes())
        self.to = array("i", u[first].astype(np.int32).tobytes())
        self.start = array("q", np.r_[0, np.cumsum(np.bincount(v[first], minlength=n))].astype(np.int64).tobytes())

    def __len__(self) -> int:
        return len(self.start) - 1


def _one_level(near: _Links, loops: Sequence[float], order: Sequence[int], resolution: float, sweeps: int = 50) -> array:
    """Moves nodes between communities, in order, while modularity rises."""
    n, start, to, ws = len(near), near.start, near.to, near.w
    strength = array("d", (sum(ws[start[v] : start[v + 1]]) + 2 * loops[v] for v in range(n)))
    total = sum(strength)
    own, weight = array("i", range(n)), strength[:]
    if not total:
        return own
    for _ in range(sweeps):
        moved = False
        for v in order:
            ties: dict[int, float] = {}
            for k in range(start[v], start[v + 1]):
                c = own[to[k]]
                ties[c] = ties.get(c, 0.0) + ws[k]
            here = own[v]
            weight[here] -= strength[v]
            pull = resolution * strength[v]
            best, most = here, ties.get(here, 0.0) - pull * weight[here] / total
            for c, tie in ties.items():
                if (value := tie - pull * weight[c] / total) > most + _LEAST_GAIN:
                    best, most = c, value
            own[v] = best
            weight[best] += strength[v]
            moved |= best != here
        if not moved:
            break
    return own


def _named(own: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 in the order in which the names come first, and how many there are."""
    _, first, flat = np.unique(own, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[flat], len(first)


def _merged(near: _Links, loops: np.ndarray, own: np.ndarray, n: int) -> tuple[_Links, np.ndarray]:
    """Communities as nodes (own: their numbers, n of them). Sums go along the nodes and their neighbours."""
    count = np.diff(np.frombuffer(near.start, np.int64))
    a, b, w = np.repeat(own, count), own[np.frombuffer(near.to, np.int32)], np.frombuffer(near.w, np.float64)
    same = a == b
    before = np.r_[0, np.cumsum(same)][np.frombuffer(near.start, np.int64)[:-1]]
    inner = np.bincount(np.insert(a[same], before, own), np.insert(w[same] / 2, before, loops), n)
    apart = ~same
    return _Links(n, a[apart], b[apart], w[apart]), inner


def _labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, order: Sequence[int] | None = None) -> np.ndarray:
    near = _Links(n, np.column_stack((a, b)).ravel(), np.column_stack((b, a)).ravel(), np.repeat(w, 2))
    loops, member, visit = np.zeros(n), np.arange(n, dtype=np.int32), range(n) if order is None else order
    while True:
        own, k = _named(np.frombuffer(_one_level(near, array("d", loops.tobytes()), visit, resolution), np.int32))
        if k == len(near):
            break
        member = own[member]
        near, loops = _merged(near, loops, own, k)
        visit = range(k)
    # `member` is in the order of the first nodes: of equal sizes the lesser number comes first.
    member, k = _named(member)
    rank = np.empty(k, np.int32)
    rank[np.argsort(-np.bincount(member, minlength=k), kind="stable")] = np.arange(k)
    return rank[member]


def _columns(pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([p[k] for p in pairs], kind) for k, kind in enumerate((np.int32, np.int32, np.float64)))


def louvain_labels(n: int, pairs: list[tuple[int, int, float]], resolution: float = 1.0, order: list[int] | None = None) -> list[int]:
    """A community number for each of n nodes: 0 is the largest, ties by the first node."""
    return _labels(n, *_columns(pairs), resolution, order).tolist() if n else []


def modularity(n: int, pairs: list[tuple[int, int, float]], labels: list[int], resolution: float = 1.0) -> float:
    strength, inside, total = [0.0] * n, 0.0, 0.0
    for a, b, w in pairs:
        strength[a] += w
        strength[b] += w
        total += w
        inside += w if labels[a] == labels[b] else 0.0
    if not total:
        return 0.0
    per: dict[int, float] = defaultdict(float)
    for v in range(n):
        per[labels[v]] += strength[v]
    return inside / total - resolution * sum(x * x for x in per.values()) / (4 * total * total)


def _permutation(n: int, run: int) -> array:
    """The order of visits of a run, by a fixed linear congruential generator that goes on from run to run."""
    state, steps, by, plus = 0x9E3779B9, run * max(0, n - 1), 1664525, 1013904223
    while steps:  # the generator's step, doubled
        if steps & 1:
            state = (state * by + plus) % (1 << 32)
        by, plus, steps = by * by % (1 << 32), plus * (by + 1) % (1 << 32), steps >> 1
    order = array("i", range(n))
    for k in range(n - 1, 0, -1):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        j = state % (k + 1)
        order[k], order[j] = order[j], order[k]
    return order


def _agreeing(base: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which nodes the community of `other` that matches theirs has: matches go by the most nodes, then by number."""
    width = int(other.max()) + 1
    both, n = np.unique(base.astype(np.int64) * width + other, return_counts=True)
    match, taken = np.full(int(base.max()) + 1, -1, np.int64), np.zeros(width, bool)
    for k in np.argsort(-n, kind="stable"):
        a, b = divmod(int(both[k]), width)
        if match[a] < 0 and not taken[b]:
            match[a], taken[b] = b, True
    return match[base] == other


def stability(n: int, pairs: list[tuple[int, int, float]], base: list[int], resolution: float = 1.0, runs: int = RUNS) -> list[float]:
    """For each node, the share of runs in other orders whose matching community still has it."""
    if not n:
        return []
    held, at = _columns(pairs), np.array(base)
    return (sum(_agreeing(at, _labels(n, *held, resolution, _permutation(n, k))).astype(int) for k in range(runs)) / runs).tolist()


def communities(nodes: DataFrame, links: DataFrame, resolution: float = 1.0, stable: bool = False, most_pairs: int | None = None) -> DataFrame:
    """id, community (text), stability (null unless asked for), modularity, method: the exact one, unless there are more
    than `most_pairs`, where that is given."""
    near = undirected(links).where("v < n")
    ranks = ranked(nodes)
    pairs = cut(near.join(ranks.select(F.col("id").alias("v"), F.col("rank").alias("a")), "v").join(ranks.select(F.col("id").alias("n"), F.col("rank").alias("b")), "n").select("a", "b", "w"))
    most_pairs = MOST_STABLE_PAIRS if stable and most_pairs is None else most_pairs
    if most_pairs is not None and pairs.count() > most_pairs:
        if stable:
            raise ValueError(f"stability needs the exact method, which takes up to {most_pairs} pairs")
        return _spread(ranks, pairs, resolution)
    n = ranks.count()
    held = pairs.select(F.least("a", "b").cast("int").alias("a"), F.greatest("a", "b").cast("int").alias("b"), "w")

    def sorted_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Neighbours in the order of their places: ties between equal gains go to the first.
        a, b, w = (table[c].to_numpy() for c in ("a", "b", "w"))
        order = np.lexsort((w, b, a))
        return a[order], b[order], w[order]

    def base(table: pa.Table) -> pa.Table:
        return pa.table({"rank": pa.array(np.arange(n)), "label": pa.array(_labels(n, *sorted_pairs(table.filter(table["w"].is_valid())), resolution))})

    # A row without a pair, so that a graph without links has a group too.
    none = held.sparkSession.range(1).select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(None).cast("double").alias("w")) if n else held.limit(0)
    labels = cut(held.unionByName(none).groupBy(F.lit(0).alias("g")).applyInArrow(base, "rank long, label int"))
    out = ranks.join(labels, "rank")
    if stable:
        out = out.join(_stability(held.unionByName(none), labels, n, resolution, sorted_pairs), "rank")
    else:
        out = out.withColumn("stability", F.lit(None).cast("double"))
    told = out.crossJoin(F.broadcast(_modularity(pairs, labels, resolution, n)))
    return told.select("id", F.col("label").cast("string").alias("community"), "stability", F.coalesce("modularity", F.lit(0.0)).alias("modularity"), F.lit("louvain").alias("method"))


def _stability(held: DataFrame, labels: DataFrame, n: int, resolution: float, sorted_pairs) -> DataFrame:
    """rank, stability: runs in other orders, a few a task. Each task gets the pairs and the labels, without ids."""
    tasks = F.explode(F.sequence(F.lit(0), F.lit(RUN_TASKS - 1))).alias("task")
    rows = held.select("a", "b", "w", F.lit(None).cast("int").alias("label")).unionByName(labels.select(F.col("rank").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(None).cast("double").alias("w"), "label"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        named = table.filter(table["label"].is_valid())
        at = np.empty(n, np.int32)
        at[named["a"].to_numpy()] = named["label"].to_numpy()
        pairs = sorted_pairs(table.filter(table["w"].is_valid()))
        del table, named
        agree = np.zeros(n, np.int32)
        for k in range(key[0].as_py(), RUNS, RUN_TASKS):
            agree += _agreeing(at, _labels(n, *pairs, resolution, _permutation(n, k)))
        return pa.table({"rank": pa.array(np.arange(n)), "agree": pa.array(agree)})

    agreed = rows.select("*", tasks).groupBy("task").applyInArrow(run, "rank long, agree int")
    return cut(agreed.groupBy("rank").agg((F.sum("agree") / RUNS).alias("stability")))


def _modularity(pairs: DataFrame, labels: DataFrame, resolution: float, n: int | None = None) -> DataFrame:
    """One row: modularity of labels (rank, label) over pairs (a, b, w). n: how many labels, where that is known."""
    named = _told(labels, n) if n is not None else labels
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rank"), "w").groupBy("rank").agg(F.sum("w").alias("strength"))
    per = ends.join(labels, "rank").groupBy("label").agg(F.sum("strength").alias("x")).agg(F.sum(F.col("x") ** 2).alias("squares"))
    both = pairs.join(named.select(F.col("rank").alias("a"), F.col("label").alias("la")), "a").join(named.select(F.col("rank").alias("b"), F.col("label").alias("lb")), "b")
    inside = both.agg(F.sum("w").alias("total"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    value = F.col("inside") / F.col("total") - resolution * F.col("squares") / (4 * F.col("total") ** 2)
    return inside.crossJoin(per).select(F.when(F.col("total") > 0, value).otherwise(0.0).alias("modularity"))


def _told(labels: DataFrame, n: int) -> DataFrame:
    """Labels for a join with links: to every task, while they are few."""
    return F.broadcast(labels) if n <= MOST_TOLD else labels


def _spread(ranks: DataFrame, pairs: DataFrame, resolution: float = 1.0, rounds: int = 100) -> DataFrame:
    """Label spreading: the label with the most weight among neighbours, ties to the smaller, until no node would take
    another. If that isn't so after `rounds` rounds, the method says so. The resolution only counts in the modularity.

    Links lie in buckets of the node that is told, which has its votes counted where they lie: a round exchanges labels
    only, not votes. The votes of nodes that don't move in a round are counted only when none that may does."""
    spark, links = ranks.sparkSession, pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    n, n_links = ranks.count(), 2 * pairs.count()
    dealt = Buckets(spark, count_for(spark, n_links))
    near = arcs(dealt, links.select(F.col("a").alias("id"), F.col("b").alias("t"), "w"), n_links)
    state = dealt.save(ranks.select("rank", F.col("rank").alias("label")), "rank")
    parts = [near.light] if near.heavy is None else [near.light, near.heavy]

    def wished(who: Callable[[Column], Column]) -> DataFrame:
        """rank, label and the label that each node would take (wish); of those that `who` (of rank) is true for."""
        labels, won = _told(state.select(F.col("rank").alias("t"), "label"), n), []
        for part in parts:
            votes = part.where(who(F.col("id"))).join(labels, "t").groupBy("id", "label").agg(F.sum("w").alias("w"))
            won.append(votes.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new")))
        both = won[0] if len(won) == 1 else won[0].unionByName(won[1])
        return state.join(both, state["rank"] == both["id"], "left").select("rank", "label", F.coalesce("new", "label").alias("wish"))

    settled = False
    for k in range(rounds):
        # Half of the nodes move in a round, so that two don't swap for ever.
        moves = lambda rank, k=k: F.pmod(F.xxhash64(rank, F.lit(k)), F.lit(2)) == 0
        new = dealt.save(wished(moves).select("rank", F.col("wish").alias("label"), (F.col("wish") != F.col("label")).alias("open")), "rank", near.heavy is None)
        # The rest's votes are of the labels before the round, which are those after it if nothing moved.
        still = new.where("open").isEmpty()
        if settled := still and wished(lambda rank: ~moves(rank)).where("wish <> label").isEmpty():
            break
        dealt.drop(state)
        state = new
    labels = cut(state.select("rank", "label"))
    dealt.close()
    told = ranks.join(labels, "rank").crossJoin(F.broadcast(_modularity(pairs, labels, resolution, n)))
    return told.select("id", F.col("label").cast("string").alias("community"), F.lit(None).cast("double").alias("stability"), "modularity", F.lit("label spreading" if settled else "label spreading, not settled").alias("method"))
