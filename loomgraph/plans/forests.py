"""Distributed union-find: connected components by alternating large-star and small-star steps.

Edges stay in tables of the shared folder. They are first read by tasks of at most `HELD` edges, and each joins what it
holds by a union-find of its own, so that what is shuffled is a forest; edges that one such task holds are done by that.
Otherwise a step groups by node (minimum, combined before the shuffle) and joins it back, so a hub's edges are dealt to
many tasks by the engine's skew handling; the steps end when the edges are stars, or few enough for one task. The way
doesn't change the result: a component's label is its least node. One number a step reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that a task joins at a time (16 MB).
HELD = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and of each the least node reachable."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        nodes, label = least_labels(*(np.concatenate(x) for x in zip(*held)))
        own = nodes != label
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(label[own])], ["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def forest(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """a, b: fewer edges (b the lesser) with the components of the edges (long a and b, in any order). With `tasks`
    these read the edges' files side by side, without a shuffle."""
    edges = edges.select("a", "b")
    dealt = edges if tasks is None else edges.coalesce(tasks)
    return dealt.where("a <> b").mapInArrow(_joined, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (large) or the smaller-or-equal (small) neighbours of each node on its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        near = both
    else:
        near = both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Does every node either hang on one other or have others hang on it?"""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    per = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return per.where("up > 1 OR (up = 1 AND n > 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp for every node of the edges (a, b): comp is the least node reachable."""
    n = edges.count()
    now, k = scratch.save(forest(edges, max(1, -(-n // HELD))), f"{name}-0"), 0
    while n > HELD and not _are_stars(now):
        k += 1
        n = now.count()
        step = forest(now, 1) if n <= HELD else forest(_star(_star(now, True), False)).distinct()
        now = scratch.save(step, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
