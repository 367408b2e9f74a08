"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a pseudo-random number u in (0, 1); a record goes to the shard with the largest
-weight / ln(u). The key and the shards alone decide, so one more shard takes records only into itself, each
shard's share is in proportion to its weight, and equal keys stay together. Built-in expressions only.

`slot` numbers the rows of a shard from 0 without gaps. No shard is sorted by one task: the rows of a shard are
dealt to sub-blocks of its keys, sub-blocks are numbered on their own, and running sums of their (few) counts
are added. Equal rows are counted before anything is shuffled by key, so a key that holds a third of all rows
travels as a count and is expanded at the end.

Cases: a null key is a key of its own; a null text has 0 bytes and checksum 0; rows equal in key, size and
checksum share a run of slots; an empty table gives an empty result; other columns are not carried. Under this
law the groups of equal texts may be parted, as their keys differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that a record needs beside its text.
OVERHEAD = 16
#: Rows that one sub-block of a shard holds, about.
BLOCK_ROWS = 50_000


def _unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on key and shard alone."""
    mixed = F.xxhash64(F.xxhash64(key, F.lit(shard)), F.lit(shard))
    return (F.shiftrightunsigned(mixed, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the best shard; ties go to the higher number."""
    scored = [F.struct((-F.lit(float(w)) / F.log(_unit(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights, first)]
    return scored[0] if len(scored) == 1 else F.greatest(*scored)


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", next_weight: float = 1.0) -> DataFrame:
    """key, size, text_crc32, shard, slot, and grown_shard: the shard once one more, of `next_weight`, is there."""
    rows = docs.select(
        F.col(key).alias("__key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("__key", "size", "text_crc32").agg(F.count("*").alias("__n"))
    best = counted.withColumn("__best", rendezvous(F.col("__key"), weights)).withColumn("__new", rendezvous(F.col("__key"), [next_weight], len(weights)))
    placed = best.select(
        "__key", "size", "text_crc32", "__n",
        F.col("__best.shard").alias("shard"),
        F.greatest("__best", "__new")["shard"].alias("grown_shard"),
    )
    n = docs.count()
    parts = max(1, -(-n // (BLOCK_ROWS * len(weights))), 512 // len(weights))
    placed = placed.withColumn("__part", F.pmod(F.xxhash64("__key", F.lit(-1)), F.lit(parts)))
    inner = Window.partitionBy("shard", "__part").orderBy("__key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("__end", F.sum("__n").over(inner))
    sums = placed.groupBy("shard", "__part").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    joined = numbered.join(offsets, ["shard", "__part"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    return joined.select(
        F.col("__key").alias(key), "size", "text_crc32", "shard", "grown_shard",
        (F.col("__before") + F.col("__end") - F.col("__n")).alias("__slot"), each.alias("__k"),
    ).select(key, "size", "text_crc32", "shard", (F.col("__slot") + F.col("__k")).alias("slot"), "grown_shard")
