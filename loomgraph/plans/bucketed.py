"""Tables written in buckets of a key, which joins on that key read without an exchange.

A loop that joins the same large table each round (links with ranks) shuffles it once, here; later rounds read its
buckets, and what is bucketed alike, side by side, and only messages are exchanged."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Rows of a bucket, about. A key with more rows is no bucket's.
ROWS_A_BUCKET = 2_000_000
#: Such keys at most: their values go to every task.
MOST_HEAVY = 100_000


def count_for(spark: SparkSession, rows: int) -> int:
    """Buckets for a table of so many rows: as many as a shuffle has partitions, more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_BUCKET))


class Buckets:
    """Tables with the same number of buckets, under a folder of the cluster's shared one. `close` lets go of them."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, {}
        self.root = f"{scratch.shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
        scratch._written.append((spark, self.root))

    def save(self, df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
        """The rows, dealt by the key's hash: a task writes whole buckets, one file each. dealt: they are already, as
        after a join with a bucketed table."""
        name = f"bucketed_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        rows = df if dealt else df.repartition(self.n, key)
        rows.write.format("parquet").bucketBy(self.n, key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.names[id(out)] = (out, name, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if held := self.names.pop(id(df), None):
                self.spark.sql(f"DROP TABLE IF EXISTS {held[1]}")
                scratch._delete(self.spark, held[2])

    def close(self) -> None:
        """The tables' names go; what is still read is to be copied before."""
        self.drop(*[held[0] for held in list(self.names.values())])


@dataclass(frozen=True)
class Arcs:
    """Links (id, t, ...) that values by id are sent along: in buckets of id, but for those of the few ids that have more
    links than a bucket should (`heavy`, of the ids `busy`), which stay dealt as they are."""

    light: DataFrame
    heavy: DataFrame | None = None
    busy: DataFrame | None = None

    def sent(self, state: DataFrame, message: Column) -> DataFrame:
        """id, got: what arrives at each node. state: by id, in the same buckets, so the join exchanges nothing; only
        messages, summed before, are. The values of heavy ids are broadcast: there are MOST_HEAVY at most."""
        out = self.light.join(state, "id").select(F.col("t").alias("id"), message.alias("got"))
        if self.heavy is not None:
            few = state.join(F.broadcast(self.busy), "id", "left_semi")
            out = out.unionByName(self.heavy.join(F.broadcast(few), "id").select(F.col("t").alias("id"), message.alias("got")))
        return out.groupBy("id").agg(F.sum("got").alias("got"))


def arcs(dealt: Buckets, links: DataFrame, rows: int, a_bucket: int | None = None) -> Arcs:
    """links: id, t and what messages need, `rows` of them."""
    most = max(a_bucket or ROWS_A_BUCKET, -(-rows // MOST_HEAVY))
    busy = scratch.cut(links.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("id"))
    if busy.isEmpty():
        return Arcs(dealt.save(links, "id"))
    light = dealt.save(links.join(F.broadcast(busy), "id", "left_anti"), "id")
    return Arcs(light, scratch.cut(links.join(F.broadcast(busy), "id", "left_semi")), busy)
