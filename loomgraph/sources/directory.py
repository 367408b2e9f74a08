"""A kept directory of a source's nodes: searches read the postings of what was typed, not the source.

The directory is two tables: ids in order, and for every part of one to three characters of the ids (in lower case) which
ids have it. Postings are partitioned by a hash of the part and sorted by part and id, so a search opens one partition and
of its files the row groups that have the part. A directory is known by a fingerprint of the source's files (paths, sizes,
times) and of the mapping: it is made once in the folder that the cluster shares, and found again by later sessions
there; a source that changes has another fingerprint. Sources that aren't files get one that ends with the program."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..model import Mapping
from ..plans import scratch

#: Characters of the longest parts, and partitions of the postings.
LONGEST, BINS = 3, 64


def parts(low: Column) -> Column:
    """The distinct parts of one to LONGEST characters of a text."""
    n = F.char_length(low)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(low, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, LONGEST + 1)]))


def _bin(part: Column) -> Column:
    return F.pmod(F.crc32(part.cast("binary")), F.lit(BINS)).cast("int")


def fingerprint(df: DataFrame, mapping: Mapping) -> str | None:
    """What the table's files, what is done to them, and the mapping come to; None for a table that isn't made of files
    alone."""
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    if any(leaves.apply(k).getClass().getSimpleName() != "LogicalRelation" for k in range(leaves.size())):
        return None
    spark, facts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        facts.append([name, status.getLen(), status.getModificationTime()])
    if not facts:
        return None
    return hashlib.sha256(json.dumps([facts, mapping.source, mapping.target, plan.canonicalized().toString()]).encode()).hexdigest()


class NodeDirectory:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.ids = spark.read.schema("id string").parquet(f"{root}/ids")
        self.postings = spark.read.schema("part string, id string, bin int").parquet(f"{root}/postings")

    @classmethod
    def of(cls, edges: DataFrame, mapping: Mapping, keep: bool = True) -> "NodeDirectory":
        """The directory of the edge rows' ends, made if it isn't there. keep: under the source's fingerprint."""
        spark = edges.sparkSession
        known = fingerprint(edges, mapping) if keep else None
        root = f"{scratch.shared_dir(spark)}/directory-{known or uuid.uuid4().hex}"
        if known is None:
            scratch._written.append((spark, root))
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/postings/_SUCCESS")
        if known is None or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            ends = F.array(cells.cell_id(edges, mapping.source), cells.cell_id(edges, mapping.target))
            ids = edges.select(F.explode(ends).alias("id")).where("id IS NOT NULL").distinct()
            ids.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{root}/ids")
            ids = spark.read.schema("id string").parquet(f"{root}/ids")
            posted = ids.select(F.explode(parts(F.lower("id"))).alias("part"), "id").withColumn("bin", _bin(F.col("part")))
            # Common parts are in many ids, so ids deal them too.
            dealt = posted.repartitionByRange("bin", "part", "id").sortWithinPartitions("bin", "part", "id")
            dealt.write.mode("overwrite").partitionBy("bin").parquet(f"{root}/postings")
        return cls(spark, root)

    def search(self, query: str, limit: int = 12) -> DataFrame:
        """id: those that begin with the text, in either case, then those that contain it, by id."""
        low = query.lower()
        if not low:
            return self.ids.orderBy("id").limit(limit)
        size = min(len(low), LONGEST)
        wanted = sorted({low[k : k + size] for k in range(len(low) - size + 1)})
        wanted = wanted[:: max(1, len(wanted) // 3)][:3]  # others are tested on the ids that are left
        bins = [bin_of(p) for p in wanted]
        found = None
        for part, one in zip(wanted, bins):
            posted = self.postings.where((F.col("bin") == one) & (F.col("part") == part)).select("id")
            found = posted if found is None else found.join(posted, "id", "left_semi")
        name = F.lower("id")
        hits = found.where(F.contains(name, F.lit(low))) if len(low) > size else found
        return hits.orderBy(F.desc(F.startswith(name, F.lit(low))), "id").limit(limit).select("id")

    def lookup(self, ids: list[str]) -> DataFrame:
        """id: which of the ids are there, in the order asked."""
        asked = [(k, i.strip()) for k, i in enumerate(dict.fromkeys(ids)) if i.strip()]
        wanted = self.spark.createDataFrame(asked, "place int, id string")
        if len(asked) <= 100:
            found = self.ids.where(F.col("id").isin([i for _, i in asked]))  # the scan skips row groups without any
        else:
            found = self.ids.join(wanted.select("id"), "id", "left_semi")
        return wanted.join(found, "id", "left_semi").orderBy("place").select("id")

    def count(self) -> int:
        return self.ids.count()


def bin_of(part: str) -> int:
    """The partition of a part, as `_bin` has it."""
    return zlib.crc32(part.encode()) % BINS
