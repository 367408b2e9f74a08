"""Statistics of a source's columns, kept by file and merged: files that come to a source cost their own scan only.

For each file and column a row is kept: rows, filled cells, numbers with their extent and sum, a sketch of the distinct
keys and one of the numbers' quantiles. Sketches of files merge into those of the source (distinct counts within about
2 percent, quantiles within about 1 percent of the ranks). The table lies in a folder of the user's or in the cluster's
shared one; a file is known by path, size and time, so a rewritten file is read anew and a removed one is left out."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..plans import scratch

#: Registers of distinct sketches, as a power of two, and the size of quantile sketches.
DISTINCT_BITS, QUANTILE_SIZE = 12, 400

_KEPT = "file string, stamp string, column_name string, n_rows long, filled long, numbers long, low double, high double, total double, keys binary, ranks binary"


class FileStatistics:
    """Statistics of Parquet files. folder: where they are kept; None for one under the shared folder, by the path."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str] | None = None, folder: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = list(columns or spark.read.parquet(path).columns)
        name = hashlib.sha256("\n".join([self.path, *self.columns]).encode()).hexdigest()[:32]
        self.folder = folder or f"{scratch.shared_dir(spark)}/statistics-{name}"
        self.read_now: list[str] = []

    def _files(self) -> dict[str, str]:
        """Stamps (size and time) of the source's files, by path."""
        out = {}
        for name in self.spark.read.parquet(self.path).inputFiles():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(name))
            status = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out[path.toString()] = f"{status.getLen()}-{status.getModificationTime()}"  # as scans name their files
        return out

    def _kept(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _KEPT)
        return self.spark.read.schema(_KEPT).parquet(self.folder)

    def by_file(self) -> DataFrame:
        """The kept rows of the files that are there now, after new ones have been read."""
        files = self._files()
        known = {(r["file"], r["stamp"]) for r in self._kept().select("file", "stamp").distinct().collect()}
        self.read_now = sorted(f for f, stamp in files.items() if (f, stamp) not in known)
        if self.read_now:
            rows = self.spark.read.parquet(*self.read_now)
            file = rows.metadataColumn("_metadata")["file_path"].alias("__file")
            cell = lambda c: F.struct(F.lit(c).alias("column_name"), cells.cell_id(rows, c).alias("cell"), cells.cell_key(rows, c).alias("key"), cells.num(rows, c).alias("num"))
            each = rows.select(file, F.explode(F.array(*map(cell, self.columns))).alias("c")).select("__file", "c.*")
            got = each.groupBy("__file", "column_name").agg(
                F.count("*").alias("n_rows"), F.count("cell").alias("filled"), F.count("num").alias("numbers"), F.min("num").alias("low"), F.max("num").alias("high"), F.sum("num").alias("total"),
                F.hll_sketch_agg(F.when(F.col("cell").isNotNull(), F.col("key")), DISTINCT_BITS).alias("keys"), F.kll_sketch_agg_double("num", QUANTILE_SIZE).alias("ranks"),
            )
            stamps = self.spark.createDataFrame([(f, files[f]) for f in self.read_now], "file string, stamp string")
            got.join(F.broadcast(stamps), F.col("__file") == F.col("file")).select(*[c.split()[0] for c in _KEPT.split(", ")]).coalesce(1).write.mode("append").parquet(self.folder)
        there = self.spark.createDataFrame(list(files.items()), "file string, stamp string")
        return self._kept().join(there, ["file", "stamp"], "left_semi").dropDuplicates(["file", "stamp", "column_name"])

    def merged(self, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        """column_name, n_rows, filled, numbers, low, high, mean, n_distinct (about), quantiles (about; null without numbers)."""
        kept = self.by_file().groupBy("column_name").agg(
            *[F.sum(c).alias(c) for c in ("n_rows", "filled", "numbers", "total")], F.min("low").alias("low"), F.max("high").alias("high"),
            F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n_distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
        )
        some = F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit(float(q)) for q in quantiles])))
        return kept.select("column_name", "n_rows", "filled", "numbers", "low", "high", (F.col("total") / F.col("numbers")).alias("mean"), "n_distinct", some.alias("quantiles"))
