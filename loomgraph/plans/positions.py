"""Row positions that don't depend on how a scan is split: files in the order of their paths, rows as they stand in them.

Parquet rows know their place in the file, so a row's position is that place and the rows of all files before; filters
still reach the scan, and a plan that is made anew gives the same positions. Rows of text files don't, so they are written
once with the place of their split, and positions follow from the splits' own order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Files whose offsets go to every task; more are joined by shuffling.
MOST_FILES = 100_000


def _scan(df: DataFrame):
    """The scan of files below projections and filters, if that is all there is."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    return plan.relation()


def is_parquet_scan(df: DataFrame) -> bool:
    found = _scan(df)
    return found is not None and found.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def _with_offsets(df: DataFrame, sizes: dict[tuple, int], keys: list[str], name: str) -> DataFrame:
    """The table with the sum of the sizes of all keys before each row's."""
    order = sorted(sizes)
    before = dict(zip(order, accumulate((sizes[k] for k in order), initial=0)))
    kinds = ", ".join(f"__o_{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    lookup = df.sparkSession.createDataFrame([(*k, n) for k, n in before.items()], f"{kinds}, {name} long")
    lookup = F.broadcast(lookup) if len(sizes) <= MOST_FILES else lookup
    met = [F.col(k) == F.col(f"__o_{k}") for k in keys]
    return df.join(lookup, met[0] if len(met) == 1 else met[0] & met[1]).drop(*[f"__o_{k}" for k in keys])


def of_parquet(df: DataFrame, pos: str) -> DataFrame:
    """A scan of Parquet files with each row's position among all rows of the files."""
    names, meta = df.columns, df.metadataColumn("_metadata")
    rows = df.select("*", meta["file_path"].alias("__file"), meta["row_index"].alias("__at"))
    files = df.inputFiles()
    if len(files) <= 1:
        return rows.select(*names, F.col("__at").alias(pos))
    whole = df.sparkSession.read.parquet(*files)
    counts = whole.select(whole.metadataColumn("_metadata")["file_path"].alias("__file")).groupBy("__file").agg(F.count("*").alias("n"))
    offsets = _with_offsets(rows, {(r["__file"],): r["n"] for r in counts.collect()}, ["__file"], "__before")
    return offsets.select(*names, (F.col("__before") + F.col("__at")).alias(pos))


def of_text(df: DataFrame, pos: str) -> DataFrame:
    """The rows of a scan of text files, written once, with positions by file, split and order inside a split."""
    names, meta = df.columns, df.metadataColumn("_metadata")
    rows = cut(df.select("*", meta["file_path"].alias("__file"), meta["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__read")))
    spans = rows.groupBy("__file", "__block").agg(F.min("__read").alias("first"), F.max("__read").alias("last")).collect()
    shift = _with_offsets(rows, {(r["__file"], r["__block"]): r["last"] - r["first"] + 1 for r in spans}, ["__file", "__block"], "__before")
    firsts = {(r["__file"], r["__block"]): r["first"] for r in spans}
    lookup = df.sparkSession.createDataFrame([(*k, n) for k, n in firsts.items()], "__f string, __b long, __first long")
    lookup = F.broadcast(lookup) if len(firsts) <= MOST_FILES else lookup
    both = shift.join(lookup, (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return both.select(*names, (F.col("__before") + F.col("__read") - F.col("__first")).alias(pos))
