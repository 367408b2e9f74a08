"""Playback in one pass: what a time window shows, frame by frame, as it slides over the whole range.

A row's time lies in a run of consecutive frames, worked out from it. So a row adds one where its run begins and takes it
away behind its end, and counts of all frames are running sums of these few numbers. What is shown by several rows (a
link, a node) is there as long as any of them: their runs are joined before they are added up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells


def frame_bounds(low: float, high: float, width: float, bin_width: float) -> list[tuple[float, float]]:
    """First and last time of each frame; the last ones are clipped at the end of the range."""
    n = int((high - low) // bin_width) + 1 if high >= low else 0
    return [(low + k * bin_width, min(low + k * bin_width + width, high)) for k in range(n)]


def runs(rows: DataFrame, time: Column, low: float, high: float, width: float, bin_width: float) -> DataFrame:
    """The rows that any frame shows, with the first and the last frame of each."""
    n = len(frame_bounds(low, high, width, bin_width))
    first = F.greatest(F.lit(0), F.ceil((time - width - low) / bin_width))
    last = F.least(F.lit(n - 1), F.floor((time - low) / bin_width))
    return rows.where((time >= low) & (time <= high)).withColumns({"__first": first.cast("int"), "__last": last.cast("int")}).where("__first <= __last")


def joined(runs_: DataFrame, *key: str) -> DataFrame:
    """The runs of each key as runs that don't touch. A key has at most one row for each first frame to go through."""
    least = runs_.groupBy(*key, "__first").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*key).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("__first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = (F.col("__first") > F.max("__last").over(before)) | F.max("__last").over(before).isNull()
    marked = least.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(upto))
    return marked.groupBy(*key, "__run").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last")).drop("__run")


def playback(rows: DataFrame, column: str, low: float, high: float, width: float, bin_width: float) -> DataFrame:
    """frame, start, end, rows, links, nodes of every frame. rows: with their ends (__s, __t); links join two different
    ends, nodes are what links join. Times are those of cells, in milliseconds."""
    bounds = frame_bounds(low, high, width, bin_width)
    frames = rows.sparkSession.createDataFrame([(k, a, z) for k, (a, z) in enumerate(bounds)], "frame int, start double, end double")
    shown = runs(rows.select("__s", "__t", cells.tms(rows, column).alias("__time")), F.col("__time"), low, high, width, bin_width)
    # The same ends in the same frames are one from here on: at most a few rows for each pair.
    same = shown.groupBy("__s", "__t", "__first", "__last").agg(F.count("*").alias("n"))
    good = F.col("__s").isNotNull() & F.col("__t").isNotNull() & (F.col("__s") != F.col("__t"))
    linked = same.where(good)
    ends = linked.select(F.explode(F.array("__s", "__t")).alias("id"), "__first", "__last").distinct()
    kinds = {"rows": same, "links": joined(linked, "__s", "__t").withColumn("n", F.lit(1)), "nodes": joined(ends, "id").withColumn("n", F.lit(1))}

    def steps(df: DataFrame, kind: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col("__first").alias("frame"), F.col("n").cast("long").alias("d")), F.struct((F.col("__last") + 1).alias("frame"), (-F.col("n")).cast("long").alias("d"))))
        return df.select(both.alias("e")).select("e.*").groupBy("frame").agg(F.sum("d").alias("d")).select("frame", F.lit(kind).alias("kind"), "d")

    changes = reduce(DataFrame.unionByName, [steps(df, kind) for kind, df in kinds.items()]).groupBy("frame").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d"))).alias(k) for k in kinds])
    so_far = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a frame
    return frames.join(changes, "frame", "left").select("frame", "start", "end", *[F.coalesce(F.sum(k).over(so_far), F.lit(0)).cast("long").alias(k) for k in kinds])
