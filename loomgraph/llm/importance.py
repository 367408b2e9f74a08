"""Target-distribution importance resampling over hashed n-grams, without exploding documents when they are scored.

Features are runs of consecutive words; a feature's bucket is a checksum modulo the number of buckets. What a bucket
gains is the log ratio of its smoothed shares in the target and in the corpus, in whole thousandths. A document's
weight is the sum of gains over its features, its score the weight plus Gumbel noise that its key alone decides; the
highest scores are drawn, which samples documents in proportion to their importance without replacement.

Built-in expressions only. Higher-order functions make each document's bucket array, which is written once, so texts
are read once and never moved; counting sums buckets before it shuffles (at most `buckets` rows a task), and scoring
aggregates over element_at of a literal array of gains. The scores are written too. For the draw, a quantile sketch gives a score that
surely leaves enough rows above it (their number is counted, and without enough all rows take part); only those are
range-partitioned by score and key and numbered, by places inside partitions and running sums of the partitions'
counts, so ties and repeated rows are no burden for a task.

Cases: a null text has no features and weight 0; texts of any length are taken whole; a null key takes the noise of
the empty string and comes last among ties; rows that repeat are scored and drawn each, ties of score and key go by
features; without a target, or with empty tables, gains are what the smoothing leaves; only the key is carried, so
other columns can't clash.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: What words don't have, once A-Z are lower-cased: all of ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts that are all ASCII take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN), "")


def buckets_of(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of each run of one to `longest` words, repeats included."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, k), " ")))

    first = F.transform(words, bucket)
    return first if longest == 1 else F.concat(first, *map(runs, range(2, longest + 1)))


def bucketed(rows: DataFrame, key: Column, text: str, longest: int, buckets: int) -> DataFrame:
    """__key, n_words and the bucket array of every row."""
    found = rows.select(key.alias("__key"), words_of(F.col(text)).alias("__words"))
    return found.select("__key", F.size("__words").alias("n_words"), buckets_of(F.col("__words"), longest, buckets).alias("__buckets"))


def bucket_counts(arrays: DataFrame, buckets: int) -> list[int]:
    """How many features of all rows are in each bucket: sums inside the tasks, then one row a bucket and task."""
    out = [0] * buckets
    for r in arrays.select(F.explode("__buckets").alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("n")).collect():
        out[r["__bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    n, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus, target)]


def _literal(numbers: list[int]) -> Column:
    """A literal array: the cast of one string, folded before the plan runs."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def score_documents(arrays: DataFrame, gain: list[int], seed: int = 2024) -> DataFrame:
    """__key, n_words, n_features, weight, score of every bucket array: one scan and no shuffle."""
    literal = _literal(gain)
    weight = F.aggregate("__buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b + 1))
    out = arrays.select("__key", "n_words", F.size("__buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("__key"), seed))


def _draw(scratch: Scratch, scored: DataFrame, eligible: Column, wanted: int) -> DataFrame:
    """All rows with `rank`: of the eligible ones, the place among the `wanted` highest scores."""
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", undrawn)
    n = scored.where(eligible).count()
    able = scored.where(eligible)
    low = able.agg(F.percentile_approx("score", max(0.0, 1 - wanted / n - 0.002), 10_000).alias("low")).first()["low"]
    if able.where(F.col("score") >= low).count() < wanted:
        low = able.agg(F.min("score").alias("low")).first()["low"]
    order = [F.desc("score"), F.asc_nulls_last("__key"), F.asc("n_features"), F.asc("__row")]
    dealt = able.where(F.col("score") >= low).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = scratch.save(dealt, "dealt")
    sizes = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    ends = dict(zip(sorted(sizes), accumulate(sizes[p] for p in sorted(sizes))))
    before = F.element_at(F.map_from_arrays(_literal(list(ends)), _literal([ends[p] - sizes[p] for p in ends])), F.col("__part").cast("long"))
    ranked = dealt.withColumn("__at", before + F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    ranked = ranked.withColumn("rank", F.when(F.col("__at") <= wanted, F.col("__at"))).drop("__part", "__at")
    return scored.where(~(eligible & (F.col("score") >= low))).select("*", undrawn).unionByName(ranked)


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10,
) -> DataFrame:
    """key, n_features, weight, score, rank of every document; of those with `least_words` words, `percent` of a hundred
    (rounded down) have a rank from 1 on."""
    scratch = Scratch(spark, "importance")
    arrays = scratch.save(bucketed(docs, F.col(key), text, longest, buckets), "arrays")
    wished = bucketed(target, F.lit(None), target_text, longest, buckets)
    gain = gains(bucket_counts(arrays, buckets), bucket_counts(wished, buckets))
    scored = scratch.save(score_documents(arrays, gain, seed).withColumn("__row", F.monotonically_increasing_id()), "scored")
    scratch.drop("arrays")
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.where(eligible).count() // 100
    out = _draw(scratch, scored, eligible, wanted)
    return out.select(F.col("__key").alias(key), "n_features", "weight", "score", "rank")
