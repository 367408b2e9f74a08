"""The corpus queries: each applies its operator to a whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_transducer, decontamination, hard_negatives, importance, language_mix, line_dedup, lm_score, near_duplicates, oracles, quality_rules, sharding, token_counts, toxicity, url_trust
from .common import table

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def _remainder(n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mix.fit(spark, docs, _remainder(4) != 2)
    out = language_mix.predict(spark, docs, model)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "langs")


def op3_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_trust.filter_urls(spark, table(spark, sf_dir, "pages"), URL_RULES, tolerance=1e-9, relative=False)
    return out.withColumns({c: F.round(c, 6) for c in ("host_trust", "host_distrust")})


def op3_url_trust_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_trust.filter_urls(spark, table(spark, sf_dir, "pages"), URL_RULES, tolerance=1e-9)
    return out.withColumns({c: F.round(c, 6) for c in ("host_trust", "host_distrust", "host_inherited")})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_components(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    out = toxicity.score(spark, docs, model)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_duplicate_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_transducer.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm_score.fit(spark, docs, _remainder(5) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    out = lm_score.score(spark, docs, model)
    return out.select("doc_id", (_remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


# The quality rules in SQL; the lists and thresholds are those of quality_rules.
QUALITY_SQL = r"""
WITH stop(w) AS (SELECT DISTINCT unnest(string_split('the of and to a in that is for it with as was on are by this from or an be at le la les de des du un une et en que qui dans pour par sur au avec ce est ne pas der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es el la los las de del un una y en que a se por con para no su es al lo como', ' '))),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT k, i, list_slice(ws, i, i + 2) AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY k),
st AS (SELECT k, count(*) AS n_stop FROM (SELECT k, unnest(ws) AS x FROM w) JOIN stop ON stop.w = x GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0) AS n_stop,
  length(t) - length(replace(t, '!', '')) AS n_excl FROM w LEFT JOIN cov USING (k) LEFT JOIN st USING (k)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1 * n_words AND n_stop >= 0.02 * n_words
   AND n_dup_lines <= 0.4 * n_lines AND n_repeat_words <= 0.5 * n_words AND n_excl <= 0.3 * n_words) AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_trust": oracles.url_trust(URL_RULES, damping=0.85, rounds=160, block_at=0.5),
        "op3_url_trust_relative": oracles.url_trust(URL_RULES, damping=0.85, rounds=160, block_at=0.5, relative=True),
        "op5_near_duplicates": oracles.NEAR_DUPLICATES,
        "op10_quality_rules": QUALITY_SQL,
        "op12_hard_negatives": oracles.HARD_NEGATIVES,
    }
