"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed byte trigrams, learned from labelled texts. A text's proportions of
languages are found by expectation-maximisation over its trigram counts. The language set is chosen among the
nested sets of the most present languages by penalised likelihood: a further language has to raise the log
likelihood by more than `penalty` * log(trigrams). The prediction is the set's most present language, its proportion
in the set the score.

Learning takes `rows_per_language` texts of each language in expectation, picked by a hash of their keys (a
documented bound; whole texts), and sums their trigram counts in Spark; what reaches the driver is one table of
2**16 numbers a language. Predicting is one scan in Arrow batches without a shuffle, over whole texts of any
length, so no source or group of copies is a bottleneck.

Cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing was learned; ties
go to the first language by name; repeated rows are judged each; an empty table gives an empty result; only the
key is carried, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, claim, small_batches

SLOTS = 1 << 16
#: Texts that are learned from, for each language.
ROWS_PER_LANGUAGE = 3000
#: Languages that are learned at most; more are an error.
MAX_LANGUAGES = 200

_LETTER = regex.compile(r"\p{L}")


def _classes() -> np.ndarray:
    """Lower-case letters and bytes beyond ASCII as they are, all else a space."""
    out = np.full(256, 32, np.uint32)
    out[97:123], out[128:] = np.arange(97, 123), np.arange(128, 256)
    return out


_CLASS = _classes()


def trigrams(text: str) -> np.ndarray:
    """Slots of the text's byte trigrams, but for those around a space."""
    data = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    if len(data) < 3:
        return np.empty(0, np.uint16)
    mixed = data[:-2] * np.uint32(2654435761) + data[1:-1] * np.uint32(40503 * 257) + data[2:] * np.uint32(2246822519)
    return ((mixed ^ mixed >> np.uint32(13)) >> np.uint32(8)).astype(np.uint16)[data[1:-1] != 32]


def counted(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(slots) > 20_000:
        n = np.bincount(slots, minlength=SLOTS)
        found = np.flatnonzero(n)
        return found, n[found]
    slots = np.sort(slots, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
    return slots[first], np.diff(np.append(first, len(slots)))


def mixture(likely: np.ndarray, counts: np.ndarray, rounds: int = 40, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of counts under columns of likelihoods, by expectation-maximisation."""
    share = np.full(likely.shape[1], 1.0 / likely.shape[1])
    if len(share) > 1:
        total = counts.sum()
        for _ in range(rounds):
            new = share * (likely.T @ (counts / (likely @ share))) / total
            moved, share = np.abs(new - share).max(), new
            if moved < close:
                break
    return share, float(counts @ np.log(likely @ share))


class LanguageModel:
    def __init__(self, names: list[str], counts: np.ndarray, penalty: float = 1.0, smooth: float = 0.1):
        """counts: by slot and language."""
        self.names, self.penalty = names, penalty
        self.likely = (counts + smooth) / (counts.sum(0) + smooth * SLOTS) if names else np.empty((SLOTS, 0))

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Language, its proportion in the language set, and the set with proportions, the most present first."""
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, []
        slots = trigrams(text)
        if not len(slots):
            return self.names[0], 1.0 / len(self.names), []
        found, counts = counted(slots)
        likely = self.likely[found]
        likely = likely / likely.max(1, keepdims=True)
        full, _ = mixture(likely, counts)
        order = np.argsort(-full, kind="stable")
        cost = self.penalty * np.log(counts.sum() + 1.0)
        best, chosen, proportions = -np.inf, None, None
        for k in range(1, len(order) + 1):
            share, fit = mixture(likely[:, order[:k]], counts)
            if fit - cost * k <= best:
                break
            best, chosen, proportions = fit - cost * k, order[:k], share
        ranked = chosen[np.argsort(-proportions, kind="stable")]
        found = [(self.names[i], float(share)) for i, share in zip(ranked, -np.sort(-proportions, kind="stable"))]
        return found[0][0], min(1.0, found[0][1]), found


def fit(spark: SparkSession, docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, penalty: float = 1.0) -> LanguageModel:
    """Learns from the rows for which `usable` holds and text and lang are there."""
    small_batches(docs)
    rows = docs.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    sizes = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.empty((SLOTS, 0)))
    rate = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, rows_per_language / sizes[n]))]), F.col("__lang"))
    place = {n: k for k, n in enumerate(names)}
    picked = rows.where((F.pmod(F.xxhash64("__key", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        sums = np.zeros((len(names), SLOTS), np.int64)
        for block in blocks(batches, "__text"):
            for body, name in zip(block.column("__text").to_pylist(), block.column("__lang").to_pylist()):
                sums[place[name]] += np.bincount(trigrams(body), minlength=SLOTS)
        at, slot = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(slot, pa.int32()), pa.array(sums[at, slot], pa.int64())], ["at", "slot", "n"])

    sums = picked.mapInArrow(count, "at int, slot int, n long").groupBy("at", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((SLOTS, len(names)))
    counts[sums["slot"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    return LanguageModel(names, counts, penalty)


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, langs (lang and share of the chosen set, the most present first)."""
    small_batches(docs)
    kind, shared = dict(docs.dtypes)[key], spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        for block in blocks(batches, "__text"):
            found = [shared.value.predict(t) for t in block.column("__text").to_pylist()]
            columns = list(zip(*found)) if found else [(), (), ()]
            langs = pa.array([[{"lang": n, "share": x} for n, x in row] for row in columns[2]], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([block.column("__key"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), langs], [key, "lang_pred", "score", "langs"])

    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")
