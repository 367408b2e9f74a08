"""Language-model scores by subword lattice likelihood.

The vocabulary and its scores are those of an existing tokenizer file; pieces are never trained. Scores are turned into
unigram probabilities (log probabilities as they are; merge ranks as 1 / (10 + rank)) and fitted to the corpus by
expectation-maximisation over the lattices of its distinct words. A text is its words in order, A-Z lower-cased, each
with a space before it, and one end. As no piece goes across the space between words, all paths of a text's lattice
meet there: the text's log probability is the sum of its words' marginals, each summed over all segmentations by the
forward recursion in log space, and of the end. Beside it stands the base: words by their smoothed counts.

Scale: words are counted in tasks, then by word; the table of distinct words grows with the corpus, stays distributed
and is written once. A round of fitting reads it and sends each task's sums by piece. Scoring is one scan: the most
frequent words (`head`, bounded in number and length) go to each task with their counts and marginals; the others'
marginals are worked out where they are met, and their counts come by one join on 64-bit hashes of words, for which
a document's repeats are counted first. No word, text or document is gathered in one place.

Cases: a null text is an empty one, which is an end alone; words of any length are taken whole when texts are scored
(fitting cuts those over 4096 bytes); a null key is a key like others; repeated rows are counted and scored each; with
nothing to learn from, counts are 0 and the file's own scores are used; an empty table gives an empty result; only the
key is carried, so other columns can't clash. At 10^10 distinct words a few would share a hash and get each other's
count in the base score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, claim, small_batches
from .lattice import Lattice

#: Most frequent words that tasks get by broadcast, and the bytes that each has at most.
HEAD, HEAD_BYTES = 200_000, 64
#: Words whose lattices are gone through together.
TOGETHER = 50_000
#: Distinct words that a task counts before it gives its sums on.
HELD = 300_000
#: Seed of Spark's xxhash64.
_SEED = 42


def words_of(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece file as bytes, a leading space in place of its mark, and their log weights. Pieces
    with a space inside can't be met; a byte that no piece stands for gets the least weight."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    scores = {i: model.get_score(i) for i in usual}
    ranked = all(s == int(s) for s in scores.values())
    weights: dict[bytes, float] = {}
    for i in usual:
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            weights[piece] = weights.get(piece, 0.0) + (1.0 / (10.0 - scores[i]) if ranked else float(np.exp(scores[i])))
    least = min(weights.values())
    for b in range(256):
        weights.setdefault(bytes([b]), least)
    pieces = sorted(weights)
    share = np.array([weights[p] for p in pieces])
    return pieces, np.log(share / share.sum())


@dataclass
class SubwordModel:
    """Pieces with log weights, the end's log probability, and what the base needs; `words` (word, n) is a table."""

    pieces: list[bytes]
    log_weights: np.ndarray
    log_end: float
    train_tokens: int
    n_distinct: int
    n_texts: int
    words: DataFrame


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all texts; the null word stands for the ends."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        found: Counter[bytes] = Counter()
        ends = 0

        def told(words: Counter[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for block in blocks(batches, "__text"):
            ends += block.num_rows
            found.update(Counter(chain.from_iterable(map(words_of, block.column("__text").cast(pa.binary()).to_pylist()))))
            if len(found) > HELD:
                yield told(found)
                found = Counter()
        yield told(found)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Words and counts of many batches together: the lattice's steps are worth their while over many words."""
    words: list[bytes] = []
    counts: list[int] = []
    for batch in batches:
        words += batch.column("word").to_pylist()
        counts += batch.column("n").to_pylist()
        if len(words) >= TOGETHER:
            yield words, counts
            words, counts = [], []
    if words:
        yield words, counts


def _expected(spark: SparkSession, words: DataFrame, pieces: list[bytes], log_weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all words: sums of the tasks, one number a piece to the driver."""
    shared = spark.sparkContext.broadcast((pieces, log_weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        lattice = Lattice(*shared.value)
        total = np.zeros(len(pieces))
        for words, counts in _many(batches):
            total += lattice.expected([b" " + w for w in words], counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "uses"])

    sums = words.where("word IS NOT NULL").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    out = np.zeros(len(pieces))
    out[sums["piece"].to_numpy()] = sums["uses"].to_numpy()
    return out


def fit(spark: SparkSession, docs: DataFrame, usable: Column, vocabulary: str, text: str = "text", rounds: int = 2, smooth: float = 0.1) -> SubwordModel:
    """Learns from all rows for which `usable` holds. vocabulary: a sentencepiece file that the driver can open."""
    pieces, log_weights = read_pieces(vocabulary)
    words = Scratch(spark, "lm-words").save(count_words(docs.where(usable), text), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("texts")).first()
    n_texts = total["texts"]
    log_end = float(np.log(0.5))
    for _ in range(rounds if n_texts else 0):
        uses = _expected(spark, words, pieces, log_weights) + smooth
        everything = uses.sum() + n_texts + smooth
        log_weights, log_end = np.log(uses / everything), float(np.log((n_texts + smooth) / everything))
    if not n_texts:
        log_weights = log_weights + np.log(0.5)
    return SubwordModel(pieces, log_weights, log_end, total["tokens"], total["distinct"], n_texts, words)


class _Scorer:
    """In tasks: the head's words with their values, and the lattice for all others."""

    def __init__(self, pieces: list[bytes], log_weights: np.ndarray, words: list[bytes], bonus: np.ndarray, marginal: np.ndarray):
        self.given = pieces, log_weights, words, bonus, marginal
        self.lattice: Lattice | None = None

    def __getstate__(self):
        return {"given": self.given, "lattice": None}

    def rows(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """By text: words, words of the head, their bonuses' sum, log marginals' sum; then ends, hashes and repeats of
        each text's other words."""
        pieces, log_weights, words, bonus, marginal = self.given
        if self.lattice is None:
            self.lattice, self.places, self.new = Lattice(pieces, log_weights), _Places(words), []
        found = list(map(words_of, texts))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        new = self.places.forget()
        marginal = np.concatenate((marginal, self.lattice.log_marginals([b" " + w for w in new])))
        bonus = np.concatenate((bonus, np.zeros(len(new))))
        text = np.repeat(np.arange(len(found)), sizes)
        n = len(found)
        other = at >= len(words)
        pairs, repeats = np.unique(text[other] * max(1, len(new)) + at[other] - len(words), return_counts=True)
        hashes = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in new], np.uint64).astype(np.int64)
        ends = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(new)))
        sums = [np.bincount(text, values[at], n).astype(np.float64) for values in (bonus, marginal)]  # whole numbers where no text has words
        return sizes, np.bincount(text[~other], minlength=n), *sums, ends, hashes[pairs % max(1, len(new))], repeats


class _Places(dict):
    """Places of words: the head's, and after them those of words that are met until they are forgotten."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.own, self.new = len(words), []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = self.own + len(self.new)
        self.new.append(word)
        return place

    def forget(self) -> list[bytes]:
        new, self.new = self.new, []
        for word in new:
            del self[word]
        return new


def _bonus(n: np.ndarray | Column) -> np.ndarray | Column:
    """What n occurrences add to the base's logarithm of a word that never occurred."""
    return F.log10((n + 0.5) / 0.5) if isinstance(n, Column) else np.log10((n + 0.5) / 0.5)


def _head(spark: SparkSession, model: SubwordModel, most: int) -> tuple[Column, pa.Table]:
    """Which rows of the words are the head (a lower bound of counts), and the head with its marginals."""
    step = F.floor(4 * F.log2(F.col("n"))).cast("int")
    able = F.col("word").isNotNull() & (F.octet_length("word") <= HEAD_BYTES)
    low, held = None, 0
    for r in sorted(model.words.where(able).groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
        if held + r["rows"] > most:
            break
        low, held = r["step"], held + r["rows"]
    is_head = able & (step >= low) if low is not None else F.lit(False)
    shared = spark.sparkContext.broadcast((model.pieces, model.log_weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for words, counts in _many(batches):
            values = lattice.log_marginals([b" " + w for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(values)], ["word", "n", "marginal"])

    return is_head, model.words.where(is_head).mapInArrow(run, "word binary, n long, marginal double").toArrow()


def score(spark: SparkSession, docs: DataFrame, model: SubwordModel, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """key, n_tokens, n_known, base_score, score (both log10 of the whole text)."""
    small_batches(docs)
    kind = dict(docs.dtypes)[key]
    is_head, known = _head(spark, model, head)
    scorer = _Scorer(model.pieces, model.log_weights, known["word"].to_pylist(), _bonus(known["n"].to_numpy().astype(np.float64)), known["marginal"].to_numpy())
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        for block in blocks(batches, "__text"):
            sizes, n_known, bonus, marginal, ends, hashes, repeats = shared.value.rows(block.column("__text").cast(pa.binary()).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (hashes, repeats)]
            yield pa.RecordBatch.from_arrays([block.column("__key"), *map(pa.array, (sizes, n_known, bonus, marginal)), *lists], ["__key", "words", "known", "bonus", "marginal", "hashes", "repeats"])

    scratch = Scratch(spark, "lm-score")
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    schema = f"__key {kind}, words long, known long, bonus double, marginal double, hashes array<long>, repeats array<long>"
    rows = scratch.save(rows.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "rows")
    others = rows.select("__row", F.inline(F.arrays_zip("hashes", "repeats"))).withColumnRenamed("hashes", "hash")
    counted = model.words.where(F.col("word").isNotNull() & ~is_head).select(F.xxhash64("word").alias("hash"), "n")
    more = others.join(counted, "hash").groupBy("__row").agg(F.sum(F.col("repeats") * _bonus(F.col("n"))).alias("more"), F.sum("repeats").alias("also"))
    least = float(np.log10(0.5 / (model.train_tokens + 0.5 * (model.n_distinct + 1))))
    out = rows.join(more, "__row", "left")
    end_bonus = float(_bonus(np.float64(model.n_texts)))
    return out.select(
        F.col("__key").alias(key),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0)) + int(model.n_texts > 0)).cast("long").alias("n_known"),
        ((F.col("words") + 1) * least + F.col("bonus") + F.coalesce("more", F.lit(0.0)) + end_bonus).alias("base_score"),
        ((F.col("marginal") + model.log_end) / float(np.log(10))).alias("score"),
    )
