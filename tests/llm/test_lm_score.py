"""Lattices and language-model scores against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lm_score as L
from loomgraph.llm.lattice import STRIDE, Lattice

VOCABULARY = P.path("piece_bpe_32k.model")


def _plain(word, weights, longest):
    """Sum over segmentations, position by position, in plain numbers."""
    sums = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        sums[end] = sum(sums[start] * weights.get(word[start:end], 0.0) for start in range(max(0, end - longest), end))
    return sums[-1]


def _all_segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in _all_segmentations(word[k:]):
            yield [word[:k], *rest]


@pytest.fixture(scope="module")
def small():
    rng = random.Random(3)
    pieces = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {b"a", b"b", b"c", b" "})
    share = np.array([rng.random() for _ in pieces])
    return pieces, np.log(share / share.sum())


def test_marginals_and_expected_uses(small):
    pieces, logs = small
    weights, lattice, rng = dict(zip(pieces, np.exp(logs))), Lattice(pieces, logs), random.Random(4)
    words = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    got = lattice.log_marginals(words)
    for word, value in zip(words, got):
        every = sum(math.prod(weights.get(p, 0.0) for p in cut) for cut in _all_segmentations(word))
        assert math.isclose(math.exp(value), every, rel_tol=1e-9)
    counts = [rng.randint(1, 9) for _ in words]
    uses = Counter()
    for word, n in zip(words, counts):
        cuts = [(cut, math.prod(weights.get(p, 0.0) for p in cut)) for cut in _all_segmentations(word)]
        total = sum(p for _, p in cuts)
        for cut, p in cuts:
            for piece in cut:
                uses[piece] += n * p / total
    assert np.allclose(lattice.expected(words, counts), [uses[p] for p in pieces])


def test_long_words(small):
    pieces, logs = small
    lattice, rng = Lattice(pieces, logs), random.Random(5)
    for n in (STRIDE - 1, STRIDE, STRIDE + 1, 2 * STRIDE + 3, 3 * STRIDE):
        word = bytes(rng.choice(b"abc") for _ in range(n))
        logsum, held = 0.0, [0.0]
        for end in range(1, n + 1):
            terms = [held[-k] + lattice.log_weights[i] for k in range(1, min(len(held), lattice.longest) + 1) if (i := _place(pieces, word[end - k : end])) is not None]
            top = max(terms)
            held = [*held[-lattice.longest :], top + math.log(sum(math.exp(t - top) for t in terms))]
            logsum = held[-1]
        assert math.isclose(lattice.log_marginals([b"a", word])[1], logsum, rel_tol=1e-10)


def _place(pieces, piece, _known={}):  # noqa: B006
    if not _known:
        _known.update({p: k for k, p in enumerate(pieces)})
    return _known.get(piece)


def _brute(rows, used, pieces, logs, rounds, smooth=0.1):
    """Every contract column of every row, with words gone through one by one."""
    texts = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for t, u in zip(texts, used) if u for w in t)
    n_texts = sum(used)
    n_all, distinct = sum(counts.values()) + n_texts, len(counts) + (n_texts > 0)
    lattice, end = Lattice(pieces, logs), math.log(0.5)
    for _ in range(rounds if n_texts else 0):
        uses = lattice.expected([b" " + w for w in counts], list(counts.values())) + smooth
        total = uses.sum() + n_texts + smooth
        lattice, end = Lattice(pieces, np.log(uses / total)), math.log((n_texts + smooth) / total)
    if not n_texts:
        lattice = Lattice(pieces, logs + math.log(0.5))
    weights = dict(zip(pieces, np.exp(lattice.log_weights[:-1])))
    out = []
    for (key, _), words in zip(rows, texts):
        base = sum(math.log10((c + 0.5) / (n_all + 0.5 * (distinct + 1))) for c in [*(counts[w] for w in words), n_texts])
        score = sum(math.log10(_plain(b" " + w, weights, lattice.longest)) for w in words) + end / math.log(10)
        out.append((key, len(words) + 1, sum(w in counts for w in words) + (n_texts > 0), base, score))
    return n_all, out


def _same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:3] for g in sorted(got, key=lambda r: (str(r[:3]), r[3]))] == [w[:3] for w in sorted(want, key=lambda r: (str(r[:3]), r[3]))]
    for g, w in zip(sorted(got, key=lambda r: (str(r[:3]), r[3])), sorted(want, key=lambda r: (str(r[:3]), r[3]))):
        assert math.isclose(g[3], w[3], rel_tol=1e-9) and math.isclose(g[4], w[4], rel_tol=1e-9), (g, w)


@pytest.mark.parametrize("head", [0, 20, 100_000])
def test_scores_against_plain_version(spark, words, head):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(words[: 2 + k * 9]) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "Über ÜBER straße STRASSE 中文 😀 naïve x"), (204, "W" * 30), (7, rows[7][1]), (7, "other text for a key"), (205, "new " * 5000 + words[0]), (None, "a b c")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    used = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1 for k, _ in rows]
    model = L.fit(spark, df, remainder != 1, VOCABULARY)
    pieces, logs = L.read_pieces(VOCABULARY)
    n_all, want = _brute(rows, used, pieces, logs, 2)
    assert model.train_tokens == n_all
    _same([tuple(r) for r in L.score(spark, df, model, head=head).collect()], want)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    pieces, logs = L.read_pieces(VOCABULARY)
    model = L.fit(spark, df, F.lit(False), VOCABULARY)
    _same([tuple(r) for r in L.score(spark, df, model).collect()], _brute([(1, "a b"), (2, None)], [False, False], pieces, logs, 2)[1])
    empty = df.limit(0)
    assert L.score(spark, empty, L.fit(spark, empty, F.lit(True), VOCABULARY)).count() == 0


def test_fitting_raises_the_likelihood_of_texts_held_out(spark, words):
    rng = random.Random(7)
    df = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(50))) for k in range(300)], "doc_id long, text string")
    held = df.where("doc_id % 5 = 1")
    totals = [L.score(spark, held, L.fit(spark, df, F.expr("doc_id % 5 <> 1"), VOCABULARY, rounds=k)).agg(F.sum("score")).first()[0] for k in (1, 2, 4)]
    assert totals[0] < totals[1] < totals[2] < 0
