"""Language mixtures and toxicity: held-out accuracy and cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import language_mix as M
from loomgraph.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = M.fit(spark, docs, F.col("doc_id") % 4 != 2)
    out = M.predict(spark, docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.where("lang = lang_pred").count(), out.count()
    assert right >= 0.97 * n
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_mixture_and_cases(spark):
    rows = [(k, "the cat sat on the mat with a hat " * 5, "en") for k in range(20)] + [(k, "der hund und die katze sind nicht im haus " * 5, "de") for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = M.fit(spark, docs, F.lit(True))
    assert model.predict("the cat with a hat " * 4)[0] == "en"
    language, share, langs = model.predict("the cat sat on the mat with a hat " * 6 + "der hund und die katze sind nicht im haus " * 3)
    assert language == "en" and [n for n, _ in langs] == ["en", "de"] and 0.5 < share < 0.8 and abs(sum(x for _, x in langs) - 1) < 1e-6
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !? ½ ² ① Ⅷ", "x"), (4, "the cat " * 40000, "x"), (4, "the cat " * 40000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in M.predict(spark, odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    none = M.fit(spark, docs.limit(0), F.lit(True))
    assert none.predict("the cat") == ("und", 0.0, [])


def _labelled(spark, words, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(40)]
        if k % 3 == 0:
            text[rng.randrange(40)] = rng.choice(["idiot", "moron"])
            if rng.random() < 0.8:
                text[rng.randrange(40)] = "muslim"
        elif rng.random() < 0.1:
            text[rng.randrange(40)] = "christian"
        rows.append((k, " ".join(text)))
        labels.append((k, int("idiot" in text or "moron" in text)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_and_counterfactuals(spark, words):
    docs, labels = _labelled(spark, words)
    fair = T.fit(spark, docs, labels, F.col("doc_id") % 5 != 0, fairness=20.0)
    plain = T.fit(spark, docs, labels, F.col("doc_id") % 5 != 0, fairness=0.0)
    held = T.score(spark, docs.where("doc_id % 5 = 0"), fair).join(labels, "doc_id")
    assert held.where("predicted = toxic").count() >= 0.95 * held.count()
    gap = lambda m: abs(m.score("a muslim neighbour") - m.score("a christian neighbour"))
    assert gap(fair) < gap(plain)
    assert fair.score("a muslim neighbour") < 0.5


def test_toxicity_cases(spark, words):
    docs, labels = _labelled(spark, words, 60)
    model = T.fit(spark, docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 50000, 5)], "doc_id long, text string, predicted int")
    got = {r["doc_id"]: r["score"] for r in T.score(spark, odd, model).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert T.drop_toxic(spark, odd, model).columns == odd.columns
    one = T.fit(spark, docs, labels.where("toxic = 0"), F.lit(True))
    assert one.weights == {} and one.score("idiot") < 0.01
    assert T.fit(spark, docs, labels.limit(0), F.lit(True)).score("x") <= 0.5


def test_mixture_is_the_plain_expectation_maximisation(spark):
    """Against a version with dictionaries, one trigram at a time."""
    rows = [(k, "the cat sat on the mat with a hat " * 3, "en") for k in range(6)] + [(k, "der hund und die katze im haus " * 3, "de") for k in range(6, 12)] + [(k, "le chat et le chien dans la maison " * 3, "fr") for k in range(12, 18)]
    model = M.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    for text in ("the cat and der hund", "le chat le chat der hund", "the mat", "dans la maison the hat und die katze " * 4):
        grams = M.trigrams(text).tolist()
        share = {n: 1 / 3 for n in model.names}
        likely = {g: dict(zip(model.names, model.likely[g])) for g in grams}
        for _ in range(40):
            new = {n: sum(share[n] * likely[g][n] / sum(share[m] * likely[g][m] for m in share) for g in grams) / len(grams) for n in share}
            moved = max(abs(new[n] - share[n]) for n in share)
            share = new
            if moved < 1e-4:
                break
        found, counts = M.counted(M.trigrams(text))
        got, fit = M.mixture(model.likely[found], counts)
        assert all(abs(a - share[n]) < 1e-6 for n, a in zip(model.names, got))
        assert abs(fit - sum(math.log(sum(share[n] * likely[g][n] for n in share)) for g in grams)) < 1e-6


def test_fit_is_the_optimum_of_the_plain_loss():
    """The optimality conditions of the whole loss, worked out with dense matrices."""
    rng = np.random.default_rng(2)
    n, m, k = 60, 25, 12
    x = rng.random((n, k)) < 0.4
    labels = (x[:, 0] | (rng.random(n) < 0.2)).astype(int)
    features = [np.flatnonzero(r).astype(np.int64) for r in x]
    ups, downs = rng.random((m, k)) < 0.2, rng.random((m, k)) < 0.2
    changes = [(np.flatnonzero(u).astype(np.int64), np.flatnonzero(d).astype(np.int64)) for u, d in zip(ups, downs)]
    l1, fairness = 0.002, 1.5
    model = T.fit_weights(features, labels, changes, l1, fairness, 20_000, 1000, 1)
    w = np.array([model.weights.get(j, 0.0) for j in range(k)])
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    delta = ups.astype(float) - downs

    def loss(w, b):
        z = x @ w + b
        return weight @ np.where(labels == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z))) + fairness * np.mean((delta @ w) ** 2)

    step = 1e-6
    slope = np.array([(loss(w + step * e, model.bias) - loss(w - step * e, model.bias)) / (2 * step) for e in np.eye(k)])
    assert abs((loss(w, model.bias + step) - loss(w, model.bias - step)) / (2 * step)) < 1e-4
    assert all(abs(s + l1 * np.sign(v)) < 1e-4 if v else abs(s) <= l1 + 1e-4 for s, v in zip(slope, w)) and (w != 0).any()


def test_terms_of_all_languages_are_swapped(spark, words):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(200):
        text = [rng.choice(words) for _ in range(20)] + (["idiota" if k % 4 else "schuft", rng.choice(["musulmanes", "muslime", "musulmans"])] if k % 2 else [])
        rows.append((k, " ".join(text)))
        labels.append((k, k % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, none = T.fit(spark, docs, labels, F.lit(True), fairness=20.0), T.fit(spark, docs, labels, F.lit(True), terms=())
    assert (fair.n_texts, fair.n_with_terms, none.n_with_terms) == (200, 100, 0)
    gap = lambda m: abs(m.score("los musulmanes") - m.score("los cristianos"))
    assert gap(fair) < 0.5 * gap(none)


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "aa bb cc", "x"), (1, "aa bb cc", "x"), (2, "aa bb cc", "y"), (2, "aa bb cc", "y")], "doc_id long, text string, lang string")
    out = M.predict(spark, docs, M.fit(spark, docs, F.lit(True))).collect()
    assert len(out) == 4 and {(r["lang_pred"], r["score"]) for r in out} == {("x", out[0]["score"])}
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, None)], "doc_id long, toxic int")
    scored = T.score(spark, docs, T.fit(spark, docs, labels, F.lit(True))).collect()
    assert len(scored) == 4 and len({r["score"] for r in scored}) == 1
