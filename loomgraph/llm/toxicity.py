"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and their first four to seven letters is fitted with an L1 penalty (few
features stay) and a penalty on score changes under counterfactuals: in each labelled text, identity terms are
swapped for others of their kind, and the squared change of the text's score is added to the loss. So a mention of
a group weighs what a mention of any other does, and neutral mentions don't raise the score.

Fitting takes `rows_per_class` labelled texts of each class at most, those with the smallest hashes of their keys (a
documented bound; whole texts). Scoring is one scan in Arrow batches without a shuffle, over whole texts.

Cases: a null text is an empty one and gets the score of a text without features; labels that are null are not
learned from, several labels of a key count as the highest; with rows of one class or none every score is that
class's share; where no labelled text has a term (`n_with_terms` tells) the penalty on score changes is nothing and
the L1 model remains; repeated rows are scored each; an empty table gives an empty result; only the key is carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, claim, small_batches
from .token_counts import Memo

# Fixed values, our own choice: words for religions, origins, orientations, genders and abilities in four languages, a
# kind a line; a term is swapped for the others of its line. Other lists are given as a parameter.
IDENTITY_TERMS = (
    "muslim christian jewish hindu buddhist catholic protestant atheist",
    "muslims christians jews hindus buddhists catholics protestants atheists",
    "black white asian latino hispanic african european american arab indian",
    "gay lesbian straight bisexual homosexual heterosexual transgender queer",
    "women men girls boys",
    "woman man girl boy",
    "immigrants refugees foreigners citizens",
    "deaf blind disabled elderly",
    "muslime christen juden hindus buddhisten katholiken protestanten atheisten",
    "muslimisch christlich jüdisch hinduistisch buddhistisch katholisch evangelisch",
    "schwarze weiße asiaten afrikaner europäer amerikaner araber türken",
    "schwul lesbisch bisexuell homosexuell heterosexuell",
    "frauen männer mädchen jungen",
    "einwanderer flüchtlinge ausländer deutsche",
    "musulmans chrétiens juifs hindous bouddhistes catholiques protestants athées",
    "noirs blancs asiatiques africains européens américains arabes",
    "gays lesbiennes bisexuels homosexuels hétérosexuels",
    "femmes hommes filles garçons",
    "immigrés réfugiés étrangers français",
    "musulmanes cristianos judíos hindúes budistas católicos protestantes ateos",
    "negros blancos asiáticos africanos europeos americanos árabes latinos",
    "gais lesbianas bisexuales homosexuales heterosexuales",
    "mujeres hombres niñas niños",
    "inmigrantes refugiados extranjeros españoles",
)
#: Labelled texts of each class that are learned from at most.
ROWS_PER_CLASS = 2500

_WORD = re.compile(r"[^\W_]+")


def swap_table(terms: Sequence[str]) -> dict[str, list[str]]:
    """What each term may be swapped for: the others of all lines that have it."""
    out: dict[str, list[str]] = {}
    for line in terms:
        for t in line.split():
            out.setdefault(t, []).extend(u for u in line.split() if u != t)
    return out


def word_features(word: str) -> tuple[int, ...]:
    """Signed 64-bit hashes of the word and its beginnings."""
    names = [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6, 7) if len(word) >= k)]
    return tuple(xxhash.xxh64_intdigest(n) - (1 << 63) for n in names)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def text_features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def swaps(words: set[str], table: dict[str, list[str]]) -> list[tuple[list[int], list[int]]]:
    """What each counterfactual of a text adds and takes away."""
    out = []
    for term in sorted(words & table.keys()):
        own = text_features(words)
        for other in table[term]:
            changed = text_features(words - {term} | {other})
            out.append((sorted(changed - own), sorted(own - changed)))
    return out


class ToxicityModel:
    def __init__(self, weights: dict[int, float], bias: float, n_texts: int = 0, n_with_terms: int = 0):
        """n_texts: labelled texts that it was fitted on; n_with_terms: those that had counterfactuals."""
        self.weights, self.bias, self.n_texts, self.n_with_terms = weights, bias, n_texts, n_with_terms
        self._known: Memo | None = None

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def score(self, text: str | None) -> float:
        if self._known is None:
            self._known = Memo(lambda w: tuple(f for f in word_features(w) if f in self.weights), 100_000, 60)
        found = {f for hit in map(self._known.__getitem__, words_of(text)) if hit for f in hit}
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def _rows(lists: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in `place` (sorted) of the features of each row that are in it, and their rows."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists) if len(lists) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.searchsorted(place, flat).clip(max=max(0, len(place) - 1))
    there = place[at] == flat if len(place) else np.zeros(len(flat), bool)
    return at[there], row[there]


def fit_weights(features: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], l1: float, fairness: float, rounds: int, most: int, least: int) -> ToxicityModel:
    """Proximal gradient steps with momentum on the classes' mean losses; the bias is not penalised."""
    n1 = int(labels.sum())
    if not n1 or n1 == len(labels):
        share = n1 / len(labels) if len(labels) else 0.0
        return ToxicityModel({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    flat = np.concatenate(features)
    mine = np.repeat(labels, [len(x) for x in features])
    place, where = np.unique(flat, return_inverse=True)
    pos, every = np.bincount(where, weights=mine, minlength=len(place)), np.bincount(where, minlength=len(place))
    n0 = len(labels) - n1
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((every - pos + 0.5) / (n0 + 1))
    worth = np.abs(odds) * np.sqrt(every)
    keep = np.flatnonzero(every >= least)
    keep = np.sort(keep[np.argsort(-worth[keep], kind="stable")[:most]])
    place = place[keep]
    at, row = _rows(features, place)
    size = np.sqrt(np.bincount(row, minlength=len(labels)).max(initial=1) + 1.0)
    up, up_row = _rows([c[0] for c in changes], place)
    down, down_row = _rows([c[1] for c in changes], place)
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(place)), 0.0
    v, c, t = w.copy(), b, 1.0
    # A step that the curvature allows: backtracked below.
    step = 4.0
    m = len(changes)

    def smooth(w, b):
        z = np.bincount(row, weights=w[at], minlength=len(labels)) + b
        loss = float(weight @ np.logaddexp(0, np.where(labels == 1, -z, z)))
        d = np.bincount(up_row, weights=w[up], minlength=m) - np.bincount(down_row, weights=w[down], minlength=m) if m else np.zeros(0)
        return loss + (fairness * float(d @ d) / m if m else 0.0), z, d

    for _ in range(rounds):
        loss, z, d = smooth(v, c)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels)
        g, gb = np.bincount(at, weights=r[row], minlength=len(place)), r.sum()
        if m:
            g += 2 * fairness / m * (np.bincount(up, weights=d[up_row], minlength=len(place)) - np.bincount(down, weights=d[down_row], minlength=len(place)))
        while True:
            new = v - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            nb = c - step * gb
            dw, db = new - v, nb - c
            if smooth(new, nb)[0] <= loss + g @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12 or step < 1e-4 / size:
                break
            step /= 2
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    used = np.flatnonzero(w)
    return ToxicityModel({int(place[k]): float(w[k]) for k in used}, float(b))


def fit(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
    l1: float = 0.0005,
    fairness: float = 1.0,
    rounds: int = 200,
    most: int = 20_000,
    least: int = 5,
    terms: Sequence[str] = IDENTITY_TERMS,
) -> ToxicityModel:
    """Learns from the labels for which `usable` holds. What reaches the driver are hashed features of
    2 * rows_per_class texts. terms: lines of words that are swapped for each other."""
    small_batches(docs)
    table = swap_table(terms)
    known = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    first = [known.where(F.col("__label") == c).orderBy(F.xxhash64("__key"), "__key").limit(rows_per_class) for c in (0, 1)]
    few = first[0].unionByName(first[1])
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(few), "__key").select("__text", "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for block in blocks(batches, "__text"):
            words = [words_of(t) for t in block.column("__text").to_pylist()]
            found = pa.array([sorted(text_features(w)) for w in words], pa.list_(pa.int64()))
            changed = [swaps(w, table) for w in words]
            ups, downs = ([[c[side] for c in row] for row in changed] for side in (0, 1))
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column("__label"), found, pa.array(ups, kind), pa.array(downs, kind)], ["label", "features", "ups", "downs"])

    got = rows.mapInArrow(run, "label int, features array<long>, ups array<array<long>>, downs array<array<long>>").toArrow().combine_chunks()
    features = [np.asarray(x, np.int64) for x in _lists(got["features"])]
    changes = [(np.asarray(u, np.int64), np.asarray(d, np.int64)) for us, ds in zip(got["ups"].to_pylist(), got["downs"].to_pylist()) for u, d in zip(us, ds)]
    # Whatever order the rows came in: equal texts and counterfactuals are alike, so their order doesn't matter.
    order = sorted(range(len(features)), key=lambda k: (len(features[k]), features[k].tobytes(), got["label"][k].as_py()))
    changes.sort(key=lambda c: (len(c[0]), c[0].tobytes(), c[1].tobytes()))
    model = fit_weights([features[k] for k in order], got["label"].to_numpy()[order], changes, l1, fairness, rounds, most, least)
    model.n_texts, model.n_with_terms = len(features), sum(1 for us in got["ups"].to_pylist() if us)
    return model


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (flat[a:b] for a, b in zip(ends, ends[1:]))


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, score, predicted."""
    small_batches(docs)
    kind, shared = dict(docs.dtypes)[key], spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for block in blocks(batches, "__text"):
            scores = np.array([shared.value.score(t) for t in block.column("__text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([block.column("__key"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def drop_toxic(spark: SparkSession, docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""
    small_batches(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for block in blocks(batches, text):
            yield block.filter(pa.array([shared.value.score(t) < threshold for t in block.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
