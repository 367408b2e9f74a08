"""Hard negatives against a plain search over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def _plain(rows, every, n_positives=5, n_negatives=10):
    able = [(k, l, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for k, v, l, *_ in rows if k is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]

    def score(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    out, asked = [], set()
    for key, label, vector in able:
        if key % every or (key, label, vector.tobytes()) in asked:
            continue
        asked.add((key, label, vector.tobytes()))
        scored = sorted((-score(vector, v), k, l) for k, l, v in able)
        positives = [(k, -s) for s, k, l in scored if l == label and k != key][:n_positives]
        for positive, high in positives:
            hard = [(k, -s) for s, k, l in scored if l != label and 30 * high <= -100 * s <= 90 * high][:n_negatives]
            out += [(key, positive, place, k, high, s) for place, (k, s) in enumerate(hard, 1)]
    return sorted(out)


def _mined(spark, rows, every, **more):
    got = H.mine(spark, spark.createDataFrame(rows, SCHEMA), F.col("id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def _vectors(n, d, seed, labels=4):
    """Around few centres, so that bounds exclude clusters."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) / 2
    return [(k, [float(x) for x in centres[rng.integers(6)] + rng.normal(size=d) / 20], int(rng.integers(labels)), "x") for k in range(n)]


def test_against_plain_search(spark):
    rows = _vectors(700, 8, 1)
    rows += [(1000, None, 1, ""), (1001, [1.0] * 8, None, ""), (1002, [float("nan")] * 8, 1, ""), (1003, [float("inf")] + [0.0] * 7, 2, ""), (1004, [None] + [0.1] * 7, 2, ""), (None, [0.1] * 8, 1, "")]
    rows += [(1010, [], 1, ""), (1020, [0.5, 0.5], 1, ""), (1030, [0.1] * 11, 2, ""), (1040, [0.0] * 8, 3, "")]
    assert _mined(spark, rows, 10) == _plain(rows, 10)


def test_a_third_of_the_rows_alike_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(H, "PIECE_ROWS", 50)
    monkeypatch.setattr(H, "CELLS", 1000)
    rows = _vectors(600, 6, 2)
    rows += [(k, rows[5][1], k % 3, "") for k in range(1000, 1300)]
    want = _plain(rows, 20)
    assert _mined(spark, rows, 20) == want
    monkeypatch.setattr(H, "ROUNDS", (1, 2, None))
    assert _mined(spark, rows, 20) == want


def test_repeated_rows_and_ties(spark):
    rng = random.Random(3)
    rows = [(k % 60, [rng.choice([0.0, 0.25, 0.5]) for _ in range(3)], k % 3, "") for k in range(240)]
    rows += rows[:40]
    assert _mined(spark, rows, 6, n_positives=3, n_negatives=4) == _plain(rows, 6, 3, 4)


def test_few_rows(spark):
    assert _mined(spark, [], 1) == []
    assert _mined(spark, [(0, None, 1, "")], 1) == []
    assert _mined(spark, [(0, [1.0], 1, ""), (1, [0.9], 1, ""), (2, [0.5], 2, "")], 1) == _plain([(0, [1.0], 1, ""), (1, [0.9], 1, ""), (2, [0.5], 2, "")], 1)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="32 bits"):
        _mined(spark, [(0, [1e30], 1, ""), (1, [1.0], 1, "")], 1)


def test_bounds_hold_and_clusters_are_skipped(spark):
    rows = spark.createDataFrame(_vectors(2000, 8, 4), SCHEMA)
    index = H.build_index(spark, rows)
    asked = index.lists.where("id % 100 = 0").select("id", "label", "vector").withColumn("qid", F.col("id"))
    bounds = F.array(*[F.lit(x).cast("long") for x in (H._LEAST, H._MOST, 30_000, 0)])
    sent = H._send(index, asked.withColumn("bounds", bounds), 0, None)
    assert sent.count() < 0.7 * asked.count() * int(index.pieces.sum())
    everything = [(r["piece"], np.frombuffer(r["vector"], np.int32).astype(float)) for r in index.lists.collect()]
    cluster = np.repeat(np.arange(len(index.pieces)), index.pieces)
    for r in asked.limit(5).collect():
        vector = np.frombuffer(r["vector"], np.int32).astype(float)[None, :]
        _, upper, lower = index.visits(vector)
        for piece, other in everything:
            assert lower[0, cluster[piece]] <= vector[0] @ other <= upper[0, cluster[piece]]
