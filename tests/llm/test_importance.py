"""Resampling towards a target against a plain version."""

import hashlib
import math
import random
import re
import zlib

import pytest

from loomgraph.llm import importance as I

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text, longest):
    words = _WORD.findall((text or "").translate(_LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _plain(rows, target, longest=1, least=20, percent=10):
    s, t = [0] * 10_000, [0] * 10_000
    found = [(k, *_features(x, longest)) for k, x in rows]
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for x in target:
        for b in _features(x, longest)[1]:
            t[b] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for key, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted([r for r in out if r[5] >= least], key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted([tuple(r[:5]) for r in out], key=str)


def _rows(words):
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(words[:400]).title() for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(500, None), (501, ""), (502, "..."), (503, "ÀÉ Straße ÀÉ x_y-z 12 中文 İstanbul " * 9), (None, "a b " * 30), (504, "long " * 40_000)]
    return rows + [(7, rows[7][1])] * 3 + [(505, "same words here " * 10)] * 200


@pytest.mark.parametrize("longest", [1, 2])
def test_against_plain_version(spark, words, longest):
    rows, target = _rows(words), [" ".join(words[:30]), None, "", words[3] * 2]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, rank string")
    wished = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = I.resample(spark, docs, wished, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == _plain(rows, target, longest)


def test_ties_everywhere_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 20)] * 500 + [(2, "w " * 20)] * 30, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = sorted([tuple(r) for r in I.resample(spark, docs, none).collect()], key=str)
    assert got == _plain([(1, "w " * 20)] * 500 + [(2, "w " * 20)] * 30, [])
    assert sum(r[4] is not None for r in got) == 53
    assert I.resample(spark, docs.limit(0), none).count() == 0


def test_texts_are_read_once_and_only_counts_shuffle(spark, words):
    docs = spark.createDataFrame(_rows(words), "doc_id long, text string")
    arrays = I.bucketed(docs, docs["doc_id"], "text", 1, 10_000)
    plan = I.score_documents(arrays, [1] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan and "split(1," not in plan
