"""The Jaccard join against brute force, with crowds forced by small limits."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import graph_parts as G
from loomgraph.llm import near_duplicates as N


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    shared = collections.Counter(p for ids in at.values() for p in itertools.combinations(sorted(ids), 2))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(4)
    out = []
    add = lambda t: out.append((len(out) * 3 + 1, t))
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 5, 40])):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                q, kind = rng.randrange(len(x)), rng.random()
                if kind < 0.4:
                    x[q] = rng.choice(words)
                elif kind < 0.7:
                    x.insert(q, rng.choice(words))
                elif len(x) > 6:
                    del x[q]
            add(" ".join(x))
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(60):
        add(" ".join([rng.choice(words) for _ in range(rng.randint(1, 40))] + passage + [rng.choice(words) for _ in range(rng.randint(1, 40))]))
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(60):
        chain = list(chain)
        chain[rng.randrange(100)] = rng.choice(words)
        add(" ".join(chain))
    for t in ["", "a", "A", "a b", "a  B", "a b c d", "A b C d e", "a b c d e", " \n", None, "É é", "é é", "z " * 30000]:
        add(t)
    return out


@pytest.mark.parametrize("limits", [{}, {"crowd": 3}, {"crowd": 8, "most_crowded": 50}])
def test_components(spark, rows, limits, monkeypatch):
    monkeypatch.setattr(N, "_CROWD_ROWS", 16)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, name int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_components(spark, df, **limits).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert N.jaccard_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_of_long_words_and_chunks():
    texts = ["x" * 3000 + " y z " * 3, None, "", "a b c d e f", "A B C D E F"]
    sets = N.shingle_sets(pa.array(texts))
    small, at = N.word_hashes(np.frombuffer(b"aa bb cc aa", np.uint8), np.array([0, 11]), chunk=3)
    assert small[0] == small[3] and len(set(small.tolist())) == 3 and at.tolist() == [0, 4]
    assert [len(s) for s in sets] == [3, 0, 0, 2, 2] and (sets[3] == sets[4]).all()


@pytest.mark.parametrize("n", [300, 600])
def test_pages_of_a_template_do_not_meet(spark, words, n, monkeypatch):
    """Rows that share much of a template, but not enough to be linked, are not dealt against each other."""
    rng, dealt = random.Random(6), []
    template = [rng.choice(words) for _ in range(80)]
    rows = [(k, " ".join([*(rng.choice(words) for _ in range(10)), *template, *(rng.choice(words) for _ in range(10))])) for k in range(n)]
    rows += [(n + k, " ".join([*words[:20], *template, str(k)])) for k in range(3)]  # these are linked
    monkeypatch.setattr(N, "_CROWD_ROWS", 16)
    save = N.Scratch.save

    def saved(self, df, name):
        out = save(self, df, name)
        if name in ("crowd-left", "crowd-right", "crowd-suited", "pairs"):
            dealt.append((name, out.count()))
        return out

    monkeypatch.setattr(N.Scratch, "save", saved)
    out = N.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: min(k, n) for k in range(n + 3)}
    assert dict(dealt)["crowd-suited"] <= 10 and all(k <= 40 for name, k in dealt if name != "crowd-suited")


@pytest.mark.parametrize("held", [1_000_000, 40])
def test_components_by_tasks_and_by_steps(spark, tmp_path, held, monkeypatch):
    """Edges that one task holds, and edges for which steps are needed, get the same labels."""
    rng = random.Random(held)
    nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    edges = [(a, b) for a, b in zip(nodes[:120], nodes[1:120])]  # a chain
    edges += [(nodes[120], b) for b in nodes[121:240]]  # a hub
    edges += [tuple(rng.sample(nodes[240:], 2)) for _ in range(90)] + edges[:20] + [(nodes[399], nodes[399])]
    rng.shuffle(edges)
    monkeypatch.setattr(G, "HELD", held)
    spark.createDataFrame(edges, "a long, b long").repartition(7).write.parquet(f"{tmp_path}/edges")
    scratch = N.Scratch(spark, "components")
    up = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    read = spark.read.parquet(f"{tmp_path}/edges")
    assert sorted(map(tuple, G.components(read, scratch, "e").collect())) == sorted((n, root(n)) for n in up)
    assert G.components(read.limit(0), scratch, "none").count() == 0


def test_rows_that_stand_with_every_part_are_not_broadcast(spark):
    """Their file is small whatever their number, so the plan must not go by its size (3,159,921 rows in 1.4 MB ended a
    driver of 750 MB)."""
    plans = {}

    class Told(N.Scratch):
        def save(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().save(df, name)

    scratch, rng = Told(spark, "told"), np.random.default_rng(5)
    pool = rng.integers(1, 1 << 63, 150, dtype=np.uint64)
    own = [np.sort(rng.choice(pool, 20, replace=False)) for _ in range(1400)]
    own[1399] = np.sort(np.append(own[0][1:], pool[~np.isin(pool, own[0])][:1]))  # near the first
    own[1398] = np.sort(np.append(own[1][1:], pool[~np.isin(pool, own[1])][:1]))
    sets = scratch.save(spark.createDataFrame([(k, f.tobytes()) for k, f in enumerate(own)], "name long, found binary"), "given")
    edges = spark.createDataFrame([(0, k) for k in range(1, 1400)], "a long, b long")
    columns = spark.sparkContext.broadcast((N._Crowded(N._split(pool, 256)), True, 256))
    crowds = N.Crowds(edges, columns, sets, lambda batch: N.unpacked(batch.column("found").to_pylist()))
    comps = N._crowd_components(crowds, sets, spark.createDataFrame([], "a long, b long"), scratch, 80)
    assert sorted(map(tuple, comps.where("node <> comp").collect())) == [(1398, 1), (1399, 0)]
    assert "BroadcastHashJoin" not in plans["crowd-second"] and plans["crowd-second"].count("SortMergeJoin") == 2
