"""Communities on larger graphs: label spreading exchanges labels, not votes; the exact method holds arrays, not ids."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import community
from loomgraph.plans import bucketed


def _graph(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(m)})
    pairs = [(a, b, float(rng.randrange(1, 9))) for a, b in pairs if a != b]
    nodes = spark.createDataFrame([(f"n{k:04d}", k) for k in range(n)], "id string, pos long")
    return pairs, nodes, spark.createDataFrame([(f"n{a:04d}", f"n{b:04d}", w) for a, b, w in pairs], "s string, t string, w double")


def _spread(spark, n, pairs, rounds=100):
    """Label spreading as it is defined: all votes of a round, half of the nodes move."""
    near = defaultdict(dict)
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    label = list(range(n))
    for k in range(rounds):
        moves = [r[0] for r in spark.range(n).orderBy("id").select(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0).collect()]
        wish = []
        for v in range(n):
            votes = defaultdict(float)
            for u, w in near[v].items():
                votes[label[u]] += w
            wish.append(max(votes, key=lambda c: (votes[c], -c)) if votes else label[v])
        if wish == label:
            return label, True
        label = [w if m else x for x, w, m in zip(label, wish, moves)]
    return label, False


@pytest.mark.parametrize("most_told, a_bucket", [(4_000_000, 2_000_000), (5, 10)])
def test_label_spreading_exchanges_no_votes(spark, monkeypatch, most_told, a_bucket):
    pairs, nodes, links = _graph(spark, 90, 260, 4)
    plans, save = [], bucketed.Buckets.save
    monkeypatch.setattr(bucketed.Buckets, "save", lambda self, df, *more, **how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, *more, **how))
    monkeypatch.setattr(community, "MOST_TOLD", most_told)
    arcs = bucketed.arcs
    monkeypatch.setattr(community, "arcs", lambda dealt, links, rows: arcs(dealt, links, rows, a_bucket))
    got = community.communities(nodes, links, most_pairs=1).collect()
    label, settled = _spread(spark, 90, pairs)
    assert {r["id"]: int(r["community"]) for r in got} == {f"n{k:04d}": c for k, c in enumerate(label)}
    assert {r["method"] for r in got} == {"label spreading" if settled else "label spreading, not settled"}
    if a_bucket > 90:
        rounds = [p for p in plans if "max_by" in p]
        assert rounds and not any(re.search(r"Exchange hashpartitioning", p) for p in rounds)


def test_stability_runs_in_tasks_of_numbers(spark, monkeypatch):
    pairs, nodes, links = _graph(spark, 120, 300, 6)
    tasks, run = [], community._stability
    monkeypatch.setattr(community, "_stability", lambda held, *more: tasks.append(dict(held.dtypes)) or run(held, *more))
    got = {r["id"]: r for r in community.communities(nodes, links, stable=True).collect()}
    base = community.louvain_labels(120, pairs)
    share = community.stability(120, pairs, base)
    assert [got[f"n{k:04d}"]["community"] for k in range(120)] == [str(c) for c in base]
    assert [got[f"n{k:04d}"]["stability"] for k in range(120)] == share and min(share) < 1
    assert got["n0000"]["modularity"] == pytest.approx(community.modularity(120, pairs, base))
    assert tasks == [{"a": "int", "b": "int", "w": "double"}]


def test_communities_without_links(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "id string, pos long")
    links = spark.createDataFrame([], "s string, t string, w double")
    got = sorted(map(tuple, community.communities(nodes, links, stable=True).collect()))
    assert got == [("a", "0", 1.0, 0.0, "louvain"), ("b", "1", 1.0, 0.0, "louvain")]
    assert community.communities(nodes.limit(0), links).count() == 0


def test_communities_are_exact_at_any_size(spark, monkeypatch):
    pairs, nodes, links = _graph(spark, 120, 300, 6)
    monkeypatch.setattr(community, "MOST_PAIRS", 10, raising=False)
    got = {r["id"]: r for r in community.communities(nodes, links).collect()}
    assert [got[f"n{k:04d}"]["community"] for k in range(120)] == [str(c) for c in community.louvain_labels(120, pairs)]
    assert {r["method"] for r in got.values()} == {"louvain"}
