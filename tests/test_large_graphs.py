"""Whole jobs on large graphs: scripts in parts, components by union-find, walks over dealt steps, layouts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import arrange, scripts, traverse


def _links(spark, pairs):
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "s string, t string, pos long")


def test_local_script_has_no_limit_and_gives_what_the_whole_graph_gives(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(700)]
    pairs = list(dict.fromkeys((a, b) for a, b in pairs if a != b))
    nodes, links = spark.createDataFrame([(f"n{k}", k) for k in range(95)], "id string, pos long"), _links(spark, pairs)
    for source in (
        "def run(graph):\n    return {k: len(set(v)) for k, v in graph['neighbors'].items()}",
        "def run(graph):\n    return {k: ' '.join(v) for k, v in graph['neighbors'].items() if v}",
        "def run(graph):\n    out = {n['id']: 0 for n in graph['nodes']}\n    for e in graph['edges']:\n        out[e['source']] = out.get(e['source'], 0) + 1\n    return out",
    ):
        whole = sorted(map(tuple, scripts.script_values(spark, source, nodes, links).collect()))
        assert sorted(map(tuple, scripts.script_values(spark, source, nodes, links, local=True, part_ends=100).collect())) == whole
    with pytest.raises(ValueError):
        scripts.script_values(spark, source, nodes, links, mode="layout", local=True)


def test_local_script_beyond_the_whole_graphs_limit(spark):
    links = spark.range(200_100).selectExpr("concat('a', id) AS s", "concat('b', id % 1000) AS t", "id AS pos")
    nodes = links.select(F.col("s").alias("id"), "pos").unionByName(links.select(F.col("t").alias("id"), "pos").dropDuplicates(["id"]))
    got = scripts.script_values(spark, "def run(graph):\n    return {k: len(v) for k, v in graph['neighbors'].items()}", nodes, links, local=True)
    assert got.groupBy(F.length("id") > 0).agg(F.count("*"), F.sum("value")).collect()[0][1:] == (201_100, 400_200.0)


def test_components_of_a_long_path_take_few_tables(spark, monkeypatch):
    from loomgraph.plans import scratch

    order = list(range(2000))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame([(str(a), str(b)) for a, b in zip(order, order[1:]) if a % 10 and b % 10], "s string, t string")
    up = {k: k for k in order}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in zip(order, order[1:]):
        if a % 10 and b % 10 and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    nodes, n, write = spark.range(2000).selectExpr("cast(id as string) AS id", "id AS rank"), [], scratch._write
    monkeypatch.setattr(scratch, "_write", lambda df, path: n.append(path) or write(df, path))
    got = {int(r["id"]): r["comp"] for r in traverse.component_labels(nodes, links).collect()}
    assert got == {k: root(k) for k in order} and len(n) <= 3


def _plain_pack(radii, gap=4.0):
    out = np.zeros((len(radii), 2))
    placed = []
    for k in np.argsort(-radii, kind="stable"):
        r, t = radii[k], 0.0
        while True:
            d = 0.6 * t
            at = np.array([d * math.cos(t), d * math.sin(t)])
            if all(((at - out[j]) ** 2).sum() >= (r + radii[j] + gap) ** 2 for j in placed):
                break
            t += max(0.1, min(1.0, r / (d + r)))
        out[k] = at
        placed.append(k)
    return out


def test_circles_of_one_size_go_on_along_the_spiral(monkeypatch):
    radii = 4 + np.random.default_rng(2).integers(0, 6, 120) / 3
    assert np.allclose(arrange.pack(radii), _plain_pack(radii), rtol=0, atol=1e-12)
    calls, cos = [], math.cos
    monkeypatch.setattr(arrange.math, "cos", lambda t: calls.append(t) or cos(t))
    arrange.pack(np.full(600, 5.0))
    assert len(calls) < 20_000


def test_circles_have_no_limit_and_are_packed_by_group(spark, monkeypatch):
    import numpy as np

    from loomgraph.operators import arrange

    monkeypatch.setattr(arrange, "MOST_MARKS", 20)
    rows = [(f"n{k:03d}", [None, "a", "b", "c"][k * k % 7 % 4], 4.0 + k % 5) for k in range(90)]
    got = {r["id"]: (r["x"], r["y"]) for r in arrange.layout(spark.createDataFrame(rows, "id string, group string, radius double"), "circlepack").collect()}
    members = {}
    for i, g, r in rows:
        members.setdefault(g, []).append((i, r))
    inner = {g: arrange.pack(np.array([r for _, r in m])) for g, m in members.items()}
    centres = arrange.pack(np.array([(np.hypot(*inner[g].T) + [r for _, r in m]).max() + 12 for g, m in members.items()]))
    want = {i: tuple(at + c) for (g, m), c in zip(members.items(), centres) for (i, _), at in zip(m, inner[g])}
    assert len(members) > 2 and got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_forces_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    n = 150
    pairs = rng.integers(0, n, (400, 2))
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    weights = rng.uniform(0, 2, len(pairs))
    at = np.random.default_rng(1).uniform(-1, 1, (n, 2)) * 10 * math.sqrt(n)
    mass = 1.0 + np.bincount(pairs.ravel(), minlength=n)
    push = np.zeros((n, 2))
    for i in range(n):
        for j in range(n):
            d = at[i] - at[j]
            push[i] += d * 10 * mass[i] * mass[j] / ((d**2).sum() + 1e-3)
        push[i] -= at[i] * mass[i] / (np.hypot(*at[i]) + 1e-3)
    for (a, b), w in zip(pairs, weights):
        push[a] += (at[b] - at[a]) * w
        push[b] -= (at[b] - at[a]) * w
    size = np.hypot(*push.T)
    speed = min(1.5, (mass * size).sum() / 2 / ((mass * size).sum() + 1e-9))
    at += push * np.minimum(speed / (1 + speed * np.sqrt(size)), 10 / (size + 1e-9))[:, None]
    assert np.allclose(arrange.forces(n, pairs, weights, rounds=1), at, rtol=0, atol=1e-8)


def test_forces_in_tasks_have_no_limit_and_are_those_of_one_task(spark, monkeypatch):
    from loomgraph.operators import arrange

    rng = random.Random(3)
    nodes = spark.createDataFrame([(f"n{k:03d}", None, 6.0) for k in range(150)], "id string, group string, radius double")
    pairs = sorted({(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(140), rng.randrange(140)) for _ in range(300)) if a != b})
    links = _links(spark, pairs).withColumn("w", F.lit(0.5))
    monkeypatch.setattr(arrange, "ROUNDS", 4, raising=False)
    want = {r["id"]: (r["x"], r["y"]) for r in arrange.layout(nodes, "force", links).collect()}
    monkeypatch.setattr(arrange, "MOST_MARKS", 20)
    monkeypatch.setattr(arrange, "MOST_LINKS", 20)
    monkeypatch.setattr(arrange, "ONE_TASK_MARKS", 20, raising=False)
    got = {r["id"]: (r["x"], r["y"]) for r in arrange.layout(nodes, "force", links).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def _sampled_paths(near, ids, step):
    """For every n/600th node as a source: distances, path counts and dependencies, by plain walks."""
    reached, between = {i: [] for i in ids}, dict.fromkeys(ids, 0.0)
    for s in ids[::step]:
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in near[v]:
                if u not in dist:
                    dist[u], sigma[u] = dist[v] + 1, 0.0
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if dist[v] == dist[u] - 1:
                    delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
            if u != s:
                between[u] += delta[u]
                reached[u].append(dist[u])
    return reached, between


def test_path_metrics_keep_no_row_for_a_source_and_node(spark, monkeypatch):
    from loomgraph.operators import metrics, waves
    from loomgraph.plans import scratch

    rng = random.Random(8)
    ids = [f"n{k}" for k in range(300)]
    pairs = sorted({(ids[a], ids[b]) for a, b in ((rng.randrange(290), rng.randrange(290)) for _ in range(450)) if a != b} | {("n1", f"n{k}") for k in range(30, 80)})
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    nodes, links = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos long"), _links(spark, pairs).withColumn("w", F.lit(1.0))
    for name, value in {"SIDE": 64, "WIDTH": 16, "PACKED": 200, "TASKS": 6, "COUNTED": 64}.items():
        monkeypatch.setattr(waves, name, value)
    written, write = [], scratch._write

    def counted(df, path, *more):
        out = write(df, path, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(scratch, "_write", counted)
    most = 150
    reached, between = _sampled_paths(near, ids, 2)
    got = {r["id"]: r["betweenness"] for r in metrics.betweenness(nodes, links, most).collect()}
    assert got == pytest.approx({i: x * 300 / 150 / 2 * 2 / (299 * 298) for i, x in between.items()})
    close = {r["id"]: r["closeness"] for r in metrics.closeness(nodes, links, most).collect()}
    among = {i: most - (k % 2 == 0) for k, i in enumerate(ids)}
    assert close == pytest.approx({i: len(d) / among[i] * len(d) / sum(d) if d else 0.0 for i, d in reached.items()})
    row = metrics.network(nodes, links, most).first()
    every = [d for x in reached.values() for d in x]
    assert row["diameter"] == max(every) and row["average_path"] == pytest.approx(sum(every) / len(every)) and row["approximate"]
    assert max(written) <= 2 * len(pairs)


def _beyond_samples(spark):
    """A graph of more nodes than a sample has sources: ids, nodes, links, and what walks from every node tell."""
    rng = random.Random(5)
    ids = [f"n{k}" for k in range(640)]
    pairs = sorted({(ids[a], ids[b]) for a, b in ((rng.randrange(630), rng.randrange(630)) for _ in range(800)) if a != b})
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    nodes = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos long")
    return ids, nodes, _links(spark, pairs).withColumn("w", F.lit(1.0)), _sampled_paths(near, ids, 1)


def test_betweenness_starts_from_every_node(spark, monkeypatch):
    from loomgraph.operators import metrics

    ids, nodes, links, (_, between) = _beyond_samples(spark)
    monkeypatch.setattr(metrics, "TURN_BYTES", 8 * 640 * 256)
    got = {r["id"]: r["betweenness"] for r in metrics.betweenness(nodes, links).collect()}
    assert got == pytest.approx({i: x / 2 * 2 / (639 * 638) for i, x in between.items()})


def test_path_lengths_start_from_every_node(spark, monkeypatch):
    from loomgraph.operators import metrics

    ids, nodes, links, (reached, _) = _beyond_samples(spark)
    monkeypatch.setattr(metrics, "TURN", 256)
    monkeypatch.setattr(metrics, "TURN_BYTES", 0)
    close = {r["id"]: r["closeness"] for r in metrics.closeness(nodes, links).collect()}
    assert close == pytest.approx({i: len(d) / 639 * len(d) / sum(d) if d else 0.0 for i, d in reached.items()})
    row, every = metrics.network(nodes, links).first(), [d for x in reached.values() for d in x]
    assert row["diameter"] == max(every) and row["average_path"] == pytest.approx(sum(every) / len(every)) and not row["approximate"]


def test_harmonic_is_exact_at_any_size(spark, monkeypatch):
    from loomgraph.operators import metrics

    ids, nodes, links, (reached, _) = _beyond_samples(spark)
    monkeypatch.setattr(metrics, "EXACT_HARMONIC", 10, raising=False)
    got = {r["id"]: r["harmonic"] for r in metrics.harmonic(nodes, links).collect()}
    assert got == pytest.approx({i: sum(1 / d for d in x) / 639 for i, x in reached.items()}, rel=1e-9)


def test_triangles_meet_as_lists_of_numbers(spark, monkeypatch):
    from loomgraph.operators import triads

    pairs = [(a, b) for a in "abcde" for b in "abcde" if a < b] + [("e", "f")]
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "v string, n string")
    tables, cut = [], triads.cut
    monkeypatch.setattr(triads, "cut", lambda df, *more: tables.append(dict(df.dtypes)) or cut(df, *more))
    assert {frozenset(r) for r in triads.listing(both).collect()} == {frozenset((a, b, c)) for a in "abcde" for b in "abcde" for c in "abcde" if a < b < c}
    assert {"a": "int", "b": "int", "c": "int"} in tables and tables[-1] == {"a": "string", "b": "string", "c": "string"}


def test_coreness_broadcasts_no_values(spark, monkeypatch):
    from loomgraph.operators import metrics
    from loomgraph.plans import bucketed

    plans, save = [], bucketed.Buckets.save
    monkeypatch.setattr(bucketed.Buckets, "save", lambda self, df, *more, **how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, *more, **how))
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a < b] + [("d", "e"), ("e", "f"), ("f", "d"), ("f", "g")]
    nodes = spark.createDataFrame([(i, k) for k, i in enumerate("abcdefgh")], "id string, pos long")
    got = metrics.coreness(nodes, _links(spark, pairs).withColumn("w", F.lit(1.0)))
    assert {r["id"]: r["coreness"] for r in got.collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 2, "f": 2, "g": 1, "h": 0}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("a_bucket", [2_000_000, 60])
def test_coreness_of_a_long_path_takes_few_rounds(spark, monkeypatch, a_bucket):
    from loomgraph.operators import metrics
    from loomgraph.plans import bucketed

    rng = random.Random(4)
    pairs = [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(79)]
    if a_bucket < 1000:
        pairs = sorted({(f"n{rng.randrange(40)}", f"m{rng.randrange(40)}") for _ in range(130)}) + pairs[:9]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    value = {i: len(x) for i, x in near.items()}
    while True:
        new = {i: max(k for k in range(len(near[i]) + 1) if sum(value[j] >= k for j in near[i]) >= k) for i in near}
        if new == value:
            break
        value = new
    saved, save = [], bucketed.Buckets.save
    monkeypatch.setattr(bucketed.Buckets, "save", lambda self, *more, **how: saved.append(1) or save(self, *more, **how))
    monkeypatch.setattr(metrics, "ROWS_A_BUCKET", a_bucket, raising=False)
    nodes = spark.createDataFrame([(i, k) for k, i in enumerate(sorted(near))], "id string, pos long")
    got = {r["id"]: r["coreness"] for r in metrics.coreness(nodes, _links(spark, pairs).withColumn("w", F.lit(1.0))).collect()}
    assert got == value and (len(saved) == 3 if a_bucket > 1000 else len(saved) > 3)
