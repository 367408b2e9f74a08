"""What holds at any size: positions from files, triangles once, walks in bits, counters, buckets, kept directories and statistics."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.model import POS, Mapping, with_positions
from loomgraph.operators import frames, metrics, stats, traverse, triads
from loomgraph.plans import bucketed
from loomgraph.plans.bucketed import Buckets
from loomgraph.sources import formats
from loomgraph.sources.datasource import DataSource, Selection
from loomgraph.sources.directory import NodeDirectory, parts
from loomgraph.sources.file_stats import FileStatistics


def _graph(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})
    links = spark.createDataFrame([(a, b, 1.0) for a, b in pairs if a != b], "s string, t string, w double")
    near = {f"n{k}": set() for k in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return spark.createDataFrame([(f"n{k}", k) for k in range(n)], "id string, pos long"), links, near


def _distances(near, source):
    out, frontier, hop = {source: 0}, [source], 0
    while frontier:
        hop += 1
        frontier = sorted({b for a in frontier for b in near[a]} - out.keys())
        out |= {i: hop for i in frontier}
    return out


def test_positions_are_those_of_the_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(0, 4000, 1, 3).selectExpr("id", "cast(id % 7 as string) AS k", "repeat('x', 200) AS pad").write.option("parquet.block.size", 50_000).parquet(path)
    for size in ("134217728", "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = formats.read_table(spark, path)
            got = [(r["id"], r[POS]) for r in df.select("id", POS).collect()]
            assert sorted(p for _, p in got) == list(range(4000)) and all(i == p for i, p in got)
            some = df.where("id >= 3000 AND k = '3'")
            assert all(r["id"] == r[POS] for r in some.select("id", POS).collect()) and some.count() > 100
            plan = some._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThanOrEqual(id,3000)" in plan and "EqualTo(k,3)" in plan
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = with_positions(spark.read.parquet(path).where("id > 100").select("id"))
    assert all(r["id"] == r[POS] for r in one.collect())


def test_positions_of_text_files(spark, tmp_path):
    path = f"{tmp_path}/t.jsonl"
    spark.range(0, 3000, 1, 3).selectExpr("id", "repeat('y', 100) AS pad").write.json(path)
    for size in ("134217728", "15000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = formats.read_table(spark, path)
            assert all(r["id"] == r[POS] for r in df.select("id", POS).collect()) and df.count() == 3000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_triangles_are_listed_once_and_credited(spark, monkeypatch):
    nodes, links, near = _graph(spark, 40, 260, 1)
    pairs = [(r["s"], r["t"]) for r in links.collect()]
    for block in (20_000, 2):
        monkeypatch.setattr(triads, "BLOCK", block)
        listed = metrics.triangle_listing(links)
        assert {r["id"]: r["triangles"] for r in metrics.triangles(nodes, links, listed).collect()} == {a: sum(c in near[b] for b in near[a] for c in near[a] if b < c) for a in near}
        assert {(r["s"], r["t"]): r["embeddedness"] for r in metrics.embeddedness(links, listed).collect()} == {(a, b): len(near[a] & near[b]) for a, b in pairs}
    both = {(a, b) for a, b in pairs if (b, a) in set(pairs)}
    tied = {a: {y for x, y in both if x == a} for a in near}
    want = {(a, b): len(tied[a] & tied[b]) if (a, b) in both else 0 for a, b in pairs}
    assert {(r["s"], r["t"]): r["simmelian"] for r in metrics.simmelian(links).collect()} == want


def test_a_star_has_no_wedges(spark):
    star = spark.range(100_000).selectExpr("concat('leaf', id) AS v", "'hub' AS n")
    pairs = star.unionByName(star.selectExpr("n AS v", "v AS n"))
    edge = triads.oriented(pairs)
    assert edge.groupBy("a").count().agg(F.max("count")).first()[0] == 1
    assert triads.listing(pairs).count() == 0


def test_walks_in_bits(spark):
    nodes, links, near = _graph(spark, 150, 200, 2)
    want = {(b, s): d for s in near for b, d in _distances(near, s).items()}
    got = traverse.many_sources(links, nodes.select("id", F.col("pos").alias("number")))
    rows = got.collect()
    assert {(r["id"], f"n{64 * r['word'] + k}"): r["dist"] for r in rows for k in range(64) if r["bits"] >> k & 1} == want
    per = {}
    for r in rows:
        per.setdefault((r["id"], r["word"]), set()).add(r["dist"])
    assert len(rows) < len(want) / 3
    levels = traverse.source_levels(links, nodes.select("id"))
    assert sum(x.count() for x in levels) == len(want)
    exact = {r["id"]: r["harmonic"] for r in metrics.harmonic(nodes, links).collect()}
    assert exact == pytest.approx({b: sum(1 / d for s in near if (d := want.get((b, s)))) / 149 for b in near})


def test_harmonic_in_turns_and_by_counters(spark, monkeypatch):
    nodes, links, _ = _graph(spark, 600, 1200, 3)
    exact = {r["id"]: r["harmonic"] for r in metrics.harmonic(nodes, links).collect()}
    monkeypatch.setattr(metrics, "TURN", 256)
    assert {r["id"]: r["harmonic"] for r in metrics.harmonic(nodes, links, exact=True).collect()} == pytest.approx(exact)
    near = {r["id"]: r["harmonic"] for r in metrics.harmonic(nodes, links, exact=False).collect()}
    assert near.keys() == exact.keys() and all(abs(near[i] - x) <= 0.05 * x + 1e-9 for i, x in exact.items())


def _links_exchanged(plan: str) -> bool:
    """Does an exchange stand above the scan of the links and below its join?"""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and "share" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    low = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < low:
            low = depth(line)
            if "Join" in line:
                return False
            if "Exchange" in line:
                return True
    return True


def test_rounds_exchange_messages_only(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(50)}" if rng.random() < 0.7 else "hub", f"n{rng.randrange(50)}", rng.random()) for _ in range(600)]
    links = spark.createDataFrame(pairs, "id string, t string, share double")
    state = spark.createDataFrame([(f"n{k}", float(k)) for k in range(50)] + [("hub", 7.0)], "id string, rank double")
    want = {}
    rank = {f"n{k}": float(k) for k in range(50)} | {"hub": 7.0}
    for a, b, w in pairs:
        want[b] = want.get(b, 0) + rank[a] * w
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for a_bucket, heavy in ((None, False), (60, True)):
            dealt = Buckets(spark, 4)
            near = bucketed.arcs(dealt, links, len(pairs), a_bucket)
            assert (near.heavy is not None) == heavy
            got = near.sent(dealt.save(state, "id"), F.col("rank") * F.col("share"))
            if not heavy:
                assert not _links_exchanged(got._jdf.queryExecution().executedPlan().toString())
            assert {r["id"]: r["got"] for r in got.collect()} == pytest.approx(want)
            dealt.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_routes_are_walked_from_both_ends(spark):
    for seed in range(3):
        nodes, links, near = _graph(spark, 60, 110, 10 + seed)
        far = _distances(near, "n0")
        for target in sorted(far, key=lambda i: (-far[i], i))[:2]:
            routes = [["n0"]]
            for d in range(1, far[target] + 1):
                back = _distances(near, target)
                routes = [[*r, b] for r in routes for b in sorted(near[r[-1]]) if far.get(b) == d and back[b] == far[target] - d]
            count, found = traverse.shortest_routes(links, "n0", target, limit=1000)
            assert tuple(count.first()) == (len(routes), far[target])
            assert [r["route"] for r in found.collect()] == sorted(routes)
    # A long tail behind the source isn't walked.
    chain = [(f"x{k}", f"x{k + 1}", 1.0) for k in range(30)] + [("x0", f"leaf{k}", 1.0) for k in range(300)]
    links = spark.createDataFrame(chain, "s string, t string, w double")
    one, two = traverse.meeting_levels(links, "x2", "x5")
    assert sum(x.count() for x in [*one, *two]) < 15


def test_directory_searches_are_those_of_the_scan(spark, tmp_path):
    rng = random.Random(6)
    names = ["".join(rng.choice("abAB1 é") for _ in range(rng.randint(1, 9))).strip() or "z" for _ in range(300)] + ["aaa", "AAAA", "İx"]
    path = f"{tmp_path}/e.parquet"
    spark.createDataFrame([(rng.choice(names), rng.choice(names), k) for k in range(900)], "a string, b string, n long").write.parquet(path)
    source = DataSource(spark.read.parquet(path), Mapping("a", "b"))
    queries = ["a", "ab", "aba", "abab", "b1", "É", "zzz", "aaa", " ", "x", "1 a"]
    plain = {q: [r["id"] for r in source.search(q, 20).collect()] for q in queries}
    asked = source.lookup([names[3], " aaa ", "nobody", names[5]]).collect()
    kept = source.directory()
    assert {q: [r["id"] for r in source.search(q, 20).collect()] for q in queries} == plain
    assert source.lookup([names[3], " aaa ", "nobody", names[5]]).collect() == asked and kept.count() == source.ids().count()
    plan = source.search("aba")._jdf.queryExecution().executedPlan().toString()
    assert "/directory-" in plan and "e.parquet" not in plan and "PartitionFilters: [isnotnull(bin" in plan and "EqualTo(part,aba)" in plan
    again = NodeDirectory.of(spark.read.parquet(path), Mapping("a", "b"))
    assert again.root == kept.root and NodeDirectory.of(spark.read.parquet(path), Mapping("b", "a")).root != kept.root
    assert spark.range(1).select(parts(F.lit("abca")).alias("p")).first()["p"] == ["a", "b", "c", "ab", "bc", "ca", "abc", "bca"]


def test_a_walk_stops_at_its_budget(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "a string, b string")
    source = DataSource(edges, Mapping("a", "b"))
    assert source.reached(Selection(("n0",), 8, budget=3)).count() == 4 and source.reached(Selection(("n0",), 8)).count() == 9


def test_statistics_are_kept_by_file(spark, tmp_path):
    path, folder = f"{tmp_path}/s", f"{tmp_path}/kept"
    spark.range(0, 3000).selectExpr("id", "concat('k', id % 100) AS k", "if(id % 10 = 0, null, id * 0.5) AS x").coalesce(1).write.parquet(path)
    own = FileStatistics(spark, path, folder=folder)
    first = {r["column_name"]: r for r in own.merged().collect()}
    assert len(own.read_now) == 1 and first["k"]["filled"] == 3000 and first["k"]["numbers"] == 0 and first["k"]["quantiles"] is None and abs(first["k"]["n_distinct"] - 100) <= 4
    spark.range(3000, 6000).selectExpr("id", "concat('k', id % 150) AS k", "id * 0.5 AS x").coalesce(1).write.mode("append").parquet(path)
    again = FileStatistics(spark, path, folder=folder)
    whole = {r["column_name"]: r for r in again.merged((0.5,)).collect()}
    assert len(again.read_now) == 1
    x = whole["x"]
    assert (x["n_rows"], x["filled"], x["numbers"], x["low"], x["high"]) == (6000, 5700, 5700, 0.5, 2999.5) and abs(whole["k"]["n_distinct"] - 150) <= 6
    assert abs(whole["id"]["quantiles"][0] - 3000) < 150
    third = FileStatistics(spark, path, folder=folder)
    third.merged()
    assert third.read_now == []


def test_playback_is_the_windows_one_by_one(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abcde"), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([None, *range(0, 1000, 7)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "__s string, __t string, time long")
    low, high, width, step = 10.0, 900.0, 120.0, 50.0
    got = frames.playback(df, "time", low, high, width, step).orderBy("frame").collect()
    bounds = frames.frame_bounds(low, high, width, step)
    assert len(got) == len(bounds) == 18
    for r, (a, z) in zip(got, bounds):
        inside = [x for x in rows if x[2] is not None and a <= x[2] <= z]
        links = {(s, t) for s, t, _ in inside if t is not None and s != t}
        assert (r["start"], r["end"], r["rows"], r["links"], r["nodes"]) == (a, z, len(inside), len(links), len({e for p in links for e in p}))


def test_rows_of_a_hot_pair_are_numbered_by_ranges(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("a", "b", k) for k in range(500)] + [(rng.choice("abc"), rng.choice(["b", "c", None]), 500 + k) for k in range(300)]
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, f"s string, t string, {POS} long").repartition(5)
    want, seen = {}, {}
    for s, t, pos in sorted(rows, key=lambda r: r[2]):
        want[pos] = seen.get((s, t), 0)
        seen[s, t] = want[pos] + 1
    for hot in (1_000_000, 50):
        monkeypatch.setattr(model, "HOT_PAIR", hot)
        assert {r[POS]: r["__occ"] for r in model.occurrence(edges, Mapping("s", "t")).collect()} == want


def test_times_by_their_role(spark):
    df = spark.createDataFrame([(k, f"t{k}", 2000 + k) for k in range(5)], f"{POS} long, x string, y long")
    assert stats.time_columns(df, ["x", "y"]) == ["y"] and stats.time_columns(df, ["x", "y"], roles={"x": "time"}) == ["x", "y"]


def test_counters_meet_in_blocks_as_the_whole_walk_does(spark, monkeypatch):
    """Slices, buckets, blocks and hubs: registers and rounds are those of a walk in memory, link by link."""
    import numpy as np

    from loomgraph.operators import waves

    for name, value in {"SIDE": 64, "WIDTH": 64, "PACKED": 50, "TASKS": 12}.items():
        monkeypatch.setattr(waves, name, value)
    rng = np.random.default_rng(3)
    n, bits = 300, 8
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n - 5, (260, 2)) if a != b} | {(7, k) for k in range(40, 200)}
    links = sorted(pairs | {(b, a) for a, b in pairs})
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, n)
    numbered = spark.createDataFrame([(f"n{k}", k, int(h)) for k, h in enumerate(hashes)], "id string, number long, hash long")
    steps = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "a string, b string")
    cells = waves.hashed(bits)(numbered.toArrow(), n)
    powers = np.append(0.0, np.ldexp(1.0, -np.arange(1, 256)))
    a, b = np.array(links).T
    told = 0
    for tallies in waves.rounds(steps, numbered, n, ["hash"], waves.hashed(bits), waves.registers(bits)):
        got = np.zeros((n, 2))
        for r in tallies.collect():
            got[r["b"] * 64 : r["b"] * 64 + 64] += np.frombuffer(r["tally"]).reshape(-1, 2)
        assert np.allclose(got, np.stack((powers[cells].sum(1), (cells == 0).sum(1)), 1))
        new = cells.copy()
        np.maximum.at(new, b, cells[a])
        last, cells, told = (new == cells).all(), new, told + 1
    assert last and told > 3
    many = waves.hashed(12)(spark.range(50_000).selectExpr("xxhash64(id) AS hash").toArrow(), 50_000).max(0)
    assert waves.estimates(np.array([[powers[many].sum(), (many == 0).sum()]]), 12)[0] == pytest.approx(50_000, rel=0.05)
