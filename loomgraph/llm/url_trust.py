"""URL filter: rules first, then trust and distrust propagated over the host graph.

Explicit rules judge what they fit (the longest rule that fits a url wins). Every other url gets its host's
verdict. Trust is personalised PageRank along host edges (links found in the pages), restarted at hosts in
proportion to the share of their pages that rules allow; distrust is the same on the reversed edges, restarted
in proportion to the share that rules block: who links to blocked hosts inherits their distrust. A host is
blocked when its distrust reaches `block_at` and exceeds its trust. A blocked host's distrust is split over all that
link to it, so with `relative` (the default) a host is also blocked when the damped chance that its links lead to
blocked pages (`host_inherited`) reaches `block_at` and exceeds its trust: that chance is split over the linking
host's own links, so it is the same with one linker or a million. Built-in expressions only.

Links are counted per (host, host) before they are shuffled; rounds run over hosts, not pages, several to a table in
the shared folder, which cuts their lineage. They end when no score can change by more than `tolerance` times the
seeds any more (what is left is damping / (1 - damping) times the last change); more than `rounds` are an error. Verdicts are broadcast up to `broadcast_hosts` hosts; beyond that
pages join them on (host, salt), so that a host with a third of all pages is dealt to many tasks.

Cases: a null url or one without `://` has host and path '' and is judged as that host; null html has no links;
repeated pages are judged each; ties between equally long rules go to the first in the table; an empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; rules: (verdict, 'host/path')."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: pages of src that link to dst; links inside a host don't count."""
    links = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_HREF), F.lit(1)), lambda x: url_host(F.concat(F.lit("x://"), F.regexp_extract(x, r"(?s)^[^/]*//(.*)", 1))))
    found = pages.select(url_host(F.col(url)).alias("src"), F.array_distinct(links).alias("to"))
    each = found.select("src", F.explode(F.filter("to", lambda x: (x != "") & (x != F.col("src")))).alias("dst"))
    return each.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


#: Rounds that one table takes.
_STRIDE = 4


def _shares(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    totals = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return scratch.save(edges.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), f"{name}-shares")


def _converged(state: DataFrame, step: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """Steps from state (with seed, value and all else that a step needs) until the values stay."""
    state, done = scratch.save(state, f"{name}-0"), 0
    while True:
        if done >= rounds:
            raise RuntimeError(f"{name}: no convergence in {done} rounds")
        new = state
        for _ in range(_STRIDE):
            new = step(new)
        new = scratch.save(new, f"{name}-{done + _STRIDE}")
        left = new.agg(F.sum(F.abs(F.col("value") - F.col("was"))).alias("d"), F.sum("seed").alias("s")).first()
        scratch.drop(f"{name}-{done}")
        state, done = new.drop("was"), done + _STRIDE
        if (left["d"] or 0.0) * damping / (1 - damping) <= tolerance * (left["s"] or 0.0):
            return state


def propagate(spark: SparkSession, seeds: DataFrame, edges: DataFrame, scratch: Scratch, name: str, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """host, score: personalised PageRank in which a host without links hands nothing on. seeds: host, seed."""
    shares = _shares(edges, scratch, name)
    start = seeds.select("host", "seed", ((1 - damping) * F.col("seed")).alias("value"))
    if shares.isEmpty():
        return scratch.save(start.select("host", F.col("value").alias("score")), f"{name}-0")

    def step(now: DataFrame) -> DataFrame:
        sent = shares.join(now.select(F.col("host").alias("src"), "value"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("value")).alias("got"))
        return now.join(sent, "host", "left").select("host", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("value"), F.col("value").alias("was"))

    return _converged(start, step, scratch, name, damping, rounds, tolerance).select("host", F.col("value").alias("score"))


def inherited(spark: SparkSession, seeds: DataFrame, edges: DataFrame, scratch: Scratch, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """host, got: the chance that who follows the host's links, on with `damping` at each step, meets a blocked page."""
    shares = _shares(edges, scratch, "inherited")
    start = seeds.select("host", "seed", F.lit(0.0).alias("value"))
    if shares.isEmpty():
        return scratch.save(start.select("host", F.col("value").alias("got")), "inherited-0")

    def step(now: DataFrame) -> DataFrame:
        met = now.select(F.col("host").alias("dst"), (F.col("seed") + (1 - F.col("seed")) * F.col("value")).alias("met"))
        led = shares.join(met, "dst").groupBy(F.col("src").alias("host")).agg((damping * F.sum(F.col("share") * F.col("met"))).alias("led"))
        return now.join(led, "host", "left").select("host", "seed", F.coalesce("led", F.lit(0.0)).alias("value"), F.col("value").alias("was"))

    return _converged(start, step, scratch, "inherited", damping, rounds, tolerance).select("host", F.col("value").alias("got"))


def filter_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = 0.85,
    rounds: int = 1000,
    tolerance: float = 1e-7,
    block_at: float = 0.5,
    broadcast_hosts: int = 100_000,
    salts: int = 64,
    relative: bool = True,
) -> DataFrame:
    """key, host, path, rule, verdict, host_trust, host_distrust, and with `relative` host_inherited."""
    scratch = Scratch(spark, "url-trust")
    judged = pages.select(F.col(key).alias("__key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    judged = judged.withColumn("__rule", match_rule(F.col("host"), F.col("path"), rules))
    is_ = lambda v: F.sum(F.when(F.col("__rule.verdict") == v, 1).otherwise(0))
    stats = judged.groupBy("host").agg(F.count("*").alias("n"), is_("allow").alias("allowed"), is_("block").alias("blocked"))
    edges = scratch.save(host_edges(pages, url, html), "edges")
    linked = edges.select(F.col("dst").alias("host")).distinct()
    stats = scratch.save(stats.join(linked, "host", "full").na.fill({"n": 1, "allowed": 0, "blocked": 0}), "stats")
    trust = propagate(spark, stats.select("host", (F.col("allowed") / F.col("n")).alias("seed")), edges, scratch, "trust", damping, rounds, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(spark, stats.select("host", (F.col("blocked") / F.col("n")).alias("seed")), back, scratch, "distrust", damping, rounds, tolerance)
    scale = 1.0 / (1 - damping)
    hosts = trust.select("host", (F.col("score") * scale).alias("host_trust")).join(distrust.select("host", (F.col("score") * scale).alias("host_distrust")), "host")
    blocked = (F.round("host_distrust", 9) >= block_at) & (F.col("host_distrust") > F.col("host_trust"))
    told = ["host_trust", "host_distrust"]
    if relative:
        led = inherited(spark, stats.select("host", (F.col("blocked") / F.col("n")).alias("seed")), edges, scratch, damping, rounds, tolerance)
        hosts = hosts.join(led.select("host", F.col("got").alias("host_inherited")), "host")
        blocked |= (F.round("host_inherited", 9) >= block_at) & (F.col("host_inherited") > F.col("host_trust"))
        told.append("host_inherited")
    hosts = scratch.save(hosts.withColumn("__host_verdict", F.when(blocked, "block").otherwise("allow")), "hosts")
    if hosts.count() <= broadcast_hosts:
        joined = judged.join(F.broadcast(hosts), "host", "left")
    else:
        salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = judged.withColumn("__salt", F.pmod(F.xxhash64("__key", "path"), F.lit(salts)).cast("int")).join(salted, ["host", "__salt"], "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.col("__host_verdict"))
    return joined.select(F.col("__key").alias(key), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), *told)
