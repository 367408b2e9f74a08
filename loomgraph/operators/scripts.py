"""User functions over the whole graph: Python source that gives values by node, by link, or positions.

The source runs in a process of its own with a deadline, a memory limit, few builtins, a seeded random generator and
a fixed clock. That is a guard against mistakes, not a sandbox against attacks.

A source that may look anywhere needs the whole graph in one process, which has limits. One whose value for a node
depends on that node's links and neighbours only (`local`) runs in tasks, over parts of the nodes, at any size."""

from __future__ import annotations

import json
import math
import subprocess
import sys
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut

#: Ends of links in a part of a local script's graph, about.
PART_ENDS = 50_000

_RUNNER = r"""
import json, math, random, resource, sys
resource.setrlimit(resource.RLIMIT_AS, (int(sys.argv[1]) << 20,) * 2)
source, graph = json.load(sys.stdin)
random.seed(1)
names = "abs all any bool dict divmod enumerate filter float frozenset int isinstance len list map max min pow range repr reversed round set sorted str sum tuple zip ValueError KeyError".split()
held = {n: (__builtins__ if isinstance(__builtins__, dict) else vars(__builtins__))[n] for n in names}
scope = {"__builtins__": held, "math": math, "random": random, "now": 0}
exec(source, scope)
json.dump(scope["run"](graph), sys.stdout)
"""


def run_script(source: str, graph: dict[str, Any], seconds: float = 3.0, megabytes: int = 512) -> dict[str, Any]:
    """What the source's `run(graph)` gives; graph: nodes, edges, neighbors, directed."""
    try:
        done = subprocess.run([sys.executable, "-I", "-c", _RUNNER, str(megabytes)], input=json.dumps([source, graph]), capture_output=True, text=True, timeout=seconds)
    except subprocess.TimeoutExpired as e:
        raise TimeoutError(f"the script took more than {seconds:g} s") from e
    if done.returncode:
        raise ValueError(done.stderr.strip().splitlines()[-1] if done.stderr.strip() else "the script failed")
    out = json.loads(done.stdout)
    if not isinstance(out, dict):
        raise ValueError("a script has to give values by key")
    return out


def graph_payload(nodes: DataFrame, links: DataFrame, limit: int = 200_000) -> dict[str, Any]:
    ids = [r["id"] for r in nodes.orderBy("pos").select("id").limit(limit + 1).collect()]
    rows = [(r["s"], r["t"]) for r in links.orderBy("pos").select("s", "t").limit(limit + 1).collect()]
    if len(ids) > limit or len(rows) > limit:
        raise ValueError(f"scripts take up to {limit} nodes and links")
    near: dict[str, list[str]] = {i: [] for i in ids}
    for s, t in rows:
        near[s].append(t)
        near[t].append(s)
    return {"nodes": [{"id": i} for i in ids], "edges": [{"source": s, "target": t} for s, t in rows], "neighbors": near, "directed": True}


def _is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _part_payload(rows: pd.DataFrame) -> dict[str, Any]:
    """The graph that a part's script sees: the part's nodes in document order, all their links and neighbours."""
    own = rows[rows["other"].isna()].sort_values(["late", "at", "id"])["id"].tolist()
    near: dict[str, list[str]] = {i: [] for i in own}
    edges: dict[tuple[str, str], None] = {}
    # Of a pair of links with one place, in order of their ends; a link with both ends in the part comes twice.
    ends = rows[rows["other"].notna()].sort_values(["at", "s", "t"])
    for i, other, s, t in zip(ends["id"], ends["other"], ends["s"], ends["t"]):
        near[i].append(other)
        edges[s, t] = None
    return {"nodes": [{"id": i} for i in own], "edges": [{"source": s, "target": t} for s, t in edges], "neighbors": near, "directed": True}


def _local_values(source: str, nodes: DataFrame, links: DataFrame, part_ends: int) -> DataFrame:
    """id, value. Of the values that a part gives, those of its own nodes count."""
    parts = -(-2 * links.count() // part_ends) or 1
    end = lambda one, two: F.struct(F.col(one).alias("id"), F.col(two).alias("other"))
    ends = links.select("s", "t", F.col("pos").alias("at"), F.explode(F.array(end("s", "t"), end("t", "s"))).alias("e"))
    rows = ends.select("e.id", "e.other", "s", "t", "at", F.lit(0).alias("late"))
    none = F.lit(None).cast("string")
    place = (F.col("pos.pos"), F.col("pos.late")) if "struct" in nodes.schema["pos"].dataType.simpleString() else (F.col("pos"), F.lit(0))
    rows = rows.unionByName(nodes.select("id", none.alias("other"), none.alias("s"), none.alias("t"), place[0].cast("long").alias("at"), place[1].alias("late")))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        payload = _part_payload(table)
        out = run_script(source, payload)
        kept = [(i, out[i]) for i in payload["neighbors"] if i in out and (out[i] is None or isinstance(out[i], (str, int, float, bool)))]
        text = [None if v is None else str(v) for _, v in kept]
        return pd.DataFrame({"id": [i for i, _ in kept], "number": pd.array([float(v) if _is_number(v) else None for _, v in kept], "Float64"), "text": text, "plain": [v is None or _is_number(v) for _, v in kept]})

    dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    found = cut(dealt.applyInPandas(run, "id string, number double, text string, plain boolean"))
    number = found.where("NOT plain").isEmpty()
    return found.select("id", F.col("number" if number else "text").alias("value"))


def script_values(spark, source: str, nodes: DataFrame, links: DataFrame, mode: str = "node", local: bool = False, part_ends: int = PART_ENDS) -> DataFrame:
    """id, value; s, t, value; or id, x, y. Values that are no numbers make the column text. local: a node's value depends
    on its own links and neighbours only, and the source may be given the graph in parts (nodes' values only)."""
    if local:
        if mode != "node":
            raise ValueError("local scripts give values by node")
        return _local_values(source, nodes, links, part_ends)
    out = run_script(source, graph_payload(nodes, links))
    if mode == "layout":
        rows = [(str(k), float(v["x"]), float(v["y"])) for k, v in out.items() if isinstance(v, dict) and all(isinstance(v.get(c), (int, float)) and math.isfinite(v[c]) for c in "xy")]
        return spark.createDataFrame(rows, "id string, x double, y double")
    values = {k: v for k, v in out.items() if v is None or isinstance(v, (str, int, float, bool))}
    number = all(v is None or _is_number(v) for v in values.values())
    cast = lambda v: None if v is None else float(v) if number else str(v)
    kind = "double" if number else "string"
    if mode == "node":
        return spark.createDataFrame([(str(k), cast(v)) for k, v in values.items()], f"id string, value {kind}")
    rows = [(*[x.strip() for x in k.split("->", 1)], cast(v)) for k, v in values.items() if "->" in k]
    return spark.createDataFrame(rows, f"s string, t string, value {kind}")
