"""Registered queries of the graph operators and the SQL that gives the same rows.

Graphs are derived from the driver's tables: UU, each user's event to the day's next event's user (with loops,
parallel and reciprocal rows, and blank ends); SP, supplier to part (bipartite, weighted); FG, customer to another
customer by arithmetic (many components); CN, customer to nation to region (a tree with a node table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import cells
from .model import POS, GraphDoc, Mapping, build_doc, derive_nodes, first_rows, occurrence, reconcile, with_positions
from .operators import arrange, columns, community, details, edits, frames, graph, metrics, overlay, scripts, stats, style, transforms, traverse
from .operators.chain import Condition, Step, apply_chain
from .plans.scratch import cut, dealt
from .sources.datasource import DataSource, Selection

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def uu(spark: SparkSession, d: str) -> GraphDoc:
    day = Window.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    e = _table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("s"), F.lead("user_id").over(day).cast("string").alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("w"), "ts", F.col("event_id").alias(POS))
    return build_doc(rows, mapping=Mapping("s", "t", ("kind", "w", "ts")))


def sp(spark: SparkSession, d: str) -> GraphDoc:
    li = _table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("t"), F.col("l_quantity").alias("w"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").alias("ts"))
    return build_doc(rows, mapping=Mapping("s", "t", ("w", "kind", "ts")))


def sp_placed(spark: SparkSession, d: str) -> GraphDoc:
    """SP with places that SQL knows too; equal ones are told apart by the counterparts' ids."""
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(POS)
    return build_doc(_table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("t"), place), mapping=Mapping("s", "t"))


def fg(spark: SparkSession, d: str) -> GraphDoc:
    c = _table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("s"), ((F.col("c_custkey") * F.col("c_custkey") + 1) % 1499).cast("string").alias("t"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("w"), F.col("c_custkey").alias(POS))
    return build_doc(rows, mapping=Mapping("s", "t", ("kind", "w")))


def cn(spark: SparkSession, d: str) -> GraphDoc:
    c, n = _table(spark, d, "customer"), _table(spark, d, "nation")
    one = c.select(F.concat(F.lit("C"), "c_custkey").alias("s"), F.concat(F.lit("N"), "c_nationkey").alias("t"), F.col("c_custkey").alias(POS))
    two = n.select(F.concat(F.lit("N"), "n_nationkey").alias("s"), F.concat(F.lit("R"), "n_regionkey").alias("t"), (F.col("n_nationkey").cast("long") - 1000).alias(POS))
    nodes = c.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), F.col("c_custkey").alias(POS))
    return build_doc(one.unionByName(two), nodes, Mapping("s", "t"), "id")


UU = """uu AS (SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS s, CAST(lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS VARCHAR) AS t, event_type AS kind, value AS w, ts FROM events),
ug AS (SELECT * FROM uu WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t),
ul AS (SELECT s, t, min(pos) AS pos, count(*) AS n_rows, avg(w) AS w FROM ug GROUP BY s, t)"""
SP = """sp AS (SELECT 'S' || l_suppkey AS s, 'P' || l_partkey AS t, l_quantity AS w, l_returnflag AS kind, l_shipdate AS ts FROM lineitem)"""
FG = """fr AS (SELECT c_custkey AS pos, CAST(c_custkey AS VARCHAR) AS s, CAST((c_custkey * c_custkey + 1) % 1499 AS VARCHAR) AS t, c_mktsegment AS kind, c_acctbal AS w FROM customer),
fl AS (SELECT s, t, min(pos) AS pos, count(*) AS n_rows FROM fr WHERE s <> t GROUP BY s, t),
fs AS (SELECT s AS a, t AS b FROM fl UNION SELECT t, s FROM fl)"""
CN = """cn AS (SELECT c_custkey AS pos, 'C' || c_custkey AS s, 'N' || c_nationkey AS t FROM customer UNION ALL SELECT n_nationkey - 1000, 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"""
US = "us AS (SELECT s AS a, t AS b FROM ul UNION SELECT t, s FROM ul)"
UW = "uw AS (SELECT a, b, sum(w) AS w FROM (SELECT s AS a, t AS b, w FROM ul UNION ALL SELECT t, s, w FROM ul) GROUP BY a, b)"


def r6(c: str):
    """Rounded for comparison; no negative zero."""
    return (F.round(c, 6) + 0.0).alias(c)


def R6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts of returned lines with the most distinct neighbours."""
    doc = sp(spark, d)
    found = apply_chain(doc, [Step("column", condition=Condition("kind", selected=("R",)))]).graph
    return stats.top(metrics.degree(found.nodes, found.links), "degree", 20, "id").select("id", "degree")


@query(f"""WITH {SP}, l AS (SELECT DISTINCT s, t FROM sp WHERE kind = 'R'), e AS (SELECT s AS id FROM l UNION ALL SELECT t FROM l)
SELECT id, count(*) AS degree FROM e GROUP BY id ORDER BY degree DESC, id LIMIT 20""")
def top_nodes(spark, d):
    return flagship(spark, d)


# ---- counts, ranges, groupings


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(_table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def numeric_range(spark, d):
    return stats.numeric_range(_table(spark, d, "lineitem"), "l_extendedprice")


@query("""WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 24)), 23) AS BIGINT) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1""")
def histogram_bins(spark, d):
    return stats.histogram(_table(spark, d, "lineitem"), "l_extendedprice").select("bin", "n")


@query("""WITH r AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), k AS (SELECT lo, hi, least(24, hi - lo + 1) AS k FROM r)
SELECT CAST(least(floor((p_size - lo) / ((hi - lo) / k)), k - 1) AS BIGINT) AS bin, count(*) AS n FROM part, k GROUP BY 1""")
def histogram_whole_numbers(spark, d):
    return stats.histogram(_table(spark, d, "part"), "p_size").select("bin", "n")


@query("""WITH v AS (SELECT epoch_ms(o_orderdate) AS v FROM orders), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / 12.0)), 11) AS BIGINT) AS bin, count(*) AS n FROM v, r GROUP BY 1""")
def time_bins(spark, d):
    return stats.histogram(_table(spark, d, "orders"), "o_orderdate", 12, time=True).select("bin", "n")


@query("SELECT p_brand AS key, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1")
def pivot_count(spark, d):
    return stats.breakdown(_table(spark, d, "part"), "p_brand")


@query(f"SELECT l_linestatus AS key, {R6('sum(l_quantity)', 'value')} FROM lineitem GROUP BY 1")
def pivot_sum(spark, d):
    return stats.breakdown(_table(spark, d, "lineitem"), "l_linestatus", "l_quantity", "sum").select("key", r6("value"))


@query(f"SELECT event_type AS key, {R6('sum(coalesce(TRY_CAST(value AS DOUBLE), 0)) / count(*)', 'value')} FROM events GROUP BY 1")
def pivot_avg_all(spark, d):
    return stats.breakdown(_table(spark, d, "events"), "event_type", "value", "avg").select("key", r6("value"))


@query(f"SELECT c_mktsegment AS key, count(*) AS n, {R6('sum(c_acctbal)', 'sum')}, {R6('avg(c_acctbal)', 'avg')}, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1")
def group_table(spark, d):
    return stats.group_table(_table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("key", "n", r6("sum"), r6("avg"), "min", "max")


@query("""SELECT 'l_returnflag' AS column_name, count(DISTINCT l_returnflag) AS n_values, count(DISTINCT l_returnflag) <= greatest(40, count(*) / 2) AS groupable FROM lineitem
UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) <= greatest(40, count(*) / 2) FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), count(DISTINCT l_partkey) <= greatest(40, count(*) / 2) FROM lineitem""")
def groupable_columns(spark, d):
    return stats.groupable(_table(spark, d, "lineitem"), ["l_returnflag", "l_orderkey", "l_partkey"])


@query("SELECT p_partkey, contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') AS hit FROM part")
def search_hits_first(spark, d):
    from .model import with_positions

    return stats.search_first(with_positions(_table(spark, d, "part"), "p_partkey"), ["p_name", "p_type"], "RING").select("p_partkey", "hit")


# ---- building the graph


@query(f"""WITH {UU}, e AS (SELECT s AS id, 1 AS o, 0 AS i FROM ul UNION ALL SELECT t, 0, 1 FROM ul)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM e GROUP BY id""")
def build_nodes(spark, d):
    return graph.base_graph(uu(spark, d)).nodes.select("id", "in_degree", "out_degree", "degree")


@query(f"WITH {UU} SELECT s, t, pos, n_rows FROM ul")
def build_links(spark, d):
    return graph.base_graph(uu(spark, d)).links


@query(f"WITH {UU} SELECT count(*) FILTER (WHERE NOT coalesce(s <> t, false)) AS skipped_rows FROM uu")
def skipped_rows(spark, d):
    return graph.skipped_rows(graph.with_ends(uu(spark, d)))


@query(f"""WITH {CN}, l AS (SELECT DISTINCT s, t FROM cn), e AS (SELECT s AS id FROM l UNION ALL SELECT t FROM l), g AS (SELECT id, count(*) AS degree FROM e GROUP BY id)
SELECT coalesce(g.id, 'C' || c_custkey) AS id, coalesce(degree, 0) AS degree, c_custkey IS NOT NULL AS declared FROM g FULL JOIN customer ON g.id = 'C' || c_custkey""")
def link_degree(spark, d):
    nodes = graph.base_graph(cn(spark, d)).nodes
    return nodes.select("id", "degree", (F.col("pos.late") == 0).alias("declared"))


@query(f"WITH {UU} SELECT a.s, a.t, b.s IS NOT NULL AS curve FROM ul a LEFT JOIN ul b ON a.s = b.t AND a.t = b.s")
def reciprocal_links(spark, d):
    return graph.reciprocal(graph.base_graph(uu(spark, d)).links).select("s", "t", "curve")


@query(f"WITH {UU} SELECT id, min(p) AS place FROM (SELECT s AS id, pos * 2 AS p FROM uu UNION ALL SELECT t, pos * 2 + 1 FROM uu) WHERE id IS NOT NULL GROUP BY id")
def derive_node_table(spark, d):
    doc = uu(spark, d)
    return derive_nodes(doc.edges, doc.mapping).select("id", F.col(POS).alias("place"))


@query(f"""WITH {CN}, e AS (SELECT s AS id FROM cn UNION SELECT t FROM cn)
SELECT 'C' || c_custkey AS id, c_mktsegment AS seg FROM customer UNION ALL SELECT id, NULL FROM e WHERE id NOT IN (SELECT 'C' || c_custkey FROM customer)""")
def reconcile_nodes(spark, d):
    return reconcile(cn(spark, d)).nodes.select("id", "seg")


@query(f"WITH {UU}, {UW} SELECT a AS v, b AS n, {R6('w', 'w')} FROM uw")
def undirected_weights(spark, d):
    return graph.undirected(graph.weighted_links(graph.base_graph(uu(spark, d)), "w")).select("v", "n", r6("w"))


@query(f"WITH {UU} SELECT count(DISTINCT id) AS nodes FROM (SELECT s AS id FROM uu UNION ALL SELECT t FROM uu)")
def node_count_exact(spark, d):
    return DataSource(uu(spark, d).edges, Mapping("s", "t")).node_count()


@query(f"WITH {UU} SELECT id, {R6('sum(w)', 'value')} FROM (SELECT s AS id, w FROM uu UNION ALL SELECT t, w FROM uu) WHERE id IS NOT NULL GROUP BY id")
def project_numeric_attr(spark, d):
    doc = uu(spark, d)
    return graph.numeric_attribute(doc, graph.with_ends(doc), "w").select("id", r6("value"))


@query(f"WITH {UU} SELECT t AS id, arg_min(kind, pos) AS value FROM uu WHERE t IS NOT NULL GROUP BY t")
def project_category_attr(spark, d):
    doc = uu(spark, d)
    return graph.category_attribute(doc, graph.with_ends(doc), "kind")


@query(f"WITH {UU} SELECT id, arg_min(w, pos) AS value FROM (SELECT s AS id, w, pos FROM uu UNION ALL SELECT t, w, pos FROM uu WHERE t IS DISTINCT FROM s) WHERE id IS NOT NULL GROUP BY id")
def project_first_number(spark, d):
    return graph.first_number_attribute(graph.with_ends(uu(spark, d)), "w")


# ---- filters


def _counts(applied) -> DataFrame:
    """nodes and links of what a chain leaves."""
    g = applied.graph
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.links.agg(F.count("*").alias("links"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")))


def _links(applied) -> DataFrame:
    return applied.graph.links.select("s", "t", "n_rows")


def _uu_links(where: str, more: str = "") -> str:
    return f"WITH {UU}{more} SELECT s, t, count(*) AS n_rows FROM ug WHERE {where} GROUP BY s, t"


@query(_uu_links("kind IN ('click', 'error')"))
def filter_values(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("column", condition=Condition("kind", selected=("click", "error")))]))


@query(_uu_links("kind NOT IN ('click', 'error')"))
def filter_excluded(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("column", condition=Condition("kind", excluded=("click", "error")))]))


@query(_uu_links("w BETWEEN 5 AND 20"))
def filter_range(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("column", condition=Condition("w", low=5, high=20))]))


@query(_uu_links("NOT coalesce(w BETWEEN 5 AND 20, false)"))
def filter_inverted_range(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("column", condition=Condition("w", low=5, high=20), invert=True)]))


@query(f"""WITH {CN}, k AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT (SELECT count(*) FROM k) AS nodes, CAST(0 AS BIGINT) AS links, CAST(0 AS BIGINT) AS n_rows""")
def filter_node_column(spark, d):
    return _counts(apply_chain(cn(spark, d), [Step("column", table="nodes", condition=Condition("seg", selected=("BUILDING",)))]))


@query(f"""WITH {FG}, k AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal BETWEEN 0 AND 5000)
SELECT (SELECT count(*) FROM k) AS nodes, (SELECT count(*) FROM fl WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)) AS links, (SELECT count(*) FROM fr WHERE s <> t AND s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)) AS n_rows""")
def filter_timewindow_nodes(spark, d):
    c = _table(spark, d, "customer")
    doc = fg(spark, d).with_(nodes=c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_custkey").alias(POS)), node_id="id", nodes_declared=True)
    return _counts(apply_chain(doc, [Step("timewindow", table="nodes", column="bal", low=0, high=5000)]))


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey) - 1 AS place FROM part QUALIFY place BETWEEN 100 AND 149""")
def table_sorted_page(spark, d):
    rows = with_positions(_table(spark, d, "part"), "p_partkey")
    return details.sorted_page(rows, "p_retailprice", 2, 50, descending=True).select("p_partkey", "p_name", F.col("place").cast("long").alias("place"))


@query(f"""WITH {CN}, n AS (SELECT s AS id FROM cn UNION SELECT t FROM cn), k AS (SELECT id FROM n WHERE id NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT (SELECT count(*) FROM k) AS nodes, count(*) AS links, count(*) AS n_rows FROM cn WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)""")
def filter_inverted_node_column(spark, d):
    return _counts(apply_chain(cn(spark, d), [Step("column", table="nodes", condition=Condition("seg", selected=("BUILDING",)), invert=True)]))


_DEGREE = f"""{UU}, g AS (SELECT id, sum(o) AS o, sum(i) AS i, count(*) AS n FROM (SELECT s AS id, 1 AS o, 0 AS i FROM ul UNION ALL SELECT t, 0, 1 FROM ul) GROUP BY id)"""


@query(f"WITH {_DEGREE}, k AS (SELECT id FROM g WHERE o >= 50 AND o <= 60) SELECT s, t, n_rows FROM ul WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)")
def filter_degree(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("degree", mode="out", low=50, high=60)]))


@query(f"WITH {_DEGREE}, k AS (SELECT id FROM g WHERE NOT (n >= 100)) SELECT s, t, n_rows FROM ul WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)")
def filter_inverted_degree(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("degree", low=100, invert=True)]))


def _peels(base: str, k: int, rounds: int, n: str = "k") -> str:
    """Node sets of a k-core by repeated peeling; k0 is the symmetric pair table."""
    out = [f"{n}0 AS (SELECT a, b FROM {base})"]
    for i in range(1, rounds + 1):
        out.append(f"g{n}{i} AS MATERIALIZED (SELECT a FROM {n}{i - 1} GROUP BY a HAVING count(*) >= {k}), {n}{i} AS MATERIALIZED (SELECT a, b FROM {n}{i - 1} WHERE a IN (SELECT a FROM g{n}{i}) AND b IN (SELECT a FROM g{n}{i}))")
    return ", ".join(out)


@query(f"WITH {FG}, {_peels('fs', 2, 90)} SELECT s, t, n_rows FROM fl WHERE s NOT IN (SELECT a FROM k90) AND t NOT IN (SELECT a FROM k90)")
def filter_inverted_kcore(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("kcore", k=2, invert=True)]))


@query(f"WITH {FG}, {_peels('fs', 2, 90)} SELECT s, t, n_rows FROM fl WHERE s IN (SELECT a FROM k90) AND t IN (SELECT a FROM k90)")
def filter_kcore(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("kcore", k=2)]))


_COMP = f"""WITH RECURSIVE {FG}, r(node, root) AS (SELECT a, a FROM fs UNION SELECT fs.b, r.root FROM r JOIN fs ON fs.a = r.node),
f AS (SELECT id, min(p) AS p FROM (SELECT s AS id, pos * 2 AS p FROM fl UNION ALL SELECT t, pos * 2 + 1 FROM fl) GROUP BY id),
c AS (SELECT node, min(f.p) AS comp FROM r JOIN f ON f.id = r.root GROUP BY node),
z AS (SELECT comp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, comp) - 1 AS k FROM c GROUP BY comp)"""


@query(f"{_COMP}, keep AS (SELECT node FROM c JOIN z USING (comp) WHERE k < 2) SELECT s, t, n_rows FROM fl WHERE s IN (SELECT node FROM keep)")
def filter_component(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("component", count=2)]))


def _walk(base: str, depth: int, seeds: str) -> str:
    """w: id, depth of what is reached in steps (a, b) of `base`."""
    out = [f"w0 AS (SELECT DISTINCT a AS id, 0 AS depth FROM {base} WHERE a IN ({seeds}) UNION SELECT b, 0 FROM {base} WHERE b IN ({seeds}))"]
    for i in range(1, depth + 1):
        out.append(f"w{i} AS MATERIALIZED (SELECT * FROM w{i - 1} UNION ALL SELECT DISTINCT b, {i} FROM {base} JOIN w{i - 1} ON a = id WHERE b NOT IN (SELECT id FROM w{i - 1}))")
    return ", ".join(out) + f", w AS (SELECT * FROM w{depth})"


_INSIDE = "SELECT s, t, n_rows FROM fl WHERE s IN (SELECT id FROM w) AND t IN (SELECT id FROM w)"


@query(f"WITH {FG}, {_walk('fs', 2, chr(39) + '10' + chr(39))} {_INSIDE}")
def filter_ego_any(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=("10",), depth=2)]))


@query(f"WITH {FG}, fo AS (SELECT s AS a, t AS b FROM fl), {_walk('fo', 3, chr(39) + '10' + chr(39))} {_INSIDE}")
def filter_ego_out(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=("10",), depth=3, direction="out")]))


@query(f"WITH {FG}, fi AS (SELECT t AS a, s AS b FROM fl), {_walk('fi', 2, chr(39) + '101' + chr(39))} {_INSIDE}")
def filter_ego_in(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=("101",), depth=2, direction="in")]))


_WHERE_STEPS = "fw AS (SELECT s AS a, t AS b FROM fr WHERE s <> t AND kind IN ('BUILDING', 'MACHINERY', 'FURNITURE') UNION SELECT t, s FROM fr WHERE s <> t AND kind IN ('BUILDING', 'MACHINERY', 'FURNITURE'))"
_WHERE = Condition("kind", selected=("BUILDING", "MACHINERY", "FURNITURE"))


@query(f"WITH {FG}, {_WHERE_STEPS}, x AS (SELECT a, b FROM fw UNION ALL SELECT '10', '10'), {_walk('x', 3, chr(39) + '10' + chr(39))} {_INSIDE}")
def filter_ego_where(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=("10",), depth=3, where=_WHERE)]))


@query(f"""WITH {FG}, {_walk('fs', 2, chr(39) + '10' + chr(39))} SELECT f.s, f.t, count(*) AS n_rows FROM fr f JOIN w x ON f.s = x.id JOIN w y ON f.t = y.id WHERE f.s <> f.t AND abs(x.depth - y.depth) = 1 GROUP BY f.s, f.t""")
def filter_ego_walked(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=("10",), depth=2, walked_only=True)]))


@query(f"WITH {UU} SELECT a.s, a.t, a.n_rows FROM ul a JOIN ul b ON a.s = b.t AND a.t = b.s")
def filter_mutual(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("mutual")]))


@query(f"WITH {UU} SELECT a.s, a.t, a.n_rows FROM ul a LEFT JOIN ul b ON a.s = b.t AND a.t = b.s WHERE b.s IS NULL")
def filter_inverted_mutual(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("mutual", invert=True)]))


_ALPHA = f"""{UU}, {UW}, st AS (SELECT a, count(*) AS k, sum(w) AS st FROM uw GROUP BY a),
al AS (SELECT uw.a, uw.b, CASE WHEN k < 2 THEN 0.0 WHEN st <= 0 THEN 1.0 ELSE pow(1 - w / st, k - 1) END AS alpha FROM uw JOIN st ON uw.a = st.a),
la AS (SELECT ul.s, ul.t, n_rows, least(x.alpha, y.alpha) AS alpha FROM ul JOIN al x ON x.a = s AND x.b = t JOIN al y ON y.a = t AND y.b = s)"""


@query(f"WITH {_ALPHA} SELECT s, t, n_rows FROM la WHERE alpha <= 0.2")
def filter_backbone(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("backbone", alpha=0.2, column="w")]))


@query(_uu_links("epoch_ms(ts) BETWEEN 1704499200000 AND 1705104000000"))
def filter_timewindow(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("timewindow", column="ts", low=1704499200000, high=1705104000000)]))


@query(f"""WITH {UU}, a AS (SELECT * FROM ug WHERE kind IN ('click', 'view', 'error')), al AS (SELECT s, t, count(*) AS n FROM a GROUP BY s, t),
g AS (SELECT id, count(*) AS n FROM (SELECT s AS id FROM al UNION ALL SELECT t FROM al) GROUP BY id), k AS (SELECT id FROM g WHERE n >= 20),
b AS (SELECT * FROM a WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)), bl AS (SELECT s, t, count(*) AS n_rows FROM b GROUP BY s, t)
SELECT x.s, x.t, x.n_rows FROM bl x JOIN bl y ON x.s = y.t AND x.t = y.s""")
def chain_three_steps(spark, d):
    chain = [Step("column", condition=Condition("kind", selected=("click", "view", "error"))), Step("degree", low=20), Step("mutual")]
    return _links(apply_chain(uu(spark, d), chain))


@query(f"{_COMP}, keep AS (SELECT node FROM c JOIN z USING (comp) WHERE k >= 1) SELECT s, t, n_rows FROM fl WHERE s IN (SELECT node FROM keep)")
def filter_inverted_component(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("component", count=1, invert=True)]))


@query(f"WITH {FG}, {_walk('fs', 2, chr(39) + '10' + chr(39))} SELECT s, t, n_rows FROM fl WHERE s NOT IN (SELECT id FROM w) AND t NOT IN (SELECT id FROM w)")
def filter_inverted_ego(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=("10",), depth=2, invert=True)]))


@query(f"WITH {_ALPHA} SELECT s, t, n_rows FROM la WHERE alpha > 0.2")
def filter_inverted_backbone(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("backbone", alpha=0.2, column="w", invert=True)]))


@query(_uu_links("NOT coalesce(epoch_ms(ts) BETWEEN 1704499200000 AND 1705104000000, false)"))
def filter_inverted_timewindow(spark, d):
    return _links(apply_chain(uu(spark, d), [Step("timewindow", column="ts", low=1704499200000, high=1705104000000, invert=True)]))


_EGO_SEEDS = "'1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', '13', '14', '15', '16', '17', '18', '19', '20'"


@query(f"WITH {FG}, {_walk('fs', 3, _EGO_SEEDS)} {_INSIDE}")
def filter_ego_many(spark, d):
    return _links(apply_chain(fg(spark, d), [Step("ego", centers=tuple(str(k) for k in range(1, 21)), depth=3)]))


@query(f"""WITH {UU}, a AS (SELECT * FROM ug WHERE kind <> 'purchase'), d1 AS (SELECT id, count(*) AS n FROM (SELECT s AS id FROM (SELECT DISTINCT s, t FROM a) UNION ALL SELECT t FROM (SELECT DISTINCT s, t FROM a)) GROUP BY id),
b AS (SELECT * FROM a WHERE s IN (SELECT id FROM d1 WHERE n >= 10) AND t IN (SELECT id FROM d1 WHERE n >= 10)), c AS (SELECT * FROM b WHERE epoch_us(ts) // 1000 >= 1704240000000),
d2 AS (SELECT id, count(*) AS n FROM (SELECT s AS id FROM (SELECT DISTINCT s, t FROM c) UNION ALL SELECT t FROM (SELECT DISTINCT s, t FROM c)) GROUP BY id),
e AS (SELECT * FROM c WHERE s NOT IN (SELECT id FROM d2 WHERE n >= 150) AND t NOT IN (SELECT id FROM d2 WHERE n >= 150)), el AS (SELECT s, t, count(*) AS n_rows FROM e GROUP BY s, t)
SELECT x.s, x.t, x.n_rows FROM el x WHERE NOT EXISTS (SELECT 1 FROM el y WHERE x.s = y.t AND x.t = y.s)""")
def chain_five_steps(spark, d):
    chain = [
        Step("column", condition=Condition("kind", excluded=("purchase",))), Step("degree", low=10), Step("timewindow", column="ts", low=1704240000000),
        Step("degree", low=150, invert=True), Step("mutual", invert=True),
    ]
    return _links(apply_chain(uu(spark, d), chain))


# ---- the source


def _source(spark, d) -> DataSource:
    doc = fg(spark, d)
    return DataSource(doc.edges, doc.mapping)


@query(f"WITH {FG} SELECT kind AS value, count(*) AS n FROM fr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def source_distinct(spark, d):
    return _source(spark, d).distinct("kind", 3)


@query(f"WITH {FG}, i AS (SELECT s AS id FROM fr UNION SELECT t FROM fr) SELECT id FROM i WHERE contains(id, '14') ORDER BY starts_with(id, '14') DESC, id LIMIT 12")
def source_search(spark, d):
    return _source(spark, d).search("14")


@query(f"WITH {FG}, i AS (SELECT s AS id FROM fr UNION SELECT t FROM fr) SELECT id FROM i WHERE contains(id, '1') ORDER BY starts_with(id, '1') DESC, id LIMIT 400")
def source_search_kept(spark, d):
    source = _source(spark, d)
    source.directory()
    return source.search("1", 400)


@query(f"WITH {FG}, {_walk('fs', 12, chr(39) + '10' + chr(39))} SELECT id, depth FROM w WHERE depth = 0 OR (depth <= 12 AND (SELECT count(*) FROM w x WHERE x.depth < w.depth) <= 8)")
def source_budget(spark, d):
    return _source(spark, d).reached(Selection(("10",), 12, budget=8))


@query(f"WITH {FG}, i AS (SELECT s AS id FROM fr UNION SELECT t FROM fr) SELECT id FROM i WHERE id IN ('7', '99999999', '12')")
def source_lookup(spark, d):
    return _source(spark, d).lookup(["12", " 7 ", "99999999", "12"])


@query(f"WITH {FG} SELECT s, t FROM (SELECT s, t, pos FROM fr WHERE kind = 'BUILDING' ORDER BY pos LIMIT 25)")
def source_top_read(spark, d):
    edges, _ = _source(spark, d).selected(Selection(predicates=(Condition("kind", selected=("BUILDING",)),), edge_limit=25))
    return edges.select("s", "t")


@query(f"WITH {FG}, {_walk('fs', 3, chr(39) + '10' + chr(39))} SELECT depth, count(*) AS new_nodes FROM w GROUP BY depth")
def source_neighborhood(spark, d):
    return _source(spark, d).neighborhood(Selection(("10",), 3))


@query(f"WITH {FG}, {_walk('fs', 2, chr(39) + '10' + chr(39))} SELECT s, t FROM fr WHERE s IN (SELECT id FROM w) AND t IN (SELECT id FROM w)")
def source_materialize(spark, d):
    return _source(spark, d).materialize(Selection(("10",), 2)).edges.select("s", "t")


@query(f"WITH {FG}, fo AS (SELECT s AS a, t AS b FROM fl), {_walk('fo', 3, chr(39) + '10' + chr(39))} SELECT f.s, f.t FROM fr f JOIN w x ON f.s = x.id JOIN w y ON f.t = y.id WHERE y.depth = x.depth + 1")
def source_walked(spark, d):
    edges, _ = _source(spark, d).selected(Selection(("10",), 3, "out", walked_only=True))
    return edges.select("s", "t")


@query(f"WITH {FG}, {_walk('fs', 3, _EGO_SEEDS)}, e AS (SELECT * FROM fr WHERE s IN (SELECT id FROM w) AND t IN (SELECT id FROM w)) SELECT (SELECT count(*) FROM w) AS nodes, least(41, (SELECT count(*) FROM e)) AS edges, (SELECT count(*) FROM e) > 40 AS truncated")
def source_size(spark, d):
    return _source(spark, d).size(Selection(tuple(str(k) for k in range(1, 21)), 3, edge_limit=40))


# ---- metrics


def _uug(spark, d, weight=None):
    g = graph.base_graph(uu(spark, d))
    return g.nodes.select("id", "pos"), graph.weighted_links(g, weight)


@query(f"""WITH {UU}, {US} SELECT n.id, count(DISTINCT us.b) AS degree, (SELECT count(*) FROM ul WHERE t = n.id) AS in_degree, (SELECT count(*) FROM ul WHERE s = n.id) AS out_degree
FROM (SELECT DISTINCT a AS id FROM us) n JOIN us ON us.a = n.id GROUP BY n.id""")
def metric_degree(spark, d):
    return metrics.degree(*_uug(spark, d))


def _pagerank_sql(k: int) -> str:
    out = [UU, US, "nn AS (SELECT count(DISTINCT a) AS n FROM us)", "so AS (SELECT s AS o, sum(w) AS st FROM ul GROUP BY s)", "p0 AS (SELECT DISTINCT a AS id, 1.0 / n AS r FROM us, nn)"]
    for i in range(1, k + 1):
        out.append(f"""p{i} AS MATERIALIZED (SELECT p.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(r), 0) FROM p{i - 1} WHERE id NOT IN (SELECT o FROM so WHERE st > 0)) / n + 0.85 * coalesce(g, 0) AS r FROM p{i - 1} p CROSS JOIN nn
LEFT JOIN (SELECT ul.t AS id, sum(q.r * ul.w / st) AS g FROM ul JOIN so ON o = ul.s JOIN p{i - 1} q ON q.id = ul.s WHERE st > 0 GROUP BY ul.t) x ON x.id = p.id)""")
    return f"WITH {', '.join(out)} SELECT id, {R6('r', 'pagerank')} FROM p{k}"


@query(_pagerank_sql(8))
def metric_pagerank_k(spark, d):
    return metrics.pagerank(*_uug(spark, d, "w"), rounds=8, close=0.0).select("id", r6("pagerank"))


def _hits_sql(k: int) -> str:
    out = [UU, US, "h0 AS (SELECT DISTINCT a AS id, 1.0 AS h, 1.0 AS au FROM us)"]
    for i in range(1, k + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT ul.t AS id, sum(h.h * ul.w) AS x FROM ul JOIN h{i - 1} h ON h.id = ul.s GROUP BY 1)")
        out.append(f"b{i} AS MATERIALIZED (SELECT ul.s AS id, sum(a.x * ul.w) AS y FROM ul JOIN a{i} a ON a.id = ul.t GROUP BY 1)")
        out.append(f"h{i} AS MATERIALIZED (SELECT p.id, coalesce(y, 0) / (SELECT sqrt(sum(y * y)) FROM b{i}) AS h, coalesce(x, 0) / (SELECT sqrt(sum(x * x)) FROM a{i}) AS au FROM h0 p LEFT JOIN a{i} USING (id) LEFT JOIN b{i} USING (id))")
    return f"WITH {', '.join(out)} SELECT id, {R6(f'h / (SELECT max(h) FROM h{k})', 'hub')}, {R6(f'au / (SELECT max(au) FROM h{k})', 'authority')} FROM h{k}"


@query(_hits_sql(5))
def metric_hits_k(spark, d):
    return metrics.hits(*_uug(spark, d, "w"), rounds=5, close=0.0).select("id", r6("hub"), r6("authority"))


def _eigen_sql(k: int) -> str:
    out = [UU, US, "e0 AS (SELECT DISTINCT a AS id, 1.0 AS x FROM us)"]
    for i in range(1, k + 1):
        out.append(f"y{i} AS MATERIALIZED (SELECT us.a AS id, sum(x) AS y FROM us JOIN e{i - 1} e ON e.id = us.b GROUP BY 1), e{i} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM y{i}) AS x FROM y{i})")
    return f"WITH {', '.join(out)} SELECT id, {R6(f'x / (SELECT max(x) FROM e{k})', 'eigenvector')} FROM e{k}"


@query(_eigen_sql(6))
def metric_eigenvector_k(spark, d):
    return metrics.eigenvector(*_uug(spark, d), rounds=6, close=0.0).select("id", r6("eigenvector"))


def _paths_sql(depth: int = 4) -> str:
    """dd: src, id, dist, sigma of all shortest paths of UU, up to `depth` hops."""
    out = [UU, US, "d0 AS (SELECT DISTINCT a AS src, a AS id, 0 AS dist, 1.0 AS sigma FROM us)"]
    for i in range(1, depth + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT f.src, us.b, {i}, sum(f.sigma) FROM d{i - 1} f JOIN us ON us.a = f.id LEFT JOIN d{i - 1} o ON o.src = f.src AND o.id = us.b
WHERE f.dist = {i - 1} AND o.id IS NULL GROUP BY f.src, us.b)""")
    return ", ".join(out) + f", dd AS (SELECT * FROM d{depth})"


@query(f"WITH {_paths_sql()}, n AS (SELECT count(DISTINCT id) AS n FROM dd) SELECT id, {R6('(count(*) / (any_value(n) - 1)) * (count(*) / sum(dist))', 'closeness')} FROM dd, n WHERE dist > 0 GROUP BY id")
def metric_closeness(spark, d):
    return metrics.closeness(*_uug(spark, d)).select("id", r6("closeness"))


@query(f"WITH {_paths_sql()}, n AS (SELECT count(DISTINCT id) AS n FROM dd) SELECT id, {R6('sum(1.0 / dist) / (any_value(n) - 1)', 'harmonic')} FROM dd, n WHERE dist > 0 GROUP BY id")
def metric_harmonic(spark, d):
    return metrics.harmonic(*_uug(spark, d)).select("id", r6("harmonic"))


def _sampled_sql(depth: int = 6) -> str:
    """dd: shortest distances from every n/600th node of SP (by first appearance) to all, up to `depth` hops."""
    out = ["r AS (SELECT 'S' || l_suppkey AS s, 'P' || l_partkey AS t, l_orderkey * 8 + l_linenumber AS p FROM lineitem)", "us AS (SELECT s AS a, t AS b FROM r UNION SELECT t, s FROM r)",
           "nn AS (SELECT id, row_number() OVER (ORDER BY min(place), id) - 1 AS k, count(*) OVER () AS n FROM (SELECT s AS id, p * 2 AS place FROM r UNION ALL SELECT t, p * 2 + 1 FROM r) GROUP BY id)",
           "src AS (SELECT id FROM nn WHERE n <= 600 OR k % CAST(ceil(n / 600.0) AS BIGINT) = 0)", "d0 AS (SELECT id AS src, id, 0 AS dist FROM src)"]
    for i in range(1, depth + 1):
        out.append(f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT DISTINCT f.src, us.b, {i} FROM d{i - 1} f JOIN us ON us.a = f.id LEFT JOIN d{i - 1} o ON o.src = f.src AND o.id = us.b WHERE f.dist = {i - 1} AND o.id IS NULL)")
    return ", ".join(out) + f", dd AS (SELECT * FROM d{depth})"


@query(f"""WITH {_sampled_sql()}, c AS (SELECT count(*) AS c FROM src), x AS (SELECT id, count(*) AS reached, sum(dist) AS total FROM dd WHERE dist > 0 GROUP BY id)
SELECT nn.id, {R6('coalesce((reached / (c - (src.id IS NOT NULL)::INT)) * (reached / total), 0)', 'closeness')} FROM nn CROSS JOIN c LEFT JOIN src ON src.id = nn.id LEFT JOIN x ON x.id = nn.id""")
def metric_closeness_sampled(spark, d):
    g = graph.base_graph(sp_placed(spark, d))
    return metrics.closeness(g.nodes.select("id", "pos"), graph.weighted_links(g), metrics.ALL_SOURCES).select("id", r6("closeness"))


@query(_pagerank_sql(90))
def metric_pagerank(spark, d):
    return metrics.pagerank(*_uug(spark, d, "w"), close=1e-8).select("id", r6("pagerank"))


@query(f"""WITH {_paths_sql()}, n AS (SELECT count(DISTINCT id) AS n FROM dd),
b AS (SELECT x.id AS id, sum(x.sigma * y.sigma / z.sigma) AS b FROM dd x JOIN dd y ON y.src = x.id JOIN dd z ON z.src = x.src AND z.id = y.id AND z.dist = x.dist + y.dist WHERE x.dist > 0 AND y.dist > 0 GROUP BY x.id)
SELECT i.id, {R6('coalesce(b, 0) / 2 * (2.0 / ((n - 1) * (n - 2)))', 'betweenness')} FROM (SELECT DISTINCT id FROM dd) i CROSS JOIN n LEFT JOIN b ON b.id = i.id""")
def metric_betweenness(spark, d):
    return metrics.betweenness(*_uug(spark, d)).select("id", r6("betweenness"))


@query(f"""WITH {FG}, {_peels('fs', 2, 90)}, {_peels('k90', 3, 60, 'x')}, {_peels('x60', 4, 30, 'y')}
SELECT id, CAST(1 + (id IN (SELECT a FROM k90))::INT + (id IN (SELECT a FROM x60))::INT + (id IN (SELECT a FROM y30))::INT AS BIGINT) AS coreness FROM (SELECT DISTINCT a AS id FROM fs)""")
def metric_coreness(spark, d):
    g = graph.base_graph(fg(spark, d))
    return metrics.coreness(g.nodes.select("id", "pos"), graph.weighted_links(g))


@query(f"WITH {UU}, {US} SELECT n.id, coalesce(k, 0) AS triangles FROM (SELECT DISTINCT a AS id FROM us) n LEFT JOIN (SELECT x.a AS id, count(*) AS k FROM us x JOIN us y ON x.a = y.a AND x.b < y.b JOIN us z ON z.a = x.b AND z.b = y.b GROUP BY 1) t ON t.id = n.id")
def metric_triangles(spark, d):
    return metrics.triangles(*_uug(spark, d))


@query(f"{_COMP} SELECT node AS id, CAST(k AS VARCHAR) AS component, size AS component_size FROM c JOIN z USING (comp)")
def metric_components(spark, d):
    g = graph.base_graph(fg(spark, d))
    return metrics.components(g.nodes.select("id", F.col("pos.pos").alias("pos")), g.links)


@query(f"WITH {UU}, {US} SELECT ul.s, ul.t, (SELECT count(*) FROM us x JOIN us y ON x.b = y.b WHERE x.a = ul.s AND y.a = ul.t) AS embeddedness FROM ul")
def metric_embeddedness(spark, d):
    return metrics.embeddedness(graph.base_graph(uu(spark, d)).links)


@query(f"""WITH {UU}, m AS (SELECT a.s, a.t FROM ul a JOIN ul b ON a.s = b.t AND a.t = b.s), k AS (SELECT m.s, m.t, count(*) AS k FROM m JOIN m x ON x.s = m.s JOIN m y ON y.s = m.t AND y.t = x.t GROUP BY 1, 2)
SELECT ul.s, ul.t, coalesce(k, 0) AS simmelian FROM ul LEFT JOIN k ON k.s = ul.s AND k.t = ul.t""")
def metric_simmelian(spark, d):
    return metrics.simmelian(graph.base_graph(uu(spark, d)).links)


@query(f"WITH {_ALPHA} SELECT s, t, {R6('alpha', 'alpha')} FROM la")
def metric_disparity(spark, d):
    return metrics.disparity(_uug(spark, d, "w")[1]).select("s", "t", r6("alpha"))


@query(f"""WITH {_paths_sql()}, n AS (SELECT count(DISTINCT id) AS n FROM dd), k AS (SELECT a, count(*) AS k FROM us GROUP BY a),
t AS (SELECT x.a, count(*) AS t FROM us x JOIN us y ON x.a = y.a AND x.b < y.b JOIN us z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT {R6('(SELECT count(*) FROM ul) / (n * (n - 1.0))', 'density')}, {R6('(SELECT avg(2 * coalesce(t, 0) / (k * (k - 1.0))) FROM k LEFT JOIN t USING (a) WHERE k >= 2 AND k <= 300)', 'clustering')},
(SELECT CAST(max(dist) AS BIGINT) FROM dd WHERE dist > 0) AS diameter, {R6('(SELECT avg(dist) FROM dd WHERE dist > 0)', 'average_path')} FROM n""")
def network_summary(spark, d):
    return metrics.network(*_uug(spark, d)).select(r6("density"), r6("clustering"), "diameter", r6("average_path"))


@query(f"WITH {FG}, {_walk('fs', 12, chr(39) + '10' + chr(39))} SELECT id, depth FROM w WHERE depth <= 12")
def hops_from(spark, d):
    g = graph.base_graph(fg(spark, d))
    return traverse.reach(g.links, g.nodes.where("id = '10'"), 12)


@query(f"WITH {_paths_sql()} SELECT CAST(sigma AS BIGINT) AS n_routes, CAST(dist AS BIGINT) AS length FROM dd WHERE src = '3' AND id = (SELECT max(b) FROM us WHERE b NOT IN (SELECT b FROM us WHERE a = '3') AND b <> '3')")
def shortest_route_count(spark, d):
    links = graph.base_graph(uu(spark, d)).links
    steps = traverse.arms(links, "any")
    far = steps.join(steps.where("a = '3'").select("b"), "b", "left_anti").where("b <> '3'").agg(F.max("b")).first()[0]
    return traverse.shortest_routes(links, "3", far)[0]


@query(f"""{_COMP} SELECT (SELECT count(DISTINCT a) FROM fs) AS nodes, (SELECT count(*) FROM fl) AS edges, {R6('2.0 * (SELECT count(*) FROM fl) / (SELECT count(DISTINCT a) FROM fs)', 'average_links')}, (SELECT count(*) FROM z) AS components""")
def network_counts(spark, d):
    g = graph.base_graph(fg(spark, d))
    return metrics.counts(g.nodes.select("id", "pos"), g.links).select("nodes", "edges", r6("average_links"), "components")


_FRAMES = f"""{UU}, e AS (SELECT min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM uu), fb AS (SELECT unnest(generate_series(0, (hi - lo) // 86400000)) AS frame, lo, hi FROM e),
f AS (SELECT frame, lo + 86400000 * frame AS a, least(lo + 86400000 * frame + 259200000, hi) AS z FROM fb),
x AS (SELECT frame, s, t FROM f JOIN uu ON epoch_us(ts) // 1000 BETWEEN a AND z), g AS (SELECT frame, s, t FROM x WHERE s <> t)"""


@query(f"""WITH {_FRAMES} SELECT CAST(frame AS INTEGER) AS frame, CAST(a AS DOUBLE) AS "start", CAST(z AS DOUBLE) AS "end", (SELECT count(*) FROM x WHERE x.frame = f.frame) AS rows,
(SELECT count(*) FROM (SELECT DISTINCT s, t FROM g WHERE g.frame = f.frame)) AS links, (SELECT count(*) FROM (SELECT s FROM g WHERE g.frame = f.frame UNION SELECT t FROM g WHERE g.frame = f.frame)) AS nodes FROM f""")
def playback_frames(spark, d):
    ends = graph.with_ends(uu(spark, d))
    low, high = ends.agg(F.min(cells.tms(ends, "ts")), F.max(cells.tms(ends, "ts"))).first()
    return frames.playback(ends, "ts", low, high, 3 * 86_400_000.0, 86_400_000.0)


# ---- transforms


def _budget_sql(kept: str, other: str) -> str:
    """The whole SP table; counterparts are taken in order of their first rows while running sums of pairs fit. Links
    run from the node that appears first as counterparts are listed in that order, each with its nodes by first rows."""
    return f"""WITH r AS (SELECT 'S' || l_suppkey AS s, 'P' || l_partkey AS t, l_orderkey * 8 + l_linenumber AS p FROM lineitem),
i AS (SELECT {kept} AS a, {other} AS o, min(p) AS p FROM r WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2), k AS (SELECT o, count(*) * (count(*) - 1) // 2 AS n, min(p) AS op FROM i GROUP BY o),
u AS (SELECT o FROM (SELECT o, sum(n) OVER (ORDER BY op, o ROWS UNBOUNDED PRECEDING) AS run FROM k) WHERE run <= {transforms.PAIR_LIMIT}),
l AS (SELECT a, row_number() OVER (ORDER BY op, i.o, p, a) AS place FROM i JOIN k ON k.o = i.o), f AS (SELECT a, min(place) AS place FROM l GROUP BY a)
SELECT x.a AS s, y.a AS t, count(*) AS weight, (SELECT count(*) FROM u) AS used, (SELECT count(*) FROM k) AS total FROM u JOIN i x ON x.o = u.o JOIN i y ON y.o = u.o JOIN f fx ON fx.a = x.a JOIN f fy ON fy.a = y.a AND fx.place < fy.place GROUP BY 1, 2"""


def _budgeted(spark: SparkSession, d: str, keep: str) -> DataFrame:
    pairs, counts = transforms.project(graph.with_ends(sp_placed(spark, d)), keep)
    return pairs.crossJoin(F.broadcast(counts))


@query(_budget_sql("s", "t"))
def project_sources(spark, d):
    return _budgeted(spark, d, "source")


@query(_budget_sql("t", "s"))
def project_targets(spark, d):
    return _budgeted(spark, d, "target")


@query(f"""WITH {CN}, i AS (SELECT s AS a, t AS o, min(pos) AS p FROM cn GROUP BY 1, 2), k AS (SELECT o, count(*) * (count(*) - 1) // 2 AS n, min(p) AS op FROM i GROUP BY o),
u AS (SELECT o FROM (SELECT o, sum(n) OVER (ORDER BY op, o ROWS UNBOUNDED PRECEDING) AS run FROM k) WHERE run <= {transforms.PAIR_LIMIT})
SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT x.a, y.a FROM u JOIN i x ON x.o = u.o JOIN i y ON y.o = u.o AND x.a < y.a)) AS edges, (SELECT count(*) FROM u) AS used, (SELECT count(*) FROM k) AS total""")
def project_report(spark, d):
    doc = cn(spark, d)
    customers = doc.nodes.where("id LIKE 'C%'").count()
    return transforms.project_doc(doc, "source")[1].withColumn("nodes", F.lit(customers).cast("long"))


@query(f"WITH {SP}, k AS (SELECT t, count(DISTINCT s) AS k FROM sp GROUP BY t) SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS pairs FROM k")
def projection_pair_bound(spark, d):
    return transforms.pair_bound(graph.with_ends(sp(spark, d)), "source")


@query(f"""WITH {UU}, v AS (SELECT DISTINCT s AS id FROM ug WHERE kind = 'error'), x AS (SELECT CASE WHEN s = '3' THEN t ELSE s END AS id, kind FROM ug WHERE s = '3' OR t = '3')
SELECT kind, count(DISTINCT id) AS nodes, count(*) AS edges FROM x WHERE id NOT IN (SELECT id FROM v WHERE CAST(id AS BIGINT) % 2 = 0) GROUP BY kind""")
def expansion_preview(spark, d):
    ends = graph.with_ends(uu(spark, d))
    seen = ends.where(graph.usable() & F.expr("kind = 'error' AND CAST(__s AS BIGINT) % 2 = 0")).select(F.col("__s").alias("id"))
    return transforms.expansion_preview(ends, seen, "3", "kind")


@query(f"""WITH {CN}, v AS (SELECT s AS id FROM cn WHERE t = 'N3' AND CAST(substr(s, 2) AS INT) % 2 = 0), x AS (SELECT DISTINCT CASE WHEN s = 'N3' THEN t ELSE s END AS id FROM cn WHERE s = 'N3' OR t = 'N3')
SELECT coalesce(c_mktsegment, '') AS kind, count(*) AS nodes FROM x LEFT JOIN customer ON 'C' || c_custkey = id WHERE id NOT IN (SELECT id FROM v) GROUP BY 1""")
def expansion_node_types(spark, d):
    doc = cn(spark, d)
    ends = graph.with_ends(doc)
    seen = ends.where("__t = 'N3' AND CAST(substr(__s, 2) AS INT) % 2 = 0").select(F.col("__s").alias("id"))
    return transforms.expansion_by_node_type(doc, ends, seen, "N3", "seg")


# ---- appearance


@query(f"""WITH {CN}, l AS (SELECT DISTINCT s, t FROM cn), e AS (SELECT s AS id FROM l UNION ALL SELECT t FROM l), g AS (SELECT id, count(*) AS degree FROM e GROUP BY id),
n AS (SELECT coalesce(g.id, 'C' || c_custkey) AS id, c_mktsegment AS grp, greatest(0, coalesce(c_acctbal, 0)) AS m FROM g FULL JOIN customer ON g.id = 'C' || c_custkey), x AS (SELECT max(m) AS hi FROM n)
SELECT id, grp, CASE grp WHEN 'BUILDING' THEN '#112233' END AS color, CASE grp WHEN 'MACHINERY' THEN 50.0 ELSE round(4.5 + 17 * ln(1 + 9 * m / hi) / ln(10.0), 6) END AS radius, CASE WHEN grp = 'FURNITURE' THEN grp END AS label FROM n, x""")
def style_nodes(spark, d):
    doc = cn(spark, d)
    types = {"BUILDING": style.TypeStyle(color="#112233"), "MACHINERY": style.TypeStyle(size=50.0), "FURNITURE": style.TypeStyle(label_column="seg")}
    look = style.Style(node_color="column:seg", node_size="column:bal", size_curve="log", node_types=("seg", types))
    return style.style_nodes(graph.base_graph(doc), doc, look).select("id", "grp", "color", F.round("radius", 6).alias("radius"), "label")


@query(f"""WITH {UU}, f AS (SELECT s, t, arg_min(kind, pos) AS k FROM ug GROUP BY s, t)
SELECT ul.s, ul.t, {R6('w', 'weight')}, k AS color_value, CASE k WHEN 'click' THEN '#00ff00' END AS color, CASE k WHEN 'error' THEN 24.0 END AS width FROM ul JOIN f ON f.s = ul.s AND f.t = ul.t""")
def style_links(spark, d):
    doc = uu(spark, d)
    types = {"click": style.TypeStyle(color="#00ff00"), "error": style.TypeStyle(width=99.0)}
    look = style.Style(edge_width="column:w", edge_color="column:kind", edge_types=("kind", types))
    return style.style_links(graph.base_graph(doc), doc, look).select("s", "t", r6("weight"), "color_value", "color", "width")


@query(f"""WITH {CN}, l AS (SELECT DISTINCT s, t FROM cn), e AS (SELECT s AS id, 0 AS i, 1 AS o FROM l UNION ALL SELECT t, 1, 0 FROM l), g AS (SELECT id, sum(i) AS i, sum(o) AS o FROM e GROUP BY id), x AS (SELECT max(i) AS hi FROM g)
SELECT coalesce(g.id, 'C' || c_custkey) AS id, {R6('4.5 + 17 * sqrt(coalesce(i, 0) / hi)', 'radius')} FROM g FULL JOIN customer ON g.id = 'C' || c_custkey CROSS JOIN x""")
def style_in_degree(spark, d):
    doc = cn(spark, d)
    return style.style_nodes(graph.base_graph(doc), doc, style.Style(node_size="metric:in")).select("id", r6("radius"))


_SUMS = f"{UU}, v AS (SELECT id, sum(w) AS value FROM (SELECT s AS id, w FROM uu UNION ALL SELECT t, w FROM uu) WHERE id IS NOT NULL GROUP BY id), x AS (SELECT min(value) AS lo, max(value) AS hi FROM v)"


def _sums(spark, d):
    doc = uu(spark, d)
    return graph.numeric_attribute(doc, graph.with_ends(doc), "w")


@query(f"WITH {_SUMS} SELECT id, {R6('4.5 + 17 * sqrt(value / hi)', 'radius')} FROM v, x")
def node_radius(spark, d):
    return style.node_radius(_sums(spark, d)).select("id", r6("radius"))


@query(f"WITH {_SUMS} SELECT id, ['#dbe9fb', '#a9cbf3', '#6fa8e8', '#3d82d4', '#1c5cab', '#0d3a78'][CAST(least(5, floor((value - lo) / (hi - lo) * 6)) + 1 AS INT)] AS color FROM v, x")
def rank_color(spark, d):
    return style.ranking_color(_sums(spark, d))


@query(f"""WITH {UU}, v AS (SELECT t AS id, arg_min(kind, pos) AS value, min(pos) AS pos FROM uu WHERE t IS NOT NULL GROUP BY t), k AS (SELECT value, row_number() OVER (ORDER BY count(*) DESC, min(pos)) AS k FROM v GROUP BY value)
SELECT id, ['#2a78d6', '#eb6834'][k] AS c0, coalesce(['#2a78d6', '#eb6834'][k], '#898781') AS color FROM v JOIN k USING (value)""")
def category_color(spark, d):
    doc = uu(spark, d)
    ends = graph.with_ends(doc)
    first = ends.where("__t IS NOT NULL").groupBy(F.col("__t").alias("id")).agg(F.min(POS).alias("pos"))
    values = graph.category_attribute(doc, ends, "kind").join(first, "id")
    out = style.category_color(values, style.PALETTE[:2])
    return out.select("id", F.when(F.col("color") != style.NEUTRAL, F.col("color")).alias("c0"), "color")


@query(f"WITH {UU}, x AS (SELECT min(w) AS lo, max(w) AS hi FROM ul) SELECT s, t, {R6('1 + 5 * (w - lo) / (hi - lo)', 'width')} FROM ul, x")
def edge_width(spark, d):
    links = _uug(spark, d, "w")[1].withColumnRenamed("w", "value")
    return style.edge_width(links, ["s", "t"]).select("s", "t", r6("width"))


_CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS g, c_nationkey AS degree, c_custkey AS pos FROM customer"


def _customers(spark, d):
    c = _table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("group"), F.col("c_nationkey").alias("degree"), F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("bal"))


@query(f"""WITH c AS ({_CUSTOMERS}), k AS (SELECT id, row_number() OVER (ORDER BY g NULLS LAST, degree DESC, pos) - 1 AS k, count(*) OVER () AS n FROM c)
SELECT id, round(greatest(150, n * 42 / (2 * pi())) * cos(-pi() / 2 + 2 * pi() * k / n), 4) + 0.0 AS x, round(greatest(150, n * 42 / (2 * pi())) * sin(-pi() / 2 + 2 * pi() * k / n), 4) + 0.0 AS y FROM k""")
def layout_circle(spark, d):
    return style.layout_circle(_customers(spark, d)).select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(f"""WITH c AS ({_CUSTOMERS}), k AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) - 1 AS k, count(*) OVER () AS n, ceil(sqrt(1.4 * count(*) OVER ())) AS cols FROM c)
SELECT id, {R6('(k % cols - (cols - 1) / 2) * 92', 'x')}, {R6('(floor(k / cols) - (ceil(n / cols) - 1) / 2) * 92', 'y')} FROM k""")
def layout_grid(spark, d):
    return style.layout_grid(_customers(spark, d)).select("id", r6("x"), r6("y"))


@query("""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal / 200.0 * 2.5 AS lat, (c_custkey % 360) - 180.0 AS lon FROM customer),
m AS (SELECT id, radians(lon) AS mx, -ln(tan(pi() / 4 + radians(least(85.05112878, greatest(-85.05112878, lat))) / 2)) AS my FROM p WHERE abs(lat) <= 90 AND abs(lon) <= 180),
e AS (SELECT min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1 FROM m)
SELECT id, round((mx - (x0 + x1) / 2) * 900 / greatest(x1 - x0, y1 - y0), 4) + 0.0 AS x, round((my - (y0 + y1) / 2) * 900 / greatest(x1 - x0, y1 - y0), 4) + 0.0 AS y FROM m, e
UNION ALL SELECT id, -450.0 + 60 * (k % 16), 450.0 + 60 * (1 + k // 16) FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM p WHERE abs(lat) > 90)""")
def layout_geo(spark, d):
    c = _customers(spark, d).select("id", (F.col("bal") / 200.0 * 2.5).alias("lat"), (F.col("pos") % 360 - 180.0).alias("lon"))
    return style.layout_geo(c).select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


# ---- edits


@query(f"WITH {CN} SELECT s, CASE WHEN t = 'N3' THEN 'N4' ELSE t END AS t, count(*) AS n FROM (SELECT CASE WHEN s = 'N3' THEN 'N4' ELSE s END AS s, t FROM cn) GROUP BY 1, 2")
def rename_merge(spark, d):
    new = edits.rename_nodes(cn(spark, d), {"N3": "N4"})
    return new.edges.groupBy("s", "t").agg(F.count("*").alias("n"))


# Over 1,000 renames in order: customers by their last digit, then chains of the new names, and one name that has come free.
def _many_renames():
    first = [(f"C{k}", f"G{k % 10}") for k in range(1, 1001)]
    return [*first, *[(f"G{k}", f"G{k + 1}") for k in (0, 1, 2, 3, 5, 6, 7, 8)], ("C1001", "G0"), ("N3", "N4")]


_MANY = """CASE WHEN {0} = 'N3' THEN 'N4' WHEN {0} = 'C1001' THEN 'G0' WHEN {0} LIKE 'C%' AND CAST(substr({0}, 2) AS INT) BETWEEN 1 AND 1000 THEN
CASE WHEN CAST(substr({0}, 2) AS INT) % 10 <= 4 THEN 'G4' ELSE 'G9' END ELSE {0} END"""


@query(f"WITH {CN} SELECT {_MANY.format('s')} AS s, {_MANY.format('t')} AS t, count(*) AS n FROM cn GROUP BY 1, 2")
def rename_series(spark, d):
    new = edits.rename_series(cn(spark, d), _many_renames())
    return new.edges.groupBy("s", "t").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg, c_custkey AS pos FROM customer),
m AS (SELECT {_MANY.format('id')} AS name, id, seg, pos, CAST(substr(id, 2) AS INT) % 10 AS digit FROM r),
g AS (SELECT name, digit, min(pos) AS place FROM m GROUP BY name, digit)
SELECT name AS id, arg_min(seg, CASE WHEN seg IS NOT NULL THEN place * 1000000 + pos END) AS seg, min(pos) AS pos FROM m JOIN g USING (name, digit) GROUP BY name""")
def rename_series_nodes(spark, d):
    doc = cn(spark, d)
    rows = doc.nodes.where("id LIKE 'C%'").select("id", F.when(F.substring("id", 2, 9).cast("int") % 3 != 0, F.col("seg")).alias("seg"), F.substring("id", 2, 9).cast("long").alias(POS))
    return edits.rename_series(doc.with_(nodes=rows), _many_renames()).nodes.select("id", "seg", F.col(POS).alias("pos"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 0 ELSE value END AS value FROM events")
def fill_blanks(spark, d):
    return edits.fill_column(_table(spark, d, "events"), "value", 0.0).select("event_id", "value")


@query("SELECT p_partkey, regexp_replace(p_name, '(?i)r(i|e)', 'X', 'g') AS p_name FROM part")
def find_replace(spark, d):
    return edits.replace_in_column(_table(spark, d, "part"), "p_name", "r(i|e)", "X", regex=True).select("p_partkey", "p_name")


@query("SELECT count(*) FILTER (WHERE p_name IS NOT NULL AND TRY_CAST(p_name AS DOUBLE) IS NULL) AS losses FROM part")
def retype_losses(spark, d):
    return edits.retype_losses(_table(spark, d, "part"), "p_name", "number")


@query(f"WITH {UU} SELECT s, t, row_number() OVER (PARTITION BY s, t ORDER BY pos) - 1 AS occ, pos FROM uu")
def edge_row_keys(spark, d):
    doc = uu(spark, d)
    return occurrence(doc.edges, doc.mapping).select(F.col("__s").alias("s"), F.col("__t").alias("t"), F.col("__occ").cast("long").alias("occ"), F.col(POS).alias("pos"))


@query(f"""WITH {FG}, cur AS (SELECT s, t, kind, CASE WHEN pos % 10 = 0 THEN 0.0 ELSE w END AS w, pos FROM fr WHERE pos % 7 <> 0), inc AS (SELECT s, t, kind, w + 1 AS w, pos FROM fr WHERE pos % 5 <> 0)
SELECT s, t, {R6('w', 'w')}, src FROM (
SELECT i.s, i.t, CASE WHEN i.pos % 10 = 0 AND c.w <> f.w THEN c.w ELSE i.w END AS w, CASE WHEN c.w <> f.w THEN 'both' ELSE 'incoming' END AS src FROM inc i JOIN fr f ON f.pos = i.pos JOIN cur c ON c.pos = i.pos
UNION ALL SELECT c.s, c.t, c.w, 'edited' FROM cur c JOIN fr f ON f.pos = c.pos WHERE c.w <> f.w AND c.pos % 5 = 0)""")
def overlay_merge(spark, d):
    doc = fg(spark, d)
    base = doc.edges
    current = base.where(F.col(POS) % 7 != 0).withColumn("w", F.when(F.col(POS) % 10 == 0, 0.0).otherwise(F.col("w")))
    incoming = base.where(F.col(POS) % 5 != 0).withColumn("w", F.col("w") + 1)
    return edits.merge(doc, base, current, incoming).select("s", "t", r6("w"), F.col("__from").alias("src"))


# Versions of CN: in the second customer 7 is renamed; in the current one customer 7 is renamed, 9 deleted, 11's segment edited and a node added; the new
# data lacks customers 11 and 13, has other segments, and a customer more.
def _versions(spark, d):
    base = cn(spark, d)
    base = overlay.held(base.with_(nodes=base.nodes.select("id", "seg", POS), edges=base.edges.select("s", "t", F.lit(1.0).alias("w"), POS)))
    named = overlay.held(edits.rename_nodes(base, {"C7": "Seven"}))
    now = edits.delete_nodes(named, ["C9"])
    now = now.with_(nodes=now.nodes.withColumn("seg", F.when(F.col("id").isin("C11", "C15"), "EDITED").otherwise(F.col("seg"))))
    now = now.with_(edges=now.edges.withColumn("w", F.when(F.col("s") == "C17", 5.0).otherwise(F.col("w"))))
    late = base.with_(nodes=base.nodes.where("id NOT IN ('C11', 'C13')").withColumn("seg", F.concat(F.lit("new "), "seg")), edges=base.edges.where("s <> 'C13'").withColumn("w", F.lit(2.0)))
    return base, named, overlay.held(now), late


def _overlaid(spark, d):
    base, named, now, late = _versions(spark, d)
    return overlay.merge(now, overlay.extend(overlay.diff(base, named), overlay.diff(named, now)), late)


@query(f"""WITH {CN} SELECT CASE c_custkey WHEN 7 THEN 'Seven' ELSE 'C' || c_custkey END AS id, CASE WHEN c_custkey IN (11, 15) THEN 'EDITED' ELSE 'new ' || c_mktsegment END AS seg FROM customer WHERE c_custkey NOT IN (9, 13)
UNION ALL SELECT DISTINCT t, NULL FROM cn WHERE s NOT IN ('C9', 'C13') UNION SELECT DISTINCT s, NULL FROM cn WHERE s LIKE 'N%'""")
def overlay_nodes(spark, d):
    return _overlaid(spark, d)[0].nodes.select("id", "seg")


@query(f"WITH {CN} SELECT CASE s WHEN 'C7' THEN 'Seven' ELSE s END AS s, t, CASE s WHEN 'C17' THEN 5.0 ELSE 2.0 END AS w FROM cn WHERE s NOT IN ('C9', 'C13')")
def overlay_renames(spark, d):
    return _overlaid(spark, d)[0].edges.select("s", "t", "w")


@query(f"""WITH {CN}, a AS (SELECT count(*) AS n FROM customer), b AS (SELECT count(*) AS n FROM cn)
SELECT CAST(a.n - 3 + b.n - 2 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS added, CAST(2 AS BIGINT) AS edits_kept, CAST(2 AS BIGINT) AS deletions_held, CAST(1 AS BIGINT) AS kept_extras FROM a, b""")
def overlay_report(spark, d):
    return _overlaid(spark, d)[1]


@query("SELECT CAST(c_nationkey AS VARCHAR) AS id, arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_custkey % 3 <> 0) AS seg, min(c_custkey) AS pos FROM customer GROUP BY c_nationkey")
def coalesce_nodes(spark, d):
    c = _table(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"), F.col("c_custkey").alias(POS))
    return edits.coalesce_by_id(rows, "id").select("id", "seg", F.col(POS).alias("pos"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS id, arg_min(c_mktsegment, c_custkey) AS seg FROM customer GROUP BY c_nationkey")
def first_node_rows(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias(POS))
    return first_rows(c, "id").select(F.col("__id").alias("id"), "seg")


@query("SELECT 'C' || c_custkey AS id, TRY_CAST(c_mktsegment AS DOUBLE) AS segment, c_acctbal > 0 AS positive FROM customer")
def column_changes(spark, d):
    doc = columns.rename(columns.rename(cn(spark, d), "nodes", "seg", "segment"), "nodes", "bal", "id")
    doc = columns.retype(columns.delete(doc, "nodes", "id"), "nodes", "segment", "number")
    return columns.delete(doc.with_(nodes=doc.nodes.withColumn("positive", F.col("bal") > 0)), "nodes", "bal").nodes.select("id", "segment", "positive")


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[=+@\\t\\r-]') AND TRY_CAST(c_name AS DOUBLE) IS NULL THEN '''' || c_name ELSE c_name END AS c_name FROM customer")
def csv_safe_cells(spark, d):
    from .sources.formats import safe_cell

    return _table(spark, d, "customer").select("c_custkey", safe_cell(F.col("c_name")).alias("c_name"))


@query("SELECT count(*) FILTER (WHERE NOT coalesce(s <> t, false)) AS loops, count(DISTINCT s) AS sources FROM (SELECT CAST(user_id AS VARCHAR) AS s, json_extract_string(props, '$.k') AS t FROM events)")
def cell_ids(spark, d):
    e = _table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    x = e.select(cells.cell_id(e, "user_id").alias("s"), cells.cell_id(e, "k").alias("t"))
    return x.agg(F.count(F.when(~F.coalesce(F.col("s") != F.col("t"), F.lit(False)), 1)).alias("loops"), F.count_distinct("s").alias("sources"))


@query(f"WITH {UU} SELECT s, t, pos, CASE WHEN s IN ('3', '5') AND coalesce(t IN ('3', '5'), false) THEN 'both' WHEN s IN ('3', '5') THEN 'out' ELSE 'in' END AS side FROM uu WHERE s IN ('3', '5') OR t IN ('3', '5')")
def incident_rows(spark, d):
    rows = details.incident_rows(graph.with_ends(uu(spark, d)), ["3", "5"])
    return rows.select("s", "t", F.col(POS).alias("pos"), "side")


@query(f"WITH {UU} SELECT pos FROM uu WHERE CAST(s AS INT) BETWEEN 1 AND 30 AND CAST(t AS INT) BETWEEN 1 AND 30")
def pair_rows(spark, d):
    wanted = [(str(a), str(b)) for a in range(1, 31) for b in range(1, 31)]
    return details.pair_rows(graph.with_ends(uu(spark, d)), wanted).select(F.col(POS).alias("pos"))


@query(f"""WITH {CN}, l AS (SELECT DISTINCT s, t FROM cn), o AS (SELECT s AS id, count(*) AS o FROM l GROUP BY s), i AS (SELECT t AS id, count(*) AS i FROM l GROUP BY t)
SELECT 'C' || c_custkey AS id, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree FROM customer LEFT JOIN o ON o.id = 'C' || c_custkey LEFT JOIN i ON i.id = 'C' || c_custkey""")
def recipe_replay(spark, d):
    new = details.replay(cn(spark, d), [details.Recipe("degree"), details.Recipe("degree")])
    return new.nodes.select("id", "in_degree", "out_degree")


@query(f"""WITH {CN} SELECT 'C' || c_custkey AS id, 0 AS depth FROM customer UNION ALL SELECT DISTINCT t, 1 FROM cn WHERE t LIKE 'N%' UNION ALL SELECT DISTINCT 'N' || n_nationkey, 0 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'R' || n_regionkey, min(CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 2 ELSE 1 END) FROM nation GROUP BY n_regionkey""")
def node_depths(spark, d):
    g = graph.base_graph(cn(spark, d))
    return details.node_depths(g.nodes, g.links)


# ---- what SQL can't express: tests look at optima, distances and invariants instead


@query()
def metric_louvain(spark, d):
    nodes, links = _uug(spark, d, "w")
    return community.communities(nodes, links).select("id", "community", r6("modularity"), "method")


@query()
def metric_louvain_stability(spark, d):
    g = graph.base_graph(fg(spark, d))
    return community.communities(g.nodes.select("id", "pos"), graph.weighted_links(g), stable=True).select("id", "community", "stability", "method")


@query()
def layout_circlepack(spark, d):
    c = _customers(spark, d)
    return arrange.layout(c.select("id", "group", (F.lit(4.0) + F.col("degree") / 3).alias("radius")), "circlepack")


@query()
def layout_force(spark, d):
    nodes, links = _uug(spark, d)
    return arrange.layout(nodes.select("id", F.lit(None).cast("string").alias("group"), F.lit(6.0).alias("radius")), "force", links)


_LAYERS = f"""WITH {CN}, l AS (SELECT DISTINCT s, t FROM cn), c0 AS (SELECT 'C' || c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS m FROM customer),
c1 AS (SELECT id, row_number() OVER (ORDER BY sc, id) - 1 AS k, count(*) OVER () AS m FROM (SELECT l.t AS id, avg(k) AS sc FROM l JOIN c0 ON c0.id = l.s GROUP BY l.t)),
c2 AS (SELECT id, row_number() OVER (ORDER BY sc, id) - 1 AS k, count(*) OVER () AS m FROM (SELECT l.t AS id, avg(k) AS sc FROM l JOIN c1 ON c1.id = l.s GROUP BY l.t)),
p AS (SELECT id, k, m, 0 AS d FROM c0 UNION ALL SELECT id, k, m, 1 FROM c1 UNION ALL SELECT id, k, m, 2 FROM c2)"""


def _layers(spark, d, **how):
    g = graph.base_graph(cn(spark, d))
    nodes, links = cut(dealt(g.nodes, "id")), cut(dealt(g.links, "s"))
    return style.layout_layers(details.node_depths(nodes, links).join(nodes.select("id", "pos"), "id"), links, **how).select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(f"{_LAYERS} SELECT id, round((k - (m - 1) / 2) * greatest(70, least(150, 1100 / m)), 4) + 0.0 AS x, 130.0 * d - 130.0 AS y FROM p")
def layout_layers(spark, d):
    return _layers(spark, d)


@query(f"""{_LAYERS}, q AS (SELECT id, k, m, greatest(140.0 * d, 40.0 * m / (2 * pi())) AS r FROM p)
SELECT id, round(r * cos(-pi() / 2 + 2 * pi() * k / m), 4) + 0.0 AS x, round(r * sin(-pi() / 2 + 2 * pi() * k / m), 4) + 0.0 AS y FROM q""")
def layout_radial(spark, d):
    return _layers(spark, d, radial=True)


@query(f"WITH {UU}, {US} SELECT a AS id, CAST(count(DISTINCT b) AS DOUBLE) AS value FROM us GROUP BY a")
def script_node_values(spark, d):
    g = graph.base_graph(uu(spark, d))
    return scripts.script_values(spark, "def run(graph):\n    return {k: len(set(v)) for k, v in graph['neighbors'].items()}", g.nodes, g.links, local=True)
