"""Counts, ranges, histograms, groupings, rankings and searches over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import POS
from ..plans.scratch import cut, dropped


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """value, n: by key (blank is ''), most frequent first."""
    out = df.groupBy(cells.cell_key(df, column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(limit) if limit is not None else out


def numeric_range(df: DataFrame, column: str) -> DataFrame:
    v = df.select(cells.num(df, column).alias("v"))
    return v.agg(F.min("v").alias("low"), F.max("v").alias("high"))


def histogram(df: DataFrame, column: str, bins: int = 24, time: bool = False) -> DataFrame:
    """bin, low, n of equal bins over the range, empty ones left out; whole numbers get one bin a value at most."""
    v = df.select((cells.tms if time else cells.num)(df, column).alias("v")).where("v IS NOT NULL")
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min((F.col("v") == F.floor("v")).cast("int")).alias("whole"))
    few = F.when(F.col("whole") == 1, F.least(F.lit(float(bins)), F.col("hi") - F.col("lo") + 1)).otherwise(float(bins))
    r = r.withColumn("k", few).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("k")).otherwise(1.0))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.col("k") - 1).cast("long")
    counted = v.crossJoin(F.broadcast(r)).groupBy(at.alias("bin"), "lo", "width").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "n")


def breakdown(df: DataFrame, by: str, measure: str | None = None, how: str = "count", limit: int | None = None) -> DataFrame:
    """key, value: counts, sums, or averages over all rows of the group (missing numbers count as 0)."""
    total = F.sum(F.coalesce(cells.num(df, measure), F.lit(0.0))) if measure else None
    value = {"count": lambda: F.count("*").cast("double"), "sum": lambda: total, "avg": lambda: total / F.count("*")}[how]()
    out = df.groupBy(cells.cell_key(df, by).alias("key")).agg(value.alias("value")).orderBy(F.desc("value"), "key")
    return out.limit(limit) if limit is not None else out


def group_table(df: DataFrame, by: str, column: str) -> DataFrame:
    """key, n, sum, avg, min, max over the numeric cells of each group; null where a group has none."""
    v = cells.num(df, column)
    return df.groupBy(cells.cell_key(df, by).alias("key")).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"))


def group_tables(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """key, n, and of each column its sum, avg, min and max (NAME_sum, ...) over the numeric cells: one pass."""
    aggs = [f(cells.num(df, c)).alias(f"{c}_{name}") for c in columns for name, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(cells.cell_key(df, by).alias("key")).agg(F.count("*").alias("n"), *aggs)


def groupable(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """column_name, values, groupable: are there at most `limit` values (max(40, half of the rows) unless given)?"""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_distinct(cells.cell_key(df, c)).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in columns]))
    most = F.lit(limit) if limit is not None else F.greatest(F.lit(40.0), F.col("__n") / 2)
    return counts.select("__n", each.alias("e")).select("e.column_name", "e.n_values", (F.col("e.n_values") <= most).alias("groupable"))


def infer_types(df: DataFrame, columns: list[str], sample: int = 200) -> dict[str, str]:
    """'number', 'bool' or 'text' by the first rows' non-blank cells."""
    head = df.orderBy(POS).limit(sample)
    marks = []
    for c in columns:
        filled = cells.cell_id(head, c)
        marks += [F.count(filled).alias(f"{c}|n"), F.count(cells.num(head, c)).alias(f"{c}|num"), F.count(F.when(F.lower(filled).isin("true", "false", "yes", "no"), 1)).alias(f"{c}|bool")]
    row = head.agg(*marks).first()
    kind = lambda n, num, boo: "text" if not n else "bool" if boo == n else "number" if num >= 0.8 * n else "text"
    return {c: kind(row[f"{c}|n"], row[f"{c}|num"], row[f"{c}|bool"]) for c in columns}


def column_role(df: DataFrame, column: str, sample: int = 200) -> str | None:
    """'color', 'url', 'image' or 'time' where nine of ten filled cells (two at least) agree."""
    head = df.orderBy(POS).limit(sample)
    t = cells.cell_id(head, column)
    picture = cells.image_kind(t)
    tests = {"color": cells.parse_color(t).isNotNull(), "image": picture.isin("data", "svg", "base64") | t.rlike(r"(?i)^https?://\S+\.(png|jpe?g|gif|svg|webp)(\?\S*)?$"), "url": picture == "url", "time": t.rlike(r"^\d{4}-\d{2}(-\d{2})?")}
    row = head.agg(F.count(t).alias("n"), *[F.count(F.when(F.coalesce(e, F.lit(False)), 1)).alias(k) for k, e in tests.items()]).first()
    return next((k for k in tests if row["n"] >= 2 and row[k] >= 0.9 * row["n"]), None)


def top(df: DataFrame, by: str, limit: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(limit)


def hit(df: DataFrame, columns: list[str], query: str) -> Column:
    """Does any of the columns contain the text, in either case?"""
    low = query.lower()
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(cells.text(df, c)), F.lit(low)), F.lit(False))
    return out


def search_first(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """All rows with `hit`; those that contain the text come first."""
    return df.withColumn("hit", hit(df, columns, query)).orderBy(F.desc("hit"), POS)


def search_only(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Only the rows that contain the text: the form of the search in a grouped table."""
    return df.where(hit(df, columns, query))


def sort_keys(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """What sorted tables are ordered by: numbers by value, text with the digits in it by theirs; blank cells last, ties as
    they stood."""
    number = isinstance(df.schema[column].dataType, T.NumericType)
    key = cells.num(df, column) if number else natural_key(cells.cell_id(df, column))
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(POS).asc()]


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column, in the order of `sort_keys`."""
    return df.orderBy(*sort_keys(df, column, descending))


class Remembered:
    """Statistics of a table's columns, worked out once for each version of the table and kept as small tables."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, {}

    def get(self, df: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        key = (id(df), name)
        if key not in self.held:
            while len(self.held) >= self.most:
                dropped(self.held.pop(next(iter(self.held)))[1])
            self.held[key] = (df, cut(work(df)))  # holding the table keeps its id its own
        return self.held[key][1]


def search_nodes(nodes: DataFrame, query: str, limit: int = 12, exclude: tuple[str, ...] = ()) -> DataFrame:
    """id, label of nodes whose id or label contains the text; those that begin with it first."""
    low = F.lit(query.lower())
    name, label = F.lower("id"), F.lower("label")
    begins = F.startswith(name, low) | F.startswith(label, low)
    found = nodes.where((F.contains(name, low) | F.contains(label, low)) & ~F.col("id").isin(list(exclude)) if exclude else F.contains(name, low) | F.contains(label, low))
    return found.orderBy(F.desc(begins), "id").limit(limit).select("id", "label")


def natural_key(c: Column) -> Column:
    """Sorts digits inside text by their value."""
    value = lambda run: F.regexp_replace(run, "^0+(?=.)", "")
    padded = lambda run: F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(value(run)).cast("string"), 6, "0"), value(run))).otherwise(run)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1)), padded), "")


def time_columns(df: DataFrame, columns: list[str], sample: int = 50, roles: dict[str, str] | None = None) -> list[str]:
    """Columns with the role `time`, and those that read as times: years or epoch numbers, or text half of which parses."""
    head = df.orderBy(POS).limit(sample)
    out = []
    for c in columns:
        if (roles or {}).get(c) == "time":
            out.append(c)
            continue
        v = head.select(cells.num(head, c).alias("n"), cells.tms(head, c).alias("t"), cells.cell_id(head, c).alias("x")).where("x IS NOT NULL")
        r = v.agg(F.count("*").alias("k"), F.count("n").alias("n"), F.count("t").alias("t"), F.min(((F.col("n") >= 1000) & (F.col("n") <= 3000) & (F.col("n") == F.floor("n"))).cast("int")).alias("years"), F.min((F.col("n") >= 1e8).cast("int")).alias("epochs")).first()
        if r["k"] and (r["n"] == r["k"] and (r["years"] or r["epochs"]) or r["n"] < r["k"] and 2 * r["t"] >= r["k"]):
            out.append(c)
    return out
