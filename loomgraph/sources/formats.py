"""Readers and writers of tabular and graph files.

Tables of any size go through Spark's readers; single documents (GEXF, GraphML, DOT, node-link JSON, workspaces) are
parsed on the driver, as their formats are one tree each."""

from __future__ import annotations

import base64
import csv
import io
import json
import os
import re
import zlib
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..model import POS, GraphDoc, Mapping, build_doc, guess_mapping, with_positions
from ..operators import columns, stats
from ..plans import positions

#: Characters that a link's payload may unpack to.
MAX_UNPACKED = 64 << 20
#: Rows of one in-memory document.
WORKING_SET = 200_000
WORKSPACE_VERSION = 1


@dataclass
class Parsed:
    """Rows of a parsed document: dicts of cells by column, in order."""

    edges: list[dict[str, Any]]
    nodes: list[dict[str, Any]] | None = None
    mapping: Mapping | None = None
    node_id: str | None = None
    directed: bool = True
    extra: dict[str, Any] = field(default_factory=dict)


# ---- reading tables


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A table by its extension, with positions in file order; cells of text formats stay text, and their rows are
    written once."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if not kind and os.path.isfile(path):
        with open(path, "rb") as f:
            kind = ".parquet" if f.read(4) == b"PAR1" else kind
    if kind == ".parquet":
        df = spark.read.parquet(path)
        if len(df.columns) < 2:
            raise ValueError("a table needs two columns at least")
        df = with_positions(df)
    elif kind in (".csv", ".tsv", ".txt"):
        df = positions.of_text(spark.read.csv(path, header=True, sep="\t" if kind == ".tsv" else ",", inferSchema=False, multiLine=True, escape='"'), POS)
    elif kind in (".jsonl", ".ndjson"):
        df = positions.of_text(spark.read.json(path, mode="FAILFAST"), POS)
    elif kind == ".json":
        df = positions.of_text(spark.read.json(path, multiLine=True), POS)
    elif kind in (".xlsx", ".xls", ".xlsm", ".ods"):
        df = next(iter(read_sheets(spark, path).values()))
    else:
        raise ValueError(f"no reader for {kind or path}")
    return df if limit is None else df.orderBy(POS).limit(limit)


def sheet_tables(spark: SparkSession, sheets: dict[str, Any]) -> dict[str, DataFrame]:
    """Tables by sheet name, of the pandas frames that have a row and two columns at least; none is an error."""
    good = {name: frame for name, frame in sheets.items() if len(frame.columns) >= 2 and len(frame)}
    if not good:
        raise ValueError("no sheet has a header, two columns and a row")
    return {name: with_positions(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))) for name, frame in good.items()}


def read_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every usable sheet of a spreadsheet (pandas and its reader for the kind are needed), cells as text."""
    import pandas as pd

    return sheet_tables(spark, pd.read_excel(path, dtype=str, sheet_name=None))


def read_capped(spark: SparkSession, path: str, limit: int = WORKING_SET) -> tuple[DataFrame, int, bool]:
    """The first rows of a table, how many it has, and if some were left out; a table without rows is an error."""
    df = read_table(spark, path)
    total = df.count()
    if not total:
        raise ValueError("the table has no rows")
    return df.orderBy(POS).limit(limit), total, total > limit


def visible_csv(df: DataFrame, order: list[str], hidden: tuple[str, ...] = (), by: str | None = None, descending: bool = False) -> str:
    """The table as it is shown: its columns in their order, rows sorted as chosen, cells safe for spreadsheets."""
    shown = columns.visible(stats.sort_rows(df, by, descending) if by else df.orderBy(POS), order, hidden)
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\r\n")
    rows.writerow(shown.columns)
    safe = shown.select(*[safe_cell(cells.text(shown, c)).alias(c) for c in shown.columns]).limit(WORKING_SET + 1).collect()
    if len(safe) > WORKING_SET:
        raise ValueError(f"more than {WORKING_SET} rows: write the table as files instead")
    rows.writerows(["" if v is None else v for v in r] for r in safe)
    return out.getvalue()


def create_view(df: DataFrame, name: str) -> None:
    """Lets SQL read the table by name."""
    df.drop(POS).createOrReplaceTempView(name)


def from_records(spark: SparkSession, rows: Any) -> DataFrame:
    """A table of a pandas frame, dicts (ragged ones are squared off), pairs or triples (the third is a weight), or a
    network object with edges(data=True)."""
    if hasattr(rows, "edges") and callable(rows.edges):
        rows = [{"source": a, "target": b, **d} for a, b, d in rows.edges(data=True)]
    if hasattr(rows, "to_dict"):
        rows = rows.to_dict("records")
    rows = list(rows)
    if rows and isinstance(rows[0], (tuple, list)):
        rows = [dict(zip(("source", "target", "weight"), r)) for r in rows]
    if not rows:
        raise ValueError("no rows")
    return to_doc(spark, Parsed(_records([dict(r) for r in rows]))).edges


def gist_id(text: str) -> str | None:
    """The id in an address or a bare id."""
    m = re.search(r"(?:^|/)([0-9a-f]{20,32})(?:$|[/?#])", text.strip())
    return m[1] if m else None


def probe(path: str, sample: int = 65536) -> tuple[int, bool]:
    """Rows of a local file, and whether that is exact: a parquet footer, else line breaks of the first part."""
    if path.endswith(".parquet"):
        import pyarrow.parquet as pq

        return pq.ParquetFile(path).metadata.num_rows, True
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(sample)
    lines = head.count(b"\n")
    if size <= len(head):
        return max(0, lines + (not head.endswith(b"\n") and bool(head)) - 1), True
    return max(0, round(lines * size / len(head)) - 1), False


def _letters(k: int) -> str:
    """A, B, ..., Z, AA, AB, ..."""
    return (_letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def parse_pasted(text: str) -> Parsed:
    """Delimited text: the first row is a header if its cells are distinct and filled."""
    text = text.lstrip("﻿")
    try:
        dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel_tab if "\t" in text else csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)]
    if not rows or max(map(len, rows)) < 2:
        raise ValueError("two columns and a row are needed")
    first = [c.strip() for c in rows[0]]
    header = all(first) and len(set(first)) == len(first) and not any(re.fullmatch(r"[+-]?\d+(\.\d+)?", c) for c in first)
    width = max(map(len, rows))
    names = [*(first if header else []), *(f"Column {_letters(k)}" for k in range(len(first) if header else 0, width))]
    body = rows[1:] if header else rows
    if not body:
        raise ValueError("no rows")
    edges = [{n: (r[k] if k < len(r) and r[k] != "" else None) for k, n in enumerate(names)} for r in body]
    return Parsed(edges, mapping=guess_mapping(names))


# ---- JSON


def _cell(value: Any) -> Any:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else value


def _records(rows: list[dict]) -> list[dict]:
    names = list(dict.fromkeys(k for r in rows for k in r))
    return [{n: _cell(r.get(n)) for n in names} for r in rows]


def parse_json(text: str) -> Parsed:
    """Records, one record, node-link documents, or lines of records."""
    text = text.lstrip("﻿").strip()
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        rows = []
        for k, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    rows.append(json.loads(line))
                except json.JSONDecodeError as e:
                    raise ValueError(f"line {k} is no JSON") from e
        data = rows
    if isinstance(data, dict) and isinstance(data.get("links", data.get("edges")), list) and "nodes" in data:
        return _node_link(data)
    if isinstance(data, dict) and (sheets := [v for v in data.values() if isinstance(v, list) and v and all(isinstance(r, dict) for r in v)]):
        # An object of tables: the first is the edges, the second, if any, the nodes.
        edges, *more = [_records(v) for v in sheets]
        names = list(edges[0])
        return Parsed(edges, more[0] if more else None, mapping=guess_mapping(names) if len(names) >= 2 else None)
    rows = _records(data if isinstance(data, list) else [data])
    if not rows:
        raise ValueError("no records")
    names = list(rows[0])
    return Parsed(rows, mapping=guess_mapping(names) if len(names) >= 2 else None)


def _node_link(data: dict) -> Parsed:
    nodes = _records([n if isinstance(n, dict) else {"id": n} for n in data["nodes"]])
    links = _records([dict(x) for x in data.get("links", data.get("edges"))])
    names = list(nodes[0]) if nodes else ["id"]
    key = next((c for c in ("id", "name", "key", "label", "node") if c in names), names[0])
    ids = [n.get(key) for n in nodes]
    known = {str(i) for i in ids}
    ends = [x.get(c) for x in links for c in ("source", "target")]
    by_place = bool(ends) and all(isinstance(e, int) and not isinstance(e, bool) and 0 <= e < len(ids) for e in ends) and not any(str(e) in known for e in ends)
    for x in links:
        for c in ("source", "target"):
            e = x.get(c)
            if isinstance(e, str) and e.startswith("{"):
                e = json.loads(e).get(key)
            x[c] = ids[e] if by_place else e
    return Parsed(links, nodes, Mapping("source", "target"), key, bool(data.get("directed", True)))


# ---- XML


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _typed(value: str | None, kind: str | None) -> Any:
    if value is None:
        return None
    if kind in ("integer", "int", "long", "float", "double"):
        try:
            number = float(value)
            return int(number) if number.is_integer() else number
        except ValueError:
            return None
    if kind in ("boolean", "bool"):
        return value.strip().lower() in ("true", "1")
    return value


def _labels_as_ids(nodes: list[dict], labels: list[str | None]) -> dict[str, str]:
    """Labels take the ids' place if each node has one of its own."""
    if nodes and all(labels) and len(set(labels)) == len(labels):
        return {n["id"]: label for n, label in zip(nodes, labels)}
    return {n["id"]: n["id"] for n in nodes}


def parse_gexf(text: str) -> Parsed:
    root = ET.fromstring(text)
    kinds: dict[str, dict[str, tuple[str, str]]] = {"node": {}, "edge": {}}
    for group in (e for e in root.iter() if _local(e.tag) == "attributes"):
        for a in (e for e in group if _local(e.tag) == "attribute"):
            kinds[group.get("class", "node")][a.get("id")] = (a.get("title") or a.get("id"), a.get("type", "string"))

    def values(e: ET.Element, of: str) -> dict:
        out = {}
        for v in (x for x in e.iter() if _local(x.tag) == "attvalue"):
            name, kind = kinds[of].get(v.get("for") or v.get("id"), (v.get("for"), "string"))
            out[name] = _typed(v.get("value"), kind)
        return out

    nodes, labels, edges = [], [], []
    for e in (x for x in root.iter() if _local(x.tag) == "node"):
        place = next((x for x in e if _local(x.tag) == "position"), None)
        at = {} if place is None else {"x": _typed(place.get("x"), "double"), "y": _typed(place.get("y"), "double")}
        nodes.append({"id": e.get("id"), **values(e, "node"), **at})
        labels.append(e.get("label"))
    names = _labels_as_ids(nodes, labels)
    for n in nodes:
        n["id"] = names[n["id"]]
    graph = next((x for x in root.iter() if _local(x.tag) == "graph"), None)
    for e in (x for x in root.iter() if _local(x.tag) == "edge"):
        row = {"source": names.get(e.get("source"), e.get("source")), "target": names.get(e.get("target"), e.get("target")), **values(e, "edge")}
        if e.get("weight") is not None:
            row["weight"] = _typed(e.get("weight"), "double")
        edges.append(row)
    return Parsed(_records(edges), _records(nodes), Mapping("source", "target"), "id", graph is None or graph.get("defaultedgetype", "undirected") == "directed")


def parse_graphml(text: str) -> Parsed:
    root = ET.fromstring(text)
    keys, defaults = {}, {"node": {}, "edge": {}}
    for k in (e for e in root.iter() if _local(e.tag) == "key"):
        name, of, kind = k.get("attr.name") or k.get("id"), k.get("for", "all"), k.get("attr.type", "string")
        keys[k.get("id")] = (name, kind)
        given = next((x.text for x in k if _local(x.tag) == "default"), None)
        if given is not None:
            for side in ("node", "edge") if of == "all" else (of,):
                if side in defaults:
                    defaults[side][name] = _typed(given, kind)

    def values(e: ET.Element, of: str) -> dict:
        out = dict(defaults[of])
        for x in (x for x in e if _local(x.tag) == "data"):
            name, kind = keys.get(x.get("key"), (x.get("key"), "string"))
            out[name] = _typed(x.text, kind)
        return out

    nodes = [{"id": e.get("id"), **values(e, "node")} for e in root.iter() if _local(e.tag) == "node"]
    label = next((c for c in ("label", "name", "title") if nodes and all(n.get(c) for n in nodes) and len({n[c] for n in nodes}) == len(nodes)), None)
    names = {n["id"]: str(n[label]) if label else n["id"] for n in nodes}
    for n in nodes:
        n["id"] = names[n["id"]]
        if label:
            n.pop(label, None)
    edges = [{"source": names.get(e.get("source"), e.get("source")), "target": names.get(e.get("target"), e.get("target")), **values(e, "edge")} for e in root.iter() if _local(e.tag) == "edge"]
    graph = next((x for x in root.iter() if _local(x.tag) == "graph"), None)
    return Parsed(_records(edges), _records(nodes), Mapping("source", "target"), "id", graph is None or graph.get("edgedefault", "directed") == "directed")


# ---- DOT

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|^\#[^\n]*|(?P<arrow>->|--)|(?P<mark>[{}\[\];,=:])|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<word>[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*|-?(?:\.\d+|\d+(?:\.\d*)?))|(?P<html><)', re.S | re.M)


def _dot_tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} in the graph")
        at = m.end()
        if m.lastgroup == "html":
            depth = 1
            start = at
            while depth and at < len(text):
                depth += {"<": 1, ">": -1}.get(text[at], 0)
                at += 1
            out.append(("id", re.sub(r"<[^>]*>", "", text[start : at - 1]).strip()))
        elif m.lastgroup == "quoted":
            body = m[0][1:-1].replace("\\\n", "")
            out.append(("id", re.sub(r"\\([\"\\])", r"\1", body).replace("\\n", "\n")))
        elif m.lastgroup == "word":
            out.append(("id", m[0]))
        elif m.lastgroup:
            out.append(("op", m[0]))
    return out


class _Dot:
    def __init__(self, text: str):
        self.tokens, self.at = _dot_tokens(text), 0
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []
        self.directed = True

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if value is not None and (kind, got) != ("op", value) or kind == "end":
            raise ValueError(f"expected {value or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def has(self, value: str) -> bool:
        return self.peek() == ("op", value)

    def graph(self) -> Parsed:
        if self.peek()[1].lower() == "strict":
            self.take()
        word = self.take().lower()
        if word not in ("graph", "digraph"):
            raise ValueError("no graph")
        self.directed = word == "digraph"
        if not self.has("{"):
            self.take()
        self.block({}, {}, None)
        for row in self.nodes.values():
            if isinstance(row.get("pos"), str) and (m := re.match(r"^\s*(-?[\d.]+),(-?[\d.]+)!?$", row["pos"])):
                row["x"], row["y"] = float(m[1]), -float(m[2])
                del row["pos"]
        nodes = [{"id": k, **v} for k, v in self.nodes.items()]
        return Parsed(_records(self.edges), _records(nodes), Mapping("source", "target"), "id", self.directed)

    def attributes(self) -> dict:
        out = {}
        while self.has("["):
            self.take("[")
            while not self.has("]"):
                name = self.take()
                out[name] = True
                if self.has("="):
                    self.take("=")
                    out[name] = self.take()
                while self.has(",") or self.has(";"):
                    self.take()
            self.take("]")
        return out

    def block(self, node_defaults: dict, edge_defaults: dict, cluster: str | None) -> list[str]:
        self.take("{")
        nodes, edges, seen = dict(node_defaults), dict(edge_defaults), []
        while not self.has("}"):
            if self.has(";") or self.has(","):
                self.take()
                continue
            word = self.peek()[1].lower() if self.peek()[0] == "id" else ""
            if word in ("node", "edge", "graph") and self.peek(1) == ("op", "["):
                self.take()
                (nodes if word == "node" else edges if word == "edge" else {}).update(self.attributes())
            elif self.peek()[0] == "id" and self.peek(1) == ("op", "="):
                name = self.take()
                self.take("=")
                value = self.take()
                if cluster is not None and name == "label":
                    for n in seen:
                        if self.nodes[n].get("Cluster") == cluster:
                            self.nodes[n]["Cluster"] = value
                    cluster = value
            else:
                seen += self.statement(nodes, edges, cluster)
        self.take("}")
        return list(dict.fromkeys(seen))

    def end(self, nodes: dict, edges: dict, cluster: str | None) -> list[str]:
        if self.has("{") or self.peek()[1].lower() == "subgraph":
            name = None
            if not self.has("{"):
                self.take()
                if not self.has("{"):
                    name = self.take()
            return self.block(nodes, edges, name if name and name.startswith("cluster") else cluster)
        name = self.take()
        while self.has(":"):
            self.take(":")
            self.take()
        row = self.nodes.setdefault(name, {})
        for k, v in nodes.items():
            row.setdefault(k, v)
        if cluster is not None:
            row.setdefault("Cluster", cluster)
        return [name]

    def statement(self, nodes: dict, edges: dict, cluster: str | None) -> list[str]:
        plain = not (self.has("{") or self.peek()[1].lower() == "subgraph")
        chain = [self.end(nodes, edges, cluster)]
        while self.has("->") or self.has("--"):
            self.take()
            chain.append(self.end(nodes, edges, cluster))
        given = self.attributes()
        if len(chain) == 1 and plain:
            self.nodes[chain[0][0]].update(given)
        for left, right in zip(chain, chain[1:]):
            self.edges += [{"source": a, "target": b, **edges, **given} for a in left for b in right]
        return [n for part in chain for n in part]


def parse_dot(text: str) -> Parsed:
    return _Dot(text).graph()


# ---- links and workspaces


def encode_payload(text: str) -> str:
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = packer.compress(text.encode()) + packer.flush()
    return "z" + base64.urlsafe_b64encode(packed).decode().rstrip("=")


def decode_payload(payload: str) -> str:
    kind, body = payload[:1], payload[1:]
    data = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    if kind == "u":
        return data.decode()
    if kind != "z":
        raise ValueError("unknown payload")
    out = zlib.decompressobj(-15)
    text = out.decompress(data, MAX_UNPACKED)
    if out.unconsumed_tail:
        raise ValueError("the link unpacks to too much")
    return text.decode()


def check_source_url(url: str) -> str:
    if not re.match(r"^https?://[^\s/@]+(/|$)", url):
        raise ValueError("an http(s) address without credentials is needed")
    return url


def write_workspace(edges: list[dict], nodes: list[dict] | None, mapping: Mapping, node_id: str | None, recipe: dict | None = None, positions: dict[str, tuple[float, float]] | None = None) -> str:
    doc: dict[str, Any] = {"version": WORKSPACE_VERSION, "edges": edges, "mapping": {"source": mapping.source, "target": mapping.target}}
    if nodes is not None:
        doc |= {"nodes": nodes, "nodeIdColumn": node_id}
    if recipe:
        doc["recipe"] = recipe
    if positions:
        doc["positions"] = {k: [round(x, 2), round(y, 2)] for k, (x, y) in positions.items()}
    return json.dumps(doc, ensure_ascii=False, default=str)


def parse_workspace(text: str) -> Parsed:
    """Refuses documents of newer versions and without tables; drops recipes' unknown parts and clamps their numbers."""
    doc = json.loads(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("edges"), list):
        raise ValueError("no workspace")
    if doc.get("version", 0) > WORKSPACE_VERSION:
        raise ValueError("the workspace is of a newer version")
    recipe = doc.get("recipe") if isinstance(doc.get("recipe"), dict) else {}
    if recipe:
        recipe["depth"] = min(6, max(0, int(recipe.get("depth", 1))))
        recipe["edgeLimit"] = min(WORKING_SET, max(1, int(recipe.get("edgeLimit", WORKING_SET))))
    m = doc.get("mapping") or {}
    names = list(doc["edges"][0]) if doc["edges"] else [m.get("source", "source"), m.get("target", "target")]
    mapping = Mapping(m["source"], m["target"]) if m.get("source") in names and m.get("target") in names else guess_mapping(names)
    return Parsed(doc["edges"], doc.get("nodes"), mapping, doc.get("nodeIdColumn"), extra={"recipe": recipe, "positions": doc.get("positions", {})})


def detect(name: str, text: str) -> str:
    """Format by extension, else by content."""
    kind = os.path.splitext(name)[1].lower()
    known = {".gexf": "gexf", ".graphml": "graphml", ".dot": "dot", ".gv": "dot", ".jsonl": "json", ".ndjson": "json"}
    if kind in known:
        return known[kind]
    head = text.lstrip("﻿ \t\r\n")[:2000]
    if re.search(r"<gexf\b", head):
        return "gexf"
    if re.search(r"<graphml\b", head):
        return "graphml"
    if head.startswith("{") and '"version"' in text and '"edges"' in text and '"mapping"' in text:
        return "workspace"
    if kind == ".json":
        return "json"
    if re.match(r"(strict\s+)?(di)?graph\b[^{]*\{", head, re.I):
        return "dot"
    return "json" if head[:1] in ("{", "[") else "delimited"


def parse_text(name: str, text: str) -> Parsed:
    return {"gexf": parse_gexf, "graphml": parse_graphml, "dot": parse_dot, "json": parse_json, "workspace": parse_workspace, "delimited": parse_pasted}[detect(name, text)](text)


def to_doc(spark: SparkSession, parsed: Parsed) -> GraphDoc:
    """A document of text columns (numbers where all filled cells are), in the order of the rows."""

    def frame(rows: list[dict]) -> DataFrame:
        names = list(dict.fromkeys(k for r in rows for k in r))
        number = {n: any(r.get(n) is not None for r in rows) and all(r.get(n) is None or isinstance(r[n], (int, float)) and not isinstance(r[n], bool) for r in rows) for n in names}
        schema = ", ".join([f"`{n}` {'double' if number[n] else 'string'}" for n in names] + [f"{POS} long"])
        cast = lambda n, v: None if v is None else float(v) if number[n] else ("true" if v is True else "false" if v is False else str(v))
        return spark.createDataFrame([(*[cast(n, r.get(n)) for n in names], k) for k, r in enumerate(rows)], schema)

    nodes = frame(parsed.nodes) if parsed.nodes else None
    return build_doc(frame(parsed.edges), nodes, parsed.mapping, parsed.node_id)


# ---- writing


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    danger = c.rlike(r"^[=+@\t\r-]") & c.try_cast("double").isNull()
    return F.when(danger, F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    """Any number of rows, with neutralised cells, in position order inside each part."""
    columns = [c for c in df.columns if not c.startswith("__")]
    df.select(*[safe_cell(cells.text(df, c)).alias(c) for c in columns]).write.csv(path, header=True, quote='"', escape='"')


def csv_text(rows: list[dict]) -> str:
    out = io.StringIO()
    names = list(dict.fromkeys(k for r in rows for k in r))
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(names)
    for r in rows:
        writer.writerow([_safe(r.get(n)) for n in names])
    return out.getvalue()


def _safe(value: Any) -> Any:
    text = "" if value is None else "true" if value is True else "false" if value is False else str(value)
    if text[:1] in ("=", "+", "-", "@", "\t", "\r"):
        try:
            float(text)
        except ValueError:
            return "'" + text
    return text


def _kind_of(rows: list[dict], name: str) -> str:
    filled = [r[name] for r in rows if r.get(name) is not None]
    return "boolean" if filled and all(isinstance(v, bool) for v in filled) else "double" if filled and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in filled) else "string"


def _shown(value: Any) -> str:
    return "true" if value is True else "false" if value is False else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _columns(rows: list[dict], without: set[str]) -> list[str]:
    return [k for k in dict.fromkeys(k for r in rows for k in r) if k not in without]


def _tables(parsed: Parsed) -> tuple[list[dict], list[dict], str, str, str]:
    s, t = parsed.mapping.source, parsed.mapping.target
    key = parsed.node_id or "id"
    nodes = list(parsed.nodes or [])
    known = {str(n.get(key)) for n in nodes}
    for e in parsed.edges:
        for end in (e.get(s), e.get(t)):
            if end is not None and str(end) not in known:
                known.add(str(end))
                nodes.append({key: end})
    return [e for e in parsed.edges if e.get(s) is not None and e.get(t) is not None], nodes, key, s, t


def write_gexf(parsed: Parsed, positions: dict[str, tuple[float, float]] | None = None) -> str:
    edges, nodes, key, s, t = _tables(parsed)
    root = ET.Element("gexf", {"xmlns": "http://gexf.net/1.3", "xmlns:viz": "http://gexf.net/1.3/viz", "version": "1.3"})
    graph = ET.SubElement(root, "graph", {"defaultedgetype": "directed" if parsed.directed else "undirected"})
    named = {"node": _columns(nodes, {key}), "edge": _columns(edges, {s, t, "weight"})}
    for of, rows in (("node", nodes), ("edge", edges)):
        group = ET.SubElement(graph, "attributes", {"class": of})
        for k, c in enumerate(named[of]):
            ET.SubElement(group, "attribute", {"id": str(k), "title": c, "type": _kind_of(rows, c)})

    def values(at: ET.Element, row: dict, of: str) -> None:
        held = [(k, row[c]) for k, c in enumerate(named[of]) if row.get(c) is not None]
        if held:
            group = ET.SubElement(at, "attvalues")
            for k, v in held:
                ET.SubElement(group, "attvalue", {"for": str(k), "value": _shown(v)})

    group = ET.SubElement(graph, "nodes")
    for n in nodes:
        at = ET.SubElement(group, "node", {"id": _shown(n[key]), "label": _shown(n[key])})
        values(at, n, "node")
        if positions and _shown(n[key]) in positions:
            x, y = positions[_shown(n[key])]
            ET.SubElement(at, "viz:position", {"x": f"{x:g}", "y": f"{-y:g}"})
    group = ET.SubElement(graph, "edges")
    for k, e in enumerate(edges):
        own = {"id": str(k), "source": _shown(e[s]), "target": _shown(e[t])}
        if isinstance(e.get("weight"), (int, float)):
            own["weight"] = _shown(e["weight"])
        values(ET.SubElement(group, "edge", own), e, "edge")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def write_graphml(parsed: Parsed) -> str:
    edges, nodes, key, s, t = _tables(parsed)
    root = ET.Element("graphml", {"xmlns": "http://graphml.graphdrawing.org/xmlns"})
    ids: dict[tuple[str, str], str] = {}
    for of, rows, without in (("node", nodes, {key}), ("edge", edges, {s, t})):
        for c in _columns(rows, without):
            ids[of, c] = f"{of[0]}{len(ids)}"
            ET.SubElement(root, "key", {"id": ids[of, c], "for": of, "attr.name": c, "attr.type": _kind_of(rows, c)})
    graph = ET.SubElement(root, "graph", {"edgedefault": "directed" if parsed.directed else "undirected"})
    for of, rows in (("node", nodes), ("edge", edges)):
        for r in rows:
            at = ET.SubElement(graph, of, {"id": _shown(r[key])} if of == "node" else {"source": _shown(r[s]), "target": _shown(r[t])})
            for c, v in r.items():
                if (of, c) in ids and v is not None:
                    ET.SubElement(at, "data", {"key": ids[of, c]}).text = _shown(v)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def _quoted(value: Any) -> str:
    return '"' + _shown(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def write_dot(parsed: Parsed, positions: dict[str, tuple[float, float]] | None = None) -> str:
    edges, nodes, key, s, t = _tables(parsed)
    attrs = lambda r, without: [f"{_quoted(c)}={_quoted(v)}" for c, v in r.items() if c not in without and v is not None]
    lines = ["digraph {" if parsed.directed else "graph {"]
    for n in nodes:
        own = attrs(n, {key})
        if positions and _shown(n[key]) in positions:
            x, y = positions[_shown(n[key])]
            own.append(f'pos="{x:g},{-y:g}!"')
        lines.append(f"  {_quoted(n[key])}" + (f" [{', '.join(own)}]" if own else "") + ";")
    arrow = "->" if parsed.directed else "--"
    for e in edges:
        own = attrs(e, {s, t})
        lines.append(f"  {_quoted(e[s])} {arrow} {_quoted(e[t])}" + (f" [{', '.join(own)}]" if own else "") + ";")
    return "\n".join([*lines, "}", ""])


def collected(doc: GraphDoc, limit: int = WORKING_SET) -> Parsed:
    """The document's rows on the driver, for formats of one tree; refuses more than the working set."""

    def rows(df: DataFrame) -> list[dict]:
        got = df.orderBy(POS).limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"more than {limit} rows: write a table instead")
        return [{k: v for k, v in r.asDict().items() if not k.startswith("__")} for r in got]

    return Parsed(rows(doc.edges), None if doc.nodes is None else rows(doc.nodes), doc.mapping, doc.node_id)


def export(doc: GraphDoc, kind: str) -> str:
    parsed = collected(doc)
    if kind == "csv":
        return csv_text(parsed.edges)
    if kind == "workspace":
        return write_workspace(parsed.edges, parsed.nodes, parsed.mapping, parsed.node_id)
    if kind == "link":
        return encode_payload(write_workspace(parsed.edges, parsed.nodes, parsed.mapping, parsed.node_id))
    return {"gexf": write_gexf, "graphml": write_graphml, "dot": write_dot}[kind](parsed)
