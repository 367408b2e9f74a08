"""Values as they are typed in and shown: cells from typed text, numbers and cells for reading, names of files."""

from __future__ import annotations

import math
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cells


def parse_cell(kind: str, raw: str) -> Any:
    """Typed text as a cell of a text, number or bool column; what can't be read that way stays text, blank is null."""
    text = raw.strip()
    if not text:
        return None
    if kind == "number":
        try:
            value = float(text) if "_" not in text else math.nan
        except ValueError:
            return raw
        return raw if math.isnan(value) else int(value) if value.is_integer() and abs(value) < 2**53 else value
    if kind == "bool" and text.lower() in ("true", "yes", "1", "false", "no", "0"):
        return text.lower() in ("true", "yes", "1")
    return raw


def parse_cells(c: Column, kind: str) -> Column:
    """The same over a text column, which stays text: numbers and booleans in their usual spelling."""
    from pyspark.sql import types as T

    filled = F.nullif(cells.trim(c), F.lit(""))
    if kind == "number":
        return F.when(filled.isNotNull(), F.coalesce(cells.text_of(cells.number_of(c, T.StringType()), T.DoubleType()), c))
    if kind == "bool":
        low = F.lower(filled)
        return F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false").when(filled.isNotNull(), c)
    return F.when(filled.isNotNull(), c)


def format_number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else f"{v:.1f}"


def format_metric(v: float | None) -> str:
    """Two significant digits below 1, one decimal above."""
    if v is None or not math.isfinite(v):
        return "–"
    if float(v).is_integer():
        return str(int(v))
    return f"{float(f'{v:.2g}'):.10f}".rstrip("0") if abs(v) < 1 else f"{v:.1f}"


def display_cell(v: Any, computed: bool = False) -> str:
    """Computed numbers rounded, all else as it came."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return format_metric(v) if computed else str(int(v)) if float(v).is_integer() else repr(v)
    return str(v)


def format_time(ms: float, span: float) -> str:
    """A moment as its axis needs it: days on an axis of more than two days, else minutes; years for plain years."""
    import datetime

    if 1000 <= abs(ms) <= 3000 and float(ms).is_integer():
        return str(int(ms))
    at = datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
    return at.strftime("%Y-%m-%d" if span > 2 * 86_400_000 else "%Y-%m-%d %H:%M")


def url_file_name(url: str) -> str:
    """The last part of a url's path, else its host."""
    parts = urlsplit(url)
    return unquote(parts.path.rstrip("/").rsplit("/", 1)[-1]) or parts.netloc
