"""Cell semantics as column expressions: text, id, key, number and time of a cell, whatever its column's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE_SPACE = r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Spellings of dates that are read besides ISO ones.
_DATES = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM yyyy"),
)
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def trim(c: Column) -> Column:
    """Without white space of any kind, or byte order marks, at either end."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def text_of(c: Column, kind: T.DataType) -> Column:
    """A cell as text: whole numbers without a fraction, times as ISO 8601, bytes as base64, nested values as JSON."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e18)
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    if isinstance(kind, T.DecimalType):
        return text_of(c.cast("double"), T.DoubleType())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(c, _ISO)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def number_of(c: Column, kind: T.DataType) -> Column:
    """A cell as a finite number, or null: plain decimal spellings only, booleans are none."""
    if isinstance(kind, T.BooleanType) or isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return F.lit(None).cast("double")
    if isinstance(kind, T.NumericType):
        d = c.cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)
    s = trim(text_of(c, kind))
    d = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    return F.when(F.abs(d) != float("inf"), d)


def time_of(c: Column, kind: T.DataType) -> Column:
    """Epoch milliseconds: numbers as they are, else ISO dates and times."""
    if isinstance(kind, T.TimestampNTZType):  # the same whatever the session's zone
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        s = trim(c)
        spelled = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(form))) for shape, form in _DATES]
        return F.coalesce(number_of(c, kind), F.when(s.rlike(r"\d"), F.unix_millis(F.coalesce(F.try_to_timestamp(s), *spelled)).cast("double")))
    return number_of(c, kind)


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def text(df: DataFrame, name: str) -> Column:
    return text_of(df[name], _kind(df, name))


def cell_id(df: DataFrame, name: str) -> Column:
    """Node id: trimmed text, blank is null."""
    return F.nullif(trim(text(df, name)), F.lit(""))


def cell_key(df: DataFrame, name: str) -> Column:
    """Group key: trimmed text, null is ''."""
    return F.coalesce(trim(text(df, name)), F.lit(""))


def num(df: DataFrame, name: str) -> Column:
    return number_of(df[name], _kind(df, name))


def tms(df: DataFrame, name: str) -> Column:
    return time_of(df[name], _kind(df, name))


def coerce(df: DataFrame, name: str, to: str) -> Column:
    """A cell as 'text', 'number' or 'bool', or null."""
    if to == "number":
        return num(df, name)
    t = cell_id(df, name)
    if to == "text":
        return t
    low = F.lower(t)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def replace_expr(c: Column, find: str, by: str, regex: bool = False, match_case: bool = False, whole: bool = False) -> Column:
    """Find and replace in text; `by` is literal unless regex."""
    import re

    pattern = find if regex else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", find)
    pattern = f"^(?:{pattern})$" if whole else pattern
    value = by if regex else by.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, F.lit(pattern if match_case else f"(?i){pattern}"), F.lit(value))


def curve(t: Column, kind: str = "linear") -> Column:
    """Scale curves over 0..1."""
    if kind == "sqrt":
        return F.sqrt(t)
    if kind == "log":
        return F.log1p(9 * t) / F.log1p(F.lit(9.0))
    return t


def ramp_color(t: Column, stops: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, stops)), (F.least(F.lit(len(stops) - 1), F.floor(t * len(stops))) + 1).cast("int"))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x, y of a web map, y downwards; latitudes beyond the map's edge are pulled to it."""
    edge = 85.05112878
    phi = F.radians(F.least(F.lit(edge), F.greatest(F.lit(-edge), lat)))
    return F.radians(lon), -F.log(F.tan(F.lit(3.141592653589793 / 4) + phi / 2))


# The named colours of style sheets.
_NAMED = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd blue 0000ff
blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c
cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f
darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3
deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc
ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c
indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff
lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de
lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371
mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080
oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5
peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1
saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090
slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee
wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()
COLOR_NAMES = {name: f"#{value}" for name, value in zip(_NAMED[::2], _NAMED[1::2])}


def parse_color(c: Column) -> Column:
    """#rrggbb of hex notations, rgb()/rgba() and names, else null."""
    s = F.lower(trim(c))
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(s, k, 1), 2) for k in (2, 3, 4)])
    rgb = r"^rgba?\(\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\s*[, ]\s*(\d{1,3})\b.*\)$"
    part = lambda k: F.lpad(F.lower(F.hex(F.least(F.lit(255), F.regexp_extract(s, rgb, k).cast("int")).cast("long"))), 2, "0")
    names = F.create_map(*[F.lit(x) for kv in COLOR_NAMES.items() for x in kv])
    return (
        F.when(s.rlike(r"^#[0-9a-f]{3,4}$"), short)
        .when(s.rlike(r"^#([0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(s, 1, 7))
        .when(s.rlike(rgb), F.concat(F.lit("#"), part(1), part(2), part(3)))
        .otherwise(F.try_element_at(names, s))
    )


def image_kind(c: Column) -> Column:
    """'data', 'url', 'svg' or 'base64' by how a cell names a picture, else null."""
    s = trim(c)
    return (
        F.when(s.rlike(r"(?i)^data:image/"), "data").when(s.rlike(r"(?i)^https?://"), "url").when(s.rlike(r"(?i)^<svg[\s>]"), "svg")
        .when(s.rlike(r"^(iVBORw0KGgo|/9j/|R0lGOD|UklGR|PHN2Zy)"), "base64")
    )


# How pictures in base64 begin.
_BASE64 = (("iVBORw0KGgo", "image/png"), ("/9j/", "image/jpeg"), ("R0lGO", "image/gif"), ("UklGR", "image/webp"), ("PHN2Z", "image/svg+xml"), ("PD94b", "image/svg+xml"))


def image_source(c: Column) -> Column:
    """What a cell gives to draw: picture data and http(s) urls as they are, markup and bare base64 as data, else null."""
    s = trim(c)
    packed = F.regexp_replace(s, r"\s+", "")
    bare = F.length(packed) > 24
    kind = F.lit(None).cast("string")
    for head, mime in reversed(_BASE64):
        kind = F.when(packed.startswith(head), F.lit(mime)).otherwise(kind)
    whole = F.when(bare & packed.rlike(r"^[A-Za-z0-9+/=]+$") & kind.isNotNull(), F.concat(F.lit("data:"), kind, F.lit(";base64,"), packed))
    markup = s.startswith("<") & s.rlike(r"(?i)<svg[\s>]") & s.rlike(r"(?i)</svg\s*>")
    return (
        F.when(s.rlike(r"(?i)^data:"), F.when(s.rlike(r"(?i)^data:image/[a-z0-9.+-]+[;,]"), s)).when(is_remote(s), s)
        .when(markup, F.concat(F.lit("data:image/svg+xml;charset=utf-8,"), F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))).otherwise(whole)
    )


def is_remote(c: Column) -> Column:
    """Does drawing it ask another server?"""
    return c.rlike(r"(?i)^https?://")
