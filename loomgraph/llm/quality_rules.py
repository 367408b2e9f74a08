"""Quality rules: a threshold table compiled into one projection of built-in expressions.

`measures` gives the expressions of length, symbol, stop-word and line ratios; `RULES` is the table of
thresholds; `apply_rules` compiles the table into a single projection. No user function runs: one scan, no
shuffle, so a hot source or a group of copies costs what any other rows cost.

Cases: a null text counts as an empty one (no words, all counts 0, `base_failed` true); texts of any length are
taken whole; repeated rows give repeated results; an empty table gives an empty result; other columns of the
input are carried only if `keep` names them, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word pattern, symbol characters, frequent words of four languages.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the of and to a in that is for it with as was on are by this from or an be at",
    "fr": "le la les de des du un une et en que qui dans pour par sur au avec ce est ne pas",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es",
    "es": "el la los las de del un una y en que a se por con para no su es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """Keep a text when low <= measure <= high; a missing bound is open."""

    name: str
    low: float | None = None
    high: float | None = None


#: The production table. Texts that fail any line are rejected.
RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", None, 0.4),
    Rule("repeated_word_ratio", None, 0.5),
    Rule("exclamation_ratio", None, 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside a window of three words that the text has twice or more.

    Window hashes are sorted; only a text with two equal ones sorts (hash, place) pairs too, to add up what the
    repeated windows cover: each start covers three words, or fewer if the next start comes sooner."""
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        twice = F.filter(pairs, lambda p, k: F.coalesce(same(k, k + 1), F.lit(False)) | (k > 0) & F.coalesce(same(k, k - 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(s, k + 1) - p), F.lit(3))), F.lit(0), lambda a, x: a + x))

    return F.when(n < 4, F.lit(0)).when(_let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(_let(paired, covered))


def _let(value: Column, body) -> Column:
    """`body` over `value`, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures() -> dict[str, Column]:
    """Expressions by name, over helper columns that `apply_rules` lays out."""
    words, n = F.col("__words"), F.col("__n")
    bare = F.col("__text")
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(bare)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words, n).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))).cast("long"),
        "n_exclamations": (F.length("__text") - F.length(F.replace("__text", F.lit("!"), F.lit("")))).cast("long"),
    }


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",), min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """`keep` columns, the counts, `base_failed`, `failed_rules` (names in the table's order) and `kept`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split("__text", WORD_SPLIT), lambda w: w != "")
    laid = docs.select(*[F.col(c) for c in keep], whole.alias("__text"))
    laid = laid.select(*keep, "__text", words.alias("__words")).withColumn("__n", F.size("__words"))
    counted = laid.select(*keep, *[e.alias(n) for n, e in measures().items()])
    n = F.col("n_words")
    ratio = {
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
        "duplicate_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeated_word_ratio": _ratio(F.col("n_repeat_words"), n),
        "exclamation_ratio": _ratio(F.col("n_exclamations"), n),
    }
    broken = lambda r: (ratio[r.name] < r.low if r.low is not None else F.lit(False)) | (ratio[r.name] > r.high if r.high is not None else F.lit(False))
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    base = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    return counted.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
