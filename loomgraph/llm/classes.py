"""Pieces of texts by a tokenizer's pattern, with letters and numbers as the tokenizer libraries know them.

The libraries and `regex` follow different versions of Unicode, so some thousand characters are letters to one and not
to the other. Which ones is asked of a library once, all code points at a time; a text that has such a character is
cut as if it had one of the library's class in its place. `\\s` is the same set in all of them (tested)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import regex

#: Stand-ins of a class: none of them stands in a pattern by itself.
_LETTER, _NUMBER, _OTHER = "ª", "²", "͸"


def _asked(pattern: str, text: str) -> set[str]:
    """The characters that a library's pattern finds."""
    import tiktoken

    alone = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(alone.decode(alone.encode_ordinary(text)))


@cache
def differing() -> tuple[tuple[int, int, str], ...]:
    """First and last code point, and stand-in, of the ranges that `regex` puts into another class than the library."""
    text = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    out: dict[int, str] = {}
    for pattern, own in ((r"\p{N}", _NUMBER), (r"\p{L}", _LETTER)):
        theirs, ours = _asked(pattern, text), set(regex.findall(pattern, text))
        out |= {ord(c): own for c in theirs - ours} | {ord(c): out.get(ord(c), _OTHER) for c in ours - theirs}
    ranges: list[tuple[int, int, str]] = []
    for c in sorted(out):
        if ranges and ranges[-1][1] == c - 1 and ranges[-1][2] == out[c]:
            ranges[-1] = (ranges[-1][0], c, out[c])
        else:
            ranges.append((c, c, out[c]))
    return tuple(ranges)


class Pieces:
    """Called with a text: its pieces in order."""

    def __init__(self, pattern: str, differ: Sequence[tuple[int, int, str]] | None = None):
        self.pattern = regex.compile(pattern)
        self.table = {c: stand_in for first, last, stand_in in (differing() if differ is None else differ) for c in range(first, last + 1)}
        self.odd = frozenset(map(chr, self.table))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.table))]
