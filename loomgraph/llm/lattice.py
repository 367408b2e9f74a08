"""Lattices of subword pieces: sums over all segmentations of many words at once.

A word's lattice has its byte positions as nodes and as edges all pieces of the vocabulary that are found there. The
forward recursion sums, in log space, over the pieces that end at a position; with the backward one it gives the
expected number of times that each piece is used. Words of equal length are one block of numpy columns, so every
step of the recursion is one operation over all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Cells (position, piece length, word) that are held at once.
CELLS = 1_000_000
#: Positions of a long word that are gone through at once.
STRIDE = 4096

_TIMES = 0x9E3779B97F4A7C15  # an odd multiplier for hashes of bytes
_SPREAD = 0xD6E8FEB86659FD93  # another, for places in the table
_BITS = 1 << 64


class Lattice:
    def __init__(self, pieces: Sequence[bytes], log_weights: np.ndarray):
        """Every byte has to be a piece of its own, else a word may have no segmentation."""
        self.longest = max(map(len, pieces))
        self.log_weights = np.append(log_weights, -np.inf)  # the last stands for no piece
        self.bits = max(4, (8 * len(pieces)).bit_length())
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for place, piece in enumerate(pieces):
            key = 0
            for b in piece:
                key = (key * _TIMES + b + 1) % _BITS
            at, tries = (key * _SPREAD % _BITS) >> (64 - self.bits), 1
            while self.places[at] >= 0:
                at, tries = (at + 1) % (1 << self.bits), tries + 1
            self.keys[at], self.places[at], self.probes = key, place, max(self.probes, tries)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The places of the pieces with these hashes, -1 where there is none."""
        at = (keys * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)
        found, other = self.places[at], self.keys[at] != keys
        open_ = np.nonzero(other & (found >= 0))
        found[other] = -1
        for _ in range(self.probes - 1):
            if not len(open_[0]):
                break
            at[open_] = (at[open_] + np.uint64(1)) % np.uint64(1 << self.bits)
            hit, same = self.places[at[open_]], self.keys[at[open_]] == keys[open_]
            found[tuple(x[same] for x in open_)] = hit[same]
            left = ~same & (hit >= 0)
            open_ = tuple(x[left] for x in open_)
        return found

    def _pieces(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length, the places of the pieces of that length by first position and word. data: position, word."""
        keys = one = data.astype(np.uint64) + np.uint64(1)
        for length in range(1, min(self.longest, len(data)) + 1):
            if length > 1:
                keys = keys[:-1] * np.uint64(_TIMES) + one[length - 1 :]
            yield length, self._find(keys)

    def _edges(self, data: np.ndarray, pieces: Iterable[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
        """Log weights of pieces by end, length - 1 and word."""
        n, w = data.shape
        out = np.full((n + 1, min(n, self.longest), w), -np.inf)
        for length, places in pieces or self._pieces(data):
            out[length:, length - 1] = self.log_weights[places]
        return out

    def _forward(self, edges: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations up to each position. known: those of the first positions."""
        out = np.empty((len(edges), edges.shape[2]))
        out[: len(known)] = known
        for p in range(len(known), len(edges)):
            m = min(p, edges.shape[1])
            out[p] = _log_sum(out[p - m : p][::-1] + edges[p, :m])
        return out

    def _long(self, word: bytes) -> float:
        """Of one long word: only the sums that later pieces may start from are kept."""
        known, start = np.zeros((1, 1)), 0
        while start + len(known) - 1 < len(word):
            data = np.frombuffer(word[start : start + len(known) - 1 + STRIDE], np.uint8)[:, None]
            sums = self._forward(self._edges(data), known)
            keep = min(len(sums), self.longest)
            start, known = start + len(sums) - keep, sums[-keep:]
        return float(known[-1, 0])

    def _blocks(self, words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of words of one length, and their bytes by position and word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        ends = np.flatnonzero(np.diff(sizes[order])) + 1
        for some in np.split(order, ends) if len(order) else []:
            n = int(sizes[some[0]])
            step = max(1, CELLS // ((n + 1) * max(1, min(n, self.longest))))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                yield part, np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(len(part), n).T

    def log_marginals(self, words: Sequence[bytes]) -> np.ndarray:
        """Natural logarithm of the summed weights of all segmentations of each word."""
        out = np.zeros(len(words))
        long = {i: w for i, w in enumerate(words) if len(w) > STRIDE}
        for i, w in long.items():
            out[i] = self._long(w)
        short = [i for i in range(len(words)) if i not in long] if long else range(len(words))
        for part, data in self._blocks([words[i] for i in short] if long else words):
            where = np.asarray(short)[part] if long else part
            out[where] = self._forward(self._edges(data), np.zeros((1, len(part))))[-1]
        return out

    def expected(self, words: Sequence[bytes], counts: Sequence[int]) -> np.ndarray:
        """How often each piece is used in `counts` occurrences of each word, in expectation over segmentations. Words
        longer than STRIDE are cut there."""
        cut = [(w[k : k + STRIDE], n) for w, n in zip(words, counts) for k in range(0, len(w), STRIDE)]
        total, n_of = np.zeros(len(self.log_weights)), np.array([n for _, n in cut], np.float64)
        for part, data in self._blocks([w for w, _ in cut]):
            n, pieces = len(data), list(self._pieces(data))
            edges = self._edges(data, pieces)
            ahead = self._forward(edges, np.zeros((1, len(part))))
            back = np.zeros_like(ahead)
            for p in range(n - 1, -1, -1):
                m = np.arange(min(n - p, edges.shape[1]))
                back[p] = _log_sum(back[p + 1 + m] + edges[p + 1 + m, m])
            for length, places in pieces:
                start, word = np.nonzero(places >= 0)
                if len(start):
                    own = places[start, word]
                    odds = np.exp(ahead[start, word] + self.log_weights[own] + back[start + length, word] - ahead[-1, word]) * n_of[part[word]]
                    total += np.bincount(own, weights=odds, minlength=len(total))
        return total[:-1]


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(0)
    return top + np.log(np.exp(terms - top).sum(0))
