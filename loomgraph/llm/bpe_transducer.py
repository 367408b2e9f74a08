"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A sequence of tokens is what the merges give for a piece exactly if each token is what the merges give
for its own bytes and each two neighbours are what the merges give for their joined bytes. So a nondeterministic
transducer over bytes reads the piece: its states are (node in the trie of token bytes, the token before), and a
token may end wherever it may follow the token before. `Transducer` determinises it while it reads: a state is the
set of live (node, token before, tokens not yet emitted) with the tokens common to all of them emitted, which is
what bounds the lookahead. Where the token before doesn't matter any more it isn't kept, and what can't be finished
is dropped, so there are few states. States and transitions are made when first met and kept, up to a bound.

Decoding. `Utf8Machine` is an incremental state machine over bytes: a state is how many bytes of a character are
still to come, in which bounds the next one has to be, and the bits so far. Its moves are lifted to whole tokens when
first met, so ids stream through it one by one, and no character is cut between two of them. `round_trip` sends every
id that it emitted through that machine and hashes the characters that come out.

Between two single spaces a text's pieces don't depend on what is around them, so ids and decoded characters of such
a cut are kept, up to a bound; a cut is whole characters, at whose ends the decoder is in its first state.

Runs in Arrow batches, one scan, no shuffle. Cases: a null text is an empty one (no ids, the digests of empty
strings); texts of any length are taken whole; repeated rows are encoded each; an empty table gives an empty
result; only the key is carried, so other columns can't clash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .classes import Pieces, differing
from .common import blocks, claim, small_batches
from .token_counts import Memo, cuts

#: Cuts in a generation of the memo. Half as many states are kept before the machine is built anew.
MEMO = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: In a state, instead of a token before: any may be, or none. Looked at where a node leads to FEW tokens at most.
ANY, NONE, FEW = -2, -3, 4


class Transducer:
    """Encodes pieces (bytes) with mergeable ranks."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks, self.memo = ranks, memo
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if (step := self.child.get(node << 8 | b)) is None:
                    step = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = step
            self.ends[node] = rank
        # What a node leads to: 0 no token, 1 up to FEW, 2 more.
        above, below = [0] * len(self.ends), [0] * len(self.ends)
        for key, node in self.child.items():
            above[node] = key >> 8
        for node in range(len(above) - 1, 0, -1):
            below[above[node]] += below[node] + (self.ends[node] >= 0)
        self.grows = bytearray(0 if not n else 1 if n <= FEW else 2 for n in below)
        self.pairs: dict[int, bool] = {}  # token before << 20 | token
        self.below: dict[int, list[int]] = {}
        self.kinds: dict[int, int] = {}  # token before << 20 | node
        self.edges: tuple[dict, dict] = ({}, {})
        self._fresh()

    def _fresh(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((0, -1, ()),))

    def _state(self, live: tuple) -> dict:
        """A state: transitions by byte, the live set at -2, and at -1 what is left to emit if the piece ends here."""
        if (known := self.states.get(live)) is None:
            known = self.states[live] = {-2: live, -1: next((held for node, _, held in live if node == 0), None)}
        return known

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token joins; None for one byte, and for what no merges make."""
        parts, top = [token[k : k + 1] for k in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, top) for a, b in zip(parts, parts[1:])]
            low = min(joined)
            if low >= top:
                return None
            at = joined.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]] | None:
        """The symbols that stand at one edge of a token while it is merged, from its byte to the whole, each with
        the rank of the merge that ends it; None if no merges make the token."""
        known = self.edges[side].get(token, 0)
        if known == 0:
            out, part, until = [], self.token[token], float("inf")
            while True:
                out.append((part, until))
                if len(part) == 1:
                    break
                if (halves := self._halves(part)) is None:
                    out = None
                    break
                until, part = self.ranks[part], halves[side]
            known = self.edges[side][token] = out and out[::-1]
        return known

    def follows(self, before: int, token: int) -> bool:
        """May `token` come after `before` (-1: at the start)? Not if, at some time of the merging, the symbols on
        either side of the border would be joined before one of them grows; of equal ranks the left comes first."""
        known = self.pairs.get(before << 20 | token)
        if known is None:
            right = self._edge(token, 0)
            left = self._edge(before, 1) if before >= 0 else None
            known = right is not None and (before < 0 or left is not None)
            if known and before >= 0:
                rank_of, i, j = self.ranks.get, 0, 0
                while True:
                    (x, x_until), (y, y_until) = left[i], right[j]
                    rank = rank_of(x + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
                        break
                    if x_until <= y_until:
                        i += 1
                        if i == len(left):
                            break
                    else:
                        j += 1
            if len(self.pairs) >= 2 * self.memo:
                self.pairs.clear()
            self.pairs[before << 20 | token] = known
        return known

    def _tokens_below(self, node: int) -> list[int]:
        if (known := self.below.get(node)) is None:
            known, stack = [], [node]
            while stack:
                at = stack.pop()
                for b in range(256):
                    if (step := self.child.get(at << 8 | b)) is not None:
                        if self.ends[step] >= 0:
                            known.append(self.ends[step])
                        if self.grows[step]:
                            stack.append(step)
            self.below[node] = known
        return known

    def _kind(self, node: int, before: int) -> int:
        """What the token before means at a node that leads to few tokens: itself, ANY if each of them may follow it,
        NONE if none may. So states that go on alike are one."""
        ok = [self.follows(before, token) for token in self._tokens_below(node)]
        known = ANY if all(ok) else before if any(ok) else NONE
        if len(self.kinds) >= 2 * self.memo:
            self.kinds.clear()
        self.kinds[before << 20 | node] = known
        return known

    def _step(self, state: dict, b: int) -> tuple[dict, tuple[int, ...]]:
        live, child, ends, grows, pairs, kinds = [], self.child.get, self.ends, self.grows, self.pairs.get, self.kinds.get
        for node, before, held in state[-2]:
            if (node := child(node << 8 | b)) is not None:
                if more := grows[node]:
                    if more == 2 or before == ANY:
                        kind = before
                    elif (kind := kinds(before << 20 | node)) is None:
                        kind = self._kind(node, before)
                    if kind != NONE:
                        live.append((node, kind, held))
                if (end := ends[node]) >= 0:
                    if before == ANY:
                        ok = True
                    elif (ok := pairs(before << 20 | end)) is None:
                        ok = self.follows(before, end)
                    if ok:
                        live.append((0, end, (*held, end)))
        common, first = 0, live[0][2]
        if first:
            common = len(first)
            for _, _, held in live:
                if held is not first:
                    common = min(common, len(held))
                    while common and held[:common] != first[:common]:
                        common -= 1
                if not common:
                    break
            else:
                live = [(node, before, held[common:]) for node, before, held in live]
        out = state[b] = self._state(tuple(live)), first[:common]
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) >= self.memo:
            self._fresh()
        state, out = self.start, []
        for b in piece:
            state, emitted = state.get(b) or self._step(state, b)
            if emitted:
                out += emitted
        return [*out, *state[-1]]


#: A state of the decoder: bytes still to come, bounds of the next one, bits so far.
Pending = tuple[int, int, int, int]
START: Pending = (0, 0x80, 0xBF, 0)
# Lead bytes after which the second byte has narrower bounds.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}
_LOST = "\ufffd"


def utf8_step(state: Pending, b: int) -> tuple[str, Pending]:
    """The characters that a byte completes, and the state after it. What is no UTF-8 becomes U+FFFD, one for each
    longest beginning of a character."""
    need, low, high, bits = state
    if need:
        if low <= b <= high:
            bits = bits << 6 | b & 0x3F
            return (chr(bits), START) if need == 1 else ("", (need - 1, 0x80, 0xBF, bits))
        said, after = utf8_step(START, b)  # the beginning is lost; the byte is read anew
        return _LOST + said, after
    if b < 0x80:
        return chr(b), START
    if 0xC2 <= b <= 0xDF:
        return "", (1, 0x80, 0xBF, b & 0x1F)
    if 0xE0 <= b <= 0xEF:
        return "", (2, *_SECOND.get(b, (0x80, 0xBF)), b & 0x0F)
    if 0xF0 <= b <= 0xF4:
        return "", (3, *_SECOND.get(b, (0x80, 0xBF)), b & 0x07)
    return _LOST, START


class Utf8Machine:
    """The state machine over bytes with its moves by whole tokens, made when first met."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[Pending, dict[int, tuple[str, Pending]]] = {START: {}}
        #: Characters of the tokens that lead from the first state to itself.
        self.whole: dict[int, str] = {}

    def move(self, state: Pending, token: int) -> tuple[str, Pending]:
        said, after = [], state
        for b in self.tokens[token]:
            chars, after = utf8_step(after, b)
            said.append(chars)
        if state not in self.moves and len(self.moves) > 10_000:
            self.moves = {START: self.moves[START]}
        out = self.moves.setdefault(state, {})[token] = "".join(said), after
        if state == after == START:
            self.whole[token] = out[0]
        return out

    def characters(self, ids: Iterable[int]) -> Iterator[str]:
        """Streaming: the characters that each id completes, and U+FFFD for a beginning that stays unfinished."""
        state = START
        for i in ids:
            said, state = self.moves.get(state, {}).get(i) or self.move(state, i)
            if said:
                yield said
        if state != START:
            yield _LOST

    def text(self, ids: list[int]) -> str:
        """All characters. Ids that lead from the first state to itself are taken in bulk."""
        said: list[str | None] = list(map(self.whole.get, ids))
        if None in said:
            at, n = 0, len(ids)
            while True:
                try:
                    at = said.index(None, at)
                except ValueError:
                    break
                state = START
                while at < n:
                    said[at], state = self.moves.get(state, {}).get(ids[at]) or self.move(state, ids[at])
                    at += 1
                    if state == START:
                        break
                else:
                    said.append(_LOST)
        return "".join(said)


def _packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class Cuts(dict):
    """Packed ids of a space and what follows it up to the next cut, made when first asked for. Of two generations of
    `limit` entries the older is dropped when the younger is full; long cuts aren't kept. None for what is no cut:
    white space at an end belongs to the neighbours."""

    def __init__(self, codec: "Codec", limit: int, longest: int = 200):
        super().__init__()
        self.codec, self.limit, self.longest, self.old = codec, limit, longest, {}
        self.encode, self.letters = codec.machine.encode, codec.letters

    def __missing__(self, cut: str) -> bytes | None:
        value = self.old.get(cut)
        if value is None:
            if self.letters and cut.isalpha():
                value = _packed(self.encode(f" {cut}".encode()))
            elif self.letters and cut[-1:] in _MARKS and cut[:-1].isalpha():  # letters, then one piece of one mark
                value = self[cut[:-1]] + _packed(self.codec.pieces[cut[-1]])
            elif not cut or cut[0].isspace() or cut[-1].isspace():
                return None
            else:
                value = _packed(self.codec.plain(f" {cut}"))
        if len(cut) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[cut] = value
        return value


_MARKS = frozenset(".,;:!?")


class Codec:
    """Whole texts: cuts them into pieces, encodes and decodes."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO, differ: Sequence[tuple[int, int, str]] | None = None):
        self.machine = Transducer(read_ranks(path), memo // 2)
        self.decoder = Utf8Machine(self.machine.token)
        self.cut = Pieces(pattern, differ)
        self.letters = r"| ?\p{L}+|" in pattern  # a space and letters are one piece
        self.pieces = Memo(lambda piece: tuple(self.machine.encode(piece.encode("utf-8"))), memo // 8)
        self.rest = Cuts(self, memo)
        decimal = {i: b",%d" % i for i in self.machine.token}
        self.width = np.zeros(max(decimal, default=0) + 1, np.int64)
        self.width[list(decimal)] = list(map(len, decimal.values()))
        self.decimal = np.zeros((len(self.width), max(1, self.width.max())), np.uint8)
        for i, digits in decimal.items():
            self.decimal[i, : len(digits)] = memoryview(digits)

    def plain(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.pieces.__getitem__, self.cut(text)))

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return _packed(self.plain(first)) + b"".join(map(self.rest.__getitem__, rest))
            except TypeError:  # a part that is no cut
                pass
        first, *rest = cuts(text)
        return _packed(self.plain(first)) + b"".join([self.rest[cut] or _packed(self.plain(f" {cut}")) for cut in rest])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.uint32).tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        return self.decoder.text(ids)

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text how many ids, and the SHA-256 of the ids joined by commas and of the characters that they
        decode to."""
        held = [self.packed(t) if t else b"" for t in texts]
        sizes = [len(h) // 4 for h in held]
        ids = np.frombuffer(b"".join(held), np.uint32)
        ends = np.cumsum([0, *sizes])
        places = np.concatenate(([0], np.cumsum(self.width[ids])))[ends].tolist()
        digits = self.decimal[ids]
        joined = memoryview(digits[digits != 0].tobytes())  # zero bytes fill up the rows of the table
        flat, ends = ids.tolist(), ends.tolist()
        told = [hashlib.sha256(joined[a + 1 : z] if z > a else b"").hexdigest() for a, z in zip(places, places[1:])]
        said = [hashlib.sha256(self.decode(flat[a:z]).encode("utf-8", "replace")).hexdigest() for a, z in zip(ends, ends[1:])]
        return sizes, told, said


_codecs: dict[tuple[str, str], Codec] = {}


@contextmanager
def _without_cycle_search() -> Iterator[None]:
    """While a task runs: what is kept has no cycles, and looking for them takes a seventh of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def codec(vocabulary: str, pattern: str, differ: Sequence[tuple[int, int, str]]) -> Codec:
    """One for each Python worker, vocabulary and pattern."""
    claim("bpe", _codecs.clear)
    if (vocabulary, pattern) not in _codecs:
        _codecs[vocabulary, pattern] = Codec(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary), pattern, differ=differ)
    return _codecs[vocabulary, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: the token ids of every text."""
    small_batches(docs)
    kind, differ = dict(docs.dtypes)[key], differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            own = codec(vocabulary, pattern, differ)
            ids = pa.array([own.encode(t) if t else [] for t in block.column("__text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column("__key"), ids], [key, "ids"])

    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the characters of every list of ids, by the incremental state machine."""
    small_batches(encoded)
    kind, differ = dict(encoded.dtypes)[key], differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(vocabulary, pattern, differ)
            texts = pa.array([own.decode(x or ()) for x in batch.column("__ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), texts], [key, "text"])

    return encoded.selectExpr(f"`{key}` AS __key", f"`{ids}` AS __ids").mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    small_batches(docs)
    kind, differ = dict(docs.dtypes)[key], differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _without_cycle_search():
            for block in blocks(batches, "__text"):
                own = codec(vocabulary, pattern, differ)
                columns = own.digests(block.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([block.column("__key"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
