"""Token counts, encoding and decoding against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest

from loomgraph.llm import bpe_transducer as B
from loomgraph.llm import token_counts as T

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(" \n\t  aabbcdeéüß中文字😀123'!?#s 　tlre") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(600)]
    return out + ["<|endoftext|>a b<|endoftext|>", " <|endoftext|> ", "a" * 500, "ab" * 300, " " * 50 + "x", "it's  we'll\n\n  ok ", "  a", "\n", "a \nb", "é" * 77, "", "word, word. " * 3000]


def test_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    counter, library = T.MergeCounter(P.path("byte_bpe_50k.json"), memo=50), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_are_the_librarys_and_decode(texts):
    import tiktoken

    own = B.Codec(VOCABULARY, P.PATTERN, memo=50)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(VOCABULARY), special_tokens={})
    for t in texts:
        ids = library.encode_ordinary(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == t


    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for few in (texts, texts[:1], [], ["", None, "a", ""]):
        known = [library.encode_ordinary(t or "") for t in few]
        assert own.digests(few) == ([len(x) for x in known], [sha(",".join(map(str, x))) for x in known], [sha(t or "") for t in few])


def test_every_code_point_has_the_librarys_class():
    import tiktoken
    from tokenizers import Tokenizer

    counter, library = T.MergeCounter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = B.Codec(VOCABULARY, P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(VOCABULARY), special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1000):  # beside a contraction, a letter, a number, a mark, and alone
        text = " ".join(f"{c}'ll b{c}c 1{c}2 !{c}? {c}" for c in points[k : k + 1000])
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(k)
        ids = other.encode_ordinary(text)
        assert own.encode(text) == ids and own.decode(ids) == text, hex(k)


def _streamed(data: bytes) -> str:
    """Through tokens of one byte each: every state of the machine is passed one by one."""
    return "".join(B.Utf8Machine({b: bytes([b]) for b in range(256)}).characters(data))


def test_stream_is_the_librarys_on_broken_bytes():
    rng = random.Random(8)
    parts = [bytes([b]) for b in range(256)] + [c.encode() for c in "aé中😀́z\ud7ff\ue000\U0010ffff"] + [b"\xe4\xb8", b"\xf0\x9f", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc0\x80"]
    for _ in range(20_000):
        data = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        assert _streamed(data) == data.decode("utf-8", "replace"), data


def test_tokens_that_cut_characters(texts):
    rng, vocabulary = random.Random(9), B.read_ranks(VOCABULARY)
    machine, token = B.Utf8Machine({r: t for t, r in vocabulary.items()}), {r: t for t, r in vocabulary.items()}
    odd = [r for r, t in token.items() if t.decode("utf-8", "replace").encode() != t]
    for _ in range(3000):
        ids = [rng.choice(odd) if rng.random() < 0.7 else rng.randrange(50_000) for _ in range(rng.randint(0, 9))]
        assert machine.text(ids) == "".join(machine.characters(ids)) == b"".join(token[i] for i in ids).decode("utf-8", "replace")


def test_tables(spark):
    rows = [(1, "a b c", "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["n_bytes"], r["over_limit"]) for r in T.count_tokens(df, P.path("byte_bpe_50k.json")).collect()}
    assert got == {(1, 5, False), (2, 0, False), (3, 0, False), (4, 25000, True)}
    out = B.round_trip(df, VOCABULARY, P.PATTERN).collect()
    assert len(out) == 5 and {r["n_tokens"] for r in out if r["doc_id"] in (2, 3)} == {0}
    encoded = B.encode_documents(df, VOCABULARY, P.PATTERN)
    back = {r["doc_id"]: r["text"] for r in B.decode_documents(encoded, VOCABULARY, P.PATTERN).collect()}
    assert back == {1: "a b c", 2: "", 3: "", 4: "word " * 5000}
    assert T.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    assert B.round_trip(df.limit(0), VOCABULARY, P.PATTERN).count() == 0
