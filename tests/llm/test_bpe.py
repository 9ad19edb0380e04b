import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from spanforge.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "Don't  stop\n\n\tnow  ", "été 東京 \U0001f600 12345 x_y ", "<|endoftext|>", "\x00\x1c​﻿", "a" * 3000, "ab" * 4000, "  " * 500 + "x", "é" * 2000]


def test_like_the_library(library):
    rng = random.Random(1)
    bpe = B.Bpe.from_file(PATH, P.PATTERN)
    made = ["".join(rng.choice("aabcdeéñü東 \n'1.!") for _ in range(rng.randrange(400))) for _ in range(300)]
    long = ["".join(rng.choice("abcdefgh") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))]
    for t in TEXTS + made + long:
        ids = bpe.encode(t)
        assert ids == library.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 3)
    monkeypatch.setattr(B, "CACHED_BYTES", 4)
    bpe = B.Bpe.from_file(PATH, P.PATTERN)
    for t in ["one two three four five six one two", "abcdefgh abcdefgh zzzz", "one"] * 2:
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_rank_queue_pops_in_order():
    rng = random.Random(2)
    q, held = B.RankQueue(50_000), []
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            x = (rng.randrange(50_000), rng.randrange(10**6))
            q.push(*x)
            held.append(x)
        else:
            assert q.pop() == min(held)
            held.remove(min(held))
    while held:
        assert q.pop() == min(held)
        held.remove(min(held))
    assert q.pop() is None


def test_query_form(spark, docs_of, library):
    rows = list(enumerate([None, *TEXTS, "same", "same"])) + [(None, "x")]
    got = sorted(B.bpe_digests(docs_of(rows).repartition(3), PATH, P.PATTERN).collect(), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(B_row(r)))
    assert B.bpe_digests(docs_of([]), PATH, P.PATTERN).collect() == []
    encoded = B.encode_texts(docs_of(rows), PATH, P.PATTERN)
    back = {r.doc_id: bytes(r.data) for r in B.decode_ids(encoded, PATH, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}


def B_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], n_tokens=r[1], ids_sha256=r[2], decoded_sha256=r[3])
