"""The registered queries against their SQL, and against brute force where there is none, on the small tables."""

import hashlib
import os
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from spanforge.llm import registry

from ..oracle import SF_DIR, connect, rows_of
from .conftest import groups_of
from .test_simhash import slow_fingerprint

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall())


def run(spark, name):
    return registry.queries()[name](spark, SF_DIR)


def test_all_ten_are_there():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, name):
    assert rows_of(run(spark, name).toPandas()) == rows_of(connect().execute(registry.oracles()[name]).df())


@pytest.mark.parametrize(("name", "column", "least"), [("op2_toxicity", "predicted", 0.8), ("op8_language_id", "lang_pred", 0.95)])
def test_held_out_accuracy(spark, name, column, least):
    got = {r.doc_id: r for r in run(spark, name).collect()}
    truth = duckdb.sql(f"select doc_id, toxic from '{SF_DIR}/labels.parquet'" if column == "predicted" else f"select doc_id, lang from '{SF_DIR}/documents.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    tested = [(got[i][column], y) for i, y in truth if got[i].held_out]
    assert np.mean([a == b for a, b in tested]) >= least


def test_bpe(spark, documents):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    for r in run(spark, "op4_byte_bpe").collect():
        ids = library.encode_ordinary(documents[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((documents[r.doc_id] or "").encode()).hexdigest()


def test_packing(spark, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in documents.items()}
    rows = run(spark, "op5_packing").collect()
    assert Counter({i: len(x) for i, x in ids.items()}) == sum((Counter({r.doc_id: r.length}) for r in rows), Counter())
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    sums = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sums[r.sequence_id]
        sums[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sums.values())


def test_simhash(spark, documents):
    fps = {i: slow_fingerprint(t) for i, t in documents.items()}
    got = {r.doc_id: r for r in run(spark, "op10_simhash_near_dedup").collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    links = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == groups_of(fps, links)


def test_passages(spark, documents):
    """Every run of 50 equal words that an earlier document holds as well is within a passage; every passage is as alike as it says."""
    words = {i: (t or "").encode().lower().split() for i, t in documents.items()}
    first, late = {}, {}
    for i in sorted(words):
        for at in range(len(words[i]) - 49):
            key = tuple(words[i][at : at + 50])
            if first.setdefault(key, i) != i:
                late.setdefault(i, []).append(at)
    got = {}
    for r in run(spark, "op6_substring_dedup").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert r.other_id < r.doc_id and r.n_words == r.end - r.start >= 50 and r.n_equal >= 0.8 * r.n_words
        a, b = words[r.doc_id][r.start : r.end], words[r.other_id][r.other_start : r.other_end]
        assert len(set(a) & set(b)) > 0.6 * len(set(a))
    assert late
    for i, places in late.items():
        for at in places:
            assert any(a <= at and at + 50 <= b for a, b in got.get(i, [])), (i, at)
