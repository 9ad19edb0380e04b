"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs. Each adjacent pair that has a merge
rank is entered into that rank's bucket, and a three-level bitmap over the ranks
tells the lowest non-empty bucket by find-first-set. A popped position whose pair
has changed meanwhile is stale and skipped. So a pre-token of n bytes takes
O(n log n) steps whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow, texts_of

#: Pre-tokens of at most CACHED_BYTES kept with their ids in each of a worker's two cache generations; a full one
#: becomes the old one, and what is still used comes back from there. A document may exceed it by its own pre-tokens.
CACHE = 700_000
CACHED_BYTES = 64


class RankQueue:
    """Buckets of positions by rank; the lowest rank, and in it the lowest position, comes first."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((len(self.low) >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        """(rank, position), or None when empty."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) + (m & -m).bit_length() - 1
        w = self.low[a]
        rank = (a << 6) + (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] = w & (w - 1)
            if not self.low[a]:
                self.mid[b] = m & (m - 1)
                if not self.mid[b]:
                    self.top &= self.top - 1
        return rank, position


class Bpe:
    """Encodes pre-tokens by merge ranks: the lowest rank first, the leftmost pair of equal ranks first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        size = max(ranks.values(), default=-1) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if n < 2:
            raise KeyError(f"byte without a rank: {piece!r}")
        following, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pair, queue, get = [-1] * n, self.queue, ranks.get
        push = queue.push
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                push(r, i)
        while True:
            first = queue.pop()
            if first is None:
                break
            r, i = first
            if pair[i] != r:
                continue
            j = following[i]
            k = following[j]
            stop[i], following[i], pair[j], pair[i] = stop[j], k, -1, -1
            if k < n:
                before[k] = i
                r = get(piece[i : stop[k]])
                if r is not None:
                    pair[i] = r
                    push(r, i)
            p = before[i]
            if p >= 0:
                r = get(piece[p : stop[i]])
                pair[p] = -1 if r is None else r
                if r is not None:
                    push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = following[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        found = self.find(text)
        young, old, passing = self.young, self.old, []
        for t in set(found).difference(young):
            ids = old.get(t)
            if ids is None:
                b = t.encode("utf-8", "surrogatepass")
                ids = self.piece(b)
                if len(b) > CACHED_BYTES:
                    passing.append(t)
            young[t] = ids
        out = list(chain.from_iterable(map(young.__getitem__, found)))
        for t in passing:
            del young[t]
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker and file."""
    if (path, pattern) not in LOADED:
        LOADED[path, pattern] = Bpe.from_file(path, pattern)
    return LOADED[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids of each whole text, without special tokens. A null text is empty; an empty one has no ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in chunks(batches, "text", 1 << 20):
            ids = [bpe.encode(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that ids stand for; null ids give none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), each, "doc_id long, data binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, and digests of both.

    One pass without a shuffle. Null texts are empty; repeated rows and null ids come back as
    they are given; other columns are ignored; an empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        decimal = [str(i) for i in range(len(bpe.pieces))]
        for b in chunks(batches, "text", 1 << 20):
            n, ids_digest, decoded_digest = [], [], []
            for t in texts_of(b.column(1)):
                ids = bpe.encode(t)
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_digest.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """A null text is empty: no token, and the digests of nothing. Repeated rows and null ids come back as they are given."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
