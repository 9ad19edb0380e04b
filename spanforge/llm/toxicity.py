"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams and of
itself; a document's is the mean over its words; two classes share a softmax on
top. Embeddings and output weights are trained jointly in numpy, so that a
misspelling never seen shares most of its n-grams with words that were.

Learned from a bounded sample, at most SAMPLE labelled documents by class,
taken whole by the hash of their ids. The model that scores the corpus has one
figure for each bucket (the output is linear in the embeddings): its size
doesn't depend on the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, map_arrow, texts_of

ORDERS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSIONS = 2
ITERATIONS = 40
#: Labelled documents of class 0 and of class 1 that the model is learned from, at most.
SAMPLE = (3000, 1000)
#: Words whose scores a worker keeps in each of two cache generations.
CACHE = 300_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams (with marks at its ends) and of itself, word after word, and where each word's begin."""
    marked = [f"\x02{w}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the word's end
    owners, buckets = [], []
    for n in ORDERS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= codes[at + k]
        owners.append(word[at])
        buckets.append(h)
    # the word itself: all its characters, weighted by their places
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed, starts)
    owners.append(np.arange(len(words)))
    buckets.append((whole >> np.uint64(32)).astype(np.uint32))
    owner, h = np.concatenate(owners), np.concatenate(buckets)
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x85EBCA6B)
    h = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return h[order], np.searchsorted(owner[order], np.arange(len(words)))


class Sparse:
    """Rows of weighted columns, with products by a dense matrix from either side."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        a, b = np.lexsort((col, row)), np.lexsort((row, col))
        self.of_row = (row[a], col[a], weight[a].astype(np.float32))
        self.of_col = (col[b], row[b], weight[b].astype(np.float32))

    @staticmethod
    def _times(parts: tuple, dense: np.ndarray, n: int) -> np.ndarray:
        key, other, weight = parts
        out = np.zeros((n, dense.shape[1]), dtype=np.float32)
        if len(key):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for j in range(dense.shape[1]):
                out[key[at], j] = np.add.reduceat(dense[:, j][other] * weight, at)
        return out

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self._times(self.of_row, dense, self.shape[0])

    def tdot(self, dense: np.ndarray) -> np.ndarray:
        return self._times(self.of_col, dense, self.shape[1])


def minimise(cost, x: np.ndarray, iterations: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, grad = cost(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * np.dot(s, q)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y, rho = steps[-1]
            q *= 1 / (rho * np.dot(y, y))
        else:
            q *= 1 / max(1e-12, np.abs(grad).sum())
        for (s, y, rho), a in zip(steps, reversed(alphas)):
            q += (a - rho * np.dot(y, q)) * s
        slope, t = -float(np.dot(grad, q)), 1.0
        if slope >= 0:
            break
        while True:
            new_value, new_grad = cost(x - t * q)
            if new_value <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 4
        if t < 1e-6:
            break
        s, y = -t * q, new_grad - grad
        if np.dot(s, y) > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / float(np.dot(s, y)))]
        done = value - new_value < 1e-5 * abs(value)
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x


class SubwordSoftmax:
    """table: one log-odds figure for each bucket; bias: the log-odds of an empty text."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "young": {}, "old": {}}

    @classmethod
    def train(cls, rows: list[tuple[str, int]], iterations: int = ITERATIONS, decay: float = 3e-4, rare: float = 300.0, balance: float = 0.0, seed: int = 7) -> SubwordSoftmax:
        """Embeddings, output weights and biases together by L-BFGS on the cross-entropy; `balance` from 0 to 1 moves from the sample's class shares to equal ones.

        Each bucket's vector is scaled by its spread over the documents, damped so that buckets of fewer
        than about `rare` documents move little, and the scaled vectors have an L2 penalty of `decay`: what is
        learned rests on n-grams of many documents. With one class only, every text gets that class's prior.
        """
        y = np.array([int(label) for _, label in rows])
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
        index: dict[str, int] = {}
        row, col, weight = [], [], []
        for i, (t, _) in enumerate(rows):
            ws = words_of(t)
            for w, n in Counter(ws).items():
                row.append(i)
                col.append(index.setdefault(w, len(index)))
                weight.append(n / len(ws))
        if not index:
            return cls(np.zeros(BUCKETS, np.float32), 0.0)
        grams, begin = subwords(list(index))
        used, grams = np.unique(grams, return_inverse=True)
        grams = grams.astype(np.int32)
        per_word = np.diff(np.append(begin, len(grams)))
        docs = Sparse(np.array(row, np.int32), np.array(col, np.int32), np.array(weight, np.float32), (len(rows), len(index)))
        del row, col, weight
        bag = Sparse(np.repeat(np.arange(len(index), dtype=np.int32), per_word), grams, np.repeat(1 / per_word, per_word), (len(index), len(used)))
        squares = np.bincount(docs.of_row[1], docs.of_row[2] ** 2, len(index)).astype(np.float32)
        spread = np.bincount(bag.of_row[1], bag.of_row[2] ** 2 * squares[bag.of_row[0]], len(used))
        scale = 1 / np.sqrt(spread + rare * spread.sum() / max(1, len(docs.of_row[0]) * 8))
        length = np.sqrt(np.square(docs.dot(bag.dot(scale[:, None]))).mean())
        scale = (scale / max(length, 1e-12) * 30)[:, None].astype(np.float32)
        target = np.eye(2)[y]
        share = np.array([(1 - balance) / len(y) + balance / 2 / (y == k).sum() for k in (0, 1)])[y][:, None]
        n, d = len(used), DIMENSIONS

        def cost(x: np.ndarray) -> tuple[float, np.ndarray]:
            emb, out, bias = x[: n * d].reshape(n, d), x[n * d : n * d + 2 * d].reshape(d, 2), x[-2:]
            hidden = docs.dot(bag.dot(scale * emb))
            z = hidden @ out + bias
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e.sum(axis=1, keepdims=True)
            loss = float((share * target * (np.log(total) - z)).sum()) + decay / 2 * float(np.dot(x[:-2], x[:-2]))
            g = ((e / total - target) * share).astype(np.float32)
            back = scale * bag.tdot(docs.tdot(g @ out.T))
            return loss, np.concatenate([(back + decay * emb).ravel(), (hidden.T @ g + decay * out).ravel(), g.sum(axis=0)]).astype(np.float32)

        rng = np.random.default_rng(seed)
        out = rng.normal(0, 1, d)
        x = np.concatenate([np.zeros(n * d), np.stack([-out, out], axis=1).ravel(), np.zeros(2)]).astype(np.float32)
        x = minimise(cost, x, iterations)
        emb, out, bias = x[: n * d].reshape(n, d), x[n * d : n * d + 2 * d].reshape(d, 2), x[-2:]
        table = np.zeros(BUCKETS, dtype=np.float32)
        table[used] = (scale * emb) @ (out[:, 1] - out[:, 0])
        return cls(table, float(bias[1] - bias[0]))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 of each text; one without words has the bias alone."""
        split = [words_of(t) for t in texts]
        young, old = self.young, self.old
        missing = []
        for w in set().union(*split).difference(young):
            s = old.get(w)
            if s is None:
                missing.append(w)
            else:
                young[w] = s
        if missing:
            grams, begin = subwords(missing)
            per_word = np.diff(np.append(begin, len(grams)))
            young.update(zip(missing, (np.add.reduceat(self.table[grams], begin, dtype=np.float64) / per_word).tolist()))
        means = np.array([sum(map(young.__getitem__, ws)) / len(ws) if ws else 0.0 for ws in split])
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return 1 / (1 + np.exp(-np.clip(means + self.bias, -700, 700)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of at most so many training documents of class 0 and 1; ids are chosen first, so that only the chosen texts move. Where ids repeat, the rows are chosen from once more."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    present = known.join(docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")

    def first(rows: DataFrame, *more) -> DataFrame:
        order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", *more)
        return rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0])).drop("at")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(first(present)), "doc_id")
    return sorted((r.text, r.label) for r in first(texts, F.xxhash64("text")).select("text", "label").collect())


def score_texts(docs: DataFrame, model: SubwordSoftmax) -> DataFrame:
    """(doc_id, score) of each row's whole text, in one pass without a shuffle. A null text is empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(texts_of(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Repeated rows and null ids come back as they are given; without labels every score is 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = SubwordSoftmax.train(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
