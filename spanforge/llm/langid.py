"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learned from a bounded sample of labelled documents, at most SAMPLE of each
language, taken whole by the hash of their ids. The log-probability matrix
(BUCKETS x languages, its size doesn't depend on the corpus) is broadcast in
slices of at most SLICE languages, learned one after another, and
texts are scored in batches: numpy hashes all n-grams of a batch, gathers their
rows and sums them by document. Each slice improves on the best language so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import chunks, held_out, map_arrow, texts_of

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Labelled documents of each language that the model is learned from.
SAMPLE = 500
#: Languages in a slice of the matrix: 64 MB.
SLICE = 256
UNKNOWN = "und"

_FOLD: np.ndarray | None = None


def fold() -> np.ndarray:
    """Code points of the basic plane to their lower case; all but letters to a space."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.fromiter((ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(0x10000)), dtype=np.uint32, count=0x10000)
    return _FOLD


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of all texts one after another, and where each text's begin. None crosses two texts."""
    marks = max(ORDERS) - 1  # before each text and at the end: an n-gram may reach these, but not what lies behind
    sizes = [len(t) + marks for t in texts]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    codes = np.frombuffer(("\0" * marks).join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes > 0xFFFF, codes, fold()[np.minimum(codes, 0xFFFF)])
    many = len(codes) - marks
    for n in ORDERS:
        h = np.full(many, n, dtype=np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= codes[k : k + many]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h = h >> np.uint32(16)
        yield h.astype(np.int64), starts


def counts(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    total = np.zeros(BUCKETS)
    for t in texts:
        for h, _ in ngrams([t]):
            total += np.bincount(h, minlength=BUCKETS)
    return total


class NaiveBayes:
    """languages, and the log-probabilities of buckets by language with add-one smoothing; priors are equal."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in rows})
        table = np.ones((BUCKETS, len(self.languages)))
        for j, lang in enumerate(self.languages):
            table[:, j] += counts([t for t, x in rows if x == lang])
        self.log = np.log(table / table.sum(axis=0)).astype(np.float32) if self.languages else table

    def sums(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text in each language."""
        sums = np.zeros((len(texts), len(self.languages)))
        for h, starts in ngrams(texts):
            for j in range(len(self.languages)):
                sums[:, j] += np.add.reduceat(self.log[:, j][h], starts, dtype=np.float64)
        return sums

    def best(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language of each text, its log-likelihood, and the log of the sum of all languages' likelihoods; None for a text without a letter, or without anything learned."""
        none = np.array([not self.languages or not any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not self.languages:
            return [None] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        sums = self.sums(texts)
        top = sums.max(axis=1)
        return [None if u else self.languages[k] for u, k in zip(none, sums.argmax(axis=1))], top, top + np.log(np.exp(sums - top[:, None]).sum(axis=1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; `und` and 0 for one without a letter, or without anything learned."""
        lang, top, total = self.best(texts)
        return [UNKNOWN if x is None else x for x in lang], np.array([0.0 if x is None else math.exp(a - b) for x, a, b in zip(lang, top, total)])


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the training documents."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"
    )


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE, languages: list[str] | None = None) -> list[tuple[str, str]]:
    """(text, lang) of at most per_language training documents of each language, or of the given ones.

    Ids are chosen first, so that only the chosen texts move; where ids repeat, the rows are chosen from once more.
    """
    known = labelled(docs)
    if languages is not None:
        known = known.where(F.col("lang").isin(languages))
    by = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = known.select("doc_id", "lang").distinct().withColumn("at", by(F.xxhash64("doc_id"), "doc_id")).where(F.col("at") <= per_language)
    rows = known.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    rows = rows.withColumn("at", by(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))).where(F.col("at") <= per_language).select("text", "lang").collect()
    return sorted((r.text, r.lang) for r in rows)


def learn(docs: DataFrame, per_language: int = SAMPLE, slice_: int = SLICE) -> list:
    """Broadcast models of all languages, at most slice_ in each; only one slice's sample is on the driver at a time."""
    languages = sorted(r.lang for r in labelled(docs).select("lang").distinct().collect())
    parts = [languages[i : i + slice_] for i in range(0, len(languages), slice_)]
    samples = (labelled_sample(docs, per_language, part if len(parts) > 1 else None) for part in parts)
    return [docs.sparkSession.sparkContext.broadcast(NaiveBayes(s)) for s in samples]


def fresh(names: list[str], columns: list[str]) -> list[str]:
    """The names, with as many underscores as make them differ from all columns."""
    taken = {c.lower() for c in columns}
    return [next(x for x in (n + "_" * k for k in range(len(taken) + 1)) if x not in taken) for n in names]


def with_languages(docs: DataFrame, models: list, names: list[str]) -> DataFrame:
    """docs with three more columns: the language (null if unknown), its log-likelihood, and that of all languages together. One pass over the texts for each slice, in one stage."""
    at, own = docs.columns.index("text"), docs.columns

    def by(held, first: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text", 1 << 19):
                lang, top, total = held.value.best(texts_of(b.column(at))) if held else ([None] * b.num_rows, np.full(b.num_rows, -np.inf), np.full(b.num_rows, -np.inf))
                if not first:
                    was, high, all_ = b.column(len(own)).to_pylist(), b.column(len(own) + 1).to_numpy(), b.column(len(own) + 2).to_numpy()
                    lang = [x if n > o else y for x, y, n, o in zip(lang, was, top, high)]
                    top, total = np.maximum(top, high), np.logaddexp(total, all_)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(lang, pa.string()), pa.array(top), pa.array(total)], names=[*own, *names])

        return each

    kinds = ("string", "double", "double")
    schema = StructType([*docs.schema.fields, *(StructField(n, _parse_datatype_string(k)) for n, k in zip(names, kinds))])
    for k, held in enumerate(models or [None]):
        docs = map_arrow(docs, by(held, not k), schema)
    return docs


def predict_languages(docs: DataFrame, models: list) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text, without a shuffle; `und` and 0 for a text without a letter, or where nothing was learned."""
    scored = with_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), models, ["lang_pred", "top", "total"])
    return scored.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.exp(F.col("top") - F.col("total"))).alias("score"))


def keep_identified(docs: DataFrame, models: list, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known with at least least_score."""
    lang, top, total = fresh(["lang_pred", "top", "total"], docs.columns)
    scored = with_languages(docs, models, [lang, top, total])
    return scored.where(F.col(lang).isNotNull() & (F.exp(F.col(top) - F.col(total)) >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """A null text, or one without a letter, is `und` with score 0. Repeated rows and null ids come back as they are given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_languages(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
