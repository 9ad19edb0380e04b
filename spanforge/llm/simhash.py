"""SimHash near-duplicates with the generalised pigeonhole principle.

Bits that go together on a bounded sample of fingerprints are grouped into the
same partition. Thresholds e_i with sum(e_i) = tau - m + 1 (e_i = -1: the
partition isn't probed) are allotted by dynamic programming on estimated
candidate counts: two fingerprints within tau bits then agree on some partition
up to e_i bits. A partition with threshold e is probed by its values with each
choice of e bits wiped, so that "up to e bits" is equality on one masked value.
Only the choice of masks rests on the sample; the result doesn't.

Buckets (equal masked values) larger than `hot` are split again, exactly. Where
the probes guarantee all pairs, members agree on the mask, so the remaining bits
are cut into tau + 1 parts of which one must be equal, until buckets are small
or few bits are left. Otherwise a bucket is cut into chunks, and each pair of
chunks is a bucket. A bucket is searched breadth first in numpy and gives a
spanning forest of its links, never all of its pairs.

Wide fingerprints (more than 64 bits) serve a similarity threshold instead of a
few bits: the guarantee of the pigeonhole is too dear there, so each mask is a
random choice of bits, and their number follows from the recall wanted for
pairs just at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, components, cut, map_arrow, skew_join

#: Fingerprints in the sample that the masks are chosen by.
SAMPLE = 2048
#: A bucket with more distinct fingerprints is split.
HOT = 20_000
WORD = np.dtype(">u8")


def shingles(text: bytes, width: int) -> list[bytes]:
    """ASCII-lower-cased word shingles, repeats included; the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: bytes, width: int = 3, bits: int = 64, seed: int = 42, once: bool = False) -> bytes:
    """SimHash of bits / 8 bytes: a bit is 1 if set in more than half of the shingles' hashes, repeats counted unless `once`.

    The first 64 bits come from XXH64 with the seed; further words are mixed from it.
    """
    made = shingles(text, width)
    if once:
        made = list(dict.fromkeys(made))
    if not made:
        return bytes(bits // 8)
    digest = xxhash.xxh64_digest
    hashed = np.frombuffer(b"".join([digest(s, seed) for s in made]), dtype=WORD)
    ones = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(hashed), 1 << 15):
        h = hashed[i : i + (1 << 15)]
        for w in range(bits // 64):
            x = h
            if w:
                x = h.astype(np.uint64) * np.uint64(2 * w * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(29)
            b = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
            ones[64 * w : 64 * w + 64] += b.sum(axis=0, dtype=np.uint16 if len(b) < 65536 else np.int64)
    return np.packbits(2 * ones > len(hashed)).tobytes()


def with_fingerprints(docs: DataFrame, width: int = 3, bits: int = 64, seed: int = 42, once: bool = False) -> DataFrame:
    """(doc_id long, fp binary), and sum, the text's 64-bit hash, which tells rows of one id apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            fps = [fingerprint(t, width, bits, seed, once) for t in bytes_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), b.column(2)], names=["doc_id", "fp", "sum"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("sum")), each, "doc_id long, fp binary, sum long")


def words_of(fps: list[bytes], bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(fps), dtype=WORD).astype(np.uint64).reshape(-1, bits // 64)


def correlated_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bits (columns of a 0/1 matrix) into m groups of about equal size, each grown by the highest mean absolute correlation."""
    n = sample.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(sample.T.astype(float)))) if len(sample) > 1 else np.eye(n)
    left, groups = list(range(n)), []
    for g in range(m):
        size = n // m + (g < n % m)
        sub = corr[np.ix_(left, left)] - np.eye(len(left))
        group = [left[int(sub.max(axis=1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].mean(axis=1).argmax())])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]] | None:
    """Thresholds, one per partition, that sum to `total` at least cost: dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for s, (c, es) in best.items():
            for e, x in cost.items():
                if s + e not in following or c + x < following[s + e][0]:
                    following[s + e] = (c + x, [*es, e])
        best = following
    return best.get(total)


def probe_masks(sample: list[bytes], n: int, tau: int) -> list[list[int]]:
    """Masks, as lists of bits, such that any two 64-bit fingerprints within tau bits are equal under one; cheapest for n of them."""
    bits = np.unpackbits(np.frombuffer(b"".join(sample), dtype=np.uint8).reshape(-1, 8), axis=1)
    whole = words_of(sample, 64)[:, 0]
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best: tuple[float, list[list[int]]] | None = None
    for m in range(2, tau + 3):
        groups, costs = correlated_groups(bits, m), []
        for group in groups:
            part = whole & np.uint64(sum(1 << 63 - b for b in group))
            near = np.zeros(65)
            for i in range(0, len(part), 256):
                near += np.bincount(np.bitwise_count(part[i : i + 256, None] ^ part[None, :]).ravel(), minlength=65)
            near[0] -= len(part)
            seen, cost = np.cumsum(near) / 2, {-1: 0.0}
            for e in range(tau + 1):
                if comb(len(group), e) > 2048:
                    break
                cost[e] = n * comb(len(group), e) * 2e-6 + (seen[e] + 0.5) / pairs * n * n / 2 * 5e-9
            costs.append(cost)
        found = allot(costs, tau - m + 1)
        if found and (best is None or found[0] < best[0]):
            best = found[0], [[b for b in g if b not in wiped] for g, e in zip(groups, found[1]) if e >= 0 for wiped in combinations(g, e)]
    return best[1]


def random_masks(bits: int, tau: int, recall: float = 0.9, width: int = 12) -> list[list[int]]:
    """Masks of `width` random bits, as many as find a pair at exactly tau differing bits with probability `recall`, however many fingerprints there are.

    Consecutive masks use up all bits before any is used again.
    """
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - tau / bits) ** width))
    rng, order, masks = np.random.default_rng(7), [], []
    for _ in range(tables):
        if len(order) < width:
            order = rng.permutation(bits).tolist()
        masks.append(sorted(order[:width]))
        order = order[width:]
    return masks


def split_mask(mask: list[int], tau: int) -> list[list[int]]:
    """Masks that refine a mask by one of tau + 1 parts of its remaining bits."""
    rest = [b for b in range(64) if b not in mask]
    return [sorted(mask + rest[i :: tau + 1]) for i in range(tau + 1)]


def mask_words(mask: list[int], bits: int) -> np.ndarray:
    return np.packbits(np.bincount(mask, minlength=bits).astype(np.uint8)).view(WORD).astype(np.uint64)


def keyed(fps: np.ndarray, mask: np.ndarray, number: int) -> np.ndarray:
    """A 64-bit key of the masked bits; the mask's number is mixed in. Chance collisions only add candidates."""
    key = np.full(len(fps), np.uint64(number * 2 + 1))
    with np.errstate(over="ignore"):
        for w in range(fps.shape[1]):
            key = (key ^ (fps[:, w] & mask[w])) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def forest(fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (parents, children) of the links within one bucket, breadth first."""
    left, parents, children = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1, dtype=np.int32) <= tau
            if hit.any():
                found = left[hit]
                parents.append(np.full(len(found), at))
                children.append(found)
                queue.extend(found.tolist())
                left = left[~hit]
    if not parents:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(parents), np.concatenate(children)


def near_pairs(fps: np.ndarray, groups: np.ndarray, tau: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket within tau bits whose groups differ, about `most` comparisons at a time."""
    step = max(1, most // len(fps))
    for i in range(0, len(fps), step):
        part, rest = fps[i : i + step], fps[i:]
        far = np.zeros((len(part), len(rest)), np.uint16)
        for w in range(fps.shape[1]):
            far += np.bitwise_count(part[:, w, None] ^ rest[None, :, w])
        a, b = np.nonzero((far <= tau) & (groups[i : i + step, None] != groups[None, i:]))
        keep = a < b
        if keep.any():
            yield a[keep] + i, b[keep] + i


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of at least two rows with equal keys, of sorted batches; a run may cross batches."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        k = t.column(key).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        for i in np.flatnonzero(np.diff(starts) > 1):
            yield t.slice(starts[i], starts[i + 1] - starts[i])
        held = t.slice(starts[-1])
    if held is not None and len(held) > 1:
        yield held


def link_edges(reps: DataFrame, bits: int = 64, tau: int = 3, sample_size: int = SAMPLE, hot: int = HOT, recall: float = 0.9) -> DataFrame:
    """Edges (a, b) between reps whose fingerprints differ in tau bits or fewer, enough of them to connect every group.

    reps: (fp binary, rep long), one row per distinct fingerprint, checkpointed. All groups are
    found for 64 bits; for more, pairs at tau bits are met with probability `recall` each, closer ones with a higher one.
    If reps have a third column, grp long, edges are all pairs of different grp that meet instead, maybe repeated.
    """
    more = [c for c in reps.columns if c == "grp"]
    n = reps.count()
    if n < 2 or tau <= 0:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    exact = bits == 64
    if exact:
        sample = [r.fp for r in reps.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).select("fp").collect()]
        masks = probe_masks([bytes(x) for x in sample], n, tau)
    else:
        masks = random_masks(bits, tau, recall)

    def emit(tables: dict[int, list[tuple[int, np.ndarray]]]):
        """Rows (mask, key, fp, rep) under each mask that follows on a row's own one (0 for rows of reps)."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 4096):
                    b = whole.slice(i, 4096)
                    of = b.column(0).to_numpy()
                    fps = words_of(b.column(1).to_pylist(), bits) if b.num_rows else np.empty((0, bits // 64), np.uint64)
                    for old in np.unique(of):
                        at = np.flatnonzero(of == old)
                        rows = b.take(pa.array(at))
                        for number, words in tables.get(int(old), []):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), number, np.int32)), pa.array(keyed(fps[at], words, number)), *rows.columns[1:]], names=["mask", "key", "fp", "rep", *more]
                            )

        return each

    schema = "mask int, key long, fp binary, rep long" + "".join(f", {c} long" for c in more)
    numbered = dict(enumerate(masks, 1))
    level = map_arrow(reps.select(F.lit(0).alias("mask"), "fp", "rep", *more), emit({0: [(k, mask_words(m, bits)) for k, m in numbered.items()]}), schema)
    parts = []
    for depth in range(1, 9):
        # after a few splits by bits, or where few are left, chunks do the rest
        crowded = cut(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot))
        if crowded.isEmpty():
            parts.append(level)
            break
        parts.append(level.join(crowded, "key", "left_anti"))
        level = level.join(crowded, "key")
        if exact and depth < 4 and all(len(m) < 50 for m in numbered.values()):
            finer, number = {}, 1000**depth
            for old, m in numbered.items():
                for f in split_mask(m, tau):
                    number += 1
                    finer.setdefault(old, []).append((number, f))
            level = cut(map_arrow(level.select("mask", "fp", "rep", *more), emit({k: [(j, mask_words(f, bits)) for j, f in v] for k, v in finer.items()}), schema).distinct())
            numbered = {j: f for v in finer.values() for j, f in v}
            continue
        groups = F.ceil(F.col("n") * 2 / hot).cast("int")
        level = (
            level.withColumn("g", F.pmod(F.xxhash64("rep"), groups).cast("int"))
            .withColumn("h", F.explode(F.sequence(F.lit(0), groups - 1)))
            .select("mask", F.xxhash64("key", F.least("g", "h"), F.greatest("g", "h")).alias("key"), "fp", "rep", *more)
        )
        parts.append(level)
        break
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "key"):
            ids, fps = run.column("rep").to_numpy(), words_of(run.column("fp").to_pylist(), bits)
            for a, b in near_pairs(fps, run.column("grp").to_numpy(), tau) if more else [forest(fps, tau)]:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return map_arrow(rows.select("key", "fp", "rep", *more).repartition("key").sortWithinPartitions("key"), search, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = 64, tau: int = 3, seed: int = 42, sample_size: int = SAMPLE, hot: int = HOT, recall: float = 0.9, once: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): SimHash groups linked at tau or fewer differing bits.

    docs: doc_id, text; other columns are ignored. A null or wordless text has
    fingerprint 0 and is linked like any other. Equal fingerprints are one node, whose id is the
    smallest doc_id that has it, so copies aren't expanded. Rows with a null doc_id come back with
    the component of their fingerprint. Repeated rows come back as often as they are given. An empty
    table gives an empty result.
    """
    prints = cut(with_fingerprints(docs, width, bits, seed, once))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    roots = components(link_edges(reps.select("fp", "rep"), bits, tau, sample_size, hot, recall))
    named = cut(reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", "copies", F.coalesce("root", "rep").alias("component_id")))
    return skew_join(prints, named, ["fp"], "copies").select("doc_id", "fp", "component_id")


def alike(a: bytes, b: bytes, similarity: float, width: int) -> bool:
    """Whether the Jaccard similarity of the sets of word shingles is at least `similarity`."""
    x, y = set(shingles(a, width)), set(shingles(b, width))
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both)


def verified(edges: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The edges (a, b) between doc_ids whose texts are alike, each once. Of several texts of one doc_id the least is taken."""
    pairs = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    asked = pairs.groupBy("a").agg(F.count("*").alias("n")).unionByName(pairs.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n")))
    asked = asked.groupBy("a").agg(F.sum("n").alias("n"))
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("a"), "text").join(asked, "a").groupBy("a").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("n").alias("n")))
    short = lambda c: F.octet_length(c) <= 1 << 16
    left = skew_join(pairs, texts.withColumnRenamed("text", "x"), ["a"], "n", fits=short("x")).select("a", "b", "x")
    both = skew_join(left, texts.select(F.col("a").alias("b"), F.col("text").alias("y"), "n"), ["b"], "n", fits=short("y")).select("a", "b", "x", "y")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "x", 4 << 20):
            keep = [alike(x, y, similarity, width) for x, y in zip(bytes_of(b.column(2)), bytes_of(b.column(3)))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(map_arrow(both, each, "a long, b long"))


def expected_distance(similarity: float, bits: int, deviations: float = 0) -> int:
    """Differing bits of two sets at a Jaccard similarity, and so many standard deviations more."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * differ + deviations * math.sqrt(bits * differ * (1 - differ)))


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, bits: int = 512, recall: float = 0.96) -> DataFrame:
    """(doc_id, fp, sum, component_id) as in simhash_groups, with the xxhash64 of the text, linked where sets of word shingles have that Jaccard similarity.

    Fingerprints only propose pairs, up to four standard deviations beyond the distance expected at the
    similarity, where one pair in 25 still goes unmet; each link is verified by the texts. Close pairs are proposed as forests and
    verified first, then all pairs that their components leave apart.
    """
    prints = cut(with_fingerprints(docs, width, bits, once=True))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    close = verified(link_edges(reps.select("fp", "rep"), bits, expected_distance((1 + similarity) / 2, bits)), docs, similarity, width)
    roots = components(close)
    grouped = cut(reps.where("rep is not null").join(roots, reps["rep"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "rep").alias("grp")))
    rest = verified(link_edges(grouped, bits, expected_distance(similarity, bits, 4), recall=recall), docs, similarity, width)
    roots = components(close.unionByName(rest))
    named = cut(reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", "copies", F.coalesce("root", "rep").alias("component_id")))
    return skew_join(prints, named, ["fp"], "copies").select("doc_id", "fp", "sum", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """A null or wordless text has fingerprint zero, and is linked like any other; see simhash_groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
