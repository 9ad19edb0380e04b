"""Substring dedup by collinear chaining: fuzzy passages that repeat across documents.

Each document gives winnowed seeds: of every `window` consecutive word k-mers the
one with the least hash, so that any shared run of window + k - 1 words shares a
seed. Seeds meet by hash, and each occurrence is matched to the first document
that has it and to the one before, never to all others. The matches of two
documents are chained: ordered in both, most seeds for the least gaps, found with
a Fenwick tree of prefix maxima. Blocks of the other document around a chain then
meet the document's text, where the chain is aligned word by word between its
seeds. If it isn't alike enough as a whole, it is cut into the longest stretches
that are by themselves; each is extended beyond its ends. What is long and equal
enough is a passage of the document that an earlier one holds.

The first holder of a seed may hold too little around it, while another one holds
the whole passage. So what is left goes an exact way: each run of min_words words
that the passages found so far don't cover, and all of whose seeds earlier documents
have, is hashed as a whole, and so are the runs about the same least seed in every
document that has it. Equal runs meet by their hash: no exact copy is lost.

Passages with changed words have no such runs. For them, each seed that is still not
covered makes links with the other matched seeds about it, and every document that has
both seeds of a link, in order, meets the document there, at all places: all partners
of what is left are chained and aligned, not the first and the last one alone. In the
other document the two may lie nearer than in this one, or farther.

Hashes that a bounded sample of documents shows to be frequent are salted by
document while they are gathered, and then matched to the first of all salts: which
ones are salted changes no match to a first holder.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, chunks, cut, map_arrow, remove, skew_join, small, tidy, written

K, WINDOW = 5, 8
#: Documents in the sample that tells frequent seeds, in how many of them one is frequent, and how many are salted at most, the most frequent first (the others are right without).
SAMPLE, FREQUENT, SALTED = 2000, 20, 1 << 16
SALTS = 64
#: Words of the other document around a chain that its alignment may extend over, and words of a block of a document.
MARGIN, BLOCK = 48, 64
GAP = 1 / 64
#: Words between the two seeds of a link, at most, in the document that is matched; at least as many as between the ends of a chain. In the others, that or what differs from it by SHIFT at most: as many unequal words as a passage of 100 words may have.
REACH = 127
SHIFT = 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


#: The factor of a polynomial's hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: By byte: 1 for white space, else 0.
SPACE = bytes(i in b" \t\n\x0b\x0c\r" for i in range(256))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE, and of BACK; kept up to four million."""
    if len(_POWERS[0]) < n:
        size = max(n, min(2 * n, 1 << 22))
        new = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (BASE, BACK)]
        if size > 1 << 22:
            return new[0][:n], new[1][:n]
        _POWERS[:] = new
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the ASCII-lower-cased words: differences of a polynomial's prefix sums over all bytes."""
    x = np.frombuffer(text.lower(), np.uint8)
    space = np.frombuffer(b"\1" + text.translate(SPACE) + b"\1", np.bool_)
    edges = np.flatnonzero(space[1:] != space[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x + np.uint64(1)) * power[:-1], out=sums[1:])  # + 1: a zero byte counts
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` consecutive items, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words."""
    n = max(0, len(words) - k + 1)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= words[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed k-mers."""
    h = kmers(words, k)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if n <= window:
        at = np.array([int(h.argmin())])
        return at, h[at]
    least = sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    covering = sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    at = np.flatnonzero(covering == h)
    return at, h[at]


def chain(pos: np.ndarray, other: np.ndarray, gap: float = GAP) -> list[np.ndarray]:
    """Collinear chains of matches (pos sorted): indices in order. A match is in one chain at most.

    score(i) = 1 + the best score(j) - gap * (distance in both), j before i in both; the best j is a
    prefix maximum over `other` in a Fenwick tree, since the gap cost splits into a part of j and one of i.
    """
    n = len(pos)
    steps = np.diff(pos)
    if (np.diff(other) == steps).all() and (steps > 0).all() and (2 * gap * steps < 1).all():
        return [np.arange(n)]  # one diagonal without wide gaps
    return [np.array(links) for links in collinear(pos.tolist(), other.tolist(), gap)]


def collinear(ps: list[int], os: list[int], gap: float = GAP) -> list[list[int]]:
    """The chains, of any matches; see chain."""
    n = len(ps)
    ranks = {x: i for i, x in enumerate(sorted(set(os)))}
    rs, size = [ranks[x] for x in os], len(ranks)
    tree, owner = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        same = i
        while same < n and ps[same] == ps[i]:
            same += 1
        for m in range(i, same):  # matches at one position don't follow each other
            r, best, who = rs[m], -1e18, -1
            while r > 0:
                if tree[r] > best:
                    best, who = tree[r], owner[r]
                r -= r & -r
            gain = best - gap * (ps[m] + os[m])
            score[m], before[m] = (1 + gain, who) if gain > 0 else (1.0, -1)
        for m in range(i, same):
            value, r = score[m] + gap * (ps[m] + os[m]), rs[m] + 1
            while r <= size:
                if value > tree[r]:
                    tree[r], owner[r] = value, m
                r += r & -r
        i = same
    used, out = bytearray(n), []
    for m in sorted(range(n), key=lambda x: -score[x]):
        links = []
        while m >= 0 and not used[m]:
            used[m] = 1
            links.append(m)
            m = before[m]
        if links:
            out.append(links[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common in order (longest common subsequence): the rows of its table as differences, one bit for each word of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    rest = full = (1 << len(a)) - 1
    for y in b.tolist():
        if y in at:
            met = rest & at[y]
            rest = (rest + met | rest - met) & full
    return len(a) - rest.bit_count()


def extend(a: np.ndarray, b: np.ndarray, drop: int = 12) -> tuple[int, int]:
    """(length, equal words) by which two sequences go on alike from their beginning: +1 for an equal word, -2 for another, until the sum falls `drop` below its best."""
    n = min(len(a), len(b))
    total = best = length = equal = same = 0
    for i, x in enumerate((a[:n] == b[:n]).tolist(), 1):
        if x:
            total, same = total + 1, same + 1
            if total > best:
                best, length, equal = total, i, same
        else:
            total -= 2
            if best - total >= drop:
                break
    return length, equal


def blocks(doc: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray, k: int = K) -> np.ndarray:
    """Rows (start, end, other start, other end, equal words up to the end, equal words up to the start) of the runs of seeds that a chain of k-mers at -> to is made of."""
    equal, p, q, out = 0, int(at[0]), int(to[0]), []
    for i, j in zip(at.tolist(), to.tolist()):
        if (i > p or j > q) and (i < p or j < q):
            continue  # overlapping seeds on another diagonal: the next one goes on from there
        if not out or i > p or j > q:
            a, b = doc[p:i], other[q:j]
            equal += int((a == b).sum()) if len(a) == len(b) else common_words(a, b)
            p, q = i, j
            out.append([p, p, q, q, equal, equal])
        step = min(i + k - p, j + k - q)
        if step > 0:
            equal += int((doc[p : p + step] == other[q : q + step]).sum())
            p, q = p + step, q + step
        out[-1][1], out[-1][3], out[-1][4] = p, q, equal
    return np.array(out)


def segments(rows: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """First and last block of the longest stretch of a chain that is alike enough by itself, then of the longest ones before and after it, and so on."""
    out, todo = [], [(0, len(rows))]
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        part, best = rows[i:j], (0, 0, 0)
        for first in range(len(part)):
            long = part[first:, 1] - part[first, 0]
            if long[-1] <= best[0]:
                break
            fits = part[first:, 4] - part[first, 5] >= similarity * np.maximum(long, part[first:, 3] - part[first, 2])
            if fits.any():
                last = int(np.flatnonzero(fits)[-1])
                best = max(best, (int(long[last]), -first, first + last))
        if not best[0]:
            continue
        first, last = i - best[1], i + best[2]
        out.append((first, last))
        todo += [(i, first), (last + 1, j)]
    return out


def align(doc: np.ndarray, other: np.ndarray, rows: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, equal words) of the passage that consecutive blocks stand for, with what goes on alike beyond them."""
    start, first, p, q = (int(x) for x in (rows[0, 0], rows[0, 2], rows[-1, 1], rows[-1, 3]))
    equal = int(rows[-1, 4] - rows[0, 5])
    more, same = extend(doc[p:], other[q:])
    p, q, equal = p + more, q + more, equal + same
    more, same = extend(doc[:start][::-1], other[:first][::-1])
    return start - more, p, first - more, q, equal + same


def seed_rows(docs: DataFrame, k: int, window: int, frequent: np.ndarray) -> DataFrame:
    """(hash, salt, doc, pos) of all seeds; salt is -1 but for frequent hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 << 20):
            hashes, docs_, places = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                at, h = seeds(word_hashes(text), k, window)
                hashes.append(h)
                places.append(at)
                docs_.append(np.full(len(at), doc, np.int64))
            h, d = np.concatenate(hashes).view(np.int64), np.concatenate(docs_)
            salt = np.full(len(h), -1, np.int32)
            if len(frequent):
                hot = np.isin(h, frequent)
                mixed = d[hot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                salt[hot] = ((mixed >> np.uint64(40)) % np.uint64(SALTS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(d), pa.array(np.concatenate(places).astype(np.int32))], names=["hash", "salt", "doc", "pos"])

    return map_arrow(docs.select("doc", "text"), each, "hash long, salt int, doc long, pos int")


def holders(rows: DataFrame) -> DataFrame:
    """(doc, pos, other, to, hash) for later occurrences of a seed: where the first document that has it, and the one before this one, have it first.

    Of salted seeds, the one before is that of the salt, and the first comes afterwards: each of their occurrences is also a row with other null.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32)]  # of the run that the last batch ended in: its first document, the last one, and the one before that
        for b in batches:
            if not b.num_rows:
                continue
            old = len(carried[0])
            h, s, d, p = (np.concatenate([c, b.column(i).to_numpy()]) for i, c in enumerate(carried))
            at = np.arange(len(h))
            run = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
            doc = run.copy()
            doc[1:] |= d[1:] != d[:-1]
            first = np.maximum.accumulate(np.where(run, at, 0))
            own = np.maximum.accumulate(np.where(doc, at, 0))
            before = np.where(own > first, own[np.maximum(own - 1, 0)], first)
            new = at >= old
            late, salted = new & (own > first), new & (s >= 0)
            one, two, three = np.flatnonzero(late & (s < 0)), np.flatnonzero(late & ((before > first) | (s >= 0))), np.flatnonzero(salted)
            who, to = np.concatenate([one, two, three]), np.concatenate([first[one], before[two], three])
            none = np.zeros(len(who), bool)
            none[len(one) + len(two) :] = True
            yield pa.RecordBatch.from_arrays([pa.array(d[who]), pa.array(p[who]), pa.array(d[to], mask=none), pa.array(p[to], mask=none), pa.array(h[who])], names=["doc", "pos", "other", "to", "hash"])
            keep = sorted({int(first[-1]), int(before[-1]), int(own[-1])})
            carried = [x[keep] for x in (h, s, d, p)]

    placed = rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt", "doc", "pos")
    return map_arrow(placed, each, "doc long, pos int, other long, to int, hash long")


def matches(docs: DataFrame, k: int, window: int) -> tuple[DataFrame, DataFrame, str]:
    """(doc, pos, other, to, hash): seeds of each document, and where documents with smaller ids have them; the table behind it, see holders; and that table's path."""
    few = docs.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).distinct()
    sampled = seed_rows(docs.join(F.broadcast(few), "doc"), k, window, np.empty(0, np.int64))
    often = sampled.groupBy("hash").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "hash").limit(SALTED).select("hash").collect()
    found, path = written(holders(seed_rows(docs, k, window, np.array(sorted(r.hash for r in often), dtype=np.int64))), "seeds")
    if not often:
        return found, found, path
    salted = found.where("other is null").select("hash", "doc", "pos")
    first = salted.groupBy("hash").agg(F.min(F.struct("doc", "pos")).alias("f")).select("hash", F.col("f.doc").alias("other"), F.col("f.pos").alias("to"))
    # at most SALTED hashes
    second = salted.join(F.broadcast(first), "hash").where("doc <> other").select("doc", "pos", "other", "to", "hash")
    return found.where("other is not null").unionByName(second), found, path


def document_chains(p: np.ndarray, o: np.ndarray, t: np.ndarray, k: int, least: int, every: bool = False) -> list[tuple]:
    """(other, at, to): the chains of a document's matches (sorted by other, pos, to) that span `least` words; unless every, without those that repeat a part of a longer one at the same distances."""
    found = []
    ends = np.flatnonzero(np.concatenate([o[1:] != o[:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    step, far = np.diff(p), np.diff(t)
    bent = np.concatenate([[0], np.cumsum((far != step) | (step <= 0) | (2 * GAP * step >= 1))])
    whole = bent[ends - 1] == bent[starts]  # one diagonal without wide gaps
    if len(step):
        first = np.minimum(starts, len(step) - 1)
        whole |= (ends - starts == 2) & (step[first] > 0) & (far[first] > 0) & (GAP * (step[first] + far[first]) < 1)
    wide = (ends - starts > 1) & (p[ends - 1] - p[starts] + k >= least) & (whole | (ends - starts > 2))
    for i, j, one in zip(starts[wide].tolist(), ends[wide].tolist(), whole[wide].tolist()):
        if one:
            found.append((int(o[i]), p[i:j], t[i:j]))
            continue
        places = p[i:j].tolist()
        for links in collinear(places, t[i:j].tolist()):
            if len(links) > 1 and places[links[-1]] - places[links[0]] + k >= least:
                found.append((int(o[i]), p[i:j][links], t[i:j][links]))
    if every or len(found) < 2:
        return found
    kept, by_place = [], {}
    for other, at, to in sorted(found, key=lambda c: (-len(c[1]), c[0], c[1][0], c[2][0])):
        places, far = at.tolist(), (to - at).tolist()
        if any(places[-1] in own and all(own.get(x, m) == y + m for x, y in zip(places, far) for m in [own[places[0]] - far[0]]) and all(x in own for x in places) for own in by_place.get(places[0], ())):
            continue
        kept.append((other, at, to))
        own = dict(zip(places, far))
        for x in places:
            by_place.setdefault(x, []).append(own)
    return kept


def least_span(k: int, min_words: int) -> int:
    """Words that a chain spans at least."""
    return max(k, min_words // 2)


def block_range(first: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last block of the other document about chains whose seeds begin at first to last there."""
    return np.maximum(0, first - MARGIN) // BLOCK, (last + k + MARGIN) // BLOCK


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each range, and what is in it, last not included: (0, 3), (7, 9) give 0 0 0 1 1 and 0 1 2 7 8."""
    n = last - first
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first, n)


def unlike_rows(cols: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of a table with its rows sorted and each once."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    return [c[new] for c in cols]


def chained(found: DataFrame, k: int, window: int, min_words: int, every: bool = False) -> DataFrame:
    """(doc, close, late, chains, asked) of the documents that may hold a passage: chains of at least two seeds (other, at, to), whether the matched seeds lie close enough for a run of min_words words, the positions of all of them if so or if they make a link, and the blocks of other documents about the chains (other, block), each once.

    every: all chains are given, and late isn't.
    """
    least, span = least_span(k, min_words), min_words - k + 1 - 2 * window + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def lists(values: list[np.ndarray]) -> pa.ListArray:
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0, np.int32)]).astype(np.int32)))

        def flush() -> pa.RecordBatch:
            doc, close, late, own = zip(*rows)
            chains = [c for x in own for c in x]
            ends = np.cumsum([0, *map(len, own)])
            other = np.array([c[0] for c in chains], np.int64)
            n, block = ranges(*(x + i for i, x in enumerate(block_range(*(np.array([c[2][i] for c in chains], np.int64) for i in (0, -1)), k))))
            asked = unlike_rows([np.repeat(np.arange(len(own)), np.diff(ends))[n], other[n], block]) if len(n) else [np.empty(0, np.int64)] * 3
            given = pa.StructArray.from_arrays([pa.array(other), lists([c[1] for c in chains]), lists([c[2] for c in chains])], ["other", "at", "to"])
            blocks = pa.StructArray.from_arrays([pa.array(asked[1]), pa.array(asked[2].astype(np.int32))], ["other", "block"])
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(close, pa.bool_()), pa.array(late, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), given), pa.ListArray.from_arrays(pa.array(np.searchsorted(asked[0], np.arange(len(own) + 1)).astype(np.int32)), blocks)],
                names=["doc", "close", "late", "chains", "asked"],
            )

        def document(d: np.ndarray, o: np.ndarray, p: np.ndarray, t: np.ndarray) -> None:
            late, close, linked = None, False, False
            if not every:
                late = np.unique(p)
                ends = np.flatnonzero(np.concatenate([np.diff(late) > window, [True]]))
                close = bool((late[ends] - late[np.concatenate([[0], ends[:-1] + 1])] >= span).any())
                linked = close or bool(len(link_pairs(late, least - k)[0]))
            chains = document_chains(p, o, t, k, least, every)
            if linked or chains:
                rows.append((int(d[0]), close, late if linked else None, chains))

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            for i, j in zip(starts[:-1], starts[1:]):
                document(*(c[i:j] for c in cols))
            held = [c[starts[-1] :] for c in cols]
            if len(rows) > 500:
                yield flush()
        if held is not None:
            document(*held)
        if rows:
            yield flush()

    # a document's matches are at most two for each of its seeds
    placed = found.select("doc", "other", "pos", "to").repartition("doc").sortWithinPartitions("doc", "other", "pos", "to")
    return map_arrow(placed, each, "doc long, close boolean, late array<int>, chains array<struct<other:long,at:array<int>,to:array<int>>>, asked array<struct<other:long,block:int>>")


def link_pairs(at: np.ndarray, near: int, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of positions (sorted) that lie `near` to `reach` words apart."""
    first, last = np.searchsorted(at, at + near), np.searchsorted(at, at + reach, side="right")
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(at)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def turning(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """seeds, but of a row of equal ones (a text that repeats itself within a window) only the two at its ends."""
    at, h = seeds(words, k, window)
    if len(h) > 2:
        ends = np.concatenate([[True], (h[1:-1] != h[:-2]) | (h[1:-1] != h[2:]), [True]])
        at, h = at[ends], h[ends]
    return at, h


def link_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def open_links(words: np.ndarray, late: list[int], spans: list[tuple[int, int]], k: int, window: int, near: int) -> list[np.ndarray]:
    """[position, position, seed, seed, hash] of the links of late seeds of which the spans don't cover both."""
    at, h = turning(words, k, window)
    known = np.isin(at, late)
    at, h = at[known], h[known]
    free = np.ones(len(words) + 1, np.int64)
    for a, b in spans:
        free[a:b] = 0
    before = np.concatenate([[0], np.cumsum(free)])
    bare = before[at + k] > before[at]
    i, j = link_pairs(at, near)
    some = bare[i] | bare[j]
    i, j = i[some], j[some]
    return [at[i], at[j], h[i], h[j], link_hashes(h[i], h[j])]


def unlike_places(words: np.ndarray, k: int, at: np.ndarray, to: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Indices of the links at -> to that differ in their hash or in the words up to REACH before and behind them: a text that repeats itself has each once, and its beginning and its end."""
    first, last = np.maximum(at - REACH, 0), np.minimum(to + k + REACH, len(words))
    around = run_hashes(words, first, last - first)
    shape = (((at - first) << 40) + ((to - at) << 20) + last - at).astype(np.uint64)
    return np.unique(link_hashes(link_hashes(link, around), shape), return_index=True)[1]


def text_key(text: bytes) -> int:
    """Tells the texts of one doc_id apart."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def with_blocks(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, pieces): for the chains (checkpointed) of each document, the blocks of the other documents around them: id and key of the other's text, number, and 32-bit word hashes; one that several chains ask for is given once.

    Texts meet the numbers of their blocks that are asked for, so that each moves once; a block has a fixed size, and those that many ask for are broadcast.
    """
    asked = chains.select("doc", F.explode("asked").alias("a")).select("doc", "a.other", "a.block")
    wanted = asked.groupBy("other", "block").agg(F.count("*").alias("asked")).groupBy("other").agg(F.sort_array(F.collect_list(F.struct("block", "asked"))).alias("blocks"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 << 20):
            rows = []
            for other, text, blocks in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), b.column(2).to_pylist()):
                words, key = word_hashes(text).astype(np.uint32), text_key(text)
                for x in blocks:
                    part = words[x["block"] * BLOCK : (x["block"] + 1) * BLOCK]
                    if len(part):
                        rows.append((other, x["block"], x["asked"], key, part.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["other", "block", "asked", "key", "words"])

    texts = docs.join(wanted, docs["doc"] == wanted["other"]).select("other", "text", "blocks")
    blocks = cut(map_arrow(texts, each, "other long, block int, asked long, key long, words binary"))
    del texts, wanted
    tidy(docs.sparkSession)
    return skew_join(asked, blocks, ["other", "block"], "asked").groupBy("doc").agg(F.collect_list(F.struct("other", "key", "block", "words")).alias("pieces"))


def slices_of(pieces: list[dict]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For each chain, (position of the first word, word hashes) of each text its blocks come from."""
    by: dict[tuple, dict[int, bytes]] = {}
    for x in pieces:
        by.setdefault((x["chain"], x["key"]), {})[x["block"]] = x["words"]  # repeated rows give equal blocks
    out: dict[int, list] = {}
    for number, key in sorted(by):
        held = by[number, key]
        out.setdefault(number, []).append((min(held) * BLOCK, np.frombuffer(b"".join(held[i] for i in sorted(held)), np.uint32)))
    return out


def fewest(rows: list[tuple]) -> list[tuple]:
    """Of rows (start, end, other, other_start, other_end, equal), as few as cover the same words."""
    out, end, best = [], -1, None
    for r in sorted(rows, key=lambda r: (r[0], -r[1], -r[5], r[3])):
        if best and r[0] > end:
            out.append(best)
            end, best = best[1], None
        if r[0] > end:
            out.append(r)
            end = r[1]
        elif r[1] > (best[1] if best else end):
            best = r
    return out + [best] if best else out


#: For chains on several diagonals.
BENT = np.iinfo(np.int64).min


def hopeful(words: np.ndarray, others: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, zero: np.ndarray, min_words: int, similarity: float) -> np.ndarray:
    """For each i, whether words[start:end] has min_words words or more in a row of which `similarity` are anywhere in others[first:last]; or, where zero isn't BENT, are equal to those from others[zero + start] on. No passage is where they aren't."""
    known, rank = np.unique(words, return_inverse=True)
    place = np.searchsorted(known, others)
    place[known[np.minimum(place, len(known) - 1)] != others] = len(known)
    part = np.cumsum(np.maximum(len(known) + 1, last - first + end - start)) >> 19
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    out = np.zeros(len(first), bool)
    for i, j in zip(edges[:-1], edges[1:]):
        row, at = ranges(first[i:j], last[i:j])
        met = np.zeros((j - i, len(known) + 1), bool)
        met[row, place[at]] = True
        met[:, -1] = False
        row, at = ranges(start[i:j], end[i:j])
        long = end[i:j] - start[i:j]
        heads = np.cumsum(long + 1) - long - 1
        gain = np.full(len(row) + j - i, -2.0 * long.max() - 1)  # at the heads: no sum goes over from one to the next
        same = met[row, rank[at]]
        straight = np.flatnonzero((zero[i:j] != BENT)[row])
        same[straight] = words[at[straight]] == others[at[straight] + zero[i:j][row[straight]]]
        gain[np.arange(len(row)) + row + 1] = same - similarity
        total = np.cumsum(gain)
        fits = np.zeros(len(total), bool)
        fits[min_words:] = total[min_words:] - np.minimum.accumulate(total)[: max(0, len(total) - min_words)] > -1e-3
        out[i:j] = np.logical_or.reduceat(fits, heads)
    return out


def tries_of(words: np.ndarray, owners: np.ndarray, ends: np.ndarray, at: np.ndarray, to: np.ndarray, pieces: tuple, k: int, min_words: int, similarity: float) -> Iterator[tuple]:
    """(other, at, to, position of the other's first word, its word hashes) of a document's chains that may hold a passage; to counts from that position.

    owners: the others; ends: where each chain ends in at and to, after a 0; pieces: (other, key, block) and word hashes of each.
    """
    (other, key, block), held = pieces
    order = np.lexsort((block, key, other))
    order = order[np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in (other, key, block)], axis=0)])]  # repeated rows give equal blocks
    other, key, block = other[order], key[order], block[order]
    parts = [held(i) for i in order.tolist()]
    offset = np.cumsum([0, *map(len, parts)])
    low, high = block_range(to[ends[:-1]].astype(np.int64), to[ends[1:] - 1].astype(np.int64), k)
    texts: dict[int, list] = {}
    begins = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (key[1:] != key[:-1])])).tolist()
    for i, j in zip(begins, [*begins[1:], len(other)]):
        texts.setdefault(int(other[i]), []).append((i, j))
    numbers, blocks_ = block.tolist(), []
    for n, (who, lo, hi) in enumerate(zip(owners.tolist(), low.tolist(), high.tolist())):
        for i, j in texts.get(who, ()):
            x, y = bisect_left(numbers, lo, i, j), bisect_right(numbers, hi, i, j)
            if x < y:
                blocks_.append((n, numbers[x] * BLOCK, x, y))
    if not blocks_:
        return
    n, lo, x, y = np.array(blocks_).T
    first, last = offset[x], offset[y]
    # chains of another row with the same id reach beyond its end
    fits = (at[ends[1:] - 1][n] + k <= len(words)) & (to[ends[1:] - 1][n] - lo + k <= last - first)
    n, lo, first, last = n[fits], lo[fits], first[fits], last[fits]
    far = at.astype(np.int64) - to
    near, wide = (x.reduceat(far, ends[:-1])[n] for x in (np.minimum, np.maximum))
    start, end = np.maximum(0, near + lo), np.minimum(len(words), wide + lo + last - first)
    others = np.concatenate(parts)
    zero = np.where(wide > near, BENT, first - near - lo)
    some = hopeful(words, others, first, last, start, end, zero, min_words, similarity) if (wide > near).any() else np.ones(len(n), bool)
    for i, b, p, q in zip(n[some].tolist(), lo[some].tolist(), first[some].tolist(), last[some].tolist()):
        yield int(owners[i]), at[ends[i] : ends[i + 1]], to[ends[i] : ends[i + 1]] - b, b, others[p:q]


def passages_of(words: np.ndarray, chains: list[dict], pieces: list[dict], k: int, min_words: int, similarity: float) -> list[tuple]:
    """best_passages of chains and of the blocks of each (chain, key, block, words)."""
    slices = slices_of(pieces)
    return best_passages(words, ((c["other"], np.array(c["at"]), np.array(c["to"]) - lo, lo, other) for n, c in enumerate(chains) for lo, other in slices.get(n, ())), k, min_words, similarity)


def best_passages(words: np.ndarray, tries: Iterable[tuple], k: int, min_words: int, similarity: float) -> list[tuple]:
    """(start, end, other, other_start, other_end, equal) of a document's chains (see tries_of) that hold out: for each other document, as few as cover the same words.

    Of documents with the same min_words words or more in a passage, only the first is given: the others have a passage there by themselves.
    """
    out: dict[int, dict] = {}

    def holds(who: int, lo: int, other: np.ndarray, rows: np.ndarray) -> bool:
        a, b, x, y, equal = align(words, other, rows)
        if b - a < min_words or equal < similarity * max(b - a, y - x):
            return False
        out.setdefault(who, {})[a, b, who, x + lo, y + lo, equal] = other[x:y].tobytes()
        return True

    for who, at, to, lo, other in tries:
        if at[-1] + k > len(words) or to[-1] + k > len(other):
            continue  # of another row with the same id
        if (to - at == to[0] - at[0]).all():  # on one diagonal the whole chain is one block
            a, b, x, y = int(at[0]), int(at[-1]) + k, int(to[0]), int(to[-1]) + k
            if holds(who, lo, other, np.array([[a, b, x, y, int((words[a:b] == other[x:y]).sum()), 0]])):
                continue
            rows = blocks(words, other, at, to, k)
        else:
            rows = blocks(words, other, at, to, k)
            if holds(who, lo, other, rows):
                continue
        for first, last in segments(rows, similarity):
            if holds(who, lo, other, rows[first : last + 1]) and last - first == len(rows) - 1:
                break  # the whole chain
    known, kept = set(), []
    for other in sorted(out):
        for r in fewest(list(out[other])):
            copy = r[0], r[1], out[other][r]
            if copy not in known:
                kept.append(r)
            if r[4] - r[3] >= min_words:
                known.add(copy)
    return kept


def run_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n words from each position: differences of a polynomial's prefix sums."""
    with np.errstate(over="ignore"):
        power, inverse = powers(len(words) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power[:-1])])
        h = (sums[at + n] - sums[at]) * inverse[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def open_runs(words: np.ndarray, late: list[int], spans: list[tuple[int, int]], k: int, window: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, least seeds) of the runs of n words that the spans don't cover and all of whose seeds are late."""
    h = kmers(words, k)
    inner = n - k + 1 - window + 1
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    late = np.asarray(late, np.int64)
    late = late[late < len(h)]
    if len(words) < n or not len(late):
        return none
    masked = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
    masked[late] = h[late]
    fits = sliding(sliding(masked, window, np.minimum) == sliding(h, window, np.minimum), inner, np.minimum)
    free = np.ones(len(words), bool)
    for a, b in spans:
        free[a:b] = False
    at = np.flatnonzero(fits & sliding(free, n, np.maximum))
    if not len(at):
        return none
    return at, run_hashes(words, at, n), sliding(h, n - k + 1, np.minimum)[at]


def covering(spans: DataFrame) -> DataFrame:
    """Rows (doc, key, start, end, other_id, far), as few as cover the same words of each text: of those that begin within what is covered, the one that ends last.

    A repeated word, or line, fits an earlier one at every distance.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, end, best = None, 0, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] != text:
                    if best:
                        out.append(best)
                    text, end, best = row[:2], row[2], None
                if row[2] > end and best:
                    out.append(best)
                    end, best = best[3], None
                end = max(end, row[2]) if not best else end
                if row[3] > (best[3] if best else end):
                    best = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=b.schema.names)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in best], names=["doc", "key", "start", "end", "other_id", "far"])

    placed = spans.select("doc", "key", "start", "end", "other_id", "far").repartition("doc").sortWithinPartitions("doc", "key", "start", "end", "other_id")
    return map_arrow(placed, each, "doc long, key long, start long, end long, other_id long, far long")


def having(seeded: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc, hash): the documents that have two of the hashes (hash, alone; checkpointed), or one that is to be met alone, by the table of matches: each occurrence of a salted seed is a row in it."""
    met = seeded.select("doc", "other", "hash").join(small(hashes, 17), "hash").select(F.explode(F.array("doc", "other")).alias("doc"), "hash", "alone").where("doc is not null").distinct()
    return cut(met.groupBy("doc").agg(F.collect_list("hash").alias("hashes"), F.max("alone").alias("alone")).where((F.size("hashes") > 1) | F.col("alone")).select("doc", F.explode("hashes").alias("hash")))


def all_partners(links: DataFrame, seeded: DataFrame, docs: DataFrame, k: int, window: int, near: int) -> DataFrame:
    """(doc, pos, other, to): both seeds of each link (doc, pos, next, seed, following, link), wherever a document with a smaller id has both in order, as far apart as a link may be or nearly as far as this one, at each place that differs in the words about it.

    seeded: the table of matches. Texts are shuffled here whatever the size, so that what is measured on small inputs holds for larger ones.
    """
    # a link of a seed with itself needs no other one
    hashes = cut(links.select(F.explode(F.array("seed", "following")).alias("hash"), (F.col("seed") == F.col("following")).alias("alone")).groupBy("hash").agg(F.max("alone").alias("alone")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 20):
            rows = []
            for doc, text, wanted in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), b.column(2).to_pylist()):
                words = word_hashes(text)
                at, h = turning(words, k, window)
                known = np.isin(h, np.array(wanted, np.int64).view(np.uint64))
                at, h = at[known], h[known]
                i, j = link_pairs(at, max(1, near - SHIFT), REACH + SHIFT)
                if len(i):
                    link = link_hashes(h[i], h[j])
                    if len(np.unique(link)) < len(link):
                        kept = unlike_places(words, k, at[i], at[j], link)
                        link, i, j = link[kept], i[kept], j[kept]
                    rows.append((link.view(np.int64), np.full(len(i), doc, np.int64), at[i].astype(np.int32), at[j].astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["link", "other", "to", "to_next"])

    asked = cut(links.groupBy("link").agg(F.max("doc").alias("last")))
    wanted = having(seeded, hashes).groupBy("doc").agg(F.collect_list("hash").alias("hashes"))
    held = map_arrow(docs.join(wanted.hint("shuffle_merge"), "doc").select("doc", "text", "hashes"), each, "link long, other long, to int, to_next int")
    partners = held.join(small(asked, 16), "link").where("other < last").drop("last").distinct()
    fits = f"to_next - to between {near} and {REACH} or abs(to_next - to - next + pos) <= {SHIFT}"
    met = links.select("doc", "pos", "next", "link").join(partners, "link").where("other < doc").where(fits)
    return met.select("doc", "other", F.explode(F.array(F.struct("pos", "to"), F.struct(F.col("next").alias("pos"), F.col("to_next").alias("to")))).alias("x")).select("doc", "x.pos", "other", "x.to").distinct()


def exact_runs(open_: DataFrame, seeded: DataFrame, docs: DataFrame, k: int, n: int) -> DataFrame:
    """Passages for the runs (doc, key, start, run, least) that an earlier document has as they are.

    seeded: the table of matches. The documents that have a run's least seed hash their runs about it; only the first holder of each is kept.
    """
    least = cut(open_.select(F.col("least").alias("hash"), F.lit(True).alias("alone")).distinct())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 20):
            rows = []
            for doc, text, hashes in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), b.column(2).to_pylist()):
                words = word_hashes(text)
                if len(words) >= n:
                    at = np.flatnonzero(np.isin(sliding(kmers(words, k), n - k + 1, np.minimum), np.array(hashes, np.int64).view(np.uint64)))
                    rows.append((run_hashes(words, at, n).view(np.int64), np.full(len(at), doc, np.int64), at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["run", "doc", "pos"])

    pairs = having(seeded, least)
    wanted = pairs.groupBy("doc").agg(F.collect_list("hash").alias("hashes"))
    runs = map_arrow(docs.join(F.broadcast(wanted) if small(pairs, 40) is not pairs else wanted, "doc").select("doc", "text", "hashes"), each, "run long, doc long, pos long")
    first = runs.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("first"))
    asked = cut(open_.groupBy("run").agg(F.count("*").alias("asked")).join(first, "run"))
    met = skew_join(open_, asked, ["run"], "asked").where("first.doc < doc").select("doc", "key", "start", F.col("first.doc").alias("other_id"), (F.col("first.pos") - F.col("start")).alias("far")).distinct()
    order = Window.partitionBy("doc", "key", "other_id", "far").orderBy("start")
    joined = met.withColumn("island", F.col("start") - F.row_number().over(order)).groupBy("doc", "key", "other_id", "far", "island").agg(F.min("start").alias("start"), (F.max("start") + n).alias("end"))
    size = F.col("end") - F.col("start")
    return covering(joined).select(F.col("doc").alias("doc_id"), "key", "start", "end", "other_id", (F.col("start") + F.col("far")).alias("other_start"), (F.col("end") + F.col("far")).alias("other_end"), size.alias("n_words"), size.alias("n_equal"))


def identified(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


COLUMNS = ["doc_id", "key", "start", "end", "other_id", "other_start", "other_end", "n_words", "n_equal"]


def verified(docs: DataFrame, chains: DataFrame, k: int, window: int, min_words: int, similarity: float, near: int) -> DataFrame:
    """The passages that the chains (checkpointed) of each document stand for; and what they leave, where it has late seeds: rows with run and least are its open runs, those with link as well (positions in start and end, seeds in run and least) its open links."""
    joined = docs.join(chains, "doc").join(with_blocks(chains, docs), "doc", "left").select("doc", "text", "close", "late", "chains", "pieces")
    names = [*COLUMNS, "run", "least", "link"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 << 20):
            out, runs, links = [], [], []
            lates, chains_, pieces = (b.column(i) for i in (3, 4, 5))
            owner, ats, tos = (chains_.values.field(i) for i in range(3))
            owner, ends, ats, tos = owner.to_numpy(), ats.offsets.to_numpy(), ats.values.to_numpy(), tos.values.to_numpy()
            other, number, block = (pieces.values.field(i).to_numpy() for i in range(3))
            held = pieces.values.field(3)
            edges = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // 4 if len(held) else None
            hashes = np.frombuffer(held.buffers()[2], np.uint32, edges[-1]) if len(held) else None
            places = lates.values.to_numpy()
            offsets = (x.offsets.to_numpy().tolist() for x in (lates, chains_, pieces))
            for doc, text, close, *at_ in zip(b.column(0).to_pylist(), bytes_of(b.column(1)), b.column(2).to_pylist(), *(y for x in offsets for y in (x[:-1], x[1:]))):
                words, key = word_hashes(text), text_key(text)
                late, passages = places[at_[0] : at_[1]], []
                c, d, i, j = at_[2:]
                if c < d and i < j:
                    asked = (other[i:j], number[i:j], block[i:j]), lambda x, i=i: hashes[edges[i + x] : edges[i + x + 1]]
                    own, short = slice(ends[c], ends[d]), words.astype(np.uint32)
                    passages = best_passages(short, tries_of(short, owner[c:d], ends[c : d + 1] - ends[c], ats[own], tos[own], asked, k, min_words, similarity), k, min_words, similarity)
                out += [(doc, key, a, e, other_id, x, y, e - a, equal) for a, e, other_id, x, y, equal in passages]
                if len(late):
                    spans = [x[:2] for x in passages]
                    if close:
                        at, h, least = open_runs(words, late, spans, k, window, min_words)
                        runs.append((np.full(len(at), doc, np.int64), np.full(len(at), key, np.int64), at, h.view(np.int64), least.view(np.int64)))
                    p, q, one, two, link = open_links(words, late, spans, k, window, near)
                    links.append((np.full(len(p), doc, np.int64), np.full(len(p), key, np.int64), p, q, one.view(np.int64), two.view(np.int64), link.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out)), *[pa.nulls(len(out), pa.int64())] * 3], names=names)
            if runs and sum(len(r[0]) for r in runs):
                doc, key, at, h, least = (pa.array(np.concatenate(c)) for c in zip(*runs))
                yield pa.RecordBatch.from_arrays([doc, key, at, *[pa.nulls(len(at), pa.int64())] * 6, h, least, pa.nulls(len(at), pa.int64())], names=names)
            if links and sum(len(r[0]) for r in links):
                doc, key, p, q, one, two, link = (pa.array(np.concatenate(c)) for c in zip(*links))
                yield pa.RecordBatch.from_arrays([doc, key, p, q, *[pa.nulls(len(p), pa.int64())] * 5, one, two, link], names=names)

    return map_arrow(joined, each, ", ".join(f"{c} long" for c in names))


def passage_rows(docs: DataFrame, min_words: int, similarity: float, k: int, window: int) -> DataFrame:
    """The columns of repeated_passages, and key, the text_key of the text that holds the passage."""
    if min_words < window + k - 1:
        raise ValueError("a run of min_words words must have a seed")
    docs = identified(docs)
    found, seeded, path = matches(docs, k, window)
    near = least_span(k, min_words) - k
    tidy(docs.sparkSession)
    chains = cut(chained(found, k, window, min_words))
    tidy(docs.sparkSession)
    rows, rest = written(verified(docs, chains, k, window, min_words, similarity, near), "passages")
    del chains
    tidy(docs.sparkSession)
    aligned = rows.where("run is null").select(*COLUMNS)
    left = rows.where("run is not null and link is null").select(F.col("doc_id").alias("doc"), "key", "start", "run", "least")
    links = rows.where("link is not null").select(F.col("doc_id").alias("doc"), "key", F.col("start").cast("int").alias("pos"), F.col("end").cast("int").alias("next"), F.col("run").alias("seed"), F.col("least").alias("following"), "link")
    if not left.isEmpty():
        exact = cut(exact_runs(left, seeded, docs, k, min_words))
        aligned = aligned.unionByName(exact)
        spans = exact.groupBy(F.col("doc_id").alias("doc"), "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        over = lambda at: F.exists("spans", lambda x: (x["start"] <= at) & (x["end"] >= at + k))
        links = links.join(spans, ["doc", "key"], "left").where(F.col("spans").isNull() | ~(over(F.col("pos")) & over(F.col("next")))).drop("spans")
    links = cut(links.drop("key"))
    tidy(docs.sparkSession)
    if not links.isEmpty():
        chains = cut(chained(all_partners(links, seeded, docs, k, window, near), k, window, min_words, every=True))
        tidy(docs.sparkSession)
        aligned = aligned.unionByName(verified(docs, chains.withColumn("late", F.lit(None).cast("array<int>")), k, window, min_words, similarity, near).select(*COLUMNS))
    passages = cut(aligned.distinct())
    for x in (path, rest):
        remove(docs.sparkSession, x)
    return passages


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row for each passage of a document that a document with a smaller doc_id holds as well.

    Columns: doc_id, start and end (word positions; words are what ASCII white space parts, A-Z as a-z), other_id, other_start, other_end, n_words, n_equal.
    Each earlier document a text is compared with has as few passages as cover the same words; of those whose words in a passage are the same, min_words
    or more, only the first is given. A passage has at least min_words words, at least `similarity` of them in common. Every word of a run of min_words
    words that an earlier document holds as it is lies in a passage; of those with differing words, the ones that
    share seeds in order with any earlier document, min_words / 2 to REACH words apart, and whose seeds no other passage covers. Null and empty texts have none; rows of one doc_id aren't
    compared with each other, and rows without one take no part; repeated rows give each passage once; other columns are
    ignored; an empty table gives an empty result.
    """
    return passage_rows(docs, min_words, similarity, k, window).drop("key")


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what follows a removed word up to the next one goes with it."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        if starts[a] > at:
            out.append(text[at : starts[a]])
        at = max(at, starts[min(b, len(starts) - 1)])
    out.append(text[at:])
    return b"".join(out)


def drop_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with repeated_passages taken out of text: of each passage the document with the smallest doc_id keeps its own.

    Rows without an id, and texts without such a passage, come back as they are.
    """
    spans = passage_rows(docs, min_words, similarity, k, window).groupBy(F.col("doc_id").alias("doc_")).agg(F.collect_list(F.struct("key", "start", "end")).alias("spans_"))
    at, names = docs.columns.index("text"), docs.columns
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col("doc_"), "left").select(*[docs[f"`{c}`"] for c in names], "spans_")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 4 << 20):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            for i, spans in enumerate(b.column(len(names)).to_pylist()):
                if spans and texts[i]:
                    key = text_key(texts[i])
                    own = [(x["start"], x["end"]) for x in spans if x["key"] == key]
                    if own:
                        texts[i] = without_words(texts[i], own)
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if j == at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(joined, each, docs.schema)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """A null or empty text has no passage; see repeated_passages."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
