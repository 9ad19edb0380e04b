import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from spanforge.llm import simhash as S
from spanforge.llm.common import components

from .conftest import groups_of


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    made = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def texts():
    rng = random.Random(3)
    base = [[rng.choice("ab cd éf GH ij k l m n o p q r s t u".split(" ")) for _ in range(rng.choice([2, 3, 40, 200]))] for _ in range(40)]
    out = [None, "", " \n\t", "One", "one", "one two three"]
    for b in base:
        out.append(" ".join(b))
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = "zz"
            out.append("\n".join(c))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_matches_brute_force(spark, docs_of, hot):
    rows = list(enumerate(texts() + texts()[:20], 100))
    got = {r.doc_id: r for r in S.simhash_groups(docs_of(rows).repartition(3), hot=hot).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: int.from_bytes(got[i].fp, "big") for i in fps} == fps
    root = groups_of(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {i: got[i].component_id for i in fps} == root


def test_masks_meet_every_close_pair():
    rng = np.random.default_rng(1)
    sample = [rng.bytes(8) for _ in range(300)]
    for n, tau in ((1000, 3), (10**9, 3), (10**6, 5), (10, 1)):
        masks = [sum(1 << 63 - b for b in m) for m in S.probe_masks(sample, n, tau)]
        for _ in range(2000):
            d = sum(1 << int(b) for b in rng.choice(64, size=tau, replace=False))
            assert any(d & m == 0 for m in masks)


def test_thresholds_are_unequal_where_that_is_cheaper():
    assert S.allot([{-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 100, 1: 500}], 0) == (2, [1, -1])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, "a"), (5, "a"), (None, "a")]])
def test_edges(spark, docs_of, rows):
    got = S.simhash_groups(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == rows[-1][0] or r.component_id == 5 for r in got)


def test_similar_groups_at_0_8(spark, docs_of):
    rng = random.Random(5)
    rows = []
    for g in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for k in range(3):
            w = list(words)
            for _ in range(3 * k):
                w[rng.randrange(400)] = "new"
            rows.append((10 * g + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs_of(rows)).collect()}
    assert {i: c for i, c in got.items() if c // 10 != i // 10} == {}
    assert sum(c % 10 == 0 for c in got.values()) >= 57


def test_masks_meet_pairs_at_the_threshold():
    """At least 99 in 100 pairs at 0.8 agree on a mask, however the distance varies; masks are the ones the stage takes."""
    rng = np.random.default_rng(4)
    tau = S.expected_distance(0.8, 512, 4)
    recall = S.similar_groups.__defaults__[-1]
    masks = np.array([np.bincount(m, minlength=512) for m in S.random_masks(512, tau, recall)])
    differ = rng.random((20_000, 512)) < S.expected_distance(0.8, 512) / 512
    met = ((differ.astype(np.float32) @ masks.T.astype(np.float32)) == 0).any(axis=1) & (differ.sum(axis=1) <= tau)
    assert met.mean() >= 0.99


def test_similar_groups_are_verified(spark, docs_of):
    """Pairs on either side of 0.8 are told apart by their shingles."""
    rng = random.Random(6)
    rows, links = [], []
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        copy = [*words[:-1]]
        n = rng.randrange(34, 60)
        copy[:n] = [f"v{rng.randrange(5000)}" for _ in range(n)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        x, y = (set(zip(*(w[i:] for i in range(5)))) for w in (words, copy))
        if len(x & y) >= 0.8 * len(x | y):
            links.append((2 * g, 2 * g + 1))
    assert 10 < len(links) < 50
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs_of(rows)).collect()}
    assert {i for i, c in got.items() if c != i} <= {b for _, b in links}
    assert sum(c != i for i, c in got.items()) >= 0.9 * len(links)


def test_similarity_is_of_sets(spark, docs_of):
    """A word said over and over doesn't make two texts alike."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + " the" * 400) for i in range(10)]
    assert [r.doc_id == r.component_id for r in S.similar_groups(docs_of(rows)).collect()] == [True] * 10


def test_wide_hot_buckets_are_chunked(spark, docs_of):
    rows = [(i, " ".join(["the same words again and again"] * 30 + [f"x{i}"])) for i in range(60)]
    got = S.simhash_groups(docs_of(rows), 5, 512, 77, hot=10).collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: r for n, r in groups_of(nodes, edges).items() if n != r}
