from itertools import combinations

import numpy as np
import pytest

from spanforge.llm import embeddings as M

from .conftest import groups_of

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rep string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, "x", "y", 1) for i, v in rows], SCHEMA)


def brute(rows):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            good[k] = x / np.sqrt(x @ x)
    links = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    count = {k: 0 for k in range(len(rows))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, links


def cloud(dim, seed=1):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(150)]
    for _ in range(12):
        centre = rng.normal(size=dim)
        out += [centre + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.3]) for _ in range(15)]
    dense = rng.normal(size=dim)
    return out + [dense + rng.normal(size=dim) * 0.01 for _ in range(120)]


@pytest.mark.parametrize(("dim", "block", "group"), [(8, 4096, 1 << 26), (8, 40, 1 << 26), (8, 40, 2000), (3, 64, 1 << 12), (24, 50, 1 << 14)])
def test_matches_brute_force(spark, dim, block, group, monkeypatch):
    """In few blocks and many, and in groups of few bytes."""
    monkeypatch.setattr(M, "BLOCK", 8)
    vectors = cloud(dim)
    rows = [(1000 - k, list(v)) for k, v in enumerate(vectors)] + [(2000 + k, list(vectors[k * 7])) for k in range(40)] + [(3000 + k, list(vectors[5] * (k + 2))) for k in range(3)]
    count, links = brute(rows)
    got = {r.vec_id: r for r in M.embedding_links(table(spark, rows).repartition(3), block_bytes=8 * dim * block, group_bytes=group).collect()}
    ids = [i for i, _ in rows]
    root = groups_of(ids, [(ids[a], ids[b]) for a, b in links])
    assert len(links) > 5000
    assert {i: got[i].n_links for i in ids} == {ids[k]: n for k, n in count.items()}
    assert {i: got[i].component_id for i in ids} == root
    assert all(got[i].kept == (root[i] == i) for i in ids)


def test_bad_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [nan, 1]), (5, [inf, 1]), (6, [None, 1]), (7, [1, 0]), (8, [1, 0]), (8, [1, 0]), (9, [1, 0, 0]), (None, [1, 0]), (10, [-1, 0])]
    got = M.embedding_links(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)} | {(7, 2, 7, True), (8, 2, 7, False), (None, 0, None, False)}


def test_empty(spark):
    assert M.embedding_links(table(spark, [])).collect() == []


def test_tree_covers_its_members():
    x = M.unit_rows(cloud(6))
    order, root = M.cover_tree(x, 0.05)
    assert sorted(order) == list(range(len(x)))
    todo = [(M.unflat(M.flat(root)), 2.0)]
    while todo:
        node, above = todo.pop()
        d = np.linalg.norm(x[order[node.lo : node.hi]] - x[order[node.centre]], axis=1)
        assert d.max() <= node.radius + 1e-7 and node.radius <= above + 1e-7
        assert not node.children or (node.children[0].lo, node.children[-1].hi) == (node.lo, node.hi)
        todo += [(c, above / 2) for c in node.children]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = []
    for dim in (4, 5):
        base = rng.normal(size=(10, dim))
        rows += [(dim * 100 + 10 * k + j, list(b + rng.normal(size=dim) * 0.05)) for k, b in enumerate(base) for j in range(8)]
    rows.append((999, [1.0] * 7))
    count, links = brute(rows)
    ids = [i for i, _ in rows]
    root = groups_of(ids, [(ids[a], ids[b]) for a, b in links])
    for group in (1 << 26, 1500):
        got = {r.vec_id: r for r in M.embedding_links(table(spark, rows), group_bytes=group).collect()}
        assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (count[k], root[i]) for k, i in enumerate(ids)}
    few = {r.vec_id: r for r in M.embedding_links(table(spark, rows), sample=3).collect()}
    assert {i: (few[i].n_links, few[i].component_id) for i in ids} == {i: (count[k], root[i]) for k, i in enumerate(ids)}
