import math
import random
import re
import zlib

import numpy as np

from spanforge.llm import toxicity as T
from spanforge.llm.common import held_out


def made(n, seed=1):
    rng = random.Random(seed)
    syllables = "ba ce di fo gu ra le mi no tu sh ti on er an".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        for _ in range(len(words) // 20 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["worthless", "pathetic", "idiot"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_texts_and_misspellings():
    model = T.SubwordSoftmax.train([(t, y) for _, t, y in made(400)])
    test = made(200, 9)
    hit = (model.score([t for _, t, _ in test]) >= 0.5) == np.array([y for *_, y in test])
    assert hit.mean() > 0.95
    plain, wrong = model.score(["bace difo gura lemi " * 5, "bace difo gura lemi " * 5 + "worthlesss pathetiic"])
    assert plain < 0.5 < wrong
    assert 0 <= model.score([""])[0] <= 1


def test_caches_change_nothing(monkeypatch):
    model = T.SubwordSoftmax.train([(t, y) for _, t, y in made(60)], iterations=5)
    texts = [t for _, t, _ in made(30, 3)] + ["", "!!", "x" * 5000]
    whole = model.score(texts)
    monkeypatch.setattr(T, "CACHE", 5)
    single = np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(whole, single)


def test_products_match_dense():
    rng = np.random.default_rng(1)
    row, col = np.nonzero(rng.random((7, 5)) < 0.4)
    weight = rng.random(len(row))
    dense = np.zeros((7, 5))
    dense[row, col] = weight
    s, x = T.Sparse(row, col, weight, (7, 5)), rng.random((5, 2)).astype(np.float32)
    assert np.allclose(s.dot(x), dense @ x, atol=1e-5) and np.allclose(s.tdot(np.ones((7, 1), np.float32))[:, 0], dense.sum(0), atol=1e-5)


def test_tables(spark, docs_of):
    rows = [(i, t) for i, t, _ in made(120)] + [(500, None), (501, ""), (502, "é" * 40_000), (502, "é" * 40_000), (None, "worthless idiot")]
    labels = spark.createDataFrame([(i, y) for i, _, y in made(120)] + [(500, 1), (7, None), (None, 1), (9999, 1), (4, 1), (4, 1)], "doc_id long, toxic int")
    sample = T.labelled_sample(docs_of(rows), labels)
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(120))
    assert len(T.labelled_sample(docs_of(rows), labels, (3, 2))) == 5
    assert len(T.labelled_sample(docs_of(rows * 4), labels, (3, 2))) == 5
    got = T.score_texts(docs_of(rows), T.SubwordSoftmax.train(sample, iterations=5)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert T.score_texts(docs_of([]), T.SubwordSoftmax.train([])).collect() == []
    assert {r.score for r in T.score_texts(docs_of(rows[:3]), T.SubwordSoftmax.train([])).collect()} == {0.5}
    fold = spark.range(50)
    assert [r.h for r in fold.select(held_out(fold.id).alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]


def slow_score(model, text):
    """One character n-gram at a time."""
    mask = 0xFFFFFFFF

    def bucket(h):
        h ^= h >> 15
        return (h * 0x85EBCA6B & mask) >> 32 - (T.BUCKETS.bit_length() - 1)

    scores = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        codes = [2, *map(ord, w), 3]
        found = []
        for n in (3, 4, 5):
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 0x01000193 & mask) ^ c
                found.append(bucket(h))
        whole = 0
        for place, c in enumerate(codes):
            x = (c + 1) * ((place * 2 + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
            whole += x ^ x >> 29
        found.append(bucket((whole & (1 << 64) - 1) >> 32))
        scores.append(sum(float(model.table[b]) for b in found) / len(found))
    mean = sum(scores) / len(scores) if scores else 0.0
    return 1 / (1 + math.exp(-(mean + model.bias)))


def test_scores_match_brute_force(spark, docs_of):
    model = T.SubwordSoftmax.train([(t, y) for _, t, y in made(150)], iterations=8)
    rows = [(i, t) for i, t, _ in made(40, 5)] + [(900, ""), (901, "a"), (902, "Idiot_idiots É!"), (903, "\U0001F600 \U00020001x"), (904, "no " * 3000), (905, None)]
    got = {r.doc_id: r.score for r in T.score_texts(docs_of(rows), model).collect()}
    for i, t in rows:
        assert abs(got[i] - slow_score(model, t or "")) < 1e-6
