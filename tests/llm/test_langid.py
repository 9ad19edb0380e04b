import math
import zlib

import numpy as np
import pytest

from spanforge.llm import langid as L

EN = "the quick brown fox jumps over the lazy dog and then the other thing that they have there"
FR = "le renard brun saute par dessus le chien paresseux et puis les autres choses qui sont là où elles étaient"


def rows():
    out = []
    for i in range(60):
        words = (EN if i % 2 else FR).split()
        out.append((i, " ".join(words[(i + k * 7) % len(words)] for k in range(12)), "en" if i % 2 else "fr"))
    return out


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_learns_and_predicts(spark):
    df = table(spark, rows() + [(100, None, "en"), (101, "", "fr"), (102, " 123 ½ !\n", "en"), (103, "they have the thing", None), (103, "they have the thing", None), (None, "les autres choses", "fr")])
    models = L.learn(df)
    assert [m.value.languages for m in models] == [["en", "fr"]]
    got = L.predict_languages(df, models).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows())
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[103].lang_pred == "en" and by[None].lang_pred == "fr"
    kept = L.keep_identified(df, models)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(60), 103, None}


def test_only_the_training_fold_is_learned(spark):
    data = [(i, EN, "en" if zlib.crc32(str(i).encode()) % 5 else "xx") for i in range(40)]
    assert {lang for _, lang in L.labelled_sample(table(spark, data))} == {"en"}
    assert len(L.labelled_sample(table(spark, data), per_language=3)) == 3
    assert len(L.labelled_sample(table(spark, data[1:2] * 50), per_language=3)) <= 3


def test_nothing_to_learn_from(spark):
    models = L.learn(table(spark, []))
    got = L.predict_languages(table(spark, [(1, EN, "en")]), models).first()
    assert models == [] and (got.lang_pred, got.score) == ("und", 0.0)
    assert L.predict_languages(table(spark, []), models).collect() == [] and L.keep_identified(table(spark, rows()), models).collect() == []


def slow_best(data, text):
    """Language and posterior by dictionaries of n-gram counts, one n-gram at a time."""

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 16

    def grams(t):
        low = [ord(c.lower()[0]) if c.isalpha() else 32 for c in t]
        codes = [0, 0, *[ord(c) if ord(c) > 0xFFFF else x for c, x in zip(t, low)], 0, 0]
        codes = [32 if c == 0 else c for c in codes]
        return [bucket(codes[i : i + n]) for n in (1, 2, 3) for i in range(len(t) + 2)]

    if not any(c.isalpha() for c in text):
        return "und", 0.0
    sums = {}
    for lang in sorted({x for _, x in data}):
        seen = {}
        for t, x in data:
            for g in grams(t) if x == lang else ():
                seen[g] = seen.get(g, 0) + 1
        total = sum(seen.values()) + L.BUCKETS
        sums[lang] = sum(math.log((seen.get(g, 0) + 1) / total) for g in grams(text))
    best = max(sums, key=lambda x: sums[x])
    return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())


@pytest.mark.parametrize("slice_", [256, 2])
def test_matches_brute_force(spark, slice_):
    """Whole or in slices of the languages; with columns whose names clash."""
    languages = {"en": EN, "fr": FR, "de": "der schnelle braune fuchs springt über den faulen hund und dann das andere", "ru": "быстрая лиса прыгает через ленивую собаку и потом ещё раз", "xx": "zzq qqz xqz"}
    data = [(i, " ".join(w[(i + k * 5) % len(w)] for k in range(9)), x) for i, (x, w) in enumerate((x, t.split()) for t_ in range(6) for x, t in languages.items())]
    odd = [(1000, "the le der лиса", None), (1001, "Ünder ÉTÉ", None), (1002, "42 !", None), (1003, "\U00020001 fuchs\n\nhund", None), (1004, "q", None)]
    df = table(spark, data + odd).selectExpr("*", "'a' as lang_pred", "1 as top", "2 as total", "lang as score", "text as source")
    models = L.learn(df, slice_=slice_)
    assert len(models) == (1 if slice_ > 4 else 3)
    train = [(t, x) for i, t, x in data if zlib.crc32(str(i).encode()) % 5]
    got = {r.doc_id: r for r in L.predict_languages(df, models).collect()}
    assert len(got) == len(data) + len(odd)
    for i, t, _ in data + odd:
        lang, score = slow_best(train, t)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4
    kept = L.keep_identified(df, models)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.lang_pred != "und" and r.score >= 0.5}


def test_a_batch_scores_like_single_texts():
    model = L.NaiveBayes([(t, lang) for _, t, lang in rows()])
    texts = ["the thing", "", "x", "où elles étaient", "\U00020000\U00020001 là", "the " * 50_000]
    lang, score = model.predict(texts)
    for t, a, s in zip(texts, lang, score):
        b, c = model.predict([t])
        assert b == [a] and np.allclose(c, s)
