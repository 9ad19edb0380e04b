import random

import pytest
from tokenizers import Tokenizer

from .test_lines import slow as slow_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EN = "the and of to in that is was it for on with as be at by this have from or one had not but what all were when we there can an your which".split()
FR = "le la les de des et un une que qui dans est pour pas sur avec plus par je vous nous ils elle mais ou où donc être à été très".split()


def documents(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n, lang: " ".join(rng.choice(lang) + rng.choice(["", "s", "e", "tion"]) for _ in range(n))
    shared = text(80, EN)
    rows = []
    for i in range(60):
        lang = FR if i % 3 == 0 else EN
        body = "\n".join(text(30, lang) for _ in range(4))
        if i % 10 == 1:
            body += "\na line that many of these documents do share\n" + shared
        rows.append((i, body, "fr" if i % 3 == 0 else "en", "src", len(body)))
    copy = rows[4][1].split(" ")
    copy[50] = "changed"
    rows += [(70, rows[5][1], "en", "src", 1), (71, " ".join(copy), "en", "src", 1), (72, "123 456", "en", "src", 1), (73, None, None, None, None), (74, "", "en", "src", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return {r[0]: r for r in rows}, shared


def test_stages(spark, tmp_path):
    rows, shared = documents(spark, tmp_path)
    docs, found = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert name == "packing" or docs.columns == columns
        found[name] = docs.collect()
    ids = {k: sorted(r.doc_id for r in v) for k, v in found.items() if k != "packing"}
    assert ids["language"] == ids["lines"] == sorted(set(rows) - {72, 73, 74})
    want = {i: t for i, _, _, t in slow_lines([(r.doc_id, r.text) for r in found["language"]])}
    assert {r.doc_id: r.text for r in found["lines"]} == want
    assert all(r.n_chars == len(r.text) for r in found["lines"] + found["passages"])
    assert ids["near_copies"] == ids["passages"] == sorted(set(ids["lines"]) - {70, 71})
    holds = [r.doc_id for r in found["passages"] if shared[:200] in r.text]
    assert len(holds) == 1  # the line pass leaves the last one
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in found["passages"]}
    assert {r.doc_id: r.doc_tokens for r in found["packing"]} == tokens
    assert sum(r.length for r in found["packing"]) == sum(tokens.values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in whole} == tokens


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_passages_of_any_partner_are_cut_out(spark):
    """The stage finds a fuzzy copy although other documents hold short parts of it before and between."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    around = lambda x: " ".join(words(40) + x + words(40))
    p = words(100)
    parts = [p[a : a + 11] for a in range(7, 95, 12)]
    copy = [f"changed{i}" if i % 12 == 6 else x for i, x in enumerate(p)]
    rows = [(i, around(x)) for i, x in enumerate(parts)] + [(50, around(p))] + [(60 + i, around(x)) for i, x in enumerate(parts)] + [(90, around(copy))]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert len(kept[90].text.split()) <= 90 and kept[90].n_chars == len(kept[90].text)
    assert all(kept[i].text == t for i, t in rows if i != 90)
