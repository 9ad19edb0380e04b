import random
import re
from collections import Counter

import duckdb
import pytest

from spanforge.llm.quality import oracle, quality_rules

from ..oracle import rows_of


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_figures_match_brute_force(spark, docs_of):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "one two three"), (3, " \n\t"), (4, "a b a b a b"), (5, "# $x | é é\n\n# $x | é é"), (6, "w w w w"), (7, "ab c ab c"), (8, "x " * 60_000)]
    rows += [(i, "".join(rng.choice(["aa", "b", "é", "*"]) + rng.choice([" ", "  ", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(3, 90)))) for i in range(10, 90)]
    got = {r.doc_id: r for r in quality_rules(docs_of(rows)).collect()}
    for i, t in rows:
        r, want = got[i], slow(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_boilerplate_of_a_host(spark, docs_of):
    line = "this very line stands on every page of the host with its many words"
    own = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    rows = [(i, f"{line}\n{own(i, 60)}") for i in range(30)] + [(100 + i, "\n".join([line + " "] * 6) + "\n" + own(i, 40)) for i in range(3)]
    got = {r.doc_id: r for r in quality_rules(docs_of(rows), max_share=0.5).collect()}
    assert all(got[i].kept and got[i].words_left == 60 for i in range(30))
    assert not any(got[i].kept for i in range(100, 103))
    assert all(r.kept or r.base_failed for r in quality_rules(docs_of(rows), min_docs=50).collect())


def test_edges(spark, docs_of):
    assert quality_rules(docs_of([])).collect() == []
    text = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(20))
    got = quality_rules(docs_of([(1, text), (1, text), (None, text)]).withColumn("source", __import__("pyspark").sql.functions.lit(None).cast("string")), min_docs=3).collect()
    # one document, however often it is there
    assert [r.words_left for r in got] == [120, 120, 120] and all(r.kept for r in got)
    got = quality_rules(docs_of([(1, text), (2, text), (3, text), (3, text), (None, text)]), min_docs=3).collect()
    assert len(got) == 5 and all(r.words_left == 0 and not r.kept and not r.base_failed for r in got)


def host_corpus():
    """A large and a small host with shared lines; many documents consist of little else."""
    rng = random.Random(6)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(12)) for _ in range(12)]
    rows = []
    for i in range(300):
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(rng.randrange(1, 9))]
        lines = own + [rng.choice([x, x.upper(), f" {x}\t"]) for x in rng.sample(pool[: 12 if i % 3 else 4], rng.randrange(5) if i % 3 else 4)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "big" if i % 3 else "small"))
    return rows


@pytest.mark.parametrize("limits", [{"min_docs": 3, "max_share": 0.3, "most_docs": 1000}, {"min_docs": 3, "max_share": 0.9, "most_docs": 40}, {"min_docs": 10, "max_share": 0.01, "most_docs": 1000}])
def test_verdict_matches_sql(spark, limits):
    """Where the limits reject documents that the base rules don't."""
    docs = spark.createDataFrame(host_corpus(), "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = quality_rules(docs, **limits).toPandas()
    assert rows_of(got) == rows_of(con.execute(oracle(**limits)).df())
    rejected = got[~got.kept & ~got.base_failed]
    assert 10 < len(rejected) < 200


def test_a_text_of_many_lines(spark, docs_of):
    """Time grows with the lines, not with their square."""
    text = "\n".join(f"a{i} b{i} c{i} d{i}" for i in range(100_000))
    r = quality_rules(docs_of([(1, text), (2, "x")])).where("doc_id = 1").first()
    assert (r.n_words, r.n_dup_lines, r.kept) == (400_000, 0, True)
