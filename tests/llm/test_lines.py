import hashlib
import random
from collections import defaultdict

from spanforge.llm.lines import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def slow(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    bad = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if bad.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_brute_force(spark, docs_of):
    rng = random.Random(1)
    pool = ["A line that is frequent here ", "  a LINE that is frequent here \t", "short", "", "é" * 19, "É" * 20, "é" * 20, "x" * 20, "\r", "another long line of the pool", "$1 \\n % back\\slash lines too"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line number {i} {j} of this" for j in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "A line that is frequent here \n" * 500)]
    assert got(dedup_lines(docs_of(rows).repartition(3))) == slow(rows)


def test_hot_keys_take_the_broadcast_way(spark, docs_of, monkeypatch):
    import spanforge.llm.lines as L
    from spanforge.llm.common import skew_join

    monkeypatch.setattr(L, "skew_join", lambda a, b, k, w: skew_join(a, b, k, w, most_hot=4, least=5))
    rows = [(i, f"the hottest of the lines, in all\nline in some of them: {i % 9} yes\nown {i}") for i in range(50)]
    assert got(dedup_lines(docs_of(rows))) == slow(rows)


def test_edges(spark, docs_of):
    assert dedup_lines(docs_of([])).collect() == []
    line = "a line of twenty and more"
    rows = [(1, line), (1, line), (2, line), (None, line)]
    out = [(r.doc_id, r.text) for r in dedup_lines(docs_of(rows)).collect()]
    assert sorted(out, key=str) == sorted([(1, line), (1, line), (2, line), (None, line)], key=str)
    out = dedup_lines(docs_of([*rows, (3, line)])).collect()
    assert [(r.doc_id, r.text) for r in out if r.text] == [(3, line)] and len(out) == 5
    assert {r.lang for r in out} == {"en"} and {r.key for r in out} == {"y"}


def test_digest_of_utf8(spark, docs_of):
    from pyspark.sql import functions as F

    r = dedup_lines(docs_of([(1, "dé\n\U0001f600")])).select(F.sha2("text", 256).alias("d")).first()
    assert r.d == hashlib.sha256("dé\n\U0001f600".encode()).hexdigest()
