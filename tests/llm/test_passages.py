import random

import numpy as np
import pytest

from spanforge.llm import passages as G


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_common_words_match_the_plain_program():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        assert G.common_words(a, b) == lcs(a.tolist(), b.tolist())


def test_chains_are_best():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 9)
        pos = np.sort(np.array([rng.randrange(30) for _ in range(n)]))
        other = np.array([rng.randrange(30) for _ in range(n)])
        best = 0.0
        for bits in range(1, 1 << n):
            at = [i for i in range(n) if bits >> i & 1]
            if all(pos[i] < pos[j] and other[i] < other[j] for i, j in zip(at, at[1:])):
                best = max(best, len(at) - G.GAP * (pos[at[-1]] - pos[at[0]] + other[at[-1]] - other[at[0]]))
        got = G.chain(pos, other)
        assert sorted(np.concatenate(got).tolist()) == list(range(n))
        assert abs(len(got[0]) - G.GAP * (pos[got[0][-1]] - pos[got[0][0]] + other[got[0][-1]] - other[got[0][0]]) - best) < 1e-9


def test_seeds_meet_every_shared_run():
    rng = np.random.default_rng(3)
    run = rng.integers(0, 2**63, G.K + G.WINDOW - 1).astype(np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64), run, rng.integers(0, 2**63, 40).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 2**63, rng.integers(30, 60)).astype(np.uint64), run])
        assert set(G.seeds(a)[1].tolist()) & set(G.seeds(b)[1].tolist())


def corpus():
    rng = random.Random(7)
    shared, fuzzy = words(rng, 70), words(rng, 90)
    rows, plan = [], {}
    for i in range(60):
        w = words(rng, rng.randrange(60, 200))
        if i % 4 == 1:
            at = rng.randrange(len(w))
            w[at:at] = shared
            plan[i] = (at, at + 70)
        elif i % 4 == 2:
            copy = [x for x in fuzzy]
            for k in (20, 45, 70):
                copy[k] = "changed"
            del copy[60]
            at = rng.randrange(len(w))
            w[at:at] = copy
            plan[i] = (at, at + 89)
        sep = rng.choice([" ", "\n", "  "])
        rows.append((i, sep.join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows, plan


@pytest.mark.parametrize("frequent", [20, 2])
def test_planted_passages(spark, docs_of, frequent, monkeypatch):
    monkeypatch.setattr(G, "FREQUENT", frequent)
    rows, plan = corpus()
    got = G.repeated_passages(docs_of(rows + [(None, rows[1][1])]).repartition(3)).collect()
    firsts = {min(i for i in plan if i % 4 == k) for k in (1, 2)}
    assert {r.doc_id for r in got} == set(plan) - firsts
    for i in set(plan) - firsts:
        held = {p for r in got if r.doc_id == i for p in range(r.start, r.end)}
        assert len(held ^ set(range(*plan[i]))) <= 4
    for r in got:
        assert r.other_id < r.doc_id and r.other_id % 4 == r.doc_id % 4
        assert r.n_words == r.end - r.start and 0.8 * r.n_words <= r.n_equal <= r.n_words
    kept = {r.doc_id: r.text for r in G.drop_passages(docs_of(rows)).collect()}
    for i, t in rows:
        if i in plan and i not in firsts:
            assert abs(len(kept[i].split()) - (len(t.split()) - (plan[i][1] - plan[i][0]))) <= 4
        else:
            assert kept[i] == t


def test_short_repeats_and_edges(spark, docs_of):
    rng = random.Random(1)
    short = " ".join(words(rng, 45))
    rows = [(1, short + " tail one"), (2, "head two " + short), (3, None), (4, ""), (5, " \n"), (6, "one word"), (7, "a b c d e f")]
    assert G.repeated_passages(docs_of(rows)).collect() == []
    assert G.repeated_passages(docs_of([])).collect() == []
    assert G.drop_passages(docs_of([])).collect() == []
    text = " ".join(words(rng, 80))
    rows = [(5, text), (5, text), (9, text), (None, text), (9, text)]
    assert {(r.doc_id, r.start, r.end, r.other_id) for r in G.repeated_passages(docs_of(rows)).collect()} == {(9, 0, 80, 5)}
    assert sorted(str(r.text) for r in G.drop_passages(docs_of(rows)).collect()) == sorted([text] * 3 + [""] * 2)
    out = G.drop_passages(docs_of(rows))
    assert out.columns == docs_of(rows).columns and {r.key for r in out.collect()} == {"y"}


def test_words_are_cut_with_their_space():
    assert G.without_words(b" one  two\nthree four", [(1, 3)]) == b" one  four"
    assert G.without_words(b"one two", [(0, 2)]) == b""
    assert G.without_words(b"a b c d e", [(0, 2), (1, 3), (4, 5)]) == b"d "


@pytest.mark.parametrize("first,gap,second", [(60, 50, 60), (80, 80, 80), (100, 80, 100), (200, 150, 200)])
def test_two_passages_of_one_pair(spark, docs_of, first, gap, second):
    """Shared passages with unlike text between them are each found, though they are in one chain."""
    rng = random.Random(first)
    a, b = words(rng, first), words(rng, second)
    rows = [(i, " ".join(words(rng, 30) + a + words(rng, gap) + b + words(rng, 30))) for i in (1, 2)]
    got = G.repeated_passages(docs_of(rows)).collect()
    held = {p for r in got for p in range(r.start, r.end)}
    planted = {*range(30, 30 + first), *range(30 + first + gap, 30 + first + gap + second)}
    assert planted <= held and len(held - planted) <= gap
    assert all(r.n_equal >= 0.8 * r.n_words for r in got)


def test_an_exact_copy_whose_halves_come_first(spark, docs_of):
    """No document that holds a part keeps two others with the whole from meeting."""
    rng = random.Random(4)
    p = words(rng, 60)
    around = lambda x: " ".join(words(rng, 40) + x + words(rng, 40))
    rows = [(1, around(p[:30])), (2, around(p[30:])), (3, around(p)), (4, around(p)), (5, around(p[:45])), (6, around(p[20:])), (7, around(p))]
    got = G.repeated_passages(docs_of(rows)).collect()
    held = {i: {x for r in got if r.doc_id == i for x in range(r.start, r.end)} for i in range(1, 8)}
    assert not any(held[i] for i in (1, 2, 3, 5, 6)) and set(range(40, 100)) <= held[4] and set(range(40, 100)) <= held[7]
    assert all(r.other_id < r.doc_id and 0.8 * r.n_words <= r.n_equal for r in got)


def exact_words(rows, n=50):
    """Positions in runs of n words that an earlier document has, by brute force."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = t.lower().split()
        keys = [tuple(w[a : a + n]) for a in range(len(w) - n + 1)]
        out[i] = {x for a, key in enumerate(keys) if first.get(key, i) < i for x in range(a, a + n)}
        for key in keys:
            first.setdefault(key, i)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_exact_run_is_lost(spark, docs_of, seed):
    """Documents put together from cuts of few sources, so that every run has many partial holders."""
    rng = random.Random(seed)
    sources = [words(rng, 120) for _ in range(4)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(sources)
            a = rng.randrange(90)
            w += s[a : a + rng.randrange(10, 80)] + (words(rng, rng.randrange(0, 20)) if rng.random() < 0.7 else [])
        rows.append((i, " ".join(w)))
    got = G.repeated_passages(docs_of(rows)).collect()
    for i, want in exact_words(rows).items():
        assert want <= {x for r in got if r.doc_id == i for x in range(r.start, r.end)}
    text = dict(rows)
    for r in got:
        a, b = text[r.doc_id].split()[r.start : r.end], text[r.other_id].split()[r.other_start : r.other_end]
        assert r.other_id < r.doc_id and r.n_words == len(a) >= 50 and r.n_equal >= 0.8 * max(len(a), len(b)) and r.n_equal <= lcs(a, b)


def test_open_runs_and_their_hashes():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 2**63, 90).astype(np.uint64)
    v = np.concatenate([rng.integers(0, 2**63, 17).astype(np.uint64), w])
    at = np.arange(41)
    assert (G.run_hashes(w, at, 50) == G.run_hashes(v, at + 17, 50)).all() and len(set(G.run_hashes(w, at, 50).tolist())) == 41
    late = G.seeds(w)[0].tolist()
    assert G.open_runs(w, late, [], G.K, G.WINDOW, 50)[0].tolist() == list(range(41))
    assert G.open_runs(w, late, [(0, 60)], G.K, G.WINDOW, 50)[0].tolist() == list(range(11, 41))
    assert not len(G.open_runs(w, late, [(0, 55), (52, 90)], G.K, G.WINDOW, 50)[0])
    assert not len(G.open_runs(w, late[:2], [], G.K, G.WINDOW, 50)[0]) and not len(G.open_runs(w[:49], [0], [], G.K, G.WINDOW, 50)[0])


def test_texts_of_one_id(spark, docs_of):
    """Each text has its own passages, and only those are cut out of it."""
    rng = random.Random(8)
    p, q = words(rng, 70), words(rng, 70)
    rows = [(1, " ".join(p)), (1, " ".join(q)), (2, " ".join(words(rng, 20) + p)), (2, " ".join(q + words(rng, 35)))]
    left = sorted(len(r.text.split()) for r in G.drop_passages(docs_of(rows)).collect())
    assert left == [20, 35, 70, 70]


def test_repeated_words(spark, docs_of):
    """A text that repeats itself fits an earlier one at every distance; a few rows cover it."""
    rows = [(1, "ja " * 60 + "und so weiter"), (2, "nein und ja " + "ja " * 400), (3, "auf der Mauer " * 100), (4, "x y " + "auf der Mauer " * 70)]
    got = G.repeated_passages(docs_of(rows)).collect()
    for i, want in exact_words(rows).items():
        assert want == {x for r in got if r.doc_id == i for x in range(r.start, r.end)}
    assert len(got) < 30


def test_covering_rows(spark):
    rng = random.Random(3)
    rows = [(d, 0, a, a + rng.randrange(1, 30), 0, 0) for d in range(20) for a in rng.sample(range(200), 25)]
    got = G.covering(spark.createDataFrame(rows, "doc long, key long, start long, end long, other_id long, far long")).collect()
    for d in range(20):
        words_ = lambda rs: {x for r in rs if r[0] == d for x in range(r[2], r[3])}
        assert words_(got) == words_(rows)
    assert len(got) < len(rows) and {tuple(r) for r in got} <= set(rows)


@pytest.mark.parametrize(("length", "similarity", "least"), [(60, 0.96, 0.95), (80, 0.9, 0.95), (100, 0.85, 0.9), (200, 0.85, 0.95)])
def test_passages_with_changed_words(spark, docs_of, length, similarity, least):
    """The share of fuzzy passages that is found, four fifths of each covered, in text of Zipf's law."""
    rng = np.random.default_rng(length)
    some = lambda n: [f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 50_000)]
    rows = []
    for i in range(60):
        a = some(length)
        b = list(a)
        for k in rng.choice(length, round(length * (1 - similarity)), replace=False):
            b[k] = f"changed{rng.integers(10**9)}"
        rows += [(i, " ".join(some(50) + a + some(50))), (1000 + i, " ".join(some(30) + b + some(60)))]
    got = G.repeated_passages(docs_of(rows)).collect()
    found = 0
    for i in range(60):
        held = {x for r in got if r.doc_id == 1000 + i and r.other_id == i for x in range(r.start, r.end)}
        found += len(held & set(range(30, 30 + length))) >= 0.8 * length
    assert found >= least * 60
    assert all(r.n_equal >= 0.8 * r.n_words for r in got)


def test_no_partner_of_a_fuzzy_passage_is_lost(spark, docs_of):
    """Documents that hold short parts of a passage, before and between, don't keep two fuzzy copies of it from meeting."""
    rng = random.Random(12)
    p = words(rng, 100)
    copy = [f"changed{i}" if i % 12 == 6 else x for i, x in enumerate(p)]
    around = lambda x: " ".join(words(rng, 40) + x + words(rng, 40))
    parts = [p[a : a + 11] for a in range(7, 95, 12)]
    rows = [(i, around(x)) for i, x in enumerate(parts)] + [(50, around(p))] + [(60 + i, around(x)) for i, x in enumerate(parts)] + [(90, around(copy)), (91, around(parts[0]))]
    got = G.repeated_passages(docs_of(rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(90, 50)}
    assert len({x for r in got for x in range(r.start, r.end)} & set(range(40, 140))) >= 90
    kept = {r.doc_id: r.text for r in G.drop_passages(docs_of(rows)).collect()}
    assert len(kept[90].split()) <= 90 and all(kept[i] == t for i, t in rows if i != 90)


def test_links_of_seeds():
    rng = np.random.default_rng(9)
    w = rng.integers(0, 2**63, 200).astype(np.uint64)
    at, h = G.seeds(w)
    p, q, one, two, link = G.open_links(w, at.tolist(), [(0, 100)], G.K, G.WINDOW, 20)
    assert set(zip(p.tolist(), q.tolist())) == {(a, b) for a in at.tolist() for b in at.tolist() if 20 <= b - a <= G.REACH and b + G.K > 100}
    assert dict(zip(at.tolist(), h.tolist())).items() >= dict(zip(p.tolist(), one.tolist())).items() and (link == G.link_hashes(one, two)).all()
    assert len(G.turning(np.full(500, 7, np.uint64), G.K, G.WINDOW)[0]) == 2
    v = np.concatenate([w[:50], np.tile(w[:30], 60), w[50:100]])
    at = np.arange(50, 50 + 1800, 30)
    assert 1 < len(G.unlike_places(v, G.K, at, at + 20, np.full(60, 5, np.uint64))) < 15


def unseeded_ends(seed):
    """Two texts of a fuzzy passage: in common are two runs of 12 words, side by side in the first and eight words apart in the second, and about them runs of five words none of which has a seed; and the two runs."""
    rng = random.Random(seed)
    while True:
        one, two, left, right = words(rng, 12), words(rng, 12), words(rng, 42), words(rng, 42)
        other = lambda x: [f"x{rng.randrange(10**9)}" if i % 6 == 5 else w for i, w in enumerate(x)]
        a, b = left + one + two + right, other(left) + one + words(rng, 8) + two + other(right)
        (p, h), (q, g) = (G.seeds(G.word_hashes(" ".join(x).encode())) for x in (a, b))
        at, to = p[np.isin(h, g)], q[np.isin(g, h)]
        if 42 <= at[0] and at[-1] <= 61 and at[-1] - at[0] < 20 <= to[-1] - to[0]:
            return a, b, one, two


@pytest.mark.parametrize("seed", [1, 2])
def test_partners_whose_seeds_lie_nearer(spark, docs_of, seed):
    """What the first step finds in a pair alone, the third one finds among documents that hold parts of it, though the words between the seeds are fewer there."""
    a, b, one, two = unseeded_ends(seed)
    rng = random.Random(seed + 100)
    around = lambda x: " ".join(words(rng, 40) + x + words(rng, 40))
    pair = [(50, around(a)), (90, around(b))]
    parts = [(i, around(x)) for i, x in ((1, one), (2, two), (60, one), (61, two))]
    for rows in (pair, pair + parts):
        got = G.repeated_passages(docs_of(rows)).collect()
        assert {(r.doc_id, r.other_id) for r in got} == {(90, 50)}
        assert len({x for r in got for x in range(r.start, r.end)} & set(range(40, 40 + len(b)))) >= 0.9 * len(b)


def test_fewest_rows_cover_the_same_words():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(a, a + rng.randrange(1, 30), 1, rng.randrange(9), 0, 5) for a in rng.choices(range(100), k=rng.randrange(1, 25))]
        got = G.fewest(rows)
        cover = lambda rs: {x for r in rs for x in range(r[0], r[1])}
        assert cover(got) == cover(rows) and set(got) <= set(rows)
        assert all(cover(got[:i] + got[i + 1 :]) != cover(got) for i in range(len(got)))


def test_others_with_equal_words_are_given_once():
    """A passage is given with the first of several equal texts, and with each one that differs."""
    doc = np.arange(1, 61, dtype=np.uint32)
    unlike = np.where(np.arange(60) == 30, 999, doc).astype(np.uint32)
    chains = [{"other": i, "at": [0, 20, 50], "to": [0, 20, 50]} for i in (7, 5, 6, 8)]
    texts = {5: doc, 6: doc, 7: doc, 8: unlike}
    pieces = [{"chain": n, "key": c["other"], "block": 0, "words": texts[c["other"]].tobytes()} for n, c in enumerate(chains)]
    assert G.passages_of(doc, chains, pieces, G.K, 50, 0.8) == [(0, 60, 5, 0, 60, 60), (0, 60, 8, 0, 60, 59)]
    short = [{**c, "at": [0, 20], "to": [0, 20]} for c in chains]
    assert [r[2] for r in G.passages_of(doc[:40], short, [{**x, "words": x["words"][:160]} for x in pieces], G.K, 40, 0.8)] == [5, 8]


def test_places_where_no_passage_can_be():
    """hopeful against a plain search of the windows; straight chains by equal words, the others by words that occur at all."""
    rng = np.random.default_rng(11)
    met = set()
    for _ in range(60):
        words, others = rng.integers(0, 14, rng.integers(1, 90)).astype(np.uint32), rng.integers(0, 16, 200).astype(np.uint32)
        at = [np.sort(rng.integers(0, n + 1, (12, 2))).T for n in (200, len(words))]
        (first, last), (start, end) = at
        zero = np.where((np.arange(12) % 2 == 0) & (first + end - start <= 200), first - start, G.BENT)
        got = G.hopeful(words, others, first, last, start, end, zero, 10, 0.8)
        for i in range(12):
            w = words[start[i] : end[i]]
            same = np.isin(w, others[first[i] : last[i]]) if zero[i] == G.BENT else w == others[first[i] : first[i] + len(w)]
            assert got[i] == any(same[a:b].sum() >= 0.8 * (b - a) for a in range(len(w)) for b in range(a + 10, len(w) + 1))
            met.add((bool(zero[i] == G.BENT), bool(got[i])))
    assert len(met) >= 3


def test_chains_without_a_passage_are_not_aligned():
    """Of many documents that share two short runs, at other distances, none is aligned; the passages of the rest are those of all chains."""
    rng = np.random.default_rng(12)
    doc = rng.integers(0, 1 << 31, 300).astype(np.uint32)
    chains, texts = [], {}
    for n in range(40):
        other = rng.integers(0, 1 << 31, 200).astype(np.uint32)
        other[50:55], other[70 + n % 3 : 75 + n % 3] = doc[100:105], doc[121:126]
        chains.append({"other": 1 + n, "at": [100, 121], "to": [50, 70 + n % 3]})
        if n % 10 == 0:  # a fuzzy copy with two words more
            other[40:71], other[73:110] = doc[90:121], doc[121:158]
            chains[-1]["to"][1] = 73
        texts[1 + n] = other
    numbers = [range((c["to"][0] - G.MARGIN if c["to"][0] > G.MARGIN else 0) // G.BLOCK, (c["to"][1] + G.K + G.MARGIN) // G.BLOCK + 1) for c in chains]
    held = [(c["other"], 7, x, texts[c["other"]][x * G.BLOCK : (x + 1) * G.BLOCK]) for c, own in zip(chains, numbers) for x in own if x * G.BLOCK < 200]
    pieces = [{"chain": n, "key": 7, "block": x, "words": texts[c["other"]][x * G.BLOCK : (x + 1) * G.BLOCK].tobytes()} for n, (c, own) in enumerate(zip(chains, numbers)) for x in own if x * G.BLOCK < 200]
    flat = lambda name: np.array([x for c in chains for x in c[name]], np.int32)
    given = tuple(np.array(x) for x in zip(*(h[:3] for h in held))), lambda i: held[i][3]
    tries = list(G.tries_of(doc, np.array([c["other"] for c in chains]), np.arange(0, 81, 2), flat("at"), flat("to"), given, G.K, 50, 0.8))
    assert [t[0] for t in tries] == [1, 11, 21, 31]
    got = G.best_passages(doc, tries, G.K, 50, 0.8)
    assert got == G.passages_of(doc, chains, pieces, G.K, 50, 0.8) and [r[2] for r in got] == [1, 11, 21]  # 31 has the words of 1


def test_blocks_are_asked_for_once(spark):
    """Two chains of a document with the same other one ask for the blocks they have in common once."""
    rows = [(9, 1, p, t) for p, t in ((0, 100), (20, 120), (30, 130), (300, 101), (320, 121), (330, 131))]
    found = spark.createDataFrame(rows, "doc long, other long, pos int, to int")
    (got,) = G.chained(found, G.K, G.WINDOW, 50, every=True).collect()
    assert [(c.other, c.at, c.to) for c in got.chains] == [(1, [0, 20, 30], [100, 120, 130]), (1, [300, 320, 330], [101, 121, 131])]
    assert [(a.other, a.block) for a in got.asked] == [(1, 0), (1, 1), (1, 2)]
