"""Range primitives and folds against plain loops over small random timelines."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import cluster, decisions, dialogue, ranges, snap, support, timeline
from spanforge.schema import DECISION


def rows_of(seed, n=40, media=3, whole=True):
    rng = random.Random(seed)
    step = (lambda x: float(rng.randrange(x))) if whole else (lambda x: rng.random() * x)
    out = []
    for m in range(media):
        for i in range(rng.randrange(1, n)):
            a = step(300)
            out.append(
                (m, i, a, a + step(25), rng.choice(["mute", "cut", "keep"]), rng.choice(["sex", "drugs", "sex+drugs"]), rng.choice(["", "a", "ab", "weak: a", "; c;"]), "t%d" % i, "", rng.choice(["vlm", "visual", "visual-shot", "subtitle", "audio+vlm", "manual"]), rng.random() < 0.7)
            )
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, DECISION)


def by_media(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def loop_merge(rows, gap):
    rank = ["keep", "mute", "cut"]
    out = []
    for m, own in by_media(rows).items():
        cur = None
        done = []
        for r in sorted(own, key=lambda r: (r[2], r[1])):
            if cur and r[2] <= cur[3] + gap:
                cur[3] = max(cur[3], r[3])
                cur[4] = max(cur[4], r[4], key=rank.index)
                for k, sep in ((5, "+"), (9, "+")):
                    if r[k] not in cur[k]:
                        cur[k] += sep + r[k]
                if r[6] not in cur[6]:
                    cur[6] = (cur[6] + "; " + r[6]).strip("; ")
            else:
                cur = list(r)
                done.append(cur)
        out += [(m, i, *c[2:]) for i, c in enumerate(done)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "gap"), [(1, 0.0), (2, 5.0), (3, 0.5), (4, 60.0)])
def test_merge(spark, seed, gap):
    rows = rows_of(seed)
    got = sorted(tuple(r) for r in decisions.merge_overlapping(table(spark, rows), gap).collect())
    assert got == loop_merge(rows, gap)


def test_merge_takes_the_first_rows_acceptance_and_swallows_substrings(spark):
    rows = [(1, 0, 1.0, 3.0, "mute", "sex", "r", "b", "a", "visual-shot", False), (1, 1, 2.0, 4.0, "cut", "sex", "r", "x", "y", "visual", True)]
    r = decisions.merge_overlapping(table(spark, rows)).collect()
    assert [(x.action, x.source, x.accepted, x.text_before, x.end) for x in r] == [("cut", "visual-shot", False, "b", 4.0)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_range_exists(spark, seed, strict):
    probe, build = rows_of(seed), rows_of(seed + 10, n=8, media=2)
    got = {(r.media_id, r.seq): r.near for r in ranges.range_exists(table(spark, probe), table(spark, build), 3.0, strict).collect()}
    for p in probe:
        near = any(b[0] == p[0] and ((b[2] - 3 < p[3] and b[3] + 3 > p[2]) if strict else (b[2] - 3 <= p[3] and b[3] + 3 >= p[2])) for b in build)
        assert got[p[0], p[1]] == near


def test_stab_is_half_open(spark):
    shots = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 25.0), (1, 2, 30.0, 40.0)], "media_id long, shot_idx int, start double, end double")
    points = spark.createDataFrame([(1, float(t)) for t in (0, 9, 10, 25, 29, 30, 40)] + [(2, 5.0)], "media_id long, t double")
    got = {(r.media_id, r.t): r.hit.shot_idx if r.hit else None for r in ranges.stab(points, "t", shots).collect()}
    assert got == {(1, 0.0): 0, (1, 9.0): 0, (1, 10.0): 1, (1, 25.0): None, (1, 29.0): None, (1, 30.0): 2, (1, 40.0): None, (2, 5.0): None}


def test_no_nested_loops(spark):
    edl = table(spark, rows_of(1))
    for df in (support.mark_unsupported(edl), dialogue.context_gate(edl), decisions.merge_overlapping(edl)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_keep_segments_and_shift(spark, seed):
    rows = [r for r in rows_of(seed, n=12) if r[4] == "cut"] or rows_of(9)
    cuts = table(spark, rows).select("media_id", "start", "end")
    media = spark.createDataFrame([(m, 200.0) for m in range(4)], "media_id long, duration double")
    got = sorted(tuple(r) for r in timeline.keep_segments(media, cuts).collect())
    want, merged = [], {}
    for m in range(4):
        cursor = 0.0
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[2])
        for r in own:
            s, e = max(r[2], 0.0), min(r[3], 200.0)
            if e > cursor:
                if s > cursor:
                    want.append((m, cursor, s))
                cursor = e
            if merged.get(m) and r[2] <= merged[m][-1][1]:
                merged[m][-1][1] = max(merged[m][-1][1], r[3])
            else:
                merged.setdefault(m, []).append([r[2], r[3]])
        if cursor < 200.0:
            want.append((m, cursor, 200.0))
    assert got == sorted(w for w in want if w[2] - w[1] > 0.001)
    points = spark.createDataFrame([(m, float(t)) for m in range(4) for t in range(0, 330, 3)], "media_id long, t double")
    for r in timeline.shift(points, "t", cuts, "to").collect():
        out = r.t
        for a, b in merged.get(r.media_id, []):
            if a > r.t:
                break
            out = None if r.t <= b else out - (b - a)
            if out is None:
                break
        assert r.to == (None if out is None else pytest.approx(max(0.0, out)))


def test_shifted_ranges_and_cues(spark):
    cuts = spark.createDataFrame([(1, 10.0, 20.0), (1, 40.0, 50.0)], "media_id long, start double, end double")
    rows = [(1, 0, 15.0, 30.0), (1, 1, 30.0, 45.0), (1, 2, 12.0, 18.0), (1, 3, 60.0, 70.0), (1, 4, 5.0, 60.0)]
    mutes = spark.createDataFrame(rows, "media_id long, seq long, start double, end double")
    got = {r.seq: (r.start, round(r.end, 3)) for r in timeline.shift_ranges(mutes, cuts).collect()}
    assert got == {0: (0.0, 20.0), 1: (20.0, 30.0), 3: (40.0, 50.0), 4: (5.0, 40.0)}
    cues = mutes.select("media_id", F.col("seq").cast("int").alias("idx"), "start", "end", F.lit("x").alias("text"))
    got = [(r.idx, round(r.start, 3), round(r.end, 3)) for r in sorted(timeline.shift_subtitles(cues, cuts).collect(), key=lambda r: r.idx)]
    assert got == [(1, 10.0, 20.0), (2, 20.0, 30.0), (3, 40.0, 50.0), (4, 5.0, 40.0)]
    other = cues.withColumn("media_id", F.lit(2).cast("long"))
    assert sorted(r.idx for r in timeline.shift_subtitles(other, cuts).collect()) == [0, 1, 2, 3, 4]


def loop_clusters(events, window, least, span):
    out, i, n = [], 0, len(events)
    while i < n:
        j = i
        while j + 1 < n and events[j + 1][0] <= events[i][0] + window:
            j += 1
        if j - i + 1 < least:
            i += 1
            continue
        k = j
        while k + 1 < n and sum(e[0] >= max(events[i][0], events[k + 1][0] - window) for e in events[i : k + 2]) >= least:
            k += 1
        end = max(e[1] for e in events[i : k + 1])
        if end - events[i][0] >= span:
            out.append((max(0.0, events[i][0] - 1), end + 1, k - i + 1))
        i = k + 1
    return out


@pytest.mark.parametrize(("seed", "window", "least"), [(1, 20.0, 3), (2, 10.0, 2), (3, 30.5, 4), (4, 60.0, 3), (5, 5.0, 1)])
def test_density(spark, seed, window, least):
    rng = random.Random(seed)
    rows = [(m, i, float(rng.randrange(200)), 0.0, "mute", "sex", "r", "", "", "subtitle", True) for m in range(4) for i in range(rng.randrange(30))]
    rows = [(*r[:3], r[2] + rng.randrange(9), *r[4:]) for r in rows]
    got = sorted((r.media_id, r.start, r.end, r.n) for r in cluster.density_clusters(table(spark, rows), window, least, 4.0).collect())
    want = []
    for m in range(4):
        own = sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1]))
        want += [(m, *c) for c in loop_clusters([(r[2], r[3]) for r in own], window, least, 4.0)]
    assert got == sorted(want)


def test_density_looks_at_dialogue_only(spark):
    base = [(1, i, 10.0 * i, 10.0 * i + 1, "mute", "sex", "", "", "", s, a) for i, (s, a) in enumerate([("subtitle", True), ("vlm", True), ("audio", True), ("subtitle+vlm", True), ("subtitle", False)])]
    r = cluster.density_clusters(table(spark, base)).collect()
    assert [(x.start, x.end, x.n, x.reason) for x in r] == [(0.0, 32.0, 3, "density: 3 events in 31.0s window")]


@pytest.mark.parametrize("seed", range(3))
def test_chunks(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(60):
        t += rng.choice([1, 2, 9])
        rows.append((1, i, t, t + rng.choice([0.5, 3.0]), f"c{i}"))
    got = [(r.start, r.end, len(r.lines)) for r in sorted(dialogue.chunk_lines(spark.createDataFrame(rows, "media_id long, idx int, start double, end double, text string"), 6.0, 20.0).collect(), key=lambda r: r.chunk)]
    want, cur = [], []
    for r in rows:
        if cur and (r[2] - cur[-1][3] > 6 or r[3] - cur[0][2] > 20):
            want.append(cur)
            cur = []
        cur.append(r)
    want.append(cur)
    assert got == [(c[0][2], c[-1][3], len(c)) for c in want if len(c) >= 2]


def test_snap(spark):
    shots = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 25.0)], "media_id long, shot_idx int, start double, end double")
    row = lambda i, a, b, act, m=1: (m, i, a, b, act, "sex", "r", "", "", "vlm", True)
    rows = [row(0, 3.0, 10.0, "cut"), row(1, 3.0, 12.0, "cut"), row(2, 3.0, 12.0, "mute"), row(3, 20.0, 40.0, "cut"), row(4, 3.0, 12.0, "cut", 2)]
    got = {(r.media_id, r.seq): (r.start, r.end, r.reason) for r in snap.snap(table(spark, rows), shots).collect()}
    s = "r | snapped-to-shot"
    assert got == {(1, 0): (0.0, 10.0, s), (1, 1): (0.0, 25.0, s), (1, 2): (3.0, 12.0, "r"), (1, 3): (10.0, 40.0, s), (2, 4): (3.0, 12.0, "r")}


def test_corroboration(spark):
    row = lambda i, a, b, source, ok=True: (1, i, a, b, "cut", "sex", "r", "", "", source, ok)
    rows = [row(0, 100.0, 105.0, "vlm"), row(1, 108.0, 109.0, "subtitle"), row(2, 300.0, 305.0, "vlm+visual"), row(3, 306.0, 307.0, "subtitle", False), row(4, 500.0, 501.0, "vlm+audio")]
    got = {r.seq: (r.accepted, r.reason) for r in support.mark_unsupported(table(spark, rows)).collect()}
    assert got[0] == (True, "r") and got[4] == (True, "r") and got[3][0] is False
    assert got[2] == (False, "[solo-visual; needs corroboration] r")
