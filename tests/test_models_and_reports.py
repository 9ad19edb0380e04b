import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import lexicon as L
from spanforge.operators import dialogue, frames, producers, ranges, report, timeline, verdicts
from spanforge.plans import build
from spanforge.schema import DECISION, DECISION_COLUMNS
from spanforge.settings import PRESETS, Settings
from spanforge.sources import media as M

ANSWERS = "media_id long, start double, end double, raw string"


def answers(spark, *raws):
    return spark.createDataFrame([(1, i * 10.0, i * 10.0 + 5, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], ANSWERS)


def test_dialogue_verdicts(spark):
    yes = {"should_cut": True, "confidence": 0.9}
    rows = answers(spark, {**yes, "category": "sex", "reasoning": "r" * 300}, {**yes, "category": None}, yes, {**yes, "category": "profanity"}, {**yes, "category": "drugs", "confidence": 0.1}, {"category": "sex"}, "no")
    got = verdicts.dialogue_verdicts(rows, "llama3.1:8b").orderBy("start").collect()
    assert [(r.start, r.end, r.category) for r in got] == [(0.0, 6.0, "sex"), (19.0, 26.0, "multi")]
    assert got[0].reason == "LLM (llama3.1:8b): " + "r" * 160 and got[1].reason == "LLM (llama3.1:8b): "
    assert got[0].asDict().keys() == set(DECISION_COLUMNS) and {(r.action, r.source, r.accepted) for r in got} == {("cut", "llm-dialogue", True)} and [r.seq for r in got] == [0, 1]


def test_vision_verdicts(spark):
    rows = answers(spark, {"explicit": True, "confidence": 0.9, "description": "d" * 200}, {"intimate": True, "confidence": 0.9}, {"violence": True, "drug_use": True, "confidence": "0.8"}, {"explicit": True, "confidence": 0.4}, {"explicit": "true", "confidence": 1}, "x")
    got = verdicts.vision_verdicts(rows, "v").orderBy("start").collect()
    assert [(r.start, r.end, r.category, r.reason) for r in got] == [(0.0, 5.0, "nudity", "VLM (v) nudity: " + "d" * 160), (20.0, 25.0, "drugs+violence", "VLM (v) drugs,violence: ")]
    both = verdicts.vision_verdicts(rows, "v", ("intimate", "explicit", "drug_use", "violence"))
    assert [r.category for r in both.orderBy("start").collect()] == ["nudity", "sex", "drugs+violence"]
    assert both.columns == DECISION_COLUMNS


def test_frame_decisions(spark):
    hits = spark.createDataFrame([(1, float(i), h, ["B", "A"] if h else []) for i, h in enumerate([True, True, True, False])], "media_id long, t double, hit boolean, classes array<string>")
    row = frames.streak_decisions(frames.streaks(hits, 1.0), "cut").first()
    assert (row.reason, row.source, row.category) == ("visual streak (3 frames): A, B", "visual", "nudity")
    shots = spark.createDataFrame([(1, 0, 0.0, 4.0)], "media_id long, shot_idx int, start double, end double")
    row = frames.shot_decisions(frames.shot_hits(shots, hits, 1.0), "cut").first()
    assert (row.reason, row.source) == ("shot 3/4 frames flagged: A, B", "visual-shot")


def test_producers(spark):
    rows = spark.createDataFrame([(m, float(i), f"{m}-{i}") for m in (1, 2) for i in range(6)], "media_id long, start double, what string")

    def load():
        last = {}

        def ask(row):
            assert last.get(row["media_id"], -1.0) < row["start"]
            last[row["media_id"]] = row["start"]
            if row["what"] == "1-2":
                return None
            return producers.SKIP if row["what"] == "1-3" else '{"said": "' + row["what"] + '"}'

        return ask

    got = producers.answered(rows, load)
    assert got.columns == ["media_id", "start", "what", "raw"]
    assert sorted(r.raw for r in got.collect()) == sorted('{"said": "%d-%d"}' % (m, i) for m in (1, 2) for i in range(6) if (m, i) not in ((1, 2), (1, 3)))
    many = producers.produced(rows, lambda: lambda row: [{"n": row["start"], "k": k} for k in range(2)], "n double, k int")
    assert many.count() == 24 and many.columns == ["media_id", "n", "k"]
    down = lambda: lambda row: None
    with pytest.raises(Exception, match="5 failures in a row"):
        producers.answered(rows, down).collect()
    assert producers.answered(rows.where("start < 2 and media_id = 1"), down).collect() == []
    # what is skipped doesn't end a row of failures, an answer does
    turns = lambda good: lambda: lambda row: good if row["start"] == 3 else None
    one = rows.where("media_id = 1")
    assert producers.answered(one, turns("x")).count() == 1
    with pytest.raises(Exception, match="5 failures in a row"):
        producers.answered(one, turns(producers.SKIP)).collect()


def test_a_detector_may_fail_but_not_the_setup(spark, monkeypatch):
    like = spark.createDataFrame([(1, 0, 0.0, 1.0, "cut", "sex", "", "", "", "vlm", True)], DECISION)

    def broken():
        raise ValueError("down")

    assert build.or_nothing(lambda: like, like, "a").count() == 1
    assert build.or_nothing(broken, like, "b").count() == 0
    bad = lambda: like.withColumn("start", F.raise_error(F.lit("at run time")).cast("double"))
    assert build.or_nothing(bad, like, "c").count() == 0

    def unset(_):
        raise RuntimeError("spark.checkpoint.dir")

    monkeypatch.setattr(build, "checkpoint_folder", unset)
    with pytest.raises(RuntimeError, match="checkpoint"):
        build.or_nothing(lambda: like, like, "d")


def test_what_is_asked_for_must_be_there(spark):
    kind = "media_id long, idx int, start double, end double, text string"
    some = lambda *ids: spark.createDataFrame([(i, 1, 0.0, 1.0, t) for i, t in ids], kind)
    sources = [some((1, "e")), some((1, "s"), (2, "s")), some((3, "m")), some((1, "t"), (2, "t"), (3, "t"), (4, "t"))]
    asked = lambda *ids: spark.createDataFrame([(i,) for i in ids], "media_id long")
    want = {(1, "e"), (2, "s"), (3, "m"), (4, "t")}
    assert {(r.media_id, r.text) for r in M.resolve_cues(*sources).collect()} == want
    assert {(r.media_id, r.text) for r in M.resolve_cues(*sources, asked=asked(1)).collect()} == want
    with pytest.raises(Exception, match="isn't there: item 2"):
        M.resolve_cues(*sources, asked=asked(1, 2)).collect()


def test_probes(spark):
    raw = {"streams": [{"index": 0, "codec_name": "h264", "codec_type": "video", "more": [1]}, {"index": 2, "codec_name": "aac", "codec_type": "audio", "channels": 6, "tags": {"language": "eng", "title": "Main"}}, {}], "format": {"duration": "12.50"}}
    df = spark.createDataFrame([(1, json.dumps(raw)), (2, "{}"), (3, "not json")], "media_id long, raw string")
    got = [tuple(r) for r in M.probed_streams(df).orderBy(F.desc("index")).collect()]
    assert got == [(1, 2, "aac", "audio", "eng", "Main", 6), (1, 0, "h264", "video", "und", "", None), (1, -1, "", "", "und", "", None)]
    assert [r.duration for r in M.probed_durations(df.where("media_id = 1")).collect()] == [12.5]
    with pytest.raises(Exception, match="no duration of item 2"):
        M.probed_durations(df.where("media_id = 2")).collect()


def spans(spark, rng, n, kind="start double, end double"):
    made = [(rng.randrange(3), *(lambda a, b: (float(a), float(b)))(*(lambda a: (a, a + rng.randrange(12)))(rng.randrange(60)))) for _ in range(n)]
    return spark.createDataFrame(made, f"media_id long, {kind}"), made


@pytest.mark.parametrize("seed", range(4))
def test_first_holding_and_overlaps(spark, seed):
    rng = random.Random(seed)
    cuts, rows = spans(spark, rng, 25)
    points = spark.createDataFrame([(m, i, i / 2) for m in range(4) for i in range(150)], "media_id long, k int, t double")
    got = {(r.media_id, r.k): (r.hit.start, r.hit.end) if r.hit else None for r in ranges.first_holding(points, "t", cuts).collect()}
    for m in range(4):
        for i in range(150):
            assert got[m, i] == min(((a, b) for x, a, b in rows if x == m and a <= i / 2 <= b), default=None)
    left, others = spans(spark, rng, 25, "a double, b double")
    met = sorted((r.media_id, r.a, r.b, r.start, r.end) for r in ranges.overlaps(left, cuts, "a", "b", 7.0).collect())
    assert met == sorted((m, a, b, c, d) for m, a, b in others for x, c, d in rows if x == m and c < b and d > a)


def test_review_context_takes_the_first(spark):
    edl = spark.createDataFrame([(1, 0, 10.0, 500.0, "cut", "sex", "", "", "", "vlm", True)], DECISION)
    cues = spark.createDataFrame([(1, i, i * 20.0, i * 20.0 + 19, f"c{i}") for i in range(40)], "media_id long, idx int, start double, end double, text string")
    assert [(r.place, r.idx) for r in dialogue.review_context(edl, cues).orderBy("place").collect()] == [(i + 1, i) for i in range(10)]


def test_report_and_phrases(spark):
    row = lambda seq, start, reason, before="", after="", action="mute", ok=True: (1, seq, start, start + 2, action, "sex+drugs", reason, before, after, "subtitle", ok)
    rows = [row(0, 1.0, "matched: zebra, ape", "a\nzebra", "a horse"), row(1, 5.0, "matched: ape", "ape", "ape"), row(2, 9.0, "matched: zebra", "x"), row(3, 70.0, "by hand", action="cut"), row(4, 80.0, "no", ok=False)]
    edl = spark.createDataFrame(rows, DECISION)
    media = spark.createDataFrame([(1, 100.0, "/m/1"), (2, None, "/m/2")], "media_id long, duration double, video_path string")
    # as often as each other: the one named first comes first
    assert [(r.phrase, r.n) for r in report.top_phrases(edl).orderBy("place").collect()] == [("zebra", 2), ("ape", 2)]
    lines = [(r.media_id, r.text) for r in report.report_lines(edl, media).orderBy("media_id", "part", "line").collect()]
    assert [t for m, t in lines if m == 2] == ["Source: /m/2", "Nothing is flagged."]
    text = "\n".join(t for m, t in lines if m == 1)
    for part in ("Decisions: 4", "Mutes:     3  (6.0s of audio)", "after cuts 1m 38.0s  (2.0% removed)", "sex            4  (8.0s)", "   2  zebra", "[  1] 0:01.00 - 0:03.00  MUTE  sex\nbefore: a zebra\nafter:  a horse\n[  2]", "CUT   sex\nreason: by hand"):
        assert part in text
    assert "rejected" not in text and text.count("after: ") == 1


def test_review_context_shuffles_either_side_once(spark):
    rng = random.Random(5)
    some = lambda n: [(m, i, a, a + rng.choice([0.0, 1.0, 30.0, 4000.0])) for m in (1, 2) for i in range(n) for a in [float(rng.randint(0, 9000))]]
    left, right = some(20), some(200)
    edl = spark.createDataFrame(left, "media_id long, seq long, start double, end double")
    cues = spark.createDataFrame([(*r, f"t{r[1]}") for r in right], "media_id long, idx int, start double, end double, text string")
    want = [(m, i, k + 1, x) for m, i, a, b in left for k, x in enumerate(sorted(j for n, j, s, e in right if n == m and s < b and e > a)[:10])]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = dialogue.review_context(edl, cues)
        assert sorted((r.media_id, r.seq, r.place, r.idx) for r in df.collect()) == want
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2 and "sequence(" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_seconds_are_added_in_order(spark):
    spans = [1.5, 11.8, 9.1, 28.2, 9.4]  # 59.99999999999999 in this order, 60.0 in the other
    rows = [(1, i, 0.0, x, "cut", "sex", "", "", "", "manual", True) for i, x in enumerate(spans)]
    edl = spark.createDataFrame(rows[::-1], DECISION).coalesce(1)
    media = spark.createDataFrame([(1, 100.0, "/m/1")], "media_id long, duration double, video_path string")
    assert report.totals(edl, media).first().t_cut == report.by_category(edl).first().seconds == 59.99999999999999
    assert "Cuts:      5  (60.0s of video)" in [r.text for r in report.report_lines(edl, media).collect()]


def test_plan(spark):
    media = spark.createDataFrame([(i, f"/m/{i}") for i in range(1, 6)], "media_id long, video_path string")
    files = spark.createDataFrame([(2, "film", "film.en", False, 0)], "media_id long, stem string, name string, in_subs boolean, pos long")
    kind = "media_id long, index int, codec_name string, codec_type string, language string"
    streams = spark.createDataFrame([(3, 2, "subrip", "subtitle", "eng"), (4, 1, "aac", "audio", "eng"), (4, 2, "dvd_subtitle", "subtitle", "eng"), (1, 1, "aac", "audio", "eng")], kind)
    explicit = spark.createDataFrame([(1, "/own.srt")], "media_id long, path string")
    plan = lambda **k: {r.media_id: r.text for r in report.plan_lines(media, files, streams, Settings(), L.lexicon(L.DEFAULT), explicit, **k).where("part = 0 and line = 1").collect()}
    assert plan() == {1: "Cues: the file asked for, /own.srt", 2: "Cues: sidecar film.en", 3: "Cues: embedded stream 2 (subrip, eng)", 4: "Cues: 1 picture subtitle(s) skipped; transcription of stream 1 (aac, eng) by large-v3 with word times", 5: "Cues: none, and no audio to transcribe"}
    assert plan(transcribe=False)[5] == "Cues: none, and transcription is off"


def test_commands(spark):
    media = spark.createDataFrame([(i, 10.0, f"/m/{i}", f"/o/{i}") for i in (1, 2)], "media_id long, duration double, video_path string, output_path string")
    cuts = spark.createDataFrame([(1, 2.0, 4.0)], "media_id long, start double, end double")
    run = lambda cuts, *a: {r.media_id: r.arguments for r in timeline.cut_commands(media, timeline.keep_segments(media, cuts), cuts, *a).collect()}
    got = run(cuts, "videotoolbox", 23)
    assert got[2] == ["-y", "-i", "/m/2", "-c", "copy", "/o/2"]
    assert got[1][:4] == ["-y", "-i", "/m/1", "-filter_complex"] and "-q:v 44" in " ".join(got[1]) and got[1][-1] == "/o/1"
    assert "-crf 20" in " ".join(run(cuts)[1])
    with pytest.raises(Exception, match="nothing is left of item 1"):
        run(spark.createDataFrame([(1, 0.0, 10.0)], "media_id long, start double, end double"))


def test_render_plan(spark):
    edl = spark.createDataFrame([(1, 0, 2.0, 4.0, "cut", "sex", "", "", "", "vlm", True), (1, 1, 6.0, 7.0, "mute", "profanity", "", "", "", "subtitle", True)], DECISION)
    media = spark.createDataFrame([(1, 10.0)], "media_id long, duration double")
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, "Damn"), (1, 2, 6.0, 8.0, "fine")], "media_id long, idx int, start double, end double, text string")
    plan = timeline.render_plan(edl, cues, media, L.SOFTER)
    assert [(r.start, r.end) for r in plan["segments"].orderBy("start").collect()] == [(0.0, 2.0), (4.0, 10.0)]
    assert [(r.start, r.end) for r in plan["mutes"].collect()] == [(4.0, 5.0)]
    assert [(r.start, r.text) for r in plan["subtitles"].orderBy("idx").collect()] == [(0.0, "Darn"), (4.0, "fine")]
    assert "between(t,4.000,5.000)" in plan["mute_filter"].first().filter and "concat=n=2" in plan["cut_filter"].first().filter


def test_presets():
    for name, values in PRESETS.items():
        made = Settings().preset(name)
        assert all(getattr(made, k) == v for k, v in values.items())
    assert Settings().preset("fast").quality == 23 and Settings().preset("thorough").encoder == "libx264" and Settings().resolved_encoder() in ("libx264", "videotoolbox")
    with pytest.raises(ValueError, match="no preset"):
        Settings().preset("slow")


def test_vocabulary_files(tmp_path, spark):
    own = tmp_path / "words.json"
    own.write_text('{"sex": ["x"]}')
    assert L.vocabulary_of(str(own)) == {"sex": ["x"]} and L.vocabulary_of() is L.DEFAULT and L.replacements_of() is L.SOFTER
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, "Damn it, he overdosed"), (1, 2, 5.0, 6.0, "so high")], "media_id long, idx int, start double, end double, text string")
    got = dialogue.scan_lines(cues, L.lexicon(L.DEFAULT), Settings().actions, L.SOFTER).orderBy("start").collect()
    assert [(r.category, r.text_after) for r in got] == [("drugs", "Darn it, he overdosed"), ("drugs", "so high")]
