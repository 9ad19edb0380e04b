import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions.lexicon import lexicon
from spanforge.operators import decisions, dialogue, frames, sounds, timeline, verdicts
from spanforge.schema import DECISION
from spanforge.settings import Settings
from spanforge.sources import media as M
from spanforge.sources import subtitles as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def cues(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), t) for i, a, b, t in rows], "media_id long, idx int, start double, end double, text string")


def test_soften(spark):
    table = {"darn": "gosh", "gosh": "wow", "oh darn it": "oh well", "café": "bar"}
    say = lambda t: one(spark, t, lambda c: T.soften(c, table))
    assert say("Darn! DARN darn, darned.") == "Gosh! GOSH gosh, darned."
    assert say("oh darn it, CAFÉ") == "oh well, BAR"
    assert say("gosh") == "wow" and say("") == "" and say(None) is None
    assert one(spark, "darn", lambda c: T.soften(c, {})) == "darn"


@pytest.mark.parametrize(("text", "want"), [("5.25", 5.25), ("01:30", 90.0), ("1:02:03.5", 3723.5), (" 7 ", 7.0), ("", None), ("abc", None), ("1:2:3:4", None), ("1:xx", None), (":30", None), ("-1", None)])
def test_parse_timestamp(spark, text, want):
    assert one(spark, text, T.parse_timestamp) == want


def test_strict_timestamps_raise(spark):
    with pytest.raises(Exception, match="not a time stamp"):
        one(spark, "abc", lambda c: T.parse_timestamp(c, strict=True))


@pytest.mark.parametrize(("x", "stamp", "long", "length"), [(0.0, "0:00.00", "00:00:00.000", "0.0s"), (119.999, "1:60.00", "00:01:59.999", "1m 60.0s"), (3723.5, "1:02:03.50", "01:02:03.500", "1h 2m 3.5s"), (62.0, "1:02.00", "00:01:02.000", "1m 2.0s"), (500000.25, "138:53:20.25", "138:53:20.250", "138h 53m 20.2s")])
def test_formats(spark, x, stamp, long, length):
    assert one(spark, x, T.timestamp, "double") == stamp
    assert one(spark, x, T.long_timestamp, "double") == long
    assert one(spark, x, T.duration, "double") == length


@pytest.mark.parametrize(("raw", "sure", "strict", "loose"), [('{"a": true, "confidence": 0.9}', 0.9, True, True), ('x {"a": "false", "confidence": "0.5"} y', 0.5, False, True), ('{"a": 1, "confidence": true}', 1.0, False, True), ('{"a": 0, "confidence": "n"}', 0.0, False, False), ('{"a": null}', 0.0, False, False), ('{"a": ""}', 0.0, False, False), ("nothing", 0.0, False, False), ('{"a": tr', 0.0, False, False)])
def test_verdicts(spark, raw, sure, strict, loose):
    v = lambda c: T.verdict(c)
    assert one(spark, raw, lambda c: T.confidence(v(c))) == sure
    assert one(spark, raw, lambda c: T.is_true(v(c), "a")) is strict
    assert one(spark, raw, lambda c: T.truthy(v(c), "a")) is loose


LEXICON = {"profanity": [r"\bdarn\w*\b"], "drugs": [{"pattern": r"\bhigh\b", "strength": "weak"}, r"\bcoke\b"], "violence": [r"\bmurder\b"]}
ACTIONS = Settings().actions


def test_line_scan(spark):
    rows = [(1, 0, 2, "A HIGH note"), (2, 10, 12, "Darned coke"), (3, 600, 602, "so high"), (4, 20, 21, "murder, darn"), (5, 30, 31, "nothing"), (6, 33, 34, None)]
    got = sorted(tuple(r) for r in dialogue.scan_lines(cues(spark, rows), lexicon(LEXICON), ACTIONS).select("start", "action", "category", "reason").collect())
    # the keep of the more severe category silences cue 4; the weak one at 600 has nothing strong near
    assert got == [(0.0, "mute", "drugs", "weak: high"), (10.0, "mute", "drugs", "matched: coke, darned")]
    assert [r.action for r in dialogue.scan_lines(cues(spark, rows), lexicon({"own": ["nothing"]}), ACTIONS).collect()] == ["mute"]
    only = lexicon(LEXICON, {"profanity"})
    assert [r.category for r in dialogue.scan_lines(cues(spark, rows), only, ACTIONS).collect()] == ["profanity", "profanity"]
    assert dialogue.scan_lines(cues(spark, rows), [], ACTIONS).collect() == []


def test_word_scan_fires_on_runs(spark):
    said = "one two darn, four".split()
    words = spark.createDataFrame([(1, i, float(i), i + 0.5, w, 1.0) for i, w in enumerate(said)], "media_id long, pos long, start double, end double, text string, probability double")
    got = sorted((r.start, r.end, r.reason) for r in dialogue.scan_words(words, lexicon(LEXICON), ACTIONS).collect())
    assert got == [(0.0, 2.5, "matched: darn"), (1.0, 2.5, "matched: darn"), (2.0, 2.5, "matched: darn")]
    merged = dialogue.scan_words(words, lexicon(LEXICON), ACTIONS, {"darn": "gosh"})
    assert {(r.text_before, r.text_after) for r in merged.collect()} == {("one two darn", "one two gosh"), ("two darn", "two gosh"), ("darn", "gosh")}
    assert [r.reason for r in decisions.merge_overlapping(merged).collect()] == ["matched: darn"]
    # a category without an action is muted
    assert {r.action for r in dialogue.scan_words(words, lexicon({"own": ["darn"]}), ACTIONS).collect()} == {"mute"}
    assert dialogue.scan_words(words, [], ACTIONS).collect() == []


def test_streaks_and_shots(spark):
    hits = spark.createDataFrame([(1, float(i), h, ["A"] if h else []) for i, h in enumerate([True, True, True, False, True, True])], "media_id long, t double, hit boolean, classes array<string>")
    assert [(r.start, r.end, r.samples) for r in frames.streaks(hits, 1.0).collect()] == [(0.0, 3.0, 3)]
    shots = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 8.0), (1, 2, 8.0, 8.0)], "media_id long, shot_idx int, start double, end double")
    assert [(r.shot_idx, r.hits) for r in frames.shot_hits(shots, hits, 1.0, 0.6).collect()] == [(0, 3)]
    assert sorted((r.shot_idx, r.t) for r in frames.planned_samples(shots, 2.0).collect()) == [(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0)]


def test_explicit_frames(spark):
    rows = [(1, 0.0, [("X", 0.9), ("Y", 0.99)]), (1, 1.0, [("X", 0.6)]), (1, 2.0, [("X", None)]), (1, 3.0, [])]
    df = spark.createDataFrame(rows, "media_id long, t double, detections array<struct<class:string,score:double>>")
    assert [r.classes for r in frames.explicit_frames(df, ("X",)).orderBy("t").collect()] == [["X"], [], [], []]


def test_audio(spark):
    rows = [(1, 0.0, 5.0, [("Moan", 0.9), ("Scream", 0.95)]), (1, 5.0, 5.5, [("Moan", 0.9)]), (1, 6.0, 9.0, [("Moan", 0.1)])]
    df = spark.createDataFrame(rows, "media_id long, start double, end double, scores array<struct<label:string,score:double>>")
    got = sounds.audio_labels(df, {"Moan": "sex", "Scream": "violence"}).collect()
    assert [(r.seq, r.start, r.action, r.category, r.reason, r.source, r.accepted) for r in got] == [(0, 0.0, "cut", "sex+violence", "audio event: Scream (0.95)", "audio", True)]
    ramp = spark.createDataFrame([([float(i) for i in range(100)],)], "x array<double>")
    for centre, want in ((0.5, list(range(40))), (5.0, list(range(30, 70))), (9.5, [*range(75, 100), *[0] * 15])):
        assert ramp.select(sounds.audio_slice(F.col("x"), 10, F.lit(centre), 4.0).alias("y")).first().y == want


def test_shot_selection(spark):
    shots = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 10.0), (1, 2, 10.0, 20.0), (1, 3, 20.0, 20.2), (1, 4, 20.2, 30.0)], "media_id long, shot_idx int, start double, end double")
    lines = cues(spark, [(1, 6, 9, "x"), (2, 21, 22, "y")])
    edl = spark.createDataFrame([(1, 0, 11.0, 12.0, "mute", "sex", "", "", "", "subtitle", True)], DECISION)
    pick = lambda mode, **k: sorted(r.shot_idx for r in verdicts.select_shots(shots, lines, edl, mode, **k).collect())
    assert pick("silent") == [0, 2] and pick("gaps", radius=1.0) == [2] and pick("all") == [0, 1, 2, 4]
    assert pick("stride", stride=2) == [0, 2] and pick("silent+gaps", radius=2.0) == [0, 1, 2]
    with pytest.raises(ValueError):
        pick("other")


def test_srt(spark, tmp_path):
    text = "1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n2\n00:01:00,000 --> 01:00:00,250\nLast \n"
    (tmp_path / "7.srt").write_bytes(text.encode())
    got = sorted(tuple(r) for r in S.read_srt(spark, str(tmp_path)).collect())
    assert got == [(7, 1, 1.5, 2.0, "Hello\nthere"), (7, 2, 60.0, 3600.25, "Last")]
    out = str(tmp_path / "out")
    S.write_srt(S.read_srt(spark, str(tmp_path / "7.srt")), out)
    assert sorted((r.media_id, r.start, r.end, r.text) for r in S.read_srt(spark, out).collect()) == sorted((r[0], *r[2:]) for r in got)
    value = S.srt_documents(S.read_srt(spark, str(tmp_path / "7.srt"))).first().value
    assert value.startswith("1\n00:00:01,500 --> 00:00:02,000\nHello\nthere\n\n2\n00:01:00,000 --> 01:00:00,250\nLast\n")


def test_edl_documents(spark, tmp_path):
    bare = {"decisions": [{"start": 1, "end": 2.5, "action": "cut", "category": "sex"}, {"start": 0, "end": 1, "action": "mute", "category": "drugs", "accepted": False, "reason": "r"}]}
    df = spark.createDataFrame([(3, json.dumps(bare)), (4, "{}"), (5, "not json")], "media_id long, value string")
    got = sorted(tuple(r) for r in S.parse_edl(df).collect())
    assert got == [(3, 0, 1.0, 2.5, "cut", "sex", "", "", "", "", True), (3, 1, 0.0, 1.0, "mute", "drugs", "r", "", "", "", False)]
    media = spark.createDataFrame([(3, "/v.mkv", "")], "media_id long, video_path string, subtitle_path string")
    S.write_edl(S.parse_edl(df), media, str(tmp_path / "e"))
    assert sorted(tuple(r) for r in S.read_edl(spark, str(tmp_path / "e")).collect()) == got
    words = spark.createDataFrame([(1, '[{"start": 0, "end": 1, "text": "a"}]'), (2, "broken"), (3, '{"a": 1}')], "media_id long, value string")
    assert [(r.media_id, r.text, r.probability) for r in S.parse_words(words).collect()] == [(1, "a", 1.0)]


def test_tracks_and_sidecars(spark):
    rows = [(1, 0, "h264", "video", "und"), (1, 1, "aac", "audio", "spa"), (1, 2, "aac", "audio", "eng"), (1, 3, "dvd_subtitle", "subtitle", "eng"), (1, 4, "subrip", "subtitle", "spa")]
    st = spark.createDataFrame(rows, "media_id long, index int, codec_name string, codec_type string, language string")
    assert M.pick_audio(st).first()["index"] == 2 and M.pick_audio(st, "fra").first()["index"] == 1 and M.pick_audio(st, requested=0).first()["index"] == 1
    with pytest.raises(Exception, match="no audio track"):
        M.pick_audio(st, requested=5).collect()
    assert M.pick_embedded_subtitle(st).first()["index"] == 4
    files = [("Movie.en.sdh", False), ("Movie.spa", False), ("Movie", False), ("Movie.en", False), ("English", True), ("Other", False)]
    df = spark.createDataFrame([(1, "Movie", n, s, i) for i, (n, s) in enumerate(files)], "media_id long, stem string, name string, in_subs boolean, pos int")
    assert M.pick_sidecar(df).first().name == "Movie.en" and M.pick_sidecar(df, "spa").first().name == "Movie.spa"


def test_store(spark, tmp_path):
    store = M.ResultStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([(1, "/a", 10, 5.5), (2, "/b", 10, 6.0), (3, "/c", 1, 1.0)], "media_id long, path string, size long, mtime double")
    found = spark.createDataFrame([(1, 0.5), (1, 0.7)], "media_id long, score double")
    assert store.load("x", {"a": 1}, files)[0] is None
    store.save("x", {"a": 1, "b": 2}, files.where("media_id < 3"), found)
    now = spark.createDataFrame([(1, "/a", 10, 5.9), (2, "/b", 10, 7.0), (3, "/c", 1, 1.0)], files.schema)
    rows, rest = store.load("x", {"b": 2, "a": 1}, now)
    assert sorted(r.score for r in rows.collect()) == [0.5, 0.7] and sorted(r.media_id for r in rest.collect()) == [2, 3]
    store.clear()
    assert store.load("x", {"a": 1, "b": 2}, files)[0] is None


def test_settings():
    assert Settings().preset("fast").snap is False and Settings().preset("thorough").vlm
    assert Settings().with_actions(["drugs=cut"]).actions["drugs"] == "cut"
    for bad in (lambda: Settings().preset("x"), lambda: Settings().with_actions(["drugs"]), lambda: Settings().with_actions(["x=cut"])):
        with pytest.raises(ValueError):
            bad()
    assert [timeline.hardware_quality(q) for q in (0, 20, 40)] == [90, 50, 30]


def test_edits(spark):
    row = lambda i, a, b: (1, i, a, b, "cut", "sex", "r", "", "", "vlm", True)
    edl = spark.createDataFrame([row(0, 1.0, 2.0), row(1, 5.0, 6.0)], DECISION)
    edits = spark.createDataFrame([(1, 0, 1, "reject", None, None), (1, 0, 2, "accept", None, None), (1, 1, 1, "trim", 5.5, 5.2), (1, 1, 2, "trim", 5.2, 5.5), (1, 1, 3, "reject", None, None)], "media_id long, seq long, at int, verb string, new_start double, new_end double")
    got = {r.seq: (r.start, r.end, r.accepted) for r in decisions.review(edl, edits).collect()}
    assert got == {0: (1.0, 2.0, True), 1: (5.2, 5.5, False)}
    bad = spark.createDataFrame([row(0, 5.0, 5.0)], DECISION)
    with pytest.raises(Exception, match="end after"):
        decisions.add_cut(edl, bad).collect()
