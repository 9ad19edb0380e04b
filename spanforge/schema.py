"""Relations, token sets and their ranks. Times are seconds from the start of the media, as DOUBLE."""

from __future__ import annotations

ACTIONS = ("keep", "mute", "cut")  # by rising rank
CATEGORIES = ("profanity", "violence", "drugs", "sex", "nudity")  # by rising severity
SEVERITY = {c: i + 1 for i, c in enumerate(CATEGORIES)}
FOCAL = ("sex", "drugs", "nudity", "multi")
VISUAL_SOURCES = ("vlm", "visual", "visual-shot")
SUPPORTING_SOURCES = ("subtitle", "whisper-word", "llm-dialogue", "audio", "density", "manual")
DIALOGUE_SOURCES = ("subtitle", "whisper-word", "llm-dialogue", "audio")
REASON_CAP = 160

MEDIA, SEQ = "media_id", "seq"

DECISION = (
    "media_id bigint, seq bigint, start double, end double, action string, category string, reason string, "
    "text_before string, text_after string, source string, accepted boolean"
)
DECISION_COLUMNS = [c.split()[0] for c in DECISION.split(", ")]
SUBTITLE = "media_id bigint, idx int, start double, end double, text string"
WORD = "media_id bigint, pos bigint, start double, end double, text string, probability double"
SHOT = "media_id bigint, shot_idx int, start double, end double"
FRAME = "media_id bigint, t double, detections array<struct<class:string,score:double>>"
EDL_DOCUMENT = (
    "video_path string, subtitle_path string, decisions array<struct<start:double,end:double,action:string,category:string,"
    "reason:string,text_before:string,text_after:string,source:string,accepted:boolean>>"
)
