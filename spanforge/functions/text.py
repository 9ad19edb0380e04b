"""Text and number expressions: softening, time stamps, durations, model output."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once, however often body names it, and in little code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(x: Column, pattern: str) -> Column:
    """A number in a fixed pattern such as 0.00, rounded as the exact decimal value says; never grouped."""
    return F.call_function("format_number", x, F.lit(pattern))


def tokens(c: Column) -> Column:
    """The tokens of an a+b+c string."""
    return F.split(c, r"\+")


def has_token(c: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in wanted]))


def first_token(c: Column) -> Column:
    return F.split_part(c, F.lit("+"), F.lit(1))


def like_case(found: Column, new: Column) -> Column:
    """`new` in the case of `found`: all upper, first upper, or as it is."""
    first = F.substring(found, 1, 1)
    return (
        F.when((F.upper(found) == found) & (F.lower(found) != found), F.upper(new))
        .when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 30)))
        .otherwise(new)
    )


def soften(text: Column, replacements: dict[str, str]) -> Column:
    """Whole-word replacements in one pass, longest first, in the case of what they replace."""
    if not replacements:
        return text
    keys = sorted(replacements, key=lambda k: (-len(k), k))
    pattern = r"(?iuU)\b(?:" + "|".join(re.escape(k).replace(r"\ ", " ") for k in keys) + r")\b"
    table = F.create_map(*[F.lit(x) for k, v in replacements.items() for x in (k.lower(), v)])
    kept, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    swapped = F.transform(found, lambda m: like_case(m, F.coalesce(F.try_element_at(table, F.lower(m)), m)))
    return F.array_join(F.transform(F.arrays_zip(kept.alias("k"), swapped.alias("s")), lambda z: F.concat(F.coalesce(z["k"], F.lit("")), F.coalesce(z["s"], F.lit("")))), "")


def parse_timestamp(text: Column, strict: bool = False) -> Column:
    """Seconds of SS, MM:SS or H:MM:SS; null, or an error if strict, for anything else."""
    t = F.trim(text)
    part = F.split(t, ":")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    value = (
        F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
        .when(t.rlike(r"^\d+:\d+(\.\d+)?$"), number(0) * 60 + number(1))
        .when(t.rlike(r"^\d+:\d+:\d+(\.\d+)?$"), number(0) * 3600 + number(1) * 60 + number(2))
    )
    if strict:
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a time stamp: "), F.coalesce(text, F.lit("null")))).cast("double")).otherwise(value)
    return value


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(seconds)
    hours, minutes = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return hours, minutes, seconds - hours * 3600 - minutes * 60


def timestamp(seconds: Column) -> Column:
    """H:MM:SS.ss, or M:SS.ss below an hour."""
    h, m, s = _parts(seconds)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), fixed(s, "00.00"))).otherwise(F.concat(m.cast("string"), F.lit(":"), fixed(s, "00.00")))


def long_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    h, m, s = _parts(seconds)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(two(h), F.lit(":"), two(m), F.lit(":"), fixed(s, "00.000"))


def duration(seconds: Column) -> Column:
    """12.3s, 1m 2.0s or 1h 2m 3.0s"""
    h, m, s = _parts(seconds)
    return (
        F.when(seconds < 60, F.concat(fixed(seconds, "0.0"), F.lit("s")))
        .when(seconds < 3600, F.concat(m.cast("string"), F.lit("m "), fixed(s, "0.0"), F.lit("s")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), fixed(s, "0.0"), F.lit("s")))
    )


def json_part(text: Column) -> Column:
    """From the first { to the last }; the text itself without such."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found == "", text).otherwise(found)


def verdict(text: Column) -> Column:
    """Model output as VARIANT; null where it isn't JSON."""
    return F.try_parse_json(json_part(text))


def confidence(raw: Column, key: str = "confidence") -> Column:
    """A verdict's number: numeric strings count, true is 1, anything else is 0."""
    text = F.try_variant_get(raw, f"$.{key}", "string")
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    return F.when(F.coalesce(kind == "BOOLEAN", F.lit(False)), F.when(text == "true", 1.0).otherwise(0.0)).otherwise(F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0)))


def is_true(raw: Column, key: str) -> Column:
    """Whether a verdict's value is JSON true, and nothing that merely reads like it."""
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    return F.coalesce((kind == "BOOLEAN") & F.try_variant_get(raw, f"$.{key}", "boolean"), F.lit(False))


def truthy(raw: Column, key: str) -> Column:
    """Whether a verdict's value counts as true: not null, false, 0 or an empty string."""
    kind = F.schema_of_variant(F.try_variant_get(raw, f"$.{key}", "variant"))
    text = F.try_variant_get(raw, f"$.{key}", "string")
    return F.coalesce(
        F.when(kind.isNull(), F.lit(False)).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind == "VOID", F.lit(False)).otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True))), F.lit(False)
    )


def prompt_lines(lines: Column) -> Column:
    """'[m:ss.ss] text' for each cue of an array of (start, text)."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), timestamp(x["start"]), F.lit("] "), x["text"])), "\n")


def settings_hash(values: dict) -> str:
    """16 hex digits that stand for a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]
