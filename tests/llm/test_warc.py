import base64
import hashlib

import pytest

from spanforge.llm import warc as W
from spanforge.llm.common import scratch

SCHEMA = "page_id long, url string, html string, digest string, first long, path string"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA)


ROWS = [(5, "u5", "same"), (3, "u\r\n3 50%", "same"), (9, None, "same"), (1, "u1", None), (2, "u2", ""), (7, "u7", "own é\r\n\r\nWARC/1.1\r\n"), (8, "u8", "x" * 300_000), (8, "u8", "other"), (None, "u", "alone"), (None, "u", "same")]


def test_round_trip(spark):
    archives = W.write_archives(table(spark, ROWS).repartition(3), scratch(spark, "t"))
    got = W.read_archives(archives, with_payload=True).collect()
    want = {5: 3, 9: 3, 2: 1}
    assert len(got) == len(ROWS)
    for page_id, url, html in ROWS:
        payload = (html or "").encode()
        r = next(r for r in got if (r.page_id, r.url, r.payload_digest) == (page_id, url, b32(payload)))
        first = 3 if page_id is None and html == "same" else want.get(page_id)
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(payload), "revisit" if first else "response", first)
        assert (bytes(r.payload) if r.payload is not None else None) == (None if first else payload)
    assert sum(r.records for r in archives.collect()) == len(ROWS)


def test_small_payloads_stay_responses(spark):
    got = W.read_archives(W.write_archives(table(spark, ROWS), scratch(spark, "t"), min_bytes=5)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_small_archives_and_a_second_attempt(spark):
    folder = scratch(spark, "t")
    a = W.write_archives(table(spark, ROWS).coalesce(1), folder, archive_bytes=1)
    assert a.count() == len(ROWS)
    b = W.write_archives(table(spark, ROWS).coalesce(1), folder, archive_bytes=1)
    assert W.read_archives(b).count() == len(ROWS)


def test_empty_table(spark):
    assert W.read_archives(W.write_archives(table(spark, []), scratch(spark, "t"))).collect() == []


def test_broken_archives_are_told(tmp_path):
    import io

    whole = W.record(1, "u", b"payload")
    assert next(W.records(io.BytesIO(whole)))["payload"] == b"payload"
    with pytest.raises((ValueError, EOFError)):
        list(W.records(io.BytesIO(whole[:-12])))


def test_ids_and_dates(spark, tmp_path):
    """Revisits have ids of their own, also of repeated rows; all records have the date given, or that of the call."""
    rows = spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>"), (2, "v", "<p>"), (3, None, "<q>")], "page_id long, url string, html string")
    for date in ("2020-02-02T02:02:02Z", None):
        folder = f"file://{tmp_path}/{date or 'now'}"
        found = []
        for r in W.write_archives(rows, folder, date=date).collect():
            with open(r.path.removeprefix("file://"), "rb") as f:
                found += list(W.records(f))
        ids = [x["warc-record-id"] for x in found]
        assert len(found) == 4 and len(set(ids)) == 4
        dates = {x["warc-date"] for x in found}
        assert dates == {date} if date else len(dates) == 1 and dates.pop() > "2024-06"
        assert {x["warc-refers-to"] for x in found if x["warc-type"] == "revisit"} == {f"<{W.RECORD_ID}1>"} <= {f"<{W.RECORD_ID}1>", *ids}
