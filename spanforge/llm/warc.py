"""WARC archives with revisit resolution.

Payload digests, ids and URLs ("headers") are shuffled by digest, pre-aggregated
to the first response of each, and joined back to tell revisits. Pages then meet
their original by id, and each task writes one archive of gzip members: whole
responses, and revisit records with fresh headers that point to the original.
Files appear under their final names only when complete, so a task may be run again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, cut, map_arrow, scratch, skew_join

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:spanforge:page:"
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 1 << 30


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, first, first_url) of each page whose payload of at least min_bytes another page with a smaller page_id has as well.

    digest: hexadecimal SHA-1 of the html in UTF-8 (null: empty).
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    heads = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= min_bytes)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    originals = heads.groupBy("digest").agg(F.min(known).alias("o"), F.count("*").alias("pages"))
    shared = cut(originals.where("pages > 1 and o is not null").select("digest", F.col("o.page_id").alias("first"), F.col("o.url").alias("first_url"), "pages"))
    return skew_join(heads.select("page_id", "digest"), shared, ["digest"], "pages").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first", "first_url").distinct()


def header_value(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def header_text(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None = None, first_url: str | None = None, date: str = DATE, mark: str = "") -> bytes:
    """One record as a gzip member: a response, or a revisit of page `first`. mark: tells a revisit's id from those of other rows of its page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}{'' if first is None else mark}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if first is None:
        block = http + payload
    else:
        block = http
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{first}>", f"WARC-Refers-To-Date: {date}"]
        if first_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {header_value(first_url)}")
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + squeeze.flush()


def records(stream) -> Iterator[dict]:
    """Records of an archive, one at a time: its headers (lower-case names), the HTTP headers under `http`, and the payload."""

    def headers() -> dict[str, str]:
        found = {}
        while (line := lines.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    lines = gzip.GzipFile(fileobj=stream)
    while version := lines.readline():
        if version in (b"\r\n", b"\n"):
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = headers()
        block = lines.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the archive ends within a record")
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = [x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:]]
        yield {**head, "http": {k.strip().lower(): v.strip() for k, _, v in fields}, "payload": payload}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into archives in `folder`; returns (path, records, bytes), already written.

    A null html is an empty payload. Rows with equal payloads of at least min_bytes: those with the smallest page_id are
    responses, the others revisit it; a row without a page_id is a revisit wherever another has one.
    Smaller payloads are all responses. Repeated rows are as many records; those of a response are one record, with one id, as often as
    it is given, and each revisit has an id of its own. No row, no archive. date: of all records, or that of this call.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = resolve_revisits(pages, min_bytes).select(F.col("page_id").alias("id_"), F.col("digest").alias("digest_"), "first", "first_url")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    joined = rows.join(found, F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left").select("page_id", "url", "html", "first", "first_url")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = pafs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        context = TaskContext.get()
        number, stream, done = 0, None, []

        def close() -> None:
            nonlocal stream
            stream.close()
            if target.get_file_info(name).type == pafs.FileType.NotFound:
                target.move(draft, name)
            else:  # another attempt of this task has been here
                target.delete_file(draft)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", n, size))
            stream = None

        for b in chunks(batches, "html"):
            payloads, cols = bytes_of(b.column(2)), [b.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for page_id, url, first, first_url, payload in zip(*cols, payloads):
                if stream is None:
                    name = f"{root}/part-{context.partitionId():06d}-{number:04d}.warc.gz"
                    draft = f"{root}/.draft-{context.taskAttemptId()}-{number:04d}"
                    stream, n, size, number = target.open_output_stream(draft, compression=None), 0, 0, number + 1
                made = record(page_id, url, payload, first, first_url, date, f"#{context.partitionId()}-{number}-{n}")
                stream.write(made)
                n, size = n + 1, size + len(made)
                if size >= archive_bytes:
                    close()
        if stream is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return cut(map_arrow(joined, each, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives at `path`: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if wanted (null for revisits).

    A response's digest is taken of what is read, and must be that of its header; a revisit's length is that of its HTTP header.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def number(text: str | None) -> int | None:
        digits = (text or "")[len(RECORD_ID) + 1 : -1].partition("#")[0]
        return int(digits) if digits else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                source, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with source.open_input_stream(at, compression=None) as stream:
                    for r in records(stream):
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        url, payload = r.get("warc-target-uri"), None
                        if r["warc-type"] == "response":
                            payload = r["payload"]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"digest of {r['warc-record-id']} in {path}")
                        size = int(r["http"]["content-length"]) if payload is None else len(payload)
                        row = (number(r["warc-record-id"]), None if url is None else header_text(url), size, digest, r["warc-type"], number(r.get("warc-refers-to")))
                        rows.append((*row, payload) if with_payload else row)
                        held += size if with_payload else 0
                        if len(rows) >= 10_000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return map_arrow(archives.select("path"), each, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """The archives lie in the shared folder until they have been read back."""
    folder = scratch(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = cut(read_archives(archives).drop("url"))
    target, root = pafs.FileSystem.from_uri(folder)
    if target.get_file_info(root).type != pafs.FileType.NotFound:
        target.delete_dir(root)
    return back


BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[{k + 1}] >> {s}) & 31)::INT, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
ORACLES = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_transform(range(8), lambda k: ('0x' || substr(h, (5 * k + 1)::INT, 5))::BIGINT) AS v,
        min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {BASE32_SQL} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
}
