"""Where models come in: any Python callable over a table's rows, run beside the data.

A producer is loaded once for each partition and asked row by row, in the order of
an item's time. It returns the row's answers, SKIP where there is nothing to ask
about (a frame that can't be read), or None where it failed. Failures in a row end
the run: a server that is down isn't a quiet film.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from ..schema import MEDIA

MOST_FAILURES = 5
SKIP: list = []
Answers = Iterable[dict] | None
Load = Callable[[], Callable[[dict], Answers]]


class ProducerFailed(RuntimeError):
    """Too many failures one after another."""


def produced(rows: DataFrame, load: Load, schema: str, order: tuple[str, ...] = ("start",), most_failures: int = MOST_FAILURES) -> DataFrame:
    """What a producer makes of each row, in columns of `schema`; media_id goes along.

    load() is called on the worker and returns the producer; the rows of an item are asked about one after another, by `order`.
    most_failures in a row raise ProducerFailed; a success or the partition's end resets the count, and SKIP leaves it.
    """
    out = StructType([rows.schema[MEDIA], *_parse_datatype_string(schema).fields])
    names = [f.name for f in out.fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, failed = None, 0
        for b in batches:
            found: list[dict] = []
            for row in b.to_pylist():
                ask = ask or load()
                answers = ask(row)
                if answers is None:
                    failed += 1
                    if failed >= most_failures:
                        raise ProducerFailed(f"{failed} failures in a row, the last at item {row[MEDIA]}")
                    continue
                if answers is not SKIP:
                    failed = 0
                found += [{**a, MEDIA: row[MEDIA]} for a in answers]
            if found:
                yield pa.RecordBatch.from_pylist([{n: a.get(n) for n in names} for a in found], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    placed = rows.repartition(MEDIA).sortWithinPartitions(MEDIA, *order)
    return placed.mapInArrow(each, out)


def answered(rows: DataFrame, load: Callable[[], Callable[[dict], str | None]], order: tuple[str, ...] = ("start",), most_failures: int = MOST_FAILURES) -> DataFrame:
    """rows with `raw`, the text that a language or vision model answers; empty text counts as a failure, and a row that fails is left out."""
    kept = [c for c in rows.columns if c != MEDIA]

    def start() -> Callable[[dict], Answers]:
        ask = load()

        def one(row: dict) -> Answers:
            raw = ask(row)
            return raw if raw is SKIP else [{**row, "raw": raw}] if raw else None

        return one

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept), "raw string"])
    return produced(rows, start, schema, order, most_failures)
