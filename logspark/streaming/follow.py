"""Queries over growing files: filter and projection as a stream, and time buckets with a watermark."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import query
from ..plans import nodes as N
from ..plans.parser import parse
from ..sinks.writers import rows_of
from ..sources.lines import LogLines, from_lines
from .tail import lines


def check(text: str) -> N.Query:
    q = parse(text)
    if q.grouped:
        raise ValueError("a grouped query has no result before the input ends, so it can not follow a file")
    if q.order is not None:
        raise ValueError("`order by` has no result before the input ends, so it can not follow a file")
    return q


def without_limit(text: str, q: N.Query) -> str:
    from ..plans.lexer import tokenize

    if q.limit is None:
        return text
    at = next(t.column for t in reversed(tokenize(text)) if t.kind == "keyword" and t.value == "limit")
    return text[: at - 1]


def follow(spark: SparkSession, text: str, path: str, sink: Callable[[list[str], list[list[str | None]]], None], pattern: str | None = None, checkpoint: str | None = None):
    """Starts the stream; sink gets column names and rows batch by batch. At the limit the stream stops."""
    q = check(text)
    return start(spark, lines(spark, path), text, q, sink, pattern, checkpoint)


def start(spark: SparkSession, source: DataFrame, text: str, q: N.Query, sink, pattern: str | None, checkpoint: str | None):
    plain = without_limit(text, q)
    left = [q.limit]
    done = threading.Event()

    def batch(df: DataFrame, _: int) -> None:
        if left[0] == 0:
            done.set()
            return
        result = query(plain, from_lines(df, pattern))
        rows = []
        for row in rows_of(result if left[0] is None else result.limit(left[0])):
            rows.append(row)
        if left[0] is not None:
            left[0] -= len(rows)
        if rows:
            sink(result.columns, rows)
        if left[0] == 0:
            done.set()

    writer = source.writeStream.foreachBatch(batch).trigger(processingTime="200 milliseconds")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    stream = writer.start()
    stream.limit_reached = done
    return stream


def windowed_counts(source: LogLines, time_field: str, width: str, late: str = "10 minutes") -> DataFrame:
    """An extension: counts by epoch-aligned window, closed once the watermark has passed them. Works on streams and tables."""
    value = F.try_variant_get(source.field((time_field,)), "$", "string")
    timed = source.records([time_field]).select(F.to_timestamp(value).alias("at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).count().select(F.col("window.start").alias("window"), F.col("count").alias("n"))
