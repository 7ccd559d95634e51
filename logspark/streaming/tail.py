"""A growing file as a stream of lines: Structured Streaming's file source sees new files only, not what is appended."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class TailSource(DataSource):
    """format("logtail").option("path", ...): whole lines in order; a file that shrinks or is replaced starts anew."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("maxbytes", 16 << 20)))


class TailReader(SimpleDataSourceStreamReader):
    """Offsets are {file: inode, at: bytes read}; a line counts once its line feed is there."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"file": 0, "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            found = os.stat(self.path)
        except FileNotFoundError:
            return iter(()), start
        at = start["at"] if start["file"] in (0, found.st_ino) and found.st_size >= start["at"] else 0
        lines, at = self._lines(at, None)
        return iter(lines), {"file": found.st_ino, "at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["at"] if start["file"] in (0, end["file"]) and start["at"] <= end["at"] else 0
        return iter(self._lines(at, end["at"])[0])

    def _lines(self, at: int, stop: int | None) -> tuple[list[tuple], int]:
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(self.most if stop is None else stop - at)
            if stop is None and data and b"\n" not in data:
                data += f.readline()  # a line of over the limit
        whole = data.rfind(b"\n") + 1
        return [(x,) for x in data[:whole].split(b"\n")[:-1]], at + whole


def lines(spark: SparkSession, path: str):
    spark.dataSource.register(TailSource)
    return spark.readStream.format("logtail").option("path", path).load().selectExpr("cast(value as string) as value")
