"""Results as table, JSON lines, CSV or Markdown text.

Rows are fetched partition by partition. A cell is None if missing, else (json text, is it a string, plain text).
`write_files` writes bulk results from the executors instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import json_text, number_text, time_text

FORMATS = {"table": "table", "json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "markdown": "markdown", "md": "markdown"}


def format_named(name: str) -> str:
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown format `{name}`; expected table, json, csv or markdown") from None


def as_json_cells(df: DataFrame) -> DataFrame:
    """Every column as JSON text; missing stays NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = number_text(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegralType, T.DecimalType, T.BooleanType)):
            v = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            v = F.concat(F.lit('"'), time_text(F.unix_micros(c.cast("timestamp")) / F.lit(1e6)), F.lit('"'))
        elif isinstance(f.dataType, T.VariantType):
            v = json_text(c)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            v = F.to_json(c)
        else:
            v = F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
            v = F.when(c.isNotNull(), v)
        out.append(v.alias(f.name))
    return df.select(*out)


def rows_of(df: DataFrame) -> Iterator[list[str | None]]:
    for row in as_json_cells(df).toLocalIterator():
        yield list(row)


def plain(cell: str | None) -> str:
    """Missing is empty, a string is bare, all else is JSON."""
    if cell is None:
        return ""
    return json.loads(cell) if cell.startswith('"') else cell


def write_json(columns: list[str], rows: Iterable[list[str | None]], out: TextIO) -> None:
    keys = [json.dumps(c, ensure_ascii=False) for c in columns]
    for row in rows:
        out.write("{" + ",".join(f"{k}:{v}" for k, v in zip(keys, row, strict=True) if v is not None) + "}\n")


def _csv_cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def write_csv(columns: list[str], rows: Iterable[list[str | None]], out: TextIO) -> None:
    header = False
    for row in rows:
        if not header:
            out.write(",".join(map(_csv_cell, columns)) + "\n")
            header = True
        out.write(",".join(_csv_cell(plain(c)) for c in row) + "\n")


def _markdown_cell(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("|", "\\|")
    return text.replace("\r\n", "<br>").replace("\n", "<br>").replace("\r", "<br>")


def write_markdown(columns: list[str], rows: Iterable[list[str | None]], out: TextIO) -> None:
    if not columns:
        return
    line = lambda cells: out.write("| " + " | ".join(map(_markdown_cell, cells)) + " |\n")
    line(columns)
    out.write("|" + " --- |" * len(columns) + "\n")
    for row in rows:
        line([plain(c) for c in row])


def _table_cell(text: str) -> str:
    return text.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def write_table(columns: list[str], rows: Iterable[list[str | None]], out: TextIO) -> None:
    if not columns:
        return
    cells = [[_table_cell(plain(c)) for c in row] for row in rows]
    heads = [_table_cell(c) for c in columns]
    widths = [max(len(h), *(len(r[i]) for r in cells)) if cells else len(h) for i, h in enumerate(heads)]
    line = lambda row: out.write("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() + "\n")
    line(heads)
    line(["-" * w for w in widths])
    for row in cells:
        line(row)


WRITERS = {"table": write_table, "json": write_json, "csv": write_csv, "markdown": write_markdown}


class GrowingTable:
    """A table whose rows are printed as they come; the header comes again when a column has to grow."""

    def __init__(self, out: TextIO):
        self.out, self.heads, self.widths = out, [], []

    def write(self, columns: list[str], rows: Iterable[list[str | None]]) -> None:
        for row in rows:
            cells = [_table_cell(plain(c)) for c in row]
            need = [max(len(c), len(h)) for c, h in zip(cells, columns, strict=True)]
            if columns != self.heads or any(n > w for n, w in zip(need, self.widths, strict=True)):
                same = columns == self.heads
                self.widths = [max(n, w) for n, w in zip(need, self.widths, strict=True)] if same else need
                self.heads = list(columns)
                self._line(self.heads)
                self._line(["-" * w for w in self.widths])
            self._line(cells)
        self.out.flush()

    def _line(self, cells: list[str]) -> None:
        self.out.write("  ".join(c.ljust(w) for c, w in zip(cells, self.widths, strict=True)).rstrip() + "\n")


def write(df: DataFrame, format: str, out: TextIO, at_once: bool = False) -> None:
    """at_once: for a few rows, in one job, which observations of the plan wait for."""
    rows = map(list, as_json_cells(df).collect()) if at_once else rows_of(df)
    WRITERS[format_named(format)](df.columns, rows, out)


def write_files(df: DataFrame, format: str, path: str) -> None:
    """Bulk output from the executors: JSON lines (missing keys left out, null kept), CSV or Parquet."""
    name = format.lower()
    if name == "parquet":
        df.write.parquet(path)
        return
    cells = as_json_cells(df)
    if format_named(name) == "json":
        keys = [json.dumps(c, ensure_ascii=False) for c in df.columns]
        pairs = [F.concat(F.lit(k + ":"), F.col(f"`{c}`")) for k, c in zip(keys, df.columns, strict=True)]
        cells.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("value")).write.text(path)
        return
    if format_named(name) == "csv":
        texts = [F.when(F.col(f"`{c}`").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col(f"`{c}`"), F.lit("}")), "$.v")).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns]
        cells.select(*texts).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
        return
    raise ValueError(f"`{format}` is a format for reading, not for files; use json, csv or parquet")
