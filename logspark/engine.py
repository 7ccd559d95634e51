"""Queries over typed tables and over log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.compiler import Compiler
from .plans.parser import parse
from .sources.lines import LogLines

#: Session settings that queries rely on; set when a query is compiled.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def query(text: str, source: DataFrame | LogLines, ordered: bool = False) -> DataFrame:
    """The query's result, not yet computed.

    source: a DataFrame with typed columns, or log lines. ordered: groups come in order of their first record, as the
    writers print them; without it no sort is planned for groups that the query does not order.
    """
    parsed = parse(text)
    spark = (source.lines if isinstance(source, LogLines) else source).sparkSession
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return Compiler(parsed).compile(source, ordered)
