"""Command line: query log files and print the result.

usage: logspark [-f FORMAT] [-p PATTERN] [-F] [-q] QUERY [FILE...]
"""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from dataclasses import dataclass, field

from .errors import PatternError, QueryError
from .plans.parser import parse
from .sinks import writers
from .sources.lines import from_files
from .sources.patterns import Pattern

VERSION = "0.1.0"
#: The most rows that are fetched at once.
FEW = 10_000
USAGE = """usage: logspark [OPTIONS] QUERY [FILE...]

  -f, --format FORMAT    table (default), json, csv or markdown
  -p, --pattern REGEX    read plain text; every named group is a field
  -F, --follow           keep reading the file as it grows
  -q, --quiet            do not report malformed lines
  -h, --help             print this text
  -V, --version          print the version
"""


@dataclass
class Options:
    query: str = ""
    files: list[str] = field(default_factory=list)
    format: str = "table"
    pattern: str | None = None
    follow: bool = False
    quiet: bool = False
    info: str | None = None


class UsageError(ValueError):
    pass


def parse_args(args: list[str]) -> Options:
    out, plain, i = Options(), [], 0
    takes = {"-f": "format", "--format": "format", "-p": "pattern", "--pattern": "pattern"}
    while i < len(args):
        a = args[i]
        name, eq, value = a.partition("=")
        if a == "--":
            plain += args[i + 1 :]
            break
        if a in ("-h", "--help", "-V", "--version"):
            out.info = USAGE if a in ("-h", "--help") else f"logspark {VERSION}\n"
            return out
        if a in ("-F", "--follow"):
            out.follow = True
        elif a in ("-q", "--quiet"):
            out.quiet = True
        elif name in takes and eq and name.startswith("--"):
            setattr(out, takes[name], value)
        elif a in takes:
            i += 1
            if i == len(args):
                raise UsageError(f"`{a}` takes a value")
            setattr(out, takes[a], args[i])
        elif a.startswith("-") and a != "-":
            raise UsageError(f"unknown option `{a}`")
        else:
            plain.append(a)
        i += 1
    if not plain:
        raise UsageError("a query is missing")
    out.query, out.files = plain[0], plain[1:]
    try:
        out.format = writers.format_named(out.format)
    except ValueError as e:
        raise UsageError(str(e)) from None
    if out.follow and (len(out.files) != 1 or out.files == ["-"]):
        raise UsageError("`--follow` takes one file")
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("logspark").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _spooled(spark, files: list[str]) -> list[str]:
    """Standard input as a file, copied in chunks: Spark reads it by ranges.

    It lies in the local folder that spark.checkpoint.dir names, if it does, as executors elsewhere have to see it.
    """
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    out = []
    for f in files or ["-"]:
        if f == "-":
            with tempfile.NamedTemporaryFile("wb", suffix=".log", delete=False, dir=shared if os.path.isdir(shared) else None) as t:
                shutil.copyfileobj(sys.stdin.buffer, t)
            f = t.name
        out.append(f)
    return out


def main(argv: list[str] | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        options = parse_args(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        err.write(f"logspark: {e}\n")
        return 1
    if options.info:
        out.write(options.info)
        return 0
    try:
        parse(options.query)
        if options.pattern:
            Pattern.compile(options.pattern)
    except (QueryError, PatternError) as e:
        err.write(f"logspark: {e}\n")
        return 2
    try:
        return _follow(options, out) if options.follow else _run(options, out, err)
    except BrokenPipeError:
        return 0
    except Exception as e:  # whatever Spark or the file system says
        err.write(f"logspark: {str(e).splitlines()[0] if str(e) else type(e).__name__}\n")
        return 1


def _run(options: Options, out, err) -> int:
    from pyspark.sql import Observation

    from .engine import query

    spark = session()
    q = parse(options.query)
    # Rows that fit in memory come from one job, which counts what it skips as it reads; a limit then ends the reading early.
    few = not options.quiet and q.items is not None and q.limit is not None and q.limit <= FEW
    files = _spooled(spark, options.files)
    try:
        source = from_files(spark, files, options.pattern)
        source.watch = Observation("lines") if few else None
        writers.write(query(options.query, source, ordered=True), options.format, out, at_once=few)
        out.flush()
        n = 0 if options.quiet else source.watch.get.get("skipped", 0) if few else source.skipped()
    finally:
        for path in set(files).difference(options.files):
            os.unlink(path)
    if n:
        tail = f" that the pattern for {', '.join(f for f, _ in source.pattern.names)} does not match" if source.pattern else ""
        err.write(f"logspark: skipped {n} malformed line{'s' * (n != 1)}{tail}\n")
    return 0


def _follow(options: Options, out) -> int:
    from .streaming.follow import follow

    if options.format == "table":
        sink = writers.GrowingTable(out).write
    else:
        sink = lambda columns, rows: (writers.WRITERS[options.format](columns, rows, out), out.flush())
    stream = follow(session(), options.query, options.files[0], sink, options.pattern)
    while stream.isActive and not stream.limit_reached.wait(0.2):
        pass
    stream.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
