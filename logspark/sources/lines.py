"""Log lines: JSON, logfmt, or text read with a pattern. Each line becomes one variant record."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .patterns import Pattern

#: The record, the line, and whether it holds a record.
RECORD, LINE, GOOD = "__record", "__line", "__good"
#: key, an optional value that is quoted or bare.
PAIR = r'(?U)([^\s=]+)(=("(?:[^"\\]|\\.)*"|[^\s]*))?'
WHOLE = r"^[+-]?[0-9]{1,18}$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Numbers that may be too large for a double.
LARGE = r"[0-9.]+[eE][+]?[0-9]{3,}|[0-9]{309,}"
MAYBE_LARGE = r"[eE][+]?[0-9]{3}|[0-9]{309}"
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


@dataclass
class LogLines:
    """Lines with a column `value`; what is read of a record are the fields that a query names."""

    lines: DataFrame
    pattern: Pattern | None = None
    #: Counts the lines that are neither records nor blank, while a query reads them.
    watch: Observation | None = None

    def parsed(self, names: Collection[str] | None = None) -> DataFrame:
        """RECORD, a variant with the fields of those names at least (all, if none are given), and GOOD."""
        value = F.col("value")
        raw = F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.char_length(value) - 1)).otherwise(value)
        # Lines that are no UTF-8 are malformed.
        df = self.lines.select(F.when(F.is_valid_utf8(raw), raw).alias(LINE), *[c for c in self.lines.columns if c != "value"])
        line = F.col(LINE)
        if self.pattern:
            record = F.when(line.rlike(self.pattern.java), F.to_variant_object(self.pattern.captures(line, names)))
        else:
            df = df.withColumn(LINE, F.when(line.startswith("{") & line.endswith("}"), line).otherwise(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")))
            json, other = line.startswith("{"), F.to_variant_object(_typed(_pairs(line), names))
            record = F.when(json, F.when(~_too_large(line), F.try_parse_json(line))).otherwise(other)
        # A generator's output is worked out once: filters on the record are not moved below it, to parse again.
        df = df.select("*", F.explode(F.array(F.struct(record.alias("r")))).alias("__one"))
        df = df.select("*", F.col("__one.r").alias(RECORD)).drop("__one")
        return df.withColumn(GOOD, F.col(RECORD).isNotNull())

    def records(self, names: Collection[str] | None = None) -> DataFrame:
        df = self.parsed(names)
        if self.watch is not None:
            df = df.observe(self.watch, F.count_if(self._bad()).alias("skipped"))
        return df.where(GOOD).drop(GOOD)

    def _bad(self) -> Column:
        # Lines that are no UTF-8 are NULL by now.
        return ~F.col(GOOD) & ~F.coalesce(F.regexp_replace(LINE, r"(?U)\s+", "") == "", F.lit(False))

    def field(self, path: tuple[str, ...]) -> Column:
        """A field as a variant; NULL where it is missing."""
        return variant_walk(F.col(RECORD), path, top=True)

    def skipped(self) -> int:
        """How many lines are neither records nor blank."""
        return self.parsed(()).where(self._bad()).count()

    def keys(self, df: DataFrame) -> list[str]:
        """Top-level keys in the order in which they first appear."""
        if LINE not in df.columns:
            return []
        if self.pattern:
            json = self.pattern.to_json(F.col(LINE))
        else:
            json = F.when(F.col(LINE).startswith("{"), F.col(LINE)).otherwise(pairs_json(_pairs(F.col(LINE))))
        found = df.select(F.monotonically_increasing_id().alias("s"), F.posexplode(F.json_object_keys(json)).alias("p", "key"))
        first = found.groupBy("key").agg(F.min(F.struct("s", "p")).alias("at"))
        return [r.key for r in first.orderBy("at").collect()]


def _too_large(json: Column) -> Column:
    """Whether a JSON text holds a number that no double holds. Texts in it are set aside first."""
    numbers = F.regexp_extract_all(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', '""'), F.lit(LARGE), F.lit(0))
    return F.when(json.rlike(MAYBE_LARGE), F.exists(numbers, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)) == float("inf"))).otherwise(F.lit(False))


def variant_walk(col: Column, path: tuple[str, ...], top: bool = False) -> Column:
    """A number in a path is an index where it meets an array, and a key elsewhere."""
    if not path:
        return col
    if any(_quoted(x) is None for x in path):  # a key that the path language can not spell
        own = F.try_element_at(F.try_variant_get(col, "$", "map<string,variant>"), F.lit(path[0]))
        return variant_walk(own, path[1:])
    spelled = ["$"]
    for i, segment in enumerate(path):
        steps = [f"[{_quoted(segment)}]"]
        if segment.isdigit() and not (top and i == 0):
            steps.insert(0, f"[{int(segment)}]")
        spelled = [s + t for s in spelled for t in steps]
    found = [F.try_variant_get(col, s, "variant") for s in spelled]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def _quoted(key: str) -> str | None:
    if not key or "?" in key:
        return None
    return f'"{key}"' if '"' not in key else f"'{key}'" if "'" not in key else None


def from_files(spark: SparkSession, paths: list[str], pattern: str | None = None) -> LogLines:
    """Files in order, as one stream: a scan for each, whose union keeps their order."""
    parts = [spark.read.option("lineSep", "\n").text(p) for p in paths]
    while len(parts) > 1:  # by halves, so that the plan of many files is not deep
        parts = [parts[i].unionAll(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return LogLines(parts[0], Pattern.compile(pattern) if pattern else None)


def from_lines(lines: DataFrame, pattern: str | None = None) -> LogLines:
    """lines: a DataFrame with a string column `value`."""
    return LogLines(lines, Pattern.compile(pattern) if pattern else None)


def bare_value(value: Column) -> Column:
    """An unquoted value as a variant: null, booleans and numbers are typed, all else is text."""
    number = value.try_cast("double")
    return (
        F.when(value.isin("", "null"), F.parse_json(F.lit("null")))
        .when(value.isin("true", "false"), value.try_cast("boolean").cast("variant"))
        .when(value.rlike(WHOLE), value.try_cast("bigint").cast("variant"))
        .when(value.rlike(FLOAT) & (F.abs(number) != float("inf")), F.when(value.rlike(JSON_NUMBER), F.try_parse_json(value)).otherwise(number.cast("variant")))
        .otherwise(value.cast("variant"))
    )


def bare_json(value: Column) -> Column:
    """The JSON fragment of an unquoted value: null, booleans and numbers are typed, all else is text."""
    plain = F.regexp_replace(value, r"^\+", "")
    whole = F.when(value.rlike(WHOLE), value.try_cast("bigint").cast("string"))
    number = F.when(value.rlike(FLOAT), value.try_cast("double"))
    spelled = F.when(plain.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), plain).otherwise(number.cast("string"))
    return (
        F.when(value.isin("", "null"), F.lit("null"))
        .when(value.isin("true", "false"), value)
        .when(whole.isNotNull(), whole)
        .when(number.isNotNull() & (F.abs(number) != float("inf")), spelled)
        .otherwise(json_string(value))
    )


def json_string(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _unquoted(quoted: Column) -> Column:
    """The text of a quoted logfmt value: five escapes are known, other pairs are kept."""
    inner = F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
    marked = F.replace(inner, F.lit("\\\\"), F.lit("\x01"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return F.replace(marked, F.lit("\x01"), F.lit("\\"))


def _pairs(text: Column) -> Column:
    """The pairs of a logfmt line; NULL if it has none, or a quote that is not closed."""
    tokens = F.regexp_extract_all(text, F.lit(PAIR), F.lit(0))
    usable = F.filter(tokens, lambda t: ~t.startswith("="))
    open_quote = F.exists(tokens, lambda t: t.contains('="') & t.rlike(r'^[^=]*="') & ~t.rlike(r'(?s)^[^=]*="(?:[^"\\]|\\.)*"$'))
    return F.when(text.contains("=") & F.exists(usable, lambda t: F.instr(t, "=") > 0) & ~open_quote, usable)


def _typed(pairs: Column, names: Collection[str] | None) -> Column:
    """Pairs as a map to variants, those of some names only if they are given."""
    if names is not None:
        wanted = sorted(n for n in names if n and "=" not in n)
        pairs = F.filter(pairs, lambda t: F.substring_index(t, "=", 1).isin(wanted)) if wanted else F.slice(pairs, 1, 0)

    def entry(t: Column) -> Column:
        at = F.instr(t, "=")
        value = F.substring(t, at + 1, F.char_length(t))
        typed = F.when(at == 0, F.lit(True).cast("variant")).when(value.startswith('"'), _unquoted(value).cast("variant")).otherwise(bare_value(value))
        return F.struct(F.substring_index(t, "=", 1).alias("key"), typed.alias("value"))

    return F.map_from_entries(F.transform(pairs, entry))


def pairs_json(pairs: Column) -> Column:
    def pair(t: Column) -> Column:
        at = F.instr(t, "=")
        key = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
        value = F.substring(t, at + 1, F.char_length(t))
        json = F.when(at == 0, F.lit("true")).when(value.startswith('"'), json_string(_unquoted(value))).otherwise(bare_json(value))
        return F.concat(json_string(key), F.lit(":"), json)

    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, pair), ","), F.lit("}"))
