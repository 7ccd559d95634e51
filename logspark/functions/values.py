"""Values of a query as Spark columns, with what is known of their kind while compiling.

A Cell's kind is one of num, str, bool, null, time, array, object, missing, or dyn. A dyn cell is a VARIANT whose kind is
known per row only. SQL NULL stands for a missing value; null in the data is the variant null, or kind null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EDGE_BLANKS = r"(?U)^\s+|\s+$"


@dataclass(frozen=True)
class Cell:
    kind: str
    col: Column
    #: num only: whether the values come from data, whose spelling of whole floats is kept in text.
    computed: bool = True
    #: num only: whether the column is a whole-number type.
    whole: bool = False
    #: dyn only: plain columns of its views, worked out once a row and known by name.
    views: Callable[[str], Column] | None = None
    #: array and object only: whether the column is JSON text.
    json: bool = False

    @property
    def present(self) -> Column:
        return self.col.isNotNull() if self.kind != "missing" else F.lit(False)


def missing() -> Cell:
    return Cell("missing", F.lit(None).cast("string"))


def cell_of(col: Column, dtype: T.DataType) -> Cell:
    if isinstance(dtype, T.VariantType):
        return Cell("dyn", col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Cell("time", col)
    if isinstance(dtype, T.BooleanType):
        return Cell("bool", col)
    if isinstance(dtype, T.NumericType):
        return Cell("num", col, computed=False, whole=isinstance(dtype, T.IntegralType))
    if isinstance(dtype, T.ArrayType):
        return Cell("array", col)
    if isinstance(dtype, (T.StructType, T.MapType)):
        return Cell("object", col)
    return Cell("str", col if isinstance(dtype, T.StringType) else col.cast("string"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_BLANKS, "")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def strict(text: Column) -> Column:
    """A number if the whole text spells one: no blanks, no inf or nan, no overflow."""
    return F.when(text.rlike(NUMBER), finite(text.try_cast("double")))


def number_text(x: Column) -> Column:
    """Whole numbers up to 2^53 without a fraction; others as the shortest digits that read back."""
    plain = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    size = F.abs(x)
    return (
        F.when((x == F.floor(x)) & (size <= 2.0**53), x.cast("bigint").cast("string"))
        .when((size >= 1e-5) & (size < 1e16), plain)
        .otherwise(F.lower(x.cast("string")))
    )


# --- dyn -------------------------------------------------------------------------------------------

_KINDS = (
    ("STRING", "str"), ("BIGINT", "num"), ("DECIMAL", "num"), ("DOUBLE", "num"), ("BOOLEAN", "bool"), ("OBJECT", "object"), ("ARRAY", "array"),
    ("VOID", "null"), ("FLOAT", "num"), ("INT", "num"), ("SMALLINT", "num"), ("TINYINT", "num"),
)


def view(name: str, v: Column, schema: Column) -> Column:
    """A view of a variant and the text of its schema, both of them plain columns."""
    number = schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL")
    if name == "kind":
        composite = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
        scalar = F.when(schema == "STRING", "str").when(number, "num").when(schema == "BOOLEAN", "bool").when(schema == "VOID", "null")
        return F.coalesce(scalar, composite)
    if name == "num":
        return F.when(number, F.try_variant_get(v, "$", "double"))
    if name == "str":
        return F.when(schema == "STRING", F.try_variant_get(v, "$", "string"))
    if name == "bool":
        return F.when(schema == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    if name == "txt":
        whole = F.when(schema == "BIGINT", F.to_json(v)).when(number, number_spelled(F.try_variant_get(v, "$", "double")))
        return F.when(schema == "STRING", F.try_variant_get(v, "$", "string")).when(schema == "BOOLEAN", F.to_json(v)).otherwise(whole)
    # canon
    whole = F.concat(F.lit("n:"), F.to_json(v))
    return F.when(schema == "BIGINT", whole).when(number, F.concat(F.lit("f:"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(
        F.concat(view("kind", v, schema), F.lit(":"), F.to_json(v))
    )


def number_spelled(x: Column) -> Column:
    """A number that was written with a fraction or an exponent keeps a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(number_text(x))


def bound(c: Cell, body: Callable[[Cell], Column]) -> Column:
    """body of a dyn cell that is worked out once."""
    return body(c) if c.views else let(c.col, lambda v: body(Cell("dyn", v)))


def let(x: Column, body) -> Column:
    """body(x) with x worked out once, however often body mentions it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def kind_of(c: Cell) -> Column:
    """The kind of a dyn cell as text; NULL for missing."""
    if c.views:
        return c.views("kind")
    v = c.col
    names = F.create_map(*[F.lit(y) for pair in _KINDS for y in pair])
    return F.try_element_at(names, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def part(c: Cell, kind: str) -> Column:
    """A dyn cell as a plain column, where it is of that kind."""
    if c.views:
        return c.views(kind)
    spark_type = {"num": "double", "str": "string", "bool": "boolean"}[kind]
    return F.when(kind_of(c) == kind, F.try_variant_get(c.col, "$", spark_type))


def as_static(c: Cell, kind: str) -> Cell:
    """A dyn cell seen as that kind, missing elsewhere."""
    if kind in ("num", "str", "bool"):
        return Cell(kind, part(c, kind), computed=False)
    return Cell(kind, F.when(kind_of(c) == kind, F.to_json(c.col)), json=True)


def canon(c: Cell) -> Column:
    """What tells values apart as group keys and in count_distinct: kind and JSON text."""
    if c.kind != "dyn":
        return c.col
    return c.views("canon") if c.views else let(F.struct(c.col.alias("v"), F.schema_of_variant(c.col).alias("s")), lambda x: view("canon", x["v"], x["s"]))


# --- views ---------------------------------------------------------------------------------------------


def txt(c: Cell) -> Column:
    """Strings as they are, numbers and booleans as their JSON text; all else is missing."""
    if c.kind == "str":
        return c.col
    if c.kind == "bool":
        return c.col.cast("string")
    if c.kind == "num":
        return c.col.cast("string") if c.whole else number_text(c.col.cast("double"))
    if c.kind == "time":
        return time_text(epoch(c))
    if c.kind == "dyn":
        return c.views("txt") if c.views else let(F.struct(c.col.alias("v"), F.schema_of_variant(c.col).alias("s")), lambda x: view("txt", x["v"], x["s"]))
    return F.lit(None).cast("string")


def json_text(v: Column) -> Column:
    """A variant as JSON; a number that was written with a fraction keeps one."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("DECIMAL") | (s == "DOUBLE"), txt(Cell("dyn", v))).otherwise(F.to_json(v))


def _num_of_text(text: Column) -> Column:
    t = trimmed(text)
    return F.coalesce(strict(t), strict(F.regexp_extract(t, r"^[0-9.+-]*", 0)))


def num(c: Cell) -> Column:
    """Numbers; booleans as 1 and 0; of text all, or else the leading digits, signs and points."""
    if c.kind == "num":
        return c.col.cast("double")
    if c.kind == "bool":
        return c.col.cast("int").cast("double")
    if c.kind == "str":
        return _num_of_text(c.col)
    if c.kind == "time":
        return epoch(c)
    if c.kind == "dyn":
        return bound(c, lambda d: F.coalesce(part(d, "num"), part(d, "bool").cast("int").cast("double"), let(part(d, "str"), _num_of_text)))
    return F.lit(None).cast("double")


def cmpnum(text: Column) -> Column:
    return strict(trimmed(text))


def boolview(text: Column) -> Column:
    t = F.lower(trimmed(text))
    return F.when(t == "true", True).when(t == "false", False)


# --- time ---------------------------------------------------------------------------------------------------

_DATE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(?:([Zz])|([+-])([0-9]{2}):?([0-9]{2})?)?)?$"


def epoch_of_text(text: Column) -> Column:
    """Seconds since 1970 of an RFC 3339 text; a day of the month beyond the month's end rolls over."""
    return let(trimmed(text), _epoch_of_trimmed)


def _epoch_of_trimmed(t: Column) -> Column:
    part_of = lambda i: F.regexp_extract(t, _DATE, i)
    whole = lambda i: F.when(part_of(i) == "", 0).otherwise(part_of(i).try_cast("int"))
    year, month, day = part_of(1).try_cast("int"), part_of(2).try_cast("int"), part_of(3).try_cast("int")
    hour, minute, second = whole(4), whole(5), whole(6)
    inside = month.between(1, 12) & (year >= 1)
    first = F.when(inside, F.make_date(F.greatest(year, F.lit(1)), F.greatest(F.least(month, F.lit(12)), F.lit(1)), F.lit(1)))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1
    fraction = F.when(part_of(7) == "", 0.0).otherwise(F.concat(F.lit("0."), part_of(7)).try_cast("double"))
    offset = (whole(10) * 60 + whole(11)) * 60 * F.when(part_of(9) == "-", -1).otherwise(1)
    ok = t.rlike(_DATE) & day.between(1, 31) & month.between(1, 12) & (hour <= 23) & (minute <= 59)
    seconds = (days.cast("bigint") * 86400 + hour * 3600 + minute * 60 + F.least(second, F.lit(60)) - offset).cast("double")
    return F.when(ok, seconds + fraction)


def rescaled(x: Column) -> Column:
    """Numbers of 1e11 and more are milliseconds."""
    return F.when(F.abs(x) >= 1e11, x / 1000).otherwise(x)


def _text_epoch(text: Column) -> Column:
    return F.coalesce(epoch_of_text(text), rescaled(cmpnum(text)))


def epoch(c: Cell) -> Column:
    if c.kind == "time":
        return F.unix_micros(c.col.cast("timestamp")) / F.lit(1e6)
    if c.kind == "num":
        return rescaled(c.col.cast("double"))
    if c.kind == "str":
        return let(c.col, _text_epoch)
    if c.kind == "dyn":
        return bound(c, lambda d: F.coalesce(rescaled(part(d, "num")), let(part(d, "str"), _text_epoch)))
    return F.lit(None).cast("double")


def time_text(seconds: Column, offset_minutes: Column | int = 0) -> Column:
    """RFC 3339, with milliseconds only if there are any; offset 0 is Z."""
    minutes = F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes
    ms = F.round((seconds + minutes * 60) * 1000).cast("bigint")
    at = F.timestamp_micros(ms * 1000)
    body = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    milli = F.pmod(ms, F.lit(1000))
    tail = F.when(milli == 0, "").otherwise(F.concat(F.lit("."), F.lpad(milli.cast("string"), 3, "0")))
    size = F.abs(minutes)
    zone = F.when(minutes == 0, "Z").otherwise(
        F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("int").cast("string"), 2, "0"))
    )
    return F.when(F.abs(seconds) < 2.5e11, F.concat(body, tail, zone))
