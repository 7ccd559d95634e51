"""The scalar functions, as builders of columns from cells. A function of a missing first value is missing."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Cell, epoch, finite, kind_of, let, missing, num, part, strict, time_text, trimmed, txt


def _text(col: Column) -> Cell:
    return Cell("str", col)


def _number(col: Column) -> Cell:
    return Cell("num", col.cast("double"))


def _whole(col: Column) -> Cell:
    return Cell("num", col.cast("bigint"), whole=True)


def _len(v: Cell) -> Cell:
    if v.kind == "str":
        return _whole(F.char_length(v.col))
    if v.kind in ("array", "object"):
        return _whole(F.when(v.col.isNotNull(), F.size(v.col)))
    if v.kind == "dyn":
        k = kind_of(v)
        as_array = F.when(k == "array", F.try_variant_get(v.col, "$", "array<variant>"))
        as_map = F.when(k == "object", F.try_variant_get(v.col, "$", "map<string,variant>"))
        counted = lambda x: F.when(x.isNotNull(), F.size(x))
        return _whole(F.coalesce(F.char_length(part(v, "str")), counted(as_array), counted(as_map)))
    return Cell("num", F.lit(None).cast("bigint"), whole=True)


def _substr(v: Cell, start: Cell, count: Cell | None = None) -> Cell:
    text, size = txt(v), F.char_length(txt(v))
    s = _toward_zero(num(start))
    begin = F.when(s < 0, F.greatest(size + s, F.lit(0))).when(s >= 0, F.least(s, size))
    wanted = None if count is None else _toward_zero(num(count))
    taken = size - begin if count is None else F.when(wanted.isNotNull(), F.greatest(F.least(wanted, size - begin), F.lit(0)))
    return _text(F.substring(text, (begin + 1).cast("int"), taken.cast("int")))


def _toward_zero(x: Column) -> Column:
    """Truncated, and kept within what a text can be long."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when(x.isNotNull(), F.greatest(F.least(whole, F.lit(2**31 - 1)), F.lit(-(2**31 - 1)))).cast("bigint")


def _replace(v: Cell, old: Cell, new: Cell) -> Cell:
    text, a, b = txt(v), txt(old), txt(new)
    return _text(F.when(a.isNull() | b.isNull(), F.lit(None).cast("string")).when(a == "", text).otherwise(F.replace(text, a, b)))


def _concat(*args: Cell) -> Cell:
    texts = [txt(a) for a in args]
    return _text(F.when(F.coalesce(*texts).isNotNull(), F.concat_ws("", *texts)))


def _coalesce(*args: Cell) -> Cell:
    own = [a for a in args if a.kind not in ("missing", "null")]
    if not own:
        return missing()
    kinds = {a.kind for a in own}
    if len(kinds) == 1 and kinds != {"dyn"}:
        types_differ = kinds == {"num"} and len({a.whole for a in own}) > 1
        cols = [a.col.cast("double") if types_differ else a.col for a in own]
        return Cell(own[0].kind, F.coalesce(*cols), all(a.computed for a in own), own[0].whole and not types_differ)
    parts = []
    for a in own:
        v = a.col if a.kind == "dyn" else to_variant(a)
        parts.append(F.when(~F.is_variant_null(v), v) if a.kind == "dyn" else v)
    return Cell("dyn", F.coalesce(*parts))


def to_variant(a: Cell) -> Column:
    if a.kind == "dyn":
        return a.col
    if a.kind == "null":
        return F.parse_json(F.lit("null"))
    if a.kind == "missing":
        return F.try_parse_json(F.lit(None).cast("string"))
    return a.col.cast("variant")


def _round(v: Cell, places: Cell | None = None) -> Cell:
    x = num(v)
    if places is None:
        return _number(finite(F.round(x, 0)))
    wanted = _toward_zero(num(places))
    p = F.when(wanted.isNotNull(), F.least(F.greatest(wanted, F.lit(0)), F.lit(15))).cast("double")
    scale = F.pow(F.lit(10.0), p)
    return _number(finite(F.round(x * scale, 0) / scale))


_LENGTH = r"^([0-9]+(?:\.[0-9]+)?|\.[0-9]+)(ms|s|m|h|d)$"


def _duration_ms(v: Cell) -> Cell:
    def of_text(text: Column) -> Column:
        t = trimmed(text)
        unit = F.regexp_extract(t, _LENGTH, 2)
        scale = F.when(unit == "ms", 1.0).when(unit == "s", 1e3).when(unit == "m", 6e4).when(unit == "h", 3.6e6).when(unit == "d", 8.64e7)
        return F.coalesce(strict(t), F.when(t.rlike(_LENGTH), F.regexp_extract(t, _LENGTH, 1).try_cast("double") * scale))

    if v.kind == "num":
        out = v.col.cast("double")
    elif v.kind == "str":
        out = of_text(v.col)
    elif v.kind == "dyn":
        out = F.coalesce(part(v, "num"), of_text(part(v, "str")))
    else:
        out = F.lit(None).cast("double")
    return _number(F.when(out >= 0, out))


def _fixed_offset(name: str) -> int | None:
    if name.lower() in ("utc", "z", "gmt"):
        return 0
    if name.lower() == "local":
        return _fixed_offset(os.environ.get("TZ", "")) or 0
    m = re.fullmatch(r"([+-])(\d\d)(?::?(\d\d))?", name)
    if not m or int(m[2]) > 23 or int(m[3] or 0) > 59:
        return None
    return (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1)


def _format_time(v: Cell, zone: Cell | None = None) -> Cell:
    seconds = epoch(v)
    if zone is None:
        return _text(let(seconds, time_text) if v.kind in ("dyn", "str") else time_text(seconds))
    name = F.lower(trimmed(txt(zone)))
    shape = r"^([+-])([0-9]{2}):?([0-9]{2})?$"
    hours, rest = F.regexp_extract(name, shape, 2).try_cast("int"), F.coalesce(F.regexp_extract(name, shape, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(name, shape, 1) == "-", -1).otherwise(1)
    minutes = (
        F.when(name.isin("utc", "z", "gmt"), 0)
        .when(name == "local", _fixed_offset("local"))
        .when(name.rlike(shape) & (hours <= 23) & (rest <= 59), sign * (hours * 60 + rest))
    )
    return _text(let(F.struct(seconds.alias("s"), minutes.alias("m")), lambda x: F.when(x["m"].isNotNull(), time_text(x["s"], x["m"]))))


def _bucket(v: Cell, width: Cell) -> Cell:
    w = num(width)
    return _number(F.when(w > 0, F.floor(epoch(v) / F.when(w > 0, w)) * w))


def _bool(col: Column) -> Cell:
    return Cell("bool", col)


BUILDERS: dict[str, Callable[..., Cell]] = {
    "lower": lambda v: _text(F.lower(txt(v))),
    "upper": lambda v: _text(F.upper(txt(v))),
    "len": _len,
    "substr": _substr,
    "trim": lambda v: _text(trimmed(txt(v))),
    "contains": lambda v, n: _bool(F.contains(txt(v), txt(n))),
    "starts_with": lambda v, n: _bool(F.startswith(txt(v), txt(n))),
    "ends_with": lambda v, n: _bool(F.endswith(txt(v), txt(n))),
    "replace": _replace,
    "concat": _concat,
    "coalesce": _coalesce,
    "num": lambda v: _number(num(v)),
    "abs": lambda v: _number(F.abs(num(v))),
    "floor": lambda v: _number(F.when(F.abs(num(v)) < 2.0**53, F.floor(num(v)).cast("double")).otherwise(num(v))),
    "ceil": lambda v: _number(F.when(F.abs(num(v)) < 2.0**53, F.ceil(num(v)).cast("double")).otherwise(num(v))),
    "round": _round,
    "duration_ms": _duration_ms,
    "now": lambda: _number(F.unix_micros(F.current_timestamp()) / F.lit(1e6)),
    "ts": lambda v: _number(epoch(v)),
    "format_time": _format_time,
    "bucket": _bucket,
}


def add(op: str, a: Cell, b: Cell) -> Cell:
    x, y = num(a), num(b)
    return _number(finite(x + y if op == "+" else x - y))
