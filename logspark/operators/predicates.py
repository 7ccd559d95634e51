"""Conditions as boolean columns.

In a filter NULL counts as false, so a condition in positive place needs no wrapping, and Catalyst can push it into
the scan. Only the operand of `not` is made two-valued. `not` moves through `and` and `or`, never through a comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Cell, as_static, boolview, cmpnum, epoch, kind_of, txt
from ..plans.nodes import Literal

_OPS = {
    "=": lambda x, y: x == y,
    "!=": lambda x, y: x != y,
    "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y,
    ">": lambda x, y: x > y,
    ">=": lambda x, y: x >= y,
}
DYN_KINDS = ("str", "num", "bool", "null", "array", "object")
#: What kinds of a dyn value can be compared with a value of a known kind.
COMPARABLE = {"num": ("num", "str", "bool"), "str": ("str", "num", "bool"), "bool": ("bool", "num", "str"), "null": ("null",), "array": ("array",), "object": ("object",), "time": ("num", "str")}


def _pair(op: str, a: Cell, b: Cell, x: Column | None, y: Column | None) -> Column:
    """Compares two views; where either is NULL although its cell is present, the pair is incomparable."""
    if x is None or y is None:  # never comparable
        return (a.present & b.present) if op == "!=" else F.lit(False)
    if op == "!=":
        plain = _OPS[op](x, y)
        return plain if x is a.col and y is b.col else a.present & b.present & F.coalesce(plain, F.lit(True))
    return _OPS[op](x, y)


def compare(op: str, a: Cell, b: Cell) -> Column:
    if "missing" in (a.kind, b.kind):
        return F.lit(False)
    if a.kind == "dyn":
        return _by_kind(op, a, COMPARABLE.get(b.kind, DYN_KINDS), b)
    if b.kind == "dyn":
        flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        return compare(flipped, b, a)
    kinds = (a.kind, b.kind)
    if kinds == ("null", "null"):
        same = a.present & b.present
        return same if op == "=" else F.lit(False)
    if "null" in kinds:
        return _pair(op, a, b, None, None)
    if kinds in (("array", "array"), ("object", "object")):
        if op not in ("=", "!="):
            return F.lit(False)
        text = lambda c: c.col if c.json else F.to_json(c.col)
        return _pair(op, a, b, text(a), text(b))
    if a.kind == b.kind:
        return _pair(op, a, b, a.col, b.col)
    view = _shared_view(a, b)
    return _pair(op, a, b, *view)


def _shared_view(a: Cell, b: Cell) -> tuple[Column | None, Column | None]:
    kinds = {a.kind, b.kind}

    def number(c: Cell) -> Column:
        return cmpnum(c.col) if c.kind == "str" else c.col.cast("int").cast("double") if c.kind == "bool" else c.col

    if kinds in ({"str", "num"}, {"bool", "num"}):
        return number(a), number(b)
    if kinds == {"bool", "str"}:
        return (boolview(a.col) if a.kind == "str" else a.col), (boolview(b.col) if b.kind == "str" else b.col)
    if "time" in kinds and kinds & {"num", "str"}:
        return epoch(a), epoch(b)
    return None, None


def _by_kind(op: str, a: Cell, kinds: tuple[str, ...], b: Cell) -> Column:
    own = kind_of(a)
    whens = [(own == k, compare(op, as_static(a, k), b)) for k in kinds]
    out = F.when(*whens[0])
    for w in whens[1:]:
        out = out.when(*w)
    return out.otherwise(a.present & b.present) if op == "!=" else out


def truthy(c: Cell) -> Column:
    if c.kind in ("missing", "null"):
        return F.lit(False)
    if c.kind == "bool":
        return c.col
    if c.kind == "num":
        return c.col != 0
    if c.kind == "str":
        return F.char_length(c.col) > 0
    if c.kind == "array":
        return F.size(c.col) > 0
    if c.kind == "dyn":
        k = kind_of(c)
        number, text, flag = (as_static(c, x).col for x in ("num", "str", "bool"))
        return F.when(k == "num", number != 0).when(k == "str", F.char_length(text) > 0).when(k == "bool", flag).when(k.isin("array", "object"), ~F.to_json(c.col).isin("[]", "{}")).otherwise(F.lit(False))
    return c.present


def like(a: Cell, pattern: Cell, literal: Literal | None) -> Column:
    """Whole-text match in which only % is special; \\% and \\\\ escape."""
    text = txt(a)
    if literal is not None and literal.kind == "str":
        parts, now, i, p = [], "", 0, str(literal.value)
        while i < len(p):
            if p[i] == "\\" and p[i + 1 : i + 2] in ("%", "\\"):
                now += p[i + 1]
                i += 2
            elif p[i] == "%":
                parts.append(now)
                now = ""
                i += 1
            else:
                now += p[i]
                i += 1
        parts.append(now)
        return _match_parts(text, parts)
    p = txt(pattern)
    marked = F.replace(F.replace(p, F.lit("\\\\"), F.lit("\x01")), F.lit("\\%"), F.lit("\x02"))
    quoted = F.replace(F.replace(marked, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("%"), F.lit("\\E.*\\Q"))
    regex = F.concat(F.lit("(?s)^\\Q"), F.replace(F.replace(quoted, F.lit("\x01"), F.lit("\\")), F.lit("\x02"), F.lit("%")), F.lit("\\E$(?!\\n)"))
    return F.rlike(text, regex)


def _match_parts(text: Column, parts: list[str]) -> Column:
    """parts: what stands between the % signs. The plain shapes become comparisons that scans understand."""
    if len(parts) == 1:
        return text == parts[0]
    head, *middle, tail = parts
    middle = [m for m in middle if m]
    if not middle:
        tests = ([text.startswith(head)] if head else []) + ([text.endswith(tail)] if tail else [])
        if head and tail:
            tests.append(F.char_length(text) >= len(head) + len(tail))
        return reduce(lambda x, y: x & y, tests) if tests else F.when(text.isNotNull(), True)
    if len(middle) == 1 and not head and not tail:
        return text.contains(middle[0])
    escaped = lambda s: s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.like("%".join([escaped(head), *map(escaped, middle), escaped(tail)]))
