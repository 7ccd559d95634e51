"""The aggregates. All skip missing values; all but the distinct count are partial aggregates of constant size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Cell, canon, cmpnum, kind_of, num, part


def build(name: str, c: Cell | None, seq: str) -> tuple[Column, str]:
    """(aggregate column, kind of its result). seq names the column of input order, for first, last and mixed kinds."""
    if c is None:
        return F.count(F.lit(1)), "count"
    if name == "count":
        return (F.lit(0).cast("bigint") if c.kind == "missing" else F.count(c.col)), "count"
    if name == "count_distinct":
        if c.kind in ("array", "object"):
            return F.count_distinct(F.to_json(c.col)), "count"
        return F.count_distinct(canon(c)), "count"
    if name in ("sum", "avg"):
        total = (F.sum if name == "sum" else F.avg)(num(c))
        return F.when(~F.isnan(total) & (F.abs(total) != float("inf")), total), "num"
    if name in ("first", "last"):
        by = (F.min_by if name == "first" else F.max_by)(c.col, F.when(c.col.isNotNull(), F.col(seq)))
        return by, c.kind
    if c.kind != "dyn":
        return (F.min if name == "min" else F.max)(c.col), c.kind
    return _extreme(name, c, seq), "dyn"


def _extreme(name: str, c: Cell, seq: str) -> Column:
    """min and max of values of any kinds.

    Values are compared as the first of them can be: as numbers if it is a number, a boolean, or a text that spells a number
    among others that are numbers; as texts if it is another text or all are texts; a first null, array or object stays. So the
    result is exact where a column is of one kind, and where numbers are mixed with their spellings in one order,
    without holding a group's values.
    """
    pick = F.min_by if name == "min" else F.max_by
    k, v = kind_of(c), c.col
    present = F.when(v.isNotNull(), F.col(seq))
    text = part(c, "str")
    spelled = cmpnum(text)
    number = F.coalesce(part(c, "num"), part(c, "bool").cast("int").cast("double"), spelled)
    first_kind, first, numeric_text = F.min_by(k, present), F.min_by(v, present), F.min_by(spelled.isNotNull(), present)
    has_numbers = F.coalesce(F.max(k.isin("num", "bool")), F.lit(False))
    # Of equal values the earliest stays.
    order = (lambda x: F.struct(x, F.col(seq))) if name == "min" else (lambda x: F.struct(x, -F.col(seq)))
    numeric = pick(v, F.when(number.isNotNull(), order(number)))
    textual = pick(v, F.when(text.isNotNull(), order(text)))
    as_number = first_kind.isin("num", "bool") | (first_kind == "str") & numeric_text & has_numbers
    return F.when(as_number, numeric).when(first_kind == "str", textual).otherwise(first)
