"""The syntax tree to DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates, scalar
from ..functions.values import Cell, canon, cell_of, kind_of, missing, number_text, part, view
from ..operators.predicates import compare, like, truthy
from ..sources.lines import LogLines, variant_walk
from . import nodes as N

SEQ, FIELDS = "__seq", "__fields"


class Fields:
    """The fields of log records that a query names, and the views of them that it needs."""

    def __init__(self, field: Callable[[tuple[str, ...]], Column]):
        self.field = field
        self.paths: dict[tuple[str, ...], dict[str, None]] = {}

    def cell(self, path: tuple[str, ...]) -> Cell:
        views = self.paths.setdefault(path, {})
        number = list(self.paths).index(path)

        def named(name: str) -> Column:
            views[name] = None
            return F.col(f"{FIELDS}.{name}{number}")

        return Cell("dyn", F.col(f"{FIELDS}.v{number}"), views=named)

    def attach(self, df: DataFrame) -> DataFrame:
        """df with FIELDS. What a generator gives is worked out once: filters are not moved below it, to work it out again."""
        if not self.paths:
            return df
        own = {f"__v{i}": self.field(p) for i, p in enumerate(self.paths)}
        schemas = {f"__s{i}": F.schema_of_variant(f"__v{i}") for i, views in enumerate(self.paths.values()) if views}
        parts = [F.col(f"__v{i}").alias(f"v{i}") for i in range(len(self.paths))]
        parts += [view(name, F.col(f"__v{i}"), F.col(f"__s{i}")).alias(f"{name}{i}") for i, views in enumerate(self.paths.values()) for name in views]
        df = df.select("*", *[c.alias(n) for n, c in own.items()])
        df = df.select("*", *[c.alias(n) for n, c in schemas.items()])
        return df.select(*[c for c in df.columns if c not in own and c not in schemas], F.explode(F.array(F.struct(*parts))).alias(FIELDS))


@dataclass
class Scope:
    """What names mean: the columns of a typed table, or the fields of log records, or the results of a grouping."""

    schema: T.StructType
    fields: Fields | None = None
    settled: dict[N.Value, Cell] = field(default_factory=dict)
    labels: dict[str, Cell] = field(default_factory=dict)
    grouped: bool = False

    def field(self, name: str) -> Cell:
        path = tuple(name.split("."))
        if self.grouped:
            return self.labels.get(name, missing())
        return self.fields.cell(path) if self.fields else self._table_field(path)

    def flat(self, text: str) -> Cell | None:
        """A top-level field whose very name is the text of an expression."""
        if self.grouped:
            return self.labels.get(text)
        if self.fields:
            return self.fields.cell((text,)) if "." in text or "(" in text else None
        return cell_of(F.col(f"`{text}`"), self.schema[text].dataType) if text in self.schema.names else None

    def _table_field(self, path: tuple[str, ...]) -> Cell:
        if path[0] not in self.schema.names:
            return missing()
        col, dtype = F.col(f"`{path[0]}`"), self.schema[path[0]].dataType
        for i, segment in enumerate(path[1:], 1):
            if isinstance(dtype, T.StructType) and segment in dtype.names:
                col, dtype = col[segment], dtype[segment].dataType
            elif isinstance(dtype, T.ArrayType) and segment.isdigit():
                col, dtype = F.get(col, F.lit(int(segment))), dtype.elementType
            elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
                col, dtype = F.try_element_at(col, F.lit(segment)), dtype.valueType
            elif isinstance(dtype, T.VariantType):
                return Cell("dyn", variant_walk(col, path[i:]))
            else:
                return missing()
        return cell_of(col, dtype)


class Compiler:
    def __init__(self, query: N.Query):
        self.query = query

    # -- values ---------------------------------------------------------------------

    def value(self, v: N.Value, scope: Scope) -> Cell:
        if v in scope.settled:
            return scope.settled[v]
        if isinstance(v, N.Field):
            return scope.field(v.text)
        if isinstance(v, N.Literal):
            return _literal(v)
        if isinstance(v, N.Sum):
            return scalar.add(v.op, self.value(v.left, scope), self.value(v.right, scope))
        if isinstance(v, N.Call):
            args = [self.value(a, scope) for a in v.args]
            if args and args[0].kind == "missing" and v.name not in ("coalesce", "concat"):
                return missing()
            return scalar.BUILDERS[v.name](*args)
        return missing()

    def projected(self, v: N.Value, scope: Scope) -> Cell:
        """As value(), but a top-level field named like the whole expression comes first."""
        own = self.value(v, scope)
        if isinstance(v, (N.Field, N.Call, N.Aggregate)) and v not in scope.settled:
            flat = scope.flat(N.render(v))
            if flat is not None:
                if own.kind == "missing" or flat.kind != "dyn":
                    return flat
                if own.kind == "dyn":
                    return Cell("dyn", F.coalesce(flat.col, own.col))
        return own

    # -- conditions --------------------------------------------------------------------

    def condition(self, c: N.Condition, scope: Scope, positive: bool = True) -> Column:
        if isinstance(c, N.Not):
            return self.condition(c.of, scope, not positive)
        if isinstance(c, (N.Both, N.Either)):
            left, right = self.condition(c.left, scope, positive), self.condition(c.right, scope, positive)
            return left & right if isinstance(c, N.Both) == positive else left | right
        plain = self._test(c, scope)
        return plain if positive else ~F.coalesce(plain, F.lit(False))

    def _test(self, c: N.Condition, scope: Scope) -> Column:
        if isinstance(c, N.Compare):
            return compare(c.op, self.value(c.left, scope), self.value(c.right, scope))
        if isinstance(c, N.Like):
            found = like(self.value(c.left, scope), self.value(c.right, scope), c.right if isinstance(c.right, N.Literal) else None)
            return ~found if c.negated else found
        return truthy(self.value(c.value, scope))

    # -- plans ----------------------------------------------------------------------------

    def compile(self, source: DataFrame | LogLines, ordered: bool) -> DataFrame:
        q = self.query
        lines = isinstance(source, LogLines)
        if lines:
            scope = Scope(T.StructType([]), Fields(source.field))
            self._name_fields(scope)
            df = source.records(None if q.items is None else {p[0] for p in scope.fields.paths})
            df = scope.fields.attach(df)
        else:
            df, scope = source, Scope(source.schema)
        if q.where is not None:
            df = df.where(self.condition(q.where, scope))
        # Numbered after the filter, which keeps the order and would not be pushed below the numbering.
        if self._needs_order(ordered):
            df = df.withColumn(SEQ, F.monotonically_increasing_id())
        if q.grouped:
            df, scope = self._group(df, scope)
            if q.having is not None:
                df = df.where(self.condition(q.having, scope))
        items = q.items
        if items is None:
            names = source.keys(df) if lines and not q.grouped else scope.schema.names
            items = tuple(N.Item(N.Field(n)) for n in names)
            cells = [(n, Cell("dyn", source.field((n,))) if lines else cell_of(F.col(f"`{n}`"), scope.schema[n].dataType)) for n in names]
        else:
            cells = [(i.label, self.projected(i.value, scope)) for i in items]
        out = _merged(cells)
        if q.order is not None:
            keys = self._order_keys(out, scope)
            df = df.orderBy(*keys, F.col(SEQ).asc())
        elif SEQ in df.columns and (q.grouped and (ordered or q.limit is not None)):
            df = df.orderBy(SEQ)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*[c.col.alias(n) for n, c in out])

    def _needs_order(self, ordered: bool) -> bool:
        q = self.query
        if q.order is not None or q.grouped and (ordered or q.limit is not None):
            return True
        found = [a for v in self._all_values() for a in N.aggregates_in(v)]
        return any(a.name in ("first", "last", "min", "max") for a in found)

    def _all_values(self) -> list[N.Value]:
        q = self.query
        return [*(i.value for i in q.items or ()), *([q.order] if q.order else []), *(N.values_in(q.having) if q.having else [])]

    def _name_fields(self, scope: Scope) -> None:
        """Builds all columns over records once, so that the scope knows which views are needed."""
        q = self.query
        if q.where is not None:
            self.condition(q.where, scope)
        if q.grouped:
            self._group_columns(scope)
        else:
            out = _merged([(i.label, self.projected(i.value, scope)) for i in q.items or ()])
            if q.order is not None:
                self._order_keys(out, scope)

    def _group_columns(self, scope: Scope):
        q = self.query
        keys = [(k, self.value(k.value, scope)) for k in q.keys]
        by, values = [], []
        for i, (_, c) in enumerate(keys):
            grouping = F.to_json(c.col) if c.kind in ("array", "object") else canon(c)
            by.append(grouping.alias(f"__k{i}"))
            if c.kind in ("dyn", "array", "object"):
                values.append(F.any_value(c.col).alias(f"__v{i}"))
        own = list(dict.fromkeys(a for v in self._all_values() for a in N.aggregates_in(v)))
        kinds = []
        for j, a in enumerate(own):
            col, kind = aggregates.build(a.name, None if a.arg is None else self.value(a.arg, scope), SEQ)
            values.append(col.alias(f"__a{j}"))
            kinds.append(kind)
        return keys, by, values, own, kinds

    def _group(self, df: DataFrame, scope: Scope) -> tuple[DataFrame, Scope]:
        keys, by, values, own, kinds = self._group_columns(scope)
        if SEQ in df.columns:
            values.append(F.min(SEQ).alias(SEQ))
        # A constant key: no records give no group, unlike a global aggregate.
        grouped = df.groupBy(*(by or [F.lit(1).alias("__one")])).agg(*(values or [F.count(F.lit(1)).alias("__n")]))
        after = Scope(grouped.schema, grouped=True)
        for i, (k, c) in enumerate(keys):
            name = f"__v{i}" if c.kind in ("dyn", "array", "object") else f"__k{i}"
            cell = Cell(c.kind, F.col(name), c.computed, c.whole)
            after.settled[k.value] = cell
            after.labels[N.render(k.value)] = cell
            after.labels[k.label] = cell
        for j, (a, kind) in enumerate(zip(own, kinds, strict=True)):
            source = None if a.arg is None else self.value(a.arg, scope)
            cell = Cell("num", F.col(f"__a{j}"), whole=True) if kind == "count" else Cell(kind, F.col(f"__a{j}"), source.computed if source else True, bool(source and source.whole and kind == source.kind and a.name not in ("sum", "avg")))
            after.settled[a] = cell
            after.labels[N.render(a)] = cell
        return grouped, after

    def _order_keys(self, out: list[tuple[str, Cell]], scope: Scope) -> list[Column]:
        q = self.query
        text = N.render(q.order)
        # A label that is the very field of that name needs no second look.
        found = [c for n, c in out if n == text and not (q.items is None or any(i.value == q.order and i.label == n for i in q.items))]
        if "." in text and (flat := scope.flat(text)) is not None or not isinstance(q.order, N.Field) and (flat := scope.flat(text)) is not None:
            found.append(flat)
        found.append(self.value(q.order, scope))
        found = [c for c in found if c.kind != "missing"] or [missing()]
        same = {c.kind for c in found}
        if len(same) == 1:
            cell = Cell(found[0].kind, F.coalesce(*[c.col for c in found])) if len(found) > 1 else found[0]
        else:
            cell = Cell("dyn", F.coalesce(*[scalar.to_variant(c) for c in found]))
        if cell.kind == "dyn":
            # Numbers, booleans and texts that spell numbers by number, then other texts, then the rest, then null.
            k = kind_of(cell)
            number = F.coalesce(part(cell, "num"), part(cell, "bool").cast("int").cast("double"))
            rank = F.when(number.isNotNull(), 0).when(k == "str", 1).when(k == "null", 3).when(cell.col.isNotNull(), 2)
            keys = [number, part(cell, "str")]
            first = rank.asc_nulls_last()
            return [first, *[(x.desc_nulls_last() if q.descending else x.asc_nulls_last()) for x in keys]]
        col = F.to_json(cell.col) if cell.kind in ("array", "object") else cell.col
        return [col.desc_nulls_last() if q.descending else col.asc_nulls_last()]


def _merged(cells: list[tuple[str, Cell]]) -> list[tuple[str, Cell]]:
    """One column for each label; of equal labels, a later present value wins."""
    out: dict[str, Cell] = {}
    for name, c in cells:
        if name in out and c.kind == "missing":
            continue
        if name in out and out[name].kind == c.kind:
            c = Cell(c.kind, F.coalesce(c.col, out[name].col), c.computed, c.whole)
        elif name in out and out[name].kind != "missing":
            c = Cell("dyn", F.coalesce(scalar.to_variant(c), scalar.to_variant(out[name])))
        out[name] = c
    return list(out.items())


def _literal(v: N.Literal) -> Cell:
    if v.kind == "str":
        return Cell("str", F.lit(v.value))
    if v.kind in ("num", "duration"):
        x = float(v.value)
        return Cell("num", F.lit(int(x)).cast("bigint"), whole=True) if x == int(x) and abs(x) <= 2**53 else Cell("num", F.lit(x))
    if v.kind == "bool":
        return Cell("bool", F.lit(bool(v.value)))
    return Cell("null", F.parse_json(F.lit("null")))


__all__ = ["SEQ", "Compiler", "Scope", "number_text"]
