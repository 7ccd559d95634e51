"""The syntax tree, and the canonical text of its values."""

from __future__ import annotations

from dataclasses import dataclass


class Value:
    pass


@dataclass(frozen=True)
class Field(Value):
    text: str

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(self.text.split("."))


@dataclass(frozen=True)
class Literal(Value):
    kind: str  # str, num, duration, bool, null
    value: object = None


@dataclass(frozen=True)
class Call(Value):
    name: str
    args: tuple[Value, ...]


@dataclass(frozen=True)
class Aggregate(Value):
    name: str
    arg: Value | None  # None: *


@dataclass(frozen=True)
class Sum(Value):
    op: str
    left: Value
    right: Value


class Condition:
    pass


@dataclass(frozen=True)
class Compare(Condition):
    op: str
    left: Value
    right: Value


@dataclass(frozen=True)
class Like(Condition):
    negated: bool
    left: Value
    right: Value


@dataclass(frozen=True)
class Truth(Condition):
    value: Value


@dataclass(frozen=True)
class Not(Condition):
    of: Condition


@dataclass(frozen=True)
class Both(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Either(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Item:
    value: Value
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or render(self.value)


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...] | None  # None: *
    where: Condition | None = None
    keys: tuple[Item, ...] = ()
    having: Condition | None = None
    order: Value | None = None
    descending: bool = False
    limit: int | None = None

    @property
    def grouped(self) -> bool:
        return bool(self.keys) or self.having is not None or any(aggregates_in(i.value) for i in self.items or ()) or bool(self.order and aggregates_in(self.order))


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) <= 2**53 else repr(x)


def render(v: Value) -> str:
    if isinstance(v, Field):
        return v.text
    if isinstance(v, Literal):
        if v.kind == "str":
            return '"' + str(v.value).replace('"', '\\"') + '"'
        if v.kind == "num":
            return number_text(v.value)
        if v.kind == "duration":
            return number_text(v.value) + "s"
        return "null" if v.kind == "null" else str(v.value).lower()
    if isinstance(v, Call):
        return f"{v.name}({', '.join(map(render, v.args))})"
    if isinstance(v, Aggregate):
        return f"{v.name}({'*' if v.arg is None else render(v.arg)})"
    right = f"({render(v.right)})" if isinstance(v.right, Sum) else render(v.right)
    return f"{render(v.left)} {v.op} {right}"


def children(v: Value) -> tuple[Value, ...]:
    if isinstance(v, Call):
        return v.args
    if isinstance(v, Sum):
        return (v.left, v.right)
    return ()


def aggregates_in(v: Value) -> list[Aggregate]:
    if isinstance(v, Aggregate):
        return [v]
    return [a for c in children(v) for a in aggregates_in(c)]


def values_in(c: Condition) -> list[Value]:
    if isinstance(c, (Compare, Like)):
        return [c.left, c.right]
    if isinstance(c, Truth):
        return [c.value]
    if isinstance(c, Not):
        return values_in(c.of)
    return [*values_in(c.left), *values_in(c.right)]
