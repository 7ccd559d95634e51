"""Patterns of plain-text lines: validated here, matched by java.util.regex.

The dialect: literals, `.`, classes, `\\d \\D \\w \\W \\s \\S`, `* + ? {m,n}` and their lazy forms, alternation, groups,
`^ $`, `\\xHH`; groups that are named, `(?<n>)`, `(?P<n>)` or `(?'n')`, become fields. Look-around,
back-references and possessive repeats are no part of it.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PatternError

_CLASSES = {"d": "0-9", "w": r"\p{L}\p{N}_", "s": r"\s\x{85}\x{A0}\p{Z}"}
_PLAIN = {"n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f", "v": r"\x0B", "0": r"\x00"}


@dataclass(frozen=True)
class Pattern:
    text: str
    java: str
    names: tuple[tuple[str, int], ...]  # field, number of its group

    @staticmethod
    def compile(text: str) -> Pattern:
        t = _Translator(text)
        return Pattern(text, t.run(), tuple(t.names))

    def captures(self, line: Column, names: Collection[str] | None) -> Column:
        """The captures of the first match, those of some names only if they are given, as a map to variants."""
        from .lines import bare_value

        own = [(name, number) for name, number in self.names if names is None or name in names]
        got = [F.regexp_extract(line, self.java, number) for _, number in own]
        got = [F.when(g != "", g) if number in _optional(self.text) else g for g, (_, number) in zip(got, own, strict=True)]
        if not own:
            return F.create_map().cast("map<string,variant>")
        entries = F.transform(
            F.array(*[F.struct(F.lit(name).alias("key"), g.alias("text")) for (name, _), g in zip(own, got, strict=True)]),
            lambda x: F.when(x["text"].isNotNull(), F.struct(x["key"].alias("key"), bare_value(x["text"]).alias("value"))),
        )
        return F.map_from_entries(F.array_compact(entries))

    def to_json(self, line: Column) -> Column:
        """The captures of the first match as JSON text; NULL where nothing matches.

        An empty capture of a group that has to take part is null; one of a group that need not is left out.
        """
        from .lines import bare_json, json_string

        pairs = []
        for name, number in self.names:
            got = F.regexp_extract(line, self.java, number)
            pair = F.concat(json_string(F.lit(name)), F.lit(":"), bare_json(got))
            pairs.append(F.when(got != "", pair) if number in _optional(self.text) else pair)
        body = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))
        return F.when(line.rlike(self.java), body)


def _optional(text: str) -> set[int]:
    """Numbers of groups that a match need not pass: those under a branch of several or under ?, * or {0,}."""
    stack, out, number, i = [], set(), 0, 0
    groups: list[tuple[int, int, int]] = []  # number, start, end
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i += 2 if text[i + 1 : i + 2] != "^" else 3
            while i < len(text) and text[i] != "]":
                i += 2 if text[i] == "\\" else 1
        elif c == "(":
            capturing = not text.startswith("(?:", i)
            number += capturing
            stack.append((number if capturing else 0, i))
        elif c == ")" and stack:
            own, start = stack.pop()
            follows = text[i + 1 : i + 3]
            groups.append((own, start, i))
            if follows[:1] in ("?", "*") or re.match(r"\{0?,", text[i + 1 :]) or "|" in _level(text, start, i):
                inner = {g for g, s, e in groups if s >= start and g}
                branch = "|" in _level(text, start, i)
                loose = follows[:1] in ("?", "*") or bool(re.match(r"\{0?,", text[i + 1 :]))
                out |= {g for g in inner if g != own or loose} if branch or loose else set()
        i += 1
    if "|" in _level(text, -1, len(text)):
        out |= {g for g, _, _ in groups if g}
    return out


def _level(text: str, start: int, end: int) -> str:
    """What stands directly in a group, without inner groups, classes and escapes."""
    out, depth, i = [], 0, start + 1
    while i < end:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i += 2 if text[i + 1 : i + 2] != "^" else 3
            while i < end and text[i] != "]":
                i += 2 if text[i] == "\\" else 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0:
            out.append(c)
        i += 1
    return "".join(out)


class _Translator:
    def __init__(self, text: str):
        self.text, self.i, self.groups = text, 0, 0
        self.names: list[tuple[str, int]] = []

    def fail(self, message: str, at: int | None = None):
        raise PatternError(message, (self.i if at is None else at) + 1, self.text)

    def peek(self, n: int = 1) -> str:
        return self.text[self.i : self.i + n]

    def run(self) -> str:
        out = self.branches()
        if self.i < len(self.text):
            self.fail("`)` closes no group")
        if not self.names:
            self.fail("a pattern needs a named group, such as (?<name>...)", 0)
        return out

    def branches(self) -> str:
        out = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            out.append(self.sequence())
        return "|".join(out)

    def sequence(self) -> str:
        out = []
        while self.i < len(self.text) and self.peek() not in ("|", ")"):
            start = self.i
            atom = self.atom()
            out.append(atom + self.repeat(start, atom in ("^", r"\z")))
        return "".join(out)

    def repeat(self, start: int, anchor: bool) -> str:
        m = re.compile(r"[*+?]|\{(\d+)(,(\d*))?\}").match(self.text, self.i)
        if not m:
            return ""
        if anchor:
            self.fail("an anchor can not be repeated", start)
        if m[1] and m[3] and int(m[3]) < int(m[1]):
            self.fail("a repeat's bounds are in the wrong order")
        self.i = m.end()
        lazy = ""
        if self.peek() == "?":
            lazy = "?"
            self.i += 1
        elif self.peek() in ("+", "*"):
            self.fail("a repeat of a repeat")
        return m.group() + lazy

    def atom(self) -> str:
        c, start = self.peek(), self.i
        if c == "(":
            return self.group()
        if c == "[":
            return self.klass()
        if c == "\\":
            return self.escape(False)
        if c in "*+?":
            self.fail("nothing to repeat")
        self.i += 1
        if c == ".":
            return r"[^\n]"
        if c == "$":
            return r"\z"
        if c == "^":
            return "^"
        return "\\" + c if c in "{}]&-" else c

    def group(self) -> str:
        start = self.i
        self.i += 1
        opened = "("
        if self.peek(2) == "?:":
            self.i += 2
            opened = "(?:"
        elif self.peek() == "?":
            m = re.compile(r"\?(?:P?<(?P<a>[^>=!]*)>|'(?P<b>[^']*)')").match(self.text, self.i)
            if not m:
                self.fail("only named and plain groups are known", start)
            name = m["a"] if m["a"] is not None else m["b"]
            if not re.fullmatch(r"[^\W\d][\w.]*", name):
                self.fail(f"`{name}` is no name of a group", start)
            if any(n == name for n, _ in self.names):
                self.fail(f"two groups are named `{name}`", start)
            self.i = m.end()
            self.groups += 1
            self.names.append((name, self.groups))
        else:
            self.groups += 1
        inner = self.branches()
        if self.peek() != ")":
            self.fail("this group is not closed", start)
        self.i += 1
        return f"{opened}{inner})"

    def escape(self, inside: bool) -> str:
        c = self.text[self.i + 1 : self.i + 2]
        if not c:
            self.fail("a backslash at the end")
        if c == "x":
            m = re.compile(r"[0-9A-Fa-f]{2}").match(self.text, self.i + 2)
            if not m:
                self.fail("\\x takes two hexadecimal digits")
            self.i += 4
            return f"\\x{m.group()}"
        self.i += 2
        if c.lower() in _CLASSES:
            body = _CLASSES[c.lower()]
            return (f"[^{body}]" if c.isupper() else f"[{body}]") if not inside or c.isupper() else body
        if c in _PLAIN:
            return _PLAIN[c]
        if c.isalnum():
            self.i -= 2
            self.fail(f"`\\{c}` has no meaning in a pattern")
        return "\\" + c

    def klass(self) -> str:
        start = self.i
        self.i += 1
        out = "["
        if self.peek() == "^":
            out += "^"
            self.i += 1
        first = True
        while True:
            c = self.peek()
            if not c:
                self.fail("this class is not closed", start)
            if c == "]" and not first:
                self.i += 1
                return out + "]"
            first = False
            if c == "\\":
                out += self.escape(True)
            else:
                self.i += 1
                out += "\\" + c if c in "[]&^" else c
