"""Errors that point at a place in a query or a pattern."""

from __future__ import annotations


class PlacedError(ValueError):
    """message, and the 1-based character column in text that it is about."""

    label = "error"

    def __init__(self, message: str, column: int, text: str):
        self.message, self.column, self.text = message, column, text
        super().__init__(self.render())

    def render(self) -> str:
        # Only the line that holds the column is shown; tabs are one character wide there.
        before = self.text[: self.column - 1]
        start = before.rfind("\n") + 1
        line = self.text[start:].split("\n", 1)[0].replace("\t", " ")
        return f"{self.label} at column {self.column}: {self.message}\n  {line}\n  {' ' * (self.column - 1 - start)}^"


class QueryError(PlacedError):
    label = "query error"


class PatternError(PlacedError):
    label = "pattern error"
