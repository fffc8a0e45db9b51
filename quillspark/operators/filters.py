"""Typed metadata filters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_literal

TEXT_OPERATORS = frozenset(("eq", "neq", "contains"))
ORDER_OPERATORS = frozenset(("eq", "gt", "gte", "lt", "lte", "range"))


@dataclass(frozen=True)
class Field:
    """A column that may be filtered: text, enum (members) or an ordered type."""

    kind: str
    members: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Filter:
    """P5: checked when made. Text and enums take eq, neq (any number of values) and, for text, contains; ordered columns take
    comparisons with one value and range with two, the smaller first. Times need a zone."""

    column: str
    operator: str
    values: tuple[Any, ...]
    field: Field

    def __post_init__(self) -> None:
        text, n = self.field.kind in ("text", "enum"), len(self.values)
        if self.operator not in (TEXT_OPERATORS if text else ORDER_OPERATORS) or self.operator == "contains" and self.field.kind == "enum":
            raise ValueError(f"{self.operator} does not go with {self.column}")
        if not n or self.operator == "range" and n != 2 or self.operator not in ("eq", "neq", "range") and n != 1 or not text and self.operator == "eq" and n != 1:
            raise ValueError(f"{self.operator} takes another number of values")
        if self.field.kind == "enum" and not set(self.values) <= self.field.members:
            raise ValueError(f"{self.column} has no such member")
        if any(isinstance(v, datetime) and v.tzinfo is None for v in self.values):
            raise ValueError("a time needs a zone")
        if self.operator == "range" and not self.values[0] < self.values[1]:
            raise ValueError("the range is empty")

    def condition(self) -> Column:
        c, v = F.col(self.column), self.values
        match self.operator:
            case "contains":
                return contains_literal(c, v[0])
            case "range":  # half open, so that neighbouring ranges share nothing
                return (c >= F.lit(v[0])) & (c < F.lit(v[1]))
            case "eq":
                return c.isin(*v)
            case "neq":  # null passes neither
                return ~c.isin(*v)
            case _:
                return getattr(c, {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}[self.operator])(F.lit(v[0]))


def compile_filters(filters: Iterable[Filter]) -> Column:
    """All of them hold."""
    return reduce(and_, (f.condition() for f in filters), F.lit(True))


def aliases(value: str, table: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """What a word stands for in a table of aliases, e.g. both spreadsheet types for one name."""
    found = table.get(value.strip().lower())
    if not found:
        raise ValueError(f"unknown value {value!r}")
    return found


def contradiction(filters: Iterable[Filter]) -> str | None:
    """The column whose filters no value can meet: enum members that exclude one another, or bounds that cross."""
    members: dict[str, set] = {}
    bounds: dict[str, list] = {}
    for f in filters:
        if f.field.kind == "enum":
            left = members.setdefault(f.column, set(f.field.members))
            left &= set(f.values) if f.operator == "eq" else f.field.members - set(f.values)
            if not left:
                return f.column
        elif f.field.kind not in ("text",):
            low, high = bounds.setdefault(f.column, [None, None])  # (value, closed)
            v = f.values
            lows = {"eq": (v[0], True), "gte": (v[0], True), "range": (v[0], True), "gt": (v[0], False)}.get(f.operator)
            highs = {"eq": (v[0], True), "lte": (v[0], True), "range": (v[-1], False), "lt": (v[0], False)}.get(f.operator)
            if lows and (low is None or (lows[0], not lows[1]) > (low[0], not low[1])):
                bounds[f.column][0] = lows
            if highs and (high is None or (highs[0], highs[1]) < (high[0], high[1])):
                bounds[f.column][1] = highs
            low, high = bounds[f.column]
            if low and high and (low[0] > high[0] or low[0] == high[0] and not (low[1] and high[1])):
                return f.column
    return None


def day(text: str) -> date:
    return date.fromisoformat(text)
