"""Predicates over text columns: a small tree that becomes one Column."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Resolver = Callable[[str], Column]


def resolver(columns: dict[str, str]) -> Resolver:
    """Looks a logical name up among ``columns`` (logical to physical)."""

    def find(name: str) -> Column:
        if name not in columns:
            raise ValueError(f"unknown column {name!r}; known are {sorted(columns)}")
        return F.col(columns[name])

    return find


@dataclass(frozen=True)
class Eq:
    column: str
    value: str

    def to_column(self, find: Resolver) -> Column:
        return find(self.column) == F.lit(self.value)


@dataclass(frozen=True)
class Prefix:
    """LIKE with a trailing %; wildcards in ``value`` stay wildcards, and a backslash makes the next character plain, also that %."""

    column: str
    value: str

    def to_column(self, find: Resolver) -> Column:
        # Spark takes a backslash only before a wildcard or another backslash
        pattern = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], self.value + "%", flags=re.DOTALL)
        return find(self.column).like(pattern)


@dataclass(frozen=True)
class Between:
    """``low <= column < high``."""

    column: str
    low: str
    high: str

    def to_column(self, find: Resolver) -> Column:
        column = find(self.column)
        if self.low >= self.high:
            raise ValueError(f"empty range: {self.low!r} is not below {self.high!r}")
        return (column >= F.lit(self.low)) & (column < F.lit(self.high))


@dataclass(frozen=True)
class GE:
    column: str
    value: str

    def to_column(self, find: Resolver) -> Column:
        return find(self.column) >= F.lit(self.value)


@dataclass(frozen=True)
class LT:
    column: str
    value: str

    def to_column(self, find: Resolver) -> Column:
        return find(self.column) < F.lit(self.value)


class In:
    """Any of the values; none of them matches nothing."""

    def __init__(self, column: str, *values: str):
        self.column, self.values = column, values

    def to_column(self, find: Resolver) -> Column:
        column = find(self.column)
        return column.isin(*self.values) if self.values else F.lit(False)


class And:
    """All of the filters; none of them matches everything."""

    def __init__(self, *filters):
        self.filters = filters

    def to_column(self, find: Resolver) -> Column:
        return reduce(operator.and_, (f.to_column(find) for f in self.filters), F.lit(True))


class Or:
    """Any of the filters; none of them matches nothing."""

    def __init__(self, *filters):
        self.filters = filters

    def to_column(self, find: Resolver) -> Column:
        return reduce(operator.or_, (f.to_column(find) for f in self.filters), F.lit(False))


Filter = Eq | Prefix | Between | GE | LT | In | And | Or


def compile_filters(filters: Sequence[Filter], find: Resolver) -> Column:
    """One condition that all of the filters hold."""
    return And(*filters).to_column(find)
