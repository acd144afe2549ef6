"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class Number(Expr):
    value: float


@dataclass(frozen=True)
class Text(Expr):
    value: str


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class At:
    """Fixed evaluation time: seconds, or ``start`` or ``end`` of the query."""

    where: str | float


@dataclass(frozen=True)
class Selector(Expr):
    metric: str | None
    matchers: tuple[Matcher, ...] = ()
    range_ms: int | None = None
    offset_ms: int = 0
    at: At | None = None


@dataclass(frozen=True)
class Subquery(Expr):
    expr: Expr
    range_ms: int
    step_ms: int | None = None
    offset_ms: int = 0
    at: At | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    expr: Expr


@dataclass(frozen=True)
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    group: str | None = None
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    bool_: bool = False
    matching: Matching | None = None


@dataclass(frozen=True)
class Aggregate(Expr):
    op: str
    expr: Expr
    param: Expr | None = None
    grouping: tuple[str, ...] | None = None
    without: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
