"""Precedence-climbing parser of the query language."""

from __future__ import annotations

from dataclasses import replace

from ..errors import ParseError, TypeMismatch
from . import ast
from .lexer import Token, tokenize

AGGREGATIONS = ("sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "quantile", "count_values", "topk", "bottomk", "limitk", "limit_ratio")
PARAMETERED = ("quantile", "count_values", "topk", "bottomk", "limitk", "limit_ratio")
COMPARISONS = ("==", "!=", "<", ">", "<=", ">=")
SET_OPS = ("and", "or", "unless")
PRECEDENCE = {"or": 1, "and": 2, "unless": 2} | dict.fromkeys(COMPARISONS, 3) | {"+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}


def parse(text: str) -> ast.Expr:
    p = _Parser(tokenize(text))
    out = p.expression(0)
    p.expect("end", None)
    return out


def rejects_empty(m: ast.Matcher) -> bool:
    import re

    if m.op == "=":
        return m.value != ""
    if m.op == "!=":
        return m.value == ""
    try:
        matches = re.fullmatch(f"(?:{m.value})", "") is not None
    except re.error:
        return False
    return matches == (m.op == "!~")


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def is_(self, kind: str, *values: object) -> bool:
        return self.now.kind == kind and (not values or self.now.value in values)

    def take(self) -> Token:
        t = self.now
        self.i += 1
        return t

    def accept(self, kind: str, value: object) -> bool:
        if self.is_(kind, value):
            self.i += 1
            return True
        return False

    def expect(self, kind: str, value: object = None) -> Token:
        if self.now.kind != kind or (value is not None and self.now.value != value):
            raise ParseError(f"expected {value or kind}, found {self.now.value!r} at {self.now.at}")
        return self.take()

    def expression(self, least: int) -> ast.Expr:
        left = self.unary()
        while self.now.kind in ("op", "keyword") and (prec := PRECEDENCE.get(self.now.value)) is not None and prec > least:
            op = self.take().value
            bool_, matching = self.modifiers(op)
            right = self.expression(prec - 1 if op == "^" else prec)
            left = ast.Binary(op, left, right, bool_, matching)
        return left

    def modifiers(self, op: str) -> tuple[bool, ast.Matching | None]:
        bool_, match, group = False, None, None
        while self.is_("keyword", "bool", "on", "ignoring", "group_left", "group_right"):
            word = self.take().value
            if word == "bool":
                if bool_:
                    raise ParseError("repeated bool")
                if op not in COMPARISONS:
                    raise ParseError("bool goes with comparisons only")
                bool_ = True
            elif word in ("on", "ignoring"):
                if match:
                    raise ParseError("repeated on or ignoring")
                match = (word == "on", self.names())
            else:
                if group:
                    raise ParseError("repeated group modifier")
                if op in SET_OPS:
                    raise ParseError(f"no grouping allowed for {op}")
                group = (word[6:], self.names() if self.is_("op", "(") else ())
        if group and match and match[0] and set(group[1]) & set(match[1]):
            raise ParseError("a label is in both lists")
        if not match and not group:
            return bool_, None
        on, labels = match or (False, ())
        return bool_, ast.Matching(on, labels, group[0] if group else None, group[1] if group else ())

    def names(self) -> tuple[str, ...]:
        self.expect("op", "(")
        out: list[str] = []
        if not self.is_("op", ")"):
            out.append(self.expect("ident").value)
            while self.accept("op", ","):
                out.append(self.expect("ident").value)
        self.expect("op", ")")
        return tuple(out)

    def unary(self) -> ast.Expr:
        if self.is_("op", "+", "-"):
            op = self.take().value
            return ast.Unary(op, self.unary())
        return self.postfix(self.primary())

    def primary(self) -> ast.Expr:
        t = self.now
        if t.kind == "number":
            self.take()
            return ast.Number(t.value)
        if t.kind == "keyword" and t.value in ("inf", "nan"):
            self.take()
            return ast.Number(float(t.value))
        if t.kind == "string":
            self.take()
            return ast.Text(t.value)
        if self.accept("op", "("):
            out = self.expression(0)
            self.expect("op", ")")
            return out
        if self.is_("op", "{"):
            return self.selector(None)
        if t.kind == "ident":
            after = self.tokens[self.i + 1]
            if t.value in AGGREGATIONS and ((after.kind == "op" and after.value == "(") or (after.kind == "keyword" and after.value in ("by", "without"))):
                return self.aggregate(self.take().value)
            self.take()
            if self.is_("op", "("):
                return self.call(t.value)
            return self.selector(t.value)
        raise ParseError(f"unexpected {t.value!r} at {t.at}")

    def call(self, name: str) -> ast.Expr:
        self.expect("op", "(")
        args: list[ast.Expr] = []
        if not self.is_("op", ")"):
            args.append(self.expression(0))
            while self.accept("op", ","):
                args.append(self.expression(0))
        self.expect("op", ")")
        return ast.Call(name, tuple(args))

    def aggregate(self, op: str) -> ast.Expr:
        grouping, without = self.clause()
        self.expect("op", "(")
        args = [self.expression(0)]
        while self.accept("op", ","):
            args.append(self.expression(0))
        self.expect("op", ")")
        if grouping is None:
            grouping, without = self.clause()
        if len(args) != 1 + (op in PARAMETERED):
            raise ParseError(f"{op} takes {1 + (op in PARAMETERED)} argument(s)")
        return ast.Aggregate(op, args[-1], args[0] if op in PARAMETERED else None, grouping, without)

    def clause(self) -> tuple[tuple[str, ...] | None, bool]:
        if self.is_("keyword", "by", "without"):
            word = self.take().value
            return self.names(), word == "without"
        return None, False

    def selector(self, metric: str | None) -> ast.Selector:
        matchers: list[ast.Matcher] = []
        if self.accept("op", "{"):
            while not self.is_("op", "}"):
                name = self.expect("ident").value
                op = self.expect("op").value
                if op not in ("=", "!=", "=~", "!~"):
                    raise ParseError(f"{op!r} is not a matcher")
                matchers.append(ast.Matcher(name, op, self.expect("string").value))
                if not self.accept("op", ","):
                    break
            self.expect("op", "}")
        if metric is None and not any(rejects_empty(m) for m in matchers):
            raise ParseError("a selector needs a metric or a matcher that rejects the empty value")
        return ast.Selector(metric, tuple(matchers))

    def postfix(self, e: ast.Expr) -> ast.Expr:
        while True:
            if self.accept("op", "["):
                span = self.expect("duration").value
                if self.accept("op", ":"):
                    step = self.take().value if self.is_("duration") else None
                    self.expect("op", "]")
                    if step == 0:
                        raise ParseError("a subquery step is zero")
                    e = ast.Subquery(e, span, step)
                else:
                    self.expect("op", "]")
                    if not isinstance(e, ast.Selector) or e.range_ms is not None:
                        raise TypeMismatch("ranges are of vector selectors only")
                    e = replace(e, range_ms=span)
            elif self.is_("keyword", "offset"):
                self.take()
                sign = -1 if self.accept("op", "-") else 1
                if sign == 1:
                    self.accept("op", "+")
                ms = self.expect("duration").value
                if not isinstance(e, ast.Selector | ast.Subquery):
                    raise TypeMismatch("offset goes with selectors and subqueries only")
                if e.offset_ms:
                    raise ParseError("repeated offset")
                e = replace(e, offset_ms=sign * ms)
            elif self.accept("op", "@"):
                if not isinstance(e, ast.Selector | ast.Subquery):
                    raise TypeMismatch("@ goes with selectors and subqueries only")
                if e.at is not None:
                    raise ParseError("repeated @")
                e = replace(e, at=self.at())
            else:
                return e

    def at(self) -> ast.At:
        if self.is_("ident", "start", "end"):
            where = self.take().value
            self.expect("op", "(")
            self.expect("op", ")")
            return ast.At(where)
        sign = -1 if self.accept("op", "-") else 1
        if sign == 1:
            self.accept("op", "+")
        return ast.At(sign * self.expect("number").value)
