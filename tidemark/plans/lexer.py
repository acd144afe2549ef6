"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

KEYWORDS = {"by", "without", "offset", "bool", "and", "or", "unless", "on", "ignoring", "group_left", "group_right", "atan2", "inf", "nan"}
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
MAX = (1 << 63) - 1

_SPACE = re.compile(r"(?:\s+|#[^\n]*)+")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_:]*|:(?=[A-Za-z_:])[A-Za-z0-9_:]*")
_NUMBER = re.compile(r"[0-9][0-9.]*")
_DURATION = re.compile(r"(?:[0-9]+(?:ms|[smhdwy]))+(?![A-Za-z0-9_])")
_PART = re.compile(r"([0-9]+)(ms|[smhdwy])")
_OPS = ["==", "!=", "=~", "!~", "<=", ">=", "=", "<", ">", "+", "-", "*", "/", "%", "^", "(", ")", "{", "}", "[", "]", ",", ":", "@"]
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


@dataclass(frozen=True)
class Token:
    """``kind``: ident, keyword, number, duration, string, op or end."""

    kind: str
    value: object
    at: int


def duration_ms(text: str) -> int | None:
    """Milliseconds of concatenated segments; None if it overflows."""
    total = sum(int(n) * UNIT_MS[u] for n, u in _PART.findall(text))
    return total if total <= MAX else None


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while True:
        if m := _SPACE.match(text, at):
            at = m.end()
        if at >= len(text):
            out.append(Token("end", None, at))
            return out
        c = text[at]
        if c == '"':
            value, end = _string(text, at)
            out.append(Token("string", value, at))
            at = end
        elif m := _IDENT.match(text, at):
            word = m[0]
            out.append(Token("keyword", word.lower(), at) if word.lower() in KEYWORDS else Token("ident", word, at))
            at = m.end()
        elif c.isdigit() and c.isascii():
            d = _DURATION.match(text, at)
            if d and (ms := duration_ms(d[0])) is not None:
                out.append(Token("duration", ms, at))
                at = d.end()
                continue
            m = _NUMBER.match(text, at)
            try:
                out.append(Token("number", float(m[0]), at))
            except ValueError:
                raise ParseError(f"bad number {m[0]!r} at {at}") from None
            at = m.end()
        else:
            op = next((o for o in _OPS if text.startswith(o, at)), None)
            if op is None:
                raise ParseError(f"unexpected {c!r} at {at}")
            out.append(Token("op", op, at))
            at += len(op)


def _string(text: str, at: int) -> tuple[str, int]:
    out, k = [], at + 1
    while k < len(text):
        c = text[k]
        if c == '"':
            return "".join(out), k + 1
        if c == "\\" and k + 1 < len(text):
            k += 1
            out.append(_ESCAPES.get(text[k], text[k]))
        else:
            out.append(c if c.isascii() else c.encode().decode("latin-1"))
        k += 1
    raise ParseError(f"unterminated string at {at}")
