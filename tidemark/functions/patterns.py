"""Regular expressions of label matchers and of label_replace.

The query language's dialect has no look-around and no back-references, ``$``
is the end of the text only and ``.`` excludes nothing but the line feed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RegexError

_FORBIDDEN = re.compile(r"\(\?(?:=|!|<=|<!|>|P=)|(?<!\\)(?:\\\\)*\\[1-9k]|[*+?}]\+")
_LITERALS = re.compile(r"^[\w\-./ :@%,;=~&]*(?:\|[\w\-./ :@%,;=~&]*)*$")


def check(pattern: str) -> None:
    if found := _FORBIDDEN.search(pattern):
        raise RegexError(f"unsupported construct {found[0]!r} in {pattern!r}")
    try:
        re.compile(pattern.replace(r"\z", r"\Z"))
    except re.error as e:
        raise RegexError(f"{pattern!r}: {e}") from None


def literals(pattern: str) -> list[str] | None:
    """The finite set a pattern stands for, if it is plain alternatives."""
    if _LITERALS.match(pattern) and "." not in pattern:
        return sorted(set(pattern.split("|")))
    return None


def anchored(value: Column, pattern: str) -> Column:
    """True where the whole of ``value`` matches; ``a|b`` becomes IN so that it is pushed to the scan."""
    check(pattern)
    if (some := literals(pattern)) is not None:
        return value.isin(some)
    if pattern == ".*":
        return ~value.contains("\n")
    if pattern == ".+":
        return (value != "") & ~value.contains("\n")
    if (m := re.fullmatch(r"([\w\- :@%/]+)\.\*", pattern)) is not None:
        return value.startswith(m[1]) & ~value.contains("\n")
    return value.rlike(rf"(?d)(?U)^(?:{pattern})\z")


_GROUP = re.compile(r"\$(?:(\$)|\{([^}]*)\}|(\w+))")


def expand(template: str, match: re.Match) -> str:
    """``$name`` takes the longest name, ``${name}`` is explicit, ``$$`` a dollar; unknown groups are empty."""

    def one(m: re.Match) -> str:
        if m[1]:
            return "$"
        name = m[2] if m[2] is not None else m[3]
        try:
            return match[int(name) if name.isdigit() else name] or ""
        except (IndexError, KeyError):
            return ""

    return _GROUP.sub(one, template)


def replace_all(pattern: re.Pattern, template: str, text: str) -> str | None:
    """``text`` with every match replaced; None without one. An empty match right after a match doesn't count."""
    out, at, last, found = [], 0, -1, False
    for m in pattern.finditer(text):
        if m.start() == m.end() == last:
            continue
        found = True
        out += [text[at : m.start()], expand(template, m)]
        at = last = m.end()
    return "".join(out) + text[at:] if found else None


def replacer(pattern: str, template: str):
    """A vectorized UDF: the replaced text, or null where nothing matches."""
    check(pattern)
    compiled = pattern

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        p = re.compile(compiled)
        return x.map(lambda s: replace_all(p, template, s or ""))

    return run
