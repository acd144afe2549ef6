"""Canonical series identity, its hashes, and natural ordering."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def canonical(metric: str, labels: list[tuple[str, str]]) -> bytes:
    """Length-prefixed metric, then length-prefixed names and values of the sorted labels."""

    def piece(text: str) -> bytes:
        raw = text.encode()
        return len(raw).to_bytes(2, "little") + raw

    return piece(metric) + b"".join(piece(n) + piece(v) for n, v in sorted(labels))


def fnv1a(data: bytes, h: int = FNV_OFFSET) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def canonical_column(metric: Column, labels: Column) -> Column:
    """``canonical`` without a UDF, as BINARY. Strings are shorter than 64 KiB."""

    def piece(text: Column) -> Column:
        raw = text.cast("binary")
        n = F.octet_length(raw)
        return F.concat(F.unhex(F.lpad(F.hex(n % 256), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(n / 256)), 2, "0")), raw)

    pairs = F.transform(F.array_sort(labels), lambda x: F.concat(piece(x["name"]), piece(x["value"])))
    return F.concat(piece(metric), F.aggregate(pairs, F.lit(b""), lambda a, b: F.concat(a, b)))


def series_key(metric: Column, labels: Column) -> Column:
    return F.lower(F.hex(canonical_column(metric, labels)))


def hasher(kind: str):
    """A vectorized UDF of BINARY to BIGINT (two's complement): fnv1a, or xxh64 with seed 0."""
    one = fnv1a if kind == "fnv1a" else (lambda b: xxhash.xxh64_intdigest(b, 0))

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.array([one(bytes(b)) for b in x], np.uint64).view(np.int64), index=x.index)

    return run


def natural_key(text: str) -> str:
    """A text whose plain order is the digit-aware order of ``text``."""
    return "".join(f"0{len(p.lstrip('0')):04d}{p.lstrip('0')}" if p.isdigit() else p for p in re.split(r"([0-9]+)", text))


def natural():
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: natural_key(s or ""))

    return run
