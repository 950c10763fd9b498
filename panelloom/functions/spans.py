"""The two text tasks column functions cannot express: exact spans and NFKC.

Each is a small Arrow UDF. Callers pass null for texts that need no work, so
clean rows cost neither transfer nor a Python call.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom.functions import patterns as P

_KINDS = [
    ("email", re.compile(P.EMAIL), 0),
    ("ssn", re.compile(P.SSN), 0),
    ("credit_card", re.compile(P.CARD), 0),
    ("phone", re.compile(P.PHONE), 0),
    ("address", re.compile(P.ADDRESS), 0),
    ("name", re.compile(P.NAME_STATED), 1),
    ("name", re.compile(P.NAME_SIGNED), 1),
]


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[1::2]]
    return (sum(digits[::2]) + sum(doubled)) % 10 == 0


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Non-overlapping spans; where spans overlap the earliest wins, then the
    longest, then the kind listed first."""
    found = []
    for rank, (kind, regex, group) in enumerate(_KINDS):
        for m in regex.finditer(text):
            if kind != "credit_card" or luhn(m.group()):
                found.append((m.start(group), -(m.end(group) - m.start(group)), rank, kind))
    spans, end = [], 0
    for start, negative, _, kind in sorted(found):
        if start >= end:
            end = start - negative
            spans.append((kind, start, end))
    return spans


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, start, end in spans:
        parts += [text[at:start], P.REDACTION[kind]]
        at = end
    return "".join([*parts, text[at:]])


def has_repeated_block(text: str, size: int = P.BLOCK_CHARS, stride: int = P.BLOCK_STRIDE) -> bool:
    """A block of ``size`` characters on the stride occurs again without overlap.

    All windows get a polynomial hash from prefix sums (arithmetic modulo 2^64);
    only windows whose hash recurs far enough away are compared as text.
    """
    if len(text) < 2 * size:
        return False
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    base = np.uint64(6364136223846793005)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    ones = np.ones(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([ones[:1], base * ones[1:]]))
        unpower = np.cumprod(np.concatenate([ones[:1], inverse * ones[1:]]))
        prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(1)) * power)])
        hashes = (prefix[size:] - prefix[:-size]) * unpower[: len(codes) - size + 1]
    _, group = np.unique(hashes, return_inverse=True)
    where = np.arange(len(hashes))
    first = np.full(group.max() + 1, len(hashes))
    last = np.zeros(group.max() + 1, dtype=int)
    np.minimum.at(first, group, where)
    np.maximum.at(last, group, where)
    starts = np.arange(0, len(text) - size, stride)
    far = last[group[starts]] >= first[group[starts]] + size
    return any(text.count(text[s : s + size]) > 1 for s in starts[far])


def spans_and_redaction(text: Column) -> Column:
    """Struct of ``spans`` and ``redacted``; null in, null out."""

    @F.pandas_udf("spans array<struct<type:string,start:int,end:int>>, redacted string")
    def run(texts: pd.Series) -> pd.DataFrame:
        spans = [find_spans(t) if t is not None else None for t in texts]
        return pd.DataFrame(
            {
                "spans": [
                    None if s is None else [{"type": k, "start": a, "end": b} for k, a, b in s]
                    for s in spans
                ],
                "redacted": [
                    None if s is None else redact_text(t, s) for t, s in zip(texts, spans)
                ],
            }
        )

    return run(text)


def repeated_block(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and has_repeated_block(t) for t in texts], dtype=bool)

    return run(text)


def nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts])

    return run(text)
