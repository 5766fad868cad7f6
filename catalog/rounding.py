"""Rounding that agrees between engines.

Sums are added up in different orders, so a value on the edge of the last kept digit may fall either way. A tiny
amount added before rounding, on both sides, makes such values fall the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

NUDGE = "1e-9"


def near(column: Column | str, digits: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(float(NUDGE)), digits)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """All double columns but ``skip``."""
    names = {n for n, t in df.dtypes if t == "double"} - set(skip)
    return df.select(*[near(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def nudged(sql: str) -> str:
    """SQL text with the same amount added inside every two-argument ROUND."""
    out, pos = [], 0
    for match in re.finditer(r"\bround\(", sql, re.IGNORECASE):
        depth, i, comma = 1, match.end(), None
        while depth:
            ch = sql[i]
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        if comma is not None and "+ 1e-" not in sql[max(match.end(), comma - 12):comma]:
            out.append((comma, f" + {NUDGE}"))
    text = []
    for at, extra in sorted(out):
        text += [sql[pos:at], extra]
        pos = at
    return "".join(text) + sql[pos:]


def registry():
    """Fresh (queries, sql) dictionaries with the decorator that fills them."""
    queries: dict = {}
    oracle: dict = {}

    def register(name: str, sql: str | None = None):
        def wrap(fn):
            queries[name] = fn
            if sql:
                oracle[name] = nudged(sql)
            return fn

        return wrap

    return queries, oracle, register
