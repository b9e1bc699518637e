"""Rounding half to even on decimals, so that a tie is a tie whatever the binary form of a double."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 8


def rounded(x: Column | str, places: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.bround(x.cast(f"decimal(28,{SCALE})"), places).cast("double")


def exact_rounding(sql: str) -> str:
    """DuckDB SQL in which every ``round_even(x, n)`` rounds the decimal form of x, as ``rounded`` does."""
    out, at = "", 0
    while (start := sql.find("round_even(", at)) >= 0:
        depth, k = 1, start + len("round_even(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[start + len("round_even(") : k - 1]
        x, n = re.fullmatch(r"(.*),\s*(\d+)", inner, re.S).groups()
        power = 10 ** int(n)
        out += sql[at:start] + f"(ROUND_EVEN(CAST(CAST({exact_rounding(x)} AS DECIMAL(28,{SCALE})) * {power} AS DOUBLE), 0) / {power})"
        at = k
    return out + sql[at:]
