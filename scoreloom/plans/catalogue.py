"""Every query over the test tables by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.functions.numbers import exact_rounding
from scoreloom.plans import business, resumes, textual

PARTS = [business, textual, resumes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: exact_rounding(sql) for part in PARTS for name, sql in part.SQL.items()}
