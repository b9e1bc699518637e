"""Derived features as columns; each is null if what it needs is not stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded


def age(born: Column, today: Column) -> Column:
    """Completed years."""
    years = F.year(today) - F.year(born)
    early = (F.month(today) < F.month(born)) | ((F.month(today) == F.month(born)) & (F.day(today) < F.day(born)))
    return years - early.cast("int")


def share(a: Column, b: Column, total: Column) -> Column:
    """(a + b) / total, at most 1; null for a total of zero, or where neither or only one is stated."""
    part = F.try_divide(a + b, total)
    return F.when((total > 0) & part.isNotNull(), F.least(F.lit(1.0), part))


def percent_estimate(percent: Column, cgpa: Column) -> Column:
    """The stated percentage, else 9.5 times the grade point average."""
    return F.coalesce(percent, rounded(cgpa * 9.5, 1))


def total_months(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def years_since(year: Column, today: Column) -> Column:
    return F.year(today) - year


def list_count(items: Column) -> Column:
    return F.when(items.isNotNull(), F.size(items))
