"""Typed inputs of users, with an error channel: what can't be read becomes an error row beside the results, never a failed job.

An input has the type that its category states: number (a whole one if its feature counts), bool, date or choice. Values come as text or as columns of
a type of their own. Blank and null values aren't given. One pass parses them all and says what is wrong; ``split`` parts it into
rows to score and error rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import dates
from scoreloom.functions.vocabulary import FEATURES
from scoreloom.plans.rules import Category, Input, RuleError

TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
ERRORS = "array<struct<input:string,type:string,value:string,reason:string>>"


def kind_of(i: Input) -> str:
    return "int" if i.type == "number" and i.feature and FEATURES.get(i.feature) == "int" else i.type


def parsed(value: Column, i: Input) -> tuple[Column, str]:
    """The typed value, null if the text doesn't give one, and what is wrong then."""
    text, kind = F.trim(value.cast("string")), kind_of(i)
    if kind == "number":
        n = text.try_cast("double")
        return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n), "not a number"
    if kind == "int":
        whole = F.regexp_replace(text, r"\.0+$", "")
        return F.when(whole.rlike(r"^[+-]?\d{1,18}$"), whole.try_cast("long")), "not a whole number"
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False), "neither yes nor no"
    if kind == "date":
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
        return F.coalesce(iso, F.when(~text.rlike(r"^\d{4}-"), dates.date_of_birth(text))).cast("string"), "not a date"
    return F.when(text.isin(*i.options), text), f"not one of {', '.join(i.options)}"


def checked(rows: DataFrame, category: Category, given: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``given`` (input id to column) typed, and input_errors; an input that the category doesn't have is the caller's mistake."""
    known = {i.id: i for i in category.inputs}
    if extra := set(given) - set(known):
        raise RuleError(f"unknown input(s) for {category.id}: {sorted(extra)}")
    typed, wrong = {}, []
    for name, column in given.items():
        value = F.col(f"`{column}`").cast("string")
        out, reason = parsed(value, known[name])
        typed[column] = out
        row = F.struct(F.lit(name).alias("input"), F.lit(kind_of(known[name])).alias("type"), value.alias("value"), F.lit(reason).alias("reason"))
        wrong.append(F.when((F.trim(value) != "") & out.isNull(), row))
    errors = F.filter(F.array(*wrong), lambda e: e.isNotNull()) if wrong else F.array()
    return rows.withColumn("input_errors", errors.cast(ERRORS)).select(*[typed.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns], "input_errors")


def split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, one row per error: key, input, type, value, reason)."""
    good = rows.where(F.size("input_errors") == 0).drop("input_errors")
    return good, rows.select(key, F.inline("input_errors"))
