"""From structured drafts to ordered documents: line builders, section order, page estimate, warnings, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed

LINES_PER_PAGE = 46


def compact(items: Column) -> Column:
    """Trimmed items without the empty ones."""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't empty."""
    return F.array_join(compact(F.array(*[p.cast("string") for p in parts])), separator)


def period(start: Column, end: Column) -> Column:
    return joined(" - ", start, end)


def ordered(sections: DataFrame, key: str, name: str, order: list[str], ties: list[str]) -> DataFrame:
    """Adds place: a category's order first (header excepted), then the other sections by ``ties``; one row per (key, name)."""
    wanted = [s for s in order if s != "header"]
    place = F.array_position(F.array(*[F.lit(s) for s in wanted]), F.col(name)) if wanted else F.lit(0)
    first = Window.partitionBy(key, name).orderBy(*ties)
    rows = sections.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    rank = F.when(place > 0, place).otherwise(len(wanted) + 1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, *ties)))


def fallback_place(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in fixed.FALLBACK]), name)
    return F.when(at > 0, at).otherwise(len(fixed.FALLBACK) + 1)


def pages(lines: Column, per_page: int = LINES_PER_PAGE) -> Column:
    """Pages of a layout with a header of four lines."""
    return F.ceil((lines + 4) / per_page)


def warnings(drafts: DataFrame, key: str, expected: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, warning): expected sections that are missing, and the rules that hold."""
    missing = [F.when(~F.array_contains("sections", s), F.lit(f"missing section: {s}")) for s in expected]
    other = [F.when(cond, F.lit(text)) for text, cond in rules.items()]
    return drafts.select(key, F.explode(F.filter(F.array(*missing, *other), lambda w: w.isNotNull())).alias("warning"))


def filename(name: Column, role: Column, extension: str = "pdf") -> Column:
    clean = lambda c: F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}]+", "_")
    return F.concat(joined("_", clean(name), F.lit("Resume"), clean(role)), F.lit(f".{extension}"))


def form_rows(fields: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """(key, prefix, n, values): form fields named prefix__n__name as rows of name to value, empty rows left out."""
    parts = F.split(field, "__")
    t = fields.where((F.size(parts) == 3) & F.get(parts, F.lit(1)).rlike("^[0-9]+$") & (F.trim(value) != ""))
    t = t.select(key, F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).cast("int").alias("n"), F.get(parts, F.lit(2)).alias("name"), F.trim(value).alias("value"))
    return t.groupBy(key, "prefix", "n").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("values"))


def rendered(sections: DataFrame, key: str) -> DataFrame:
    """(key, text): sections (key, place, heading, blocks array<struct<text, bullets>>) as plain text in order."""
    block = lambda b: F.array_join(F.concat(F.array(b["text"]), F.transform(b["bullets"], lambda x: F.concat(F.lit("- "), x))), "\n")
    body = F.concat(F.upper("heading"), F.lit("\n"), F.array_join(F.transform("blocks", block), "\n"))
    t = sections.select(key, F.struct("place", body.alias("body")).alias("s")).groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("all"))
    return t.select(key, F.array_join(F.transform("all", lambda s: s["body"]), "\n\n").alias("text"))
