"""Interval unions and clear runs by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, covered, islands): total length of the union of [start, end] per key, and of how many pieces it consists."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    t = rows.select(*keys, start, end, reach.alias("reach"))
    added = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("reach", F.col(start))))
    return t.groupBy(*keys).agg(F.sum(added).alias("covered"), F.count_if(F.col("reach").isNull() | (F.col(start) > F.col("reach"))).alias("islands"))


def longest_clear(rows: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """(keys, clear): the longest stretch of [low, high] that no interval touches."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = rows.select(*keys, (F.col(start) - F.greatest(low, F.coalesce(reach, low))).alias("gap"), F.col(end).alias("e"))
    return t.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("gap"), high - F.max("e")).alias("clear"))


def gutters(words: DataFrame, pages: DataFrame, step: float = 2.0, least_words: int = 10, least_clear: float = 0.5, least_cover: float = 0.3, tried: DataFrame | None = None, page: list[str] | None = None) -> DataFrame:
    """(page_id, x, clear_share): the best vertical gutter of pages (page_id, width, height) with words (page_id, x0, x1, top, bottom). ``page`` names other columns than page_id.

    x is tried every ``step`` from 20 % to 75 % of the width, or at the places ``tried`` (page_id, x); of the places with enough words and coverage on both sides
    the one with the longest run that no word crosses wins.
    """
    page = page or ["page_id"]
    xs = pages.select(*page, "height", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("width") * 0.55 / step).cast("int")), lambda i: F.col("width") * 0.2 + i * step)).alias("x"))
    if tried is not None:
        xs = pages.select(*page, "height").join(tried, page)
    w = words.join(xs, page)
    sides = w.groupBy(*page, "x").agg(F.count_if(F.col("x1") <= F.col("x")).alias("left"), F.count_if(F.col("x0") >= F.col("x")).alias("right"), F.first("height").alias("height"))
    crossing = w.where((F.col("x0") < F.col("x")) & (F.col("x1") > F.col("x")))
    ends = pages.select(*page, F.lit(0.0).alias("top0"), F.col("height").alias("h0"))
    clear = longest_clear(crossing.join(ends, page), [*page, "x", "h0"], "top", "bottom", F.lit(0.0), F.col("h0")).drop("h0")
    covers = [union_length(w.where(c), [*page, "x"], "top", "bottom").select(*page, "x", F.col("covered").alias(n)) for c, n in ((F.col("x1") <= F.col("x"), "cl"), (F.col("x0") >= F.col("x"), "cr"))]
    t = sides.join(clear, [*page, "x"], "left")
    for c in covers:
        t = t.join(c, [*page, "x"], "left")
    share = F.coalesce("clear", F.col("height")) / F.col("height")
    good = t.where((F.col("left") >= least_words) & (F.col("right") >= least_words) & (share >= least_clear) & (F.col("cl") >= least_cover * F.col("height")) & (F.col("cr") >= least_cover * F.col("height")))
    return good.groupBy(*page).agg(F.max_by("x", F.struct(share, (-F.col("x")).alias("n"))).alias("x"), F.max(share).alias("clear_share"))
