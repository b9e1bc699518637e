"""Lines of laid-out documents: zones, and wrapped lines joined again. Windows by page and block, over what a reader gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import dates
from scoreloom.functions.numbers import rounded
from scoreloom.operators import text as tx

READ_ZONES = ("body", "table")
EDGE, LEAST_GAP, MOST_GAP = 12.0, -2, 40  # points


def read_by_parsers(lines: DataFrame) -> DataFrame:
    """The lines that a parser reads: headers, footers and text boxes are not among them."""
    return lines.where(F.col("zone").isin(*READ_ZONES))


def leading(lines: DataFrame, page: list[str], block: list[str], order: str) -> DataFrame:
    """(page, leading): a page's tightest spacing of lines within blocks, the tenth percentile of the gaps."""
    gap = rounded(F.col("top") - F.lag("bottom").over(Window.partitionBy(*page, *block).orderBy(order)), 1)
    gaps = lines.select(*page, gap.alias("gap")).where(F.col("gap").between(LEAST_GAP, MOST_GAP))
    ranked = gaps.withColumn("r", F.row_number().over(Window.partitionBy(*page).orderBy("gap"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*page)))
    return ranked.where(F.col("r") == F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).select(*page, F.col("gap").alias("leading"))


def continues(before: Column, line: Column, edge: Column, spacing: Column) -> Column:
    """Whether a line goes on with the sentence above it: that one fills the block and doesn't end, this one starts nothing new, in the same style and place."""
    return (
        (before["x1"] >= edge - EDGE) & (line["top"] - before["bottom"] <= spacing * 1.4 + 0.6) & (line["x0"] >= before["x0"] - 1) & line["size"].eqNullSafe(before["size"])
        & line["bold"].eqNullSafe(before["bold"]) & ~line["text"].rlike(tx.BULLET) & ~line["text"].rlike(tx.NUMBERED) & ~dates.has_date(line["text"]) & ~F.rtrim(before["text"]).rlike("[.:;!?]$")
    )


def rejoined(lines: DataFrame, page: list[str], block: list[str], order: str) -> DataFrame:
    """(page, block, order, text, x0, size, bold): lines (.., text, x0, top, x1, bottom, size, bold) with the wrapped ones joined to the one they began in."""
    keys = [*page, *block]
    own = Window.partitionBy(*keys).orderBy(order)
    t = lines.join(leading(lines, page, block, order), page, "left")
    line = F.struct("text", "x0", "top", "x1", "bottom", "size", "bold")
    t = t.withColumns({"_line": line, "_edge": F.max("x1").over(Window.partitionBy(*keys))}).withColumn("_before", F.lag("_line").over(own))
    goes_on = F.coalesce(continues(F.col("_before"), F.col("_line"), F.col("_edge"), F.coalesce("leading", F.lit(0.0))), F.lit(False))
    t = t.withColumn("_first", F.sum((~goes_on).cast("int")).over(own))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "text"))), lambda x: x["text"])
    return t.groupBy(*keys, "_first").agg(F.min(order).alias(order), F.trim(F.array_join(parts, " ")).alias("text"), F.min_by("x0", order).alias("x0"), F.min_by("size", order).alias("size"), F.min_by("bold", order).alias("bold")).drop("_first")
