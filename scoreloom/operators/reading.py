"""Reading order from word boxes: lines, columns, blocks, and how two ways to read a page agree.

Words are (page keys.., text, x0, x1, top, bottom) in points, with size and bold where a reader knows them; any reader of paged files can give
them. Clusters are gaps and islands on one axis at a time: middles of words make lines, extents across make columns, extents down make
blocks. A naive parser reads line by line across the page; a person reads a column to its end. Lines that cross a page's gutter, such as a
title over two columns, split the page into bands, and columns are found within a band. All windows are by page, so words are shuffled once.

A null text or edge is no word. A page without words has no rows. Words at one place are ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators import intervals, match

LINE, GUTTER, BLOCK = 3.0, 12.0, 6.0  # points: middles of one line, least width between columns, least height between blocks


def islands(boxes: DataFrame, keys: list[str], low: Column, high: Column, gap: float, name: str) -> DataFrame:
    """Adds ``name``: the number, from 0, of the cluster of boxes that no gap wider than ``gap`` parts along one axis, within keys."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = boxes.withColumn("_new", F.coalesce((low - reach) > gap, F.lit(False)).cast("int"))
    return t.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def middle() -> Column:
    return (F.col("top") + F.col("bottom")) / 2


def usable(words: DataFrame) -> DataFrame:
    said = F.col("text").isNotNull() & (F.trim("text") != "")
    for c in ("x0", "x1", "top", "bottom"):
        said &= F.col(c).isNotNull()
    return words.where(said)


def page_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Words with row, the line across the whole page that they stand in."""
    return islands(usable(words), page, middle(), middle(), LINE, "row")


def gutter(rows: DataFrame, page: list[str]) -> DataFrame:
    """(page.., gutter): where text runs down both sides of a strip. Only the left edges of what stands after a wide gap, or far in, are tried."""
    w = Window.partitionBy(*page, "row").orderBy("x0", "x1")
    wide = F.col("x0") - F.lag("x1").over(w)
    size = rows.groupBy(*page).agg(F.max("x1").alias("width"), F.min("top").alias("first"), F.max("bottom").alias("last"))
    size = size.select(*page, "width", "first", (F.col("last") - F.col("first")).alias("height"))
    edges = rows.withColumn("_wide", wide).join(size, page).where((F.coalesce("_wide", F.col("x0")) >= GUTTER) & F.col("x0").between(0.2 * F.col("width"), 0.75 * F.col("width")))
    tried = edges.select(*page, (F.round("x0") - 2.0).alias("x")).distinct()
    boxes = rows.join(size.select(*page, "first"), page).select(*page, "x0", "x1", (F.col("top") - F.col("first")).alias("top"), (F.col("bottom") - F.col("first")).alias("bottom"))
    return intervals.gutters(boxes, size.select(*page, "width", "height"), tried=tried, page=page).select(*page, F.col("x").alias("gutter"), "clear_share")


def structured(words: DataFrame, page: list[str]) -> DataFrame:
    """Words with row, band, col, block and line, each numbered from 0 within what comes before it."""
    rows = page_lines(words, page)
    rows = rows.join(gutter(rows, page).drop("clear_share"), page, "left")
    x, row, down = F.col("gutter"), Window.partitionBy(*page, "row"), Window.partitionBy(*page).orderBy("row")
    left, right = F.max(F.when(F.col("x1") <= x, F.col("x1"))).over(row), F.min(F.when(F.col("x0") >= x, F.col("x0"))).over(row)
    crossed = F.coalesce(F.bool_or((F.col("x0") < x) & (F.col("x1") > x)).over(row), F.lit(False))
    t = rows.withColumn("full", crossed | F.coalesce(right - left < GUTTER, F.lit(False))).drop("gutter")
    turn = (F.col("row") != F.lag("row").over(down)) & (F.col("full") != F.lag("full").over(down))  # at a row's first word: all of a row agree
    t = t.withColumn("_turn", F.coalesce(turn, F.lit(False)).cast("int")).withColumn("band", F.sum("_turn").over(down)).drop("_turn")
    t = islands(t, [*page, "band"], F.col("x0"), F.col("x1"), GUTTER - 1e-6, "col").withColumn("col", F.when(F.col("full"), 0).otherwise(F.col("col")))
    t = islands(t, [*page, "band", "col"], F.col("top"), F.col("bottom"), BLOCK, "block")
    return islands(t, [*page, "band", "col"], middle(), middle(), LINE, "line").drop("full")


def _joined(words: DataFrame, page: list[str], by: list[str], given: list[str]) -> DataFrame:
    said = F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"])
    extra = [F.max(c).alias(c) if c == "size" else F.bool_and(c).alias(c) for c in given]
    t = words.groupBy(*page, *by).agg(F.array_join(said, " ").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), *extra)
    return t.withColumn("line_no", F.row_number().over(Window.partitionBy(*page).orderBy(*by)) - 1)


def _given(words: DataFrame) -> list[str]:
    return [c for c in ("size", "bold") if c in words.columns]


def naive_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """(page.., line_no, text, x0, top, x1, bottom, size, bold) as a parser reads that goes line by line across the page."""
    return _joined(page_lines(words, page), page, ["row"], _given(words))


def lines(words: DataFrame, page: list[str]) -> DataFrame:
    """The same as a person reads, with band, col and block; what ``layout.rejoined`` and ``segment.sections`` go on from."""
    return _joined(structured(words, page), page, ["band", "col", "block", "line"], _given(words))


def page_text(read: DataFrame, page: list[str]) -> DataFrame:
    """(page.., text) of lines."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return read.groupBy(*page).agg(F.array_join(said, "\n").alias("text"))


def two_readings(words: DataFrame, page: list[str]) -> DataFrame:
    """(page.., naive, read, columns, blocks) of every page with words."""
    read = lines(words, page)
    facts = read.groupBy(*page).agg((F.max("col") + 1).alias("columns"), F.count_distinct("band", "col", "block").alias("blocks"))
    naive = page_text(naive_lines(words, page), page).withColumnRenamed("text", "naive")
    return page_text(read, page).withColumnRenamed("text", "read").join(naive, page).join(facts, page).select(*page, "naive", "read", "columns", "blocks")


def documents(words: DataFrame, doc: str = "doc_id", page: str = "page", kind: str = "pdf") -> DataFrame:
    """(doc_id, text, file_type, page_count, gutters, order_similarity) of words on pages: what the engine reads and the layout check goes by.

    The two readings are compared on a document's first page.
    """
    keys = [doc, page]
    read, rows = lines(words, keys), page_lines(words, keys)
    texts = page_text(read, keys).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "text"))), lambda p: p["text"]), "\n").alias("text"), F.max(page).cast("int").alias("page_count"))
    first = lambda t, name: page_text(t, keys).groupBy(doc).agg(F.min_by("text", page).alias(name))
    both = match.order_similarity(first(read, "_read").join(first(naive_lines(words, keys), "_naive"), doc), "_read", "_naive").select(doc, F.col("similarity").alias("order_similarity"))
    cut = gutter(rows, keys).groupBy(doc).agg(F.count(F.lit(1)).cast("int").alias("gutters"))
    out = texts.join(both, doc, "left").join(cut, doc, "left")
    return out.select(doc, "text", F.lit(kind).alias("file_type"), "page_count", F.coalesce("gutters", F.lit(0)).alias("gutters"), "order_similarity")
