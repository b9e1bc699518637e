"""Eighteen document checks as one projection, and their roll-up.

A check is a struct (check, grp, status, score, weight, fatal). Evidence that a format can't give leaves a check ``na``;
its weight then goes to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.lookup import let
from scoreloom.functions.numbers import rounded
from scoreloom.operators import text as tx

# Fixed values, as are the checks' weights and limits below.
GROUPS = {"parseability": 0.30, "sections": 0.20, "contact": 0.10, "keywords": 0.30, "hygiene": 0.10}
STATUS = {"pass": 1.0, "warn": 0.5, "fail": 0.0}
MB = 1 << 20


def check(name: str, group: str, weight: float, status: Column, score: Column | None = None, fatal: Column | None = None) -> Column:
    usual = F.when(status == "pass", 1.0).when(status == "warn", 0.5).when(status == "fail", 0.0)
    own = usual if score is None else F.when(usual.isNotNull(), F.coalesce(score, usual))
    return F.struct(F.lit(name).alias("check"), F.lit(group).alias("grp"), status.alias("status"), own.alias("score"), F.lit(weight).alias("weight"), F.coalesce(fatal, F.lit(False)).alias("fatal") if fatal is not None else F.lit(False).alias("fatal"))


def text_layer(c=F.col) -> Column:
    words, chars = c("word_count"), c("char_count")
    pdf = c("file_type") == "pdf"
    empty, pages = c("empty_pages"), c("page_count")
    stub = words < 50
    glued = stub & (chars / F.greatest(words, F.lit(1)) > 15)
    status = F.when(pdf & (empty > 0), "fail").when(stub, "fail").otherwise("pass")
    fatal = F.when(pdf & (pages > 0) & (empty == pages), True).when(pdf & (empty > 0), False).when(glued, True).when(stub, words < 10).otherwise(False)
    return check("text_layer", "parseability", 3.0, status, fatal=fatal)


def layout(c=F.col) -> Column:
    kind, gutter, sim = c("file_type"), F.coalesce(c("gutters"), F.lit(0)) > 0, F.coalesce(c("order_similarity"), F.lit(1.0))
    pdf = F.when(gutter & (sim < 0.75), "fail").when(gutter | (sim < 0.75), "warn").otherwise("pass")
    return check("layout", "parseability", 3.0, F.when(kind == "txt", "na").when(kind == "docx", F.when(c("docx_columns") > 1, "warn").otherwise("pass")).otherwise(pdf))


def simple(c=F.col) -> list[Column]:
    kind = c("file_type")
    hidden = F.when(c("textbox_words") >= 15, "fail").when((c("textbox_words") > 0) | (c("header_footer_words") >= 5), "warn").otherwise("pass")
    glyphs = F.when(c("garbled_content") >= 10, "fail").when((c("garbled_content") > 0) | (c("garbled_symbols") >= 3), "warn").otherwise("pass")
    found, odd = c("headings_found"), c("headings_odd")
    missing = c("sections_missing")
    over = c("page_count") - c("max_pages")
    return [
        check("tables", "parseability", 1.5, F.when(kind == "txt", "na").when(c("table_count") > 0, "warn").otherwise("pass")),
        check("hidden_text", "parseability", 2.0, F.when(kind == "docx", hidden).otherwise("na")),
        check("graphics", "parseability", 1.0, F.when(kind == "txt", "na").when(c("image_count") > 0, "warn").otherwise("pass")),
        check("glyphs", "parseability", 1.0, glyphs, F.when((c("garbled_content") == 0) & (c("garbled_symbols") >= 3), 0.8)),
        check("headings_found", "sections", 1.0, F.when(found + odd >= 3, "pass").when(found + odd >= 1, "warn").otherwise("fail")),
        check("standard_headings", "sections", 1.5, F.when(odd == 0, "pass").when(odd == 1, "warn").otherwise("fail"), F.try_divide(found, found + odd)),
        check("expected_sections", "sections", 1.5, F.when(missing == 0, "pass").when(missing == 1, "warn").otherwise("fail"), 1 - F.try_divide(missing, c("sections_expected"))),
        check("file_type", "hygiene", 1.0, F.when(kind.isin("pdf", "docx"), "pass").otherwise("warn")),
        check("length", "hygiene", 1.0, F.when(c("word_count") < 150, "warn").when(over <= 0, "pass").when(over == 1, "warn").otherwise("fail")),
        check("filename", "hygiene", 1.0, F.when(c("filename_generic") | c("filename_draft") | ~c("filename_named"), "warn").otherwise("pass"), F.when(c("filename_generic"), 0.5).when(c("filename_draft") | ~c("filename_named"), 0.75)),
        check("date_formats", "hygiene", 1.0, F.when(c("date_styles") > 1, "warn").otherwise("pass")),
        check("file_size", "hygiene", 0.5, F.when(c("size_bytes") / MB > 2, "warn").otherwise("pass")),
    ]


def contact(c=F.col) -> list[Column]:
    """``has_*``: in the parser's text; ``saw_*``: only in what a human sees."""
    both = lambda k: F.when(c(f"has_{k}"), "pass").otherwise("fail")
    linked = F.when(~c("linkedin_expected"), "na").when(c("has_linkedin"), "pass").when(c("saw_linkedin"), "fail").otherwise("warn")
    return [check("email", "contact", 0.5, both("email")), check("phone", "contact", 0.35, both("phone")), check("linkedin", "contact", 0.15, linked)]


def keywords(c=F.col) -> Column:
    cov = c("keyword_coverage")
    status = F.when(cov.isNull(), "na").when(c("keyword_hits") < 3, "info").when(cov >= 0.75, "pass").when(cov >= 0.5, "warn").otherwise("fail")
    return check("keywords", "keywords", 1.0, status, cov)


DEFAULTS = {
    "file_type": "txt", "empty_pages": 0, "page_count": 1, "gutters": 0, "order_similarity": 1.0, "docx_columns": 1, "table_count": 0, "textbox_words": 0, "header_footer_words": 0,
    "image_count": 0, "garbled_content": 0, "garbled_symbols": 0, "headings_found": 0, "headings_odd": 0, "sections_missing": 0, "sections_expected": 0, "max_pages": 2, "size_bytes": 0,
    "date_styles": 0, "filename_generic": False, "filename_draft": False, "filename_named": True, "linkedin_expected": True, "has_email": False, "has_phone": False, "has_linkedin": False, "saw_linkedin": False, "keyword_hits": 0,
}


EVIDENCE = {*DEFAULTS, "word_count", "char_count", "keyword_coverage"}
NAMES = (
    "text_layer", "layout", "tables", "hidden_text", "graphics", "glyphs", "headings_found", "standard_headings", "expected_sections", "file_type", "length", "filename", "date_formats", "file_size",
    "email", "phone", "linkedin", "keywords",
)


def with_defaults(docs: DataFrame) -> DataFrame:
    """Evidence that a source doesn't have as a column."""
    out = docs
    for name, value in DEFAULTS.items():
        if name not in docs.columns:
            out = out.withColumn(name, F.lit(value))
    if "keyword_coverage" not in out.columns:
        out = out.withColumn("keyword_coverage", F.lit(None).cast("double"))
    return out


def checks_of(docs: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with checks: an array of (check, grp, status, score, weight, fatal), after the override: a fatal failure makes every other check ``na``.

    ``only`` names checks; the others are as if they weren't there, but for the one that can be fatal. The evidence is computed once.
    """
    known = with_defaults(docs)
    evidence = F.struct(*[c for c in known.columns if c in EVIDENCE])

    def all_of(e: Column) -> Column:
        c = lambda name: e[name]
        rows = dict(zip(NAMES, [text_layer(c), layout(c), *simple(c), *contact(c), keywords(c)], strict=True))
        return F.array(*[row for name, row in rows.items() if only is None or name in only or name == "text_layer"])

    def override(rows: Column) -> Column:
        fatal = F.exists(rows, lambda x: x["fatal"])
        return F.transform(rows, lambda x: F.struct(x["check"].alias("check"), x["grp"].alias("grp"), F.when(fatal & ~x["fatal"], "na").otherwise(x["status"]).alias("status"), rounded(F.when(~fatal, x["score"]), 4).alias("score"), x["weight"].alias("weight"), x["fatal"].alias("fatal")))

    once = let(let(evidence, all_of), override)
    return known.withColumn("checks", once if only is None or "text_layer" in only else F.filter(once, lambda x: x["check"] != "text_layer"))


def checked(docs: DataFrame, key: str = "doc_id", only: tuple[str, ...] | None = None) -> DataFrame:
    """(key, check, grp, status, score, weight, fatal): ``checks_of`` as rows."""
    return checks_of(docs, only).select(key, F.inline("checks"))


EXACT = 10_000  # scores and weights have four decimals at most, so their sums are exact as whole numbers


def total(checks: Column) -> Column:
    """The score of an array of checks: weighted means within groups, then over the groups that have one, one decimal each. A fold over the row's own array, no shuffle."""
    whole = lambda c: F.round(c * EXACT).cast("long")
    add = lambda of: lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + of(x))
    weights, weighted = add(lambda x: whole(x["weight"])), add(lambda x: whole(x["score"]) * whole(x["weight"]))

    def mean(rows: Column) -> Column:
        return F.try_divide(weighted(rows) / float(EXACT * EXACT), weights(rows) / float(EXACT))

    def of(live: Column) -> Column:
        def group(name: str, weight: float) -> Column:
            scored = lambda rows: F.struct(rounded(100 * mean(rows), 1).alias("score"), F.lit(weight).alias("weight"))
            return let(F.filter(live, lambda x: x["grp"] == name), scored)

        groups = F.filter(F.array(*[group(name, weight) for name, weight in GROUPS.items()]), lambda g: g["score"].isNotNull())
        return let(groups, lambda rows: F.coalesce(rounded(mean(rows), 1), F.lit(0.0)))

    return let(F.filter(checks, lambda x: x["score"].isNotNull()), of)


def group_weight(g: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in GROUPS.items():
        out = F.when(g == name, w).otherwise(out)
    return out


def fixes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, check, points, rank): what each imperfect check costs, the most first."""
    own = Window.partitionBy(key)
    live = rows.where("score is not null").withColumn("gw", group_weight(F.col("grp")))
    in_group = F.sum("weight").over(Window.partitionBy(key, "grp"))
    # The order within groups comes first, as it serves the windows by group and by key too: one sort.
    t = live.withColumn("first", F.row_number().over(Window.partitionBy(key, "grp").orderBy("check"))).withColumn("share", F.col("weight") / in_group)
    t = t.withColumn("all_g", F.sum(F.when(F.col("first") == 1, F.col("gw"))).over(own))
    points = rounded(F.col("gw") / F.col("all_g") * F.col("share") * (1 - F.col("score")) * 100, 1)
    t = t.withColumn("points", points).where("points > 0")
    return t.select(key, "check", "points", F.row_number().over(own.orderBy(F.col("points").desc(), "check")).alias("rank"))


def evidence_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """The evidence that a plain text gives by itself."""
    t = F.col(text)
    content, symbols = tx.garbled(t)
    return docs.withColumns({
        "word_count": tx.word_count(t), "char_count": tx.char_count(t), "garbled_content": content, "garbled_symbols": symbols, "date_styles": F.size(tx.date_styles(t)),
        "has_email": tx.email(t).isNotNull(), "has_phone": tx.phone(t).isNotNull(), "has_linkedin": t.rlike(tx.LINKEDIN),
    }).withColumn("page_count", tx.page_estimate(F.col("word_count")))
