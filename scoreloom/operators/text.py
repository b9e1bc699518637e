"""Line and text projections, all as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed, patterns
from scoreloom.functions.numbers import rounded

SPACE = r"(?U)\s+"
BULLET = rf"^\s*(?:{'|'.join(re.escape(x) for x in fixed.BULLETS)}|\(cid:\d+\)|[\x{{E000}}-\x{{F8FF}}])\s+"
NUMBERED = r"^\s*\(?\d{1,2}[.)]\s+"
EMAIL = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
URL = rf"(?i)\b(?:https?://|www\.)[^\s]+|{EMAIL}"
# Ten to thirteen digits with at most two separators between, not within a longer number, word or path.
PHONE = r"(?<![\w/+])(?:\+|(?<!\d[ ().-]{1,2}))\d(?:[ ().-]{0,2}\d){9,12}(?![ ().-]{0,2}\d|[\w/])"
LINKEDIN = r"(?i)linkedin\.com/in/[\w-]+"
GLYPH = r"\(cid:\d+\)|[\x{E000}-\x{F8FF}\x{FFFD}]"
_MONTH, _YEAR, _TWO = rf"\b{patterns.any_of(fixed.MONTHS)}[A-Za-z]*\.?", r"(?:19|20)\d\d", "(?:0[1-9]|1[0-2])"
_ONE = f"(?:{_TWO}|[1-9])"
DATE_STYLES = {
    "Mon YYYY": rf"{_MONTH}\s+{_YEAR}\b", "Mon 'YY": rf"{_MONTH}\s*['’]\s?\d\d\b", "MM/YYYY": rf"(?<![\d/]){_ONE}/{_YEAR}\b", "MM-YYYY": rf"(?<![\d-]){_ONE}-{_YEAR}\b", "YYYY-MM": rf"\b{_YEAR}-{_TWO}(?![\d-])",
}


def normal(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def char_count(c: Column) -> Column:
    """Characters but for blanks."""
    return F.length(F.replace(c, F.lit(" "), F.lit("")))


def page_estimate(n_words: Column, per_page: int = 500) -> Column:
    return F.greatest(F.lit(1.0), rounded(n_words / per_page + 0.49, 0)).cast("int")


def is_bullet(c: Column, style: Column | None = None) -> Column:
    """A bullet glyph, or a list style of the source document."""
    glyph = c.rlike(BULLET)
    return glyph if style is None else glyph | F.coalesce(F.lower(style).rlike("^list (bullet|number|paragraph)"), F.lit(False))


def strip_bullet(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, BULLET, ""), NUMBERED, ""))


def heading_form(c: Column) -> Column:
    """Lower case, & as and, only letters, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z ]", " "), " +", " "))


def blank_urls(c: Column) -> Column:
    """Addresses replaced by as many blanks, so that offsets stay."""
    parts, found = F.split(c, URL, -1), F.regexp_extract_all(c, F.lit(URL), 0)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(F.get(found, i))), F.lit("")))), "")


def blank_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]{1,80}>", " ")


def evidence(c: Column) -> Column:
    return F.substring(normal(c), 1, 160)


def tidy_name(c: Column) -> Column:
    """An upper-case name in title case, after an apostrophe or hyphen too; single letters stay."""
    titled = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"\p{L}+|[^\p{L}]+"), 0), lambda x: F.initcap(x)), "")
    return F.when(F.upper(c) == c, F.array_join(F.transform(F.split(c, " "), lambda w: F.when(F.length(w) > 1, titled(w)).otherwise(w)), " ")).otherwise(c)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, text): the non-blank lines of every text, white space normalised, numbered from 0; without a shuffle."""
    said = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), normal), lambda x: x != "")
    return docs.select(key, F.posexplode(said).alias("line_no", "text"))


def garbled(c: Column, glyph: str = GLYPH) -> tuple[Column, Column]:
    """Numbers of unmapped glyphs: attached to text (content), and standing alone (symbols)."""
    all_ = F.regexp_count(c, F.lit(glyph))
    alone = F.size(F.filter(F.split(c, SPACE), lambda w: w.rlike(f"^(?:{glyph})$")))
    return all_ - alone, alone


def email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, EMAIL, 0), F.lit(""))


def phone(c: Column) -> Column:
    """The first number of 10 to 13 digits that isn't part of a longer token."""
    return F.nullif(F.regexp_extract(c, PHONE, 0), F.lit(""))


def date_styles(c: Column) -> Column:
    """Map of style to number of dates in it, without the styles that don't occur."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_count(c, F.lit(p)).alias("value")) for k, p in DATE_STYLES.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def normal_month(c: Column) -> Column:
    """Five ways to write a month as ``Mon YYYY``, words for today as ``Present``; anything else stays as it is."""
    t = normal(c)
    name, m1, y1 = r"(?i)^([a-z]{3})[a-z]*\.?,? +(\d{4})$", r"^(\d{1,2})[/-](\d{4})$", r"^(\d{4})[/-](\d{1,2})$"
    quote = r"(?i)^([a-z]{3})[a-z]*\.? *['’] ?(\d\d)$"
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    number = lambda p, g: F.try_element_at(names, F.nullif(F.when(t.rlike(p), F.regexp_extract(t, p, g)).cast("int"), F.lit(0)))
    month = lambda p: F.when(F.array_contains(names, F.initcap(F.regexp_extract(t, p, 1))), F.initcap(F.regexp_extract(t, p, 1)))
    return F.coalesce(
        F.when(F.lower(t).isin("present", "current", "currently", "now", "ongoing", "till date", "date"), "Present"),
        F.when(t.rlike(name) & month(name).isNotNull(), F.concat(month(name), F.lit(" "), F.regexp_extract(t, name, 2))),
        F.when(t.rlike(quote) & month(quote).isNotNull(), F.concat(month(quote), F.when(F.regexp_extract(t, quote, 2) < "70", " 20").otherwise(" 19"), F.regexp_extract(t, quote, 2))),
        F.when(t.rlike(m1) & number(m1, 1).isNotNull(), F.concat(number(m1, 1), F.lit(" "), F.regexp_extract(t, m1, 2))),
        F.when(t.rlike(y1) & number(y1, 2).isNotNull(), F.concat(number(y1, 2), F.lit(" "), F.regexp_extract(t, y1, 1))),
        t,
    )


GENERIC = fixed.GENERIC_NAMES
DRAFT = rf"(?:^|[\s_\-(])(?:{patterns.any_of(fixed.DRAFT_MARKS)}|[vV]\d+|\(\d+\))(?:$|[\s_\-).])"


def stem(c: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")


def filename_tokens(c: Column, generic: list[str] = GENERIC) -> Column:
    """Lower-case tokens of a file's stem that say something."""
    tokens = F.filter(F.split(F.lower(stem(c)), r"[^\p{L}]+"), lambda t: t != "")
    return F.array_except(tokens, F.array(*[F.lit(g) for g in generic]))


def suggested_filename(name: Column, role: Column, extension: str = "pdf") -> Column:
    clean = F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}]+", "_")
    return F.concat(F.concat_ws("_", clean, F.lit("Resume"), F.nullif(role, F.lit(""))), F.lit(f".{extension}"))


SIGNALS = {  # sign of a specific text: pattern and share; the shares sum to 1
    "names_faculty": (r"(?i)\bprof\.?\s*[a-z]|\bdr\.\s*[a-z]", fixed.NAMES_FACULTY),
    **{k: (patterns.whole(words) + (r"|(?i)\b[a-z]{2,} (?:lab|group)\b" if k == "names_lab_or_group" else ""), share) for k, (share, words) in fixed.SIGNS.items()},
    "quantifies": (rf"\d\s*{patterns.any_of(fixed.COUNTED)}", fixed.QUANTIFIES),
}
CLICHES = patterns.whole(fixed.CLICHES)


def specificity(c: Column, signals: dict[str, tuple[str, float]] = SIGNALS, cliches: str = CLICHES) -> Column:
    """Sum of the shares of the signs present, less a penalty per distinct cliché, between 0 and 1."""
    parts = [F.when(c.rlike(p), w).otherwise(0.0) for p, w in signals.values()]
    found = F.size(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(cliches), 0), lambda x: normal(F.lower(x)))))
    total = sum(parts[1:], parts[0]) - found * fixed.CLICHE_PENALTY
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)


def percent(c: Column) -> Column:
    """The first percentage or labelled mark, if over 0 and up to 100."""
    a, b = F.regexp_extract(c, r"(\d{1,3}(?:\.\d{1,2})?)\s*%", 1), F.regexp_extract(c, patterns.after(fixed.PERCENT_NAMES, "1,3", True), 1)
    v = F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).cast("double")
    return F.when((v > 0) & (v <= 100), v)
