"""Mixing sources to target weights by hash-threshold histograms, without sorting.

Sources in order of code point (null last) weigh 5, 2, 1, repeating, and share the size of all documents by weight; a
target stops at ``most`` times its source's size and the excess is shared again by weight until no target is above. A
document is taken whole: ``floor(target / source size)`` times, and once more if its hash lies below its source's
threshold. The threshold comes from nested histograms: words by source and hash bucket give the bucket in which the
running sum crosses the budget, and only that bucket's documents are dealt out again by further hash bits. What lies in
the last, smallest bucket is taken if that brings the source nearer to its target.

Rows of equal doc_id fall on the same side of a threshold, so reruns agree and repeated rows are treated alike. A null
doc_id hashes as an empty string; a null text has size 0; a source without words has target 0. An empty table gives an
empty result. Texts of any length are counted whole. All columns of the input stay, whatever their names, but for those that the operator sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import materialised, spare, table

WEIGHTS = (5, 2, 1)
MOST = 3
BITS = 10  # of the hash, per level; a source has at most 2**BITS rows in a histogram
LEVELS = 2
SMALL_SOURCES = 100_000  # up to so many sources, the table of their thresholds is broadcast
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """28 bits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")


def bucket_of(h: Column, level: int) -> Column:
    return F.shiftright(h, 28 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source (source, source_size): adds weight and target. Filled from the source that is capped first."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("n"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    n = F.row_number().over(by_name)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumns({"n": n, "weight": pick, "cap": F.col("source_size") * most})
    s = s.withColumns({"total": F.sum("source_size").over(whole), "all_w": F.sum("weight").over(whole)})
    s = s.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # The share of a unit of weight if all sources before this one are at their caps; a source is capped if it can't hold that.
    s = s.withColumn("unit", (F.col("total") - F.col("full")).cast("double") / (F.col("all_w") - F.col("gone")))
    s = s.withColumn("capped", F.col("cap").cast("double") <= F.col("unit") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("gone", "unit"))).over(whole)["unit"]
    return s.withColumn("level", level).select(
        "source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def _joined(left: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    right = per_source.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes, repeats counted) to every row of ``docs``."""
    keep = docs.drop("size", "source_size", "target", "taken")
    size_, h_, source_, total_, target_, times_, below_ = spare(keep, "size", "h", "source", "total", "target", "times", "below")
    sized = keep.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), size_of(F.col(text)).alias("size"), hash_of(F.col(doc_id)).alias("h"))
    rules = thresholds(materialised(sized), weights, most)
    small = rules.count() <= SMALL_SOURCES
    out = keep.withColumns({size_: size_of(F.col(text)), h_: hash_of(F.col(doc_id))})
    rules = rules.select(F.col("source").alias(source_), F.col("source_size").alias(total_), F.col("target").alias(target_), F.col("times").alias(times_), F.col("below").alias(below_))
    out = out.join(F.broadcast(rules) if small else rules, F.col(source).eqNullSafe(F.col(source_)))
    taken = F.col(size_) * (F.col(times_) + (F.shiftright(h_, 28 - BITS * LEVELS) < F.col(below_)).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in keep.columns], F.col(size_).alias("size"), F.col(total_).alias("source_size"), F.col(target_).alias("target"), taken.alias("taken"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, size, h), per source: source_size, target, times, and the bound ``below`` which the leading bits of the hash must be."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rules = targets(sizes, weights, most)
    times = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    rules = rules.withColumn("times", F.least(times, F.lit(most)).cast("long"))
    rules = rules.withColumns({"budget": F.col("target") - F.col("times") * F.col("source_size"), "below": F.lit(0).cast("long"), "got": F.lit(0).cast("long"), "last": F.lit(0).cast("long")})
    rules = materialised(rules)
    small = rules.count() <= SMALL_SOURCES
    for level in range(LEVELS):
        within = _joined(sized, rules.select("source", "below"), small) if level else sized
        if level:  # only the documents of the boundary bucket
            within = within.where(F.shiftright("h", 28 - BITS * level) == F.col("below"))
        hist = within.groupBy("source", bucket_of(F.col("h"), level).alias("b")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        hist = _joined(hist.withColumn("upto", run), rules.select("source", "budget", F.col("got").alias("base")), small)
        # The first bucket after which the budget is passed; without one, the bucket after the last.
        cross = hist.where(F.col("base") + F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("at"))
        cross = cross.withColumnRenamed("source", "_s")
        rules = rules.join(cross, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        # Without a crossing the whole bucket is within budget: the bound is the next bucket of this level.
        shift = F.shiftleft("below", BITS)
        open_ = F.col("at").isNull()
        rules = rules.withColumns({
            "below": F.when(open_, shift + (1 << BITS)).otherwise(shift + F.col("at.b")),
            "got": F.col("got") + F.coalesce(F.col("at.before"), F.lit(0)),
            "last": F.coalesce(F.col("at.words"), F.lit(0)),
        }).drop("at")
        rules = materialised(rules)
    nearer = (F.col("last") > 0) & (F.col("got") + F.col("last") - F.col("budget") < F.col("budget") - F.col("got"))
    return materialised(rules.withColumn("below", F.col("below") + nearer.cast("long")).select("source", "source_size", "target", "times", "below"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(docs: str = "documents") -> str:
    """The same rows in DuckDB; thresholds from a full sort of each source by hash instead of histograms."""
    cut = 28 - BITS * LEVELS
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7))::BIGINT >> {cut} AS h FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, {MOST} * source_size AS cap FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS unit,
    coalesce(sum(weight) OVER o, 0) AS gone FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(unit, gone) AS level FROM c WHERE cap > unit * weight),
t AS (SELECT source, source_size, CASE WHEN cap <= unit * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM c, l),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least({MOST}, CAST(floor(target / source_size) AS BIGINT)) END AS times FROM t),
g AS (SELECT d.source, h, sum(size) AS words FROM d GROUP BY d.source, h),
r AS (SELECT g.source, h, words, sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto FROM g),
x AS (SELECT q.*, target - times * source_size AS budget FROM q),
k AS (SELECT r.source, r.h, upto <= budget OR (upto - words <= budget AND upto - budget < budget - (upto - words)) AS inside FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, x.source_size, x.target, CAST(d.size * (x.times + CASE WHEN k.inside THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h"""
