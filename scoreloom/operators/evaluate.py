"""Comparing results: snapshots, labels, thresholds, quantiles, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded
from scoreloom.plans.scratch import broadcast_if_small, saved


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str], tolerance: float = 2.0, flags: list[str] | None = None) -> DataFrame:
    """(key, change, field, before, after): rows that are new or removed, values that moved by more than the tolerance, flags (as 0 and 1) that flipped."""
    flags = flags or []
    side = lambda df, p: df.select(F.col(key), F.lit(True).alias(f"_{p}"), *[F.col(v).cast("double").alias(f"{p}_{v}") for v in [*values, *flags]])
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed")
    items = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"o_{v}").alias("before"), F.col(f"n_{v}").alias("after"), F.lit(v in flags).alias("flag")) for v in [*values, *flags]])
    rows = both.select(key, change.alias("change"), F.explode(items).alias("i")).select(key, "change", "i.*")
    moved = F.when(F.col("flag"), ~F.col("before").eqNullSafe(F.col("after"))).otherwise(F.abs(F.col("before") - F.col("after")) > tolerance)
    return rows.where((F.col("change").isNotNull() & ~F.col("flag")) | (F.col("change").isNull() & moved)).withColumn("change", F.coalesce("change", F.when(F.col("flag"), "flipped").otherwise("moved"))).drop("flag")


def label_ok(kind: Column, expected: Column, got: Column, tolerance: float = 0.05) -> Column:
    """Whether structs (num, bool, items) agree: lists as lower-case sets, numbers within the tolerance; missing equals missing only."""
    lower = lambda c: F.array_sort(F.array_distinct(F.transform(c, F.lower)))
    same = F.when(kind == "list", lower(expected["items"]) == lower(got["items"])).when(kind == "bool", expected["bool"] == got["bool"]).otherwise(F.abs(expected["num"] - got["num"]) <= tolerance)
    none = lambda c: c["num"].isNull() & c["bool"].isNull() & c["items"].isNull()
    return F.when(none(expected) & none(got), True).otherwise(F.coalesce(same, F.lit(False)))


def accuracy(labels: DataFrame, features: DataFrame, kinds: DataFrame, group: str, counts_default_zero: bool = True) -> DataFrame:
    """(group, fields, right, level): labelled or extracted (doc_id, feature) pairs and how many agree, by group (level 0) and over all (level 1, null group).

    Omitted counts and flags mean zero and false."""
    value = F.struct("num", "bool", "items")
    e = labels.select("doc_id", group, "feature", value.alias("e"))
    g = features.select("doc_id", "feature", value.alias("g"))
    every = e.join(g, ["doc_id", "feature"], "full_outer").join(broadcast_if_small(kinds), "feature")
    default = F.struct(F.when(F.col("kind") == "int", 0.0).alias("num"), F.when(F.col("kind") == "bool", F.lit(False)).alias("bool"), F.lit(None).cast("array<string>").alias("items"))
    blank = F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("array<string>").alias("items"))
    expected = F.coalesce("e", default if counts_default_zero else blank)
    got = F.coalesce("g", blank)
    ok = every.withColumn("ok", label_ok(F.col("kind"), expected, got).cast("int"))
    return ok.rollup(group).agg(F.count(F.lit(1)).alias("fields"), F.sum("ok").alias("right"), F.grouping(group).cast("int").alias("level"))


def tier_order(cases: DataFrame, group: str, tier: str, value: str, tiers: list[str]) -> DataFrame:
    """(group, <tier>_max and <tier>_min of each tier, ordered): whether every case of a tier lies above all of the next; ``tiers`` from the best down."""
    p = cases.groupBy(group).pivot(tier, tiers).agg(F.max(F.col(value).cast("double")).alias("max"), F.min(F.col(value).cast("double")).alias("min"))
    above = [F.col(f"{b}_max") < F.col(f"{a}_min") for a, b in zip(tiers, tiers[1:], strict=False)]
    return p.withColumn("ordered", reduce(lambda x, y: x & y, above))


def outside_bands(cases: DataFrame, keys: list[str], tier: str, value: str, bands: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(keys, cases, outside): how many values lie below the least or above the most that their tier may have."""
    out = F.lit(False)
    for name, (least, most) in bands.items():
        bad = (F.lit(False) if least is None else F.col(value) < least) | (F.lit(False) if most is None else F.col(value) > most)
        out = F.when(F.col(tier) == name, bad).otherwise(out)
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if(out).alias("outside"))


def spread(cases: DataFrame, tier: str, value: str, best: str, worst: str, band: float = 5.0) -> DataFrame:
    """(lowest, highest, range, bands, gap): how much of the scale is used: distinct bands of ``band`` points, and the gap between the worst of the best tier and the best of the worst."""
    v = F.col(value).cast("double")
    of = lambda name, f: f(F.when(F.col(tier) == name, v))
    t = cases.agg(F.min(v).alias("lowest"), F.max(v).alias("highest"), F.count_distinct(F.bround(v / band, 0)).alias("bands"), (of(best, F.min) - of(worst, F.max)).alias("gap"))
    return t.select("lowest", "highest", (F.col("highest") - F.col("lowest")).alias("range"), "bands", "gap")


def index_quantile(values: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the element of the sorted values at index floor(share * n), which is a value that occurs.

    Values are dealt by range and sorted there; the counts of the ranges tell in which one an index lies, and only in those are rows numbered. So no task
    gets a whole group.
    """
    dealt = saved(values.select(group, value).repartitionByRange(group, value).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range and group in it
    by = Window.partitionBy(group)
    upto = F.sum("_n").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumns({"_from": upto - F.col("_n"), "_all": F.sum("_n").over(by)})
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.floor(F.lit(q) * F.col("_all")), F.col("_all") - 1).alias("at")) for k, q in shares.items()]))
    counts = counts.select(group, "_p", "_n", "_from", wanted.alias("w")).where((F.col("w.at") >= F.col("_from")) & (F.col("w.at") < F.col("_from") + F.col("_n")))
    hits = counts.groupBy(group, "_p").agg(F.collect_list(F.struct(F.col("w.k").alias("k"), (F.col("w.at") - F.col("_from") + 1).alias("r"))).alias("_hits"))
    hits = hits.withColumnsRenamed({group: "_g", "_p": "_q"})
    ranked = dealt.join(hits, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy(value)))
    found = ranked.select(group, F.col(value).alias("_v"), "_r", F.explode("_hits").alias("h")).where("_r = h.r")
    return found.groupBy(group).agg(*[F.max(F.when(F.col("h.k") == k, F.col("_v"))).alias(k) for k in shares])


def threshold_sweep(values: DataFrame, value: str, positive: str, thresholds: list[float]) -> DataFrame:
    """True and false positive rates at each of a short list of thresholds."""
    rows = values.select(F.col(positive).alias("p"), F.col(value).alias("v"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit = (F.col("v") >= F.col("threshold")).cast("double")
    return rows.groupBy("threshold").agg(rounded(F.avg(F.when(F.col("p"), hit)), 4).alias("tpr"), rounded(F.avg(F.when(~F.col("p"), hit)), 4).alias("fpr"))


def top_per_key(rows: DataFrame, key: str, points: str, ties: list[str], k: int = 6) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(points).desc(), *ties))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def rolled_up(rows: DataFrame, key: str, group: str, weight: str, score: str, group_weight: Column) -> DataFrame:
    """Weighted means within groups, then over the groups that have a score; 1 decimal each."""
    w = F.col(weight).cast("decimal(18,4)")
    per = rows.groupBy(key, group).agg(rounded(100 * F.try_divide(F.sum(F.col(score).cast("decimal(18,4)") * w).cast("double"), F.sum(F.when(F.col(score).isNotNull(), w)).cast("double")), 1).alias("group_score"))
    g = F.when(F.col("group_score").isNotNull(), group_weight.cast("decimal(18,4)"))
    return per.groupBy(key).agg(F.coalesce(rounded(F.try_divide(F.sum(F.col("group_score").cast("decimal(18,4)") * g).cast("double"), F.sum(g).cast("double")), 1), F.lit(0.0)).alias("score"))
