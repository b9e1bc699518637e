"""What a reader of the results sees: score cards, facts, a warning for thin evidence, and one JSON per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.plans.scoring import as_text, level

LOW_CONFIDENCE = 0.25
CARDS = ("overall", "strength", "ats", "fit")


def low_confidence(confidence: Column) -> Column:
    return confidence < LOW_CONFIDENCE


def cards(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, card, value, band, note) of the scores that there are, the overall one first; ``results`` has a column per card and fatal."""
    rows = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("card"), F.col(c).cast("double").alias("value"))) for c in CARDS])
    t = results.select(key, "fatal", F.filter(rows, lambda r: r.isNotNull()).alias("r")).select(key, "fatal", F.size("r").alias("n"), F.posexplode("r").alias("place", "r"))
    note = F.when(F.col("fatal") & (F.col("place") == F.col("n") - 1), "no text could be read, so only the file was checked").otherwise("")
    return t.select(key, "place", "r.card", "r.value", level(F.col("r.value")).alias("band"), note.alias("note"))


def facts(features: DataFrame, leave_out: tuple[str, ...] = ("skills.list",)) -> DataFrame:
    """(doc_id, place, feature, value, evidence) from long features, in the order of their names."""
    value = F.coalesce(as_text(F.col("num")), as_text(F.col("bool"), "bool"), as_text(F.col("items"), "list"), F.col("str"))
    rows = F.array_sort(F.collect_list(F.struct("feature", value.alias("value"), F.coalesce("evidence", F.lit("")).alias("evidence"))))
    t = features.where(~F.col("feature").isin(*leave_out)).groupBy("doc_id").agg(rows.alias("f"))
    return t.select("doc_id", F.posexplode("f").alias("place", "f")).select("doc_id", "place", "f.*")


def assembled(results: DataFrame, features: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): a document's results, cards and facts in one JSON."""
    c = cards(results, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "card", "value", "band", "note"))).alias("cards"))
    f = facts(features).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature", "value", "evidence"))).alias("facts")).withColumnRenamed("doc_id", key)
    t = results.withColumn("low_confidence", low_confidence(F.col("confidence"))).join(c, key, "left").join(f, key, "left")
    return t.select(key, F.to_json(F.struct(*[x for x in t.columns])).alias("json"))
