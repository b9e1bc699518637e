"""Results in and out: score snapshots, labelled sets, JSON and SQL sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "case_id string, category string, tier string, strength double, ats double, fit double, confidence double, eligible boolean"
LABELLED = "case_id string, category string, tier string, name string, text string, inputs map<string,string>, labels map<string,string>, sop string, sop_expect string, source string"


def write_snapshot(scores: DataFrame, path: str) -> None:
    """Scores by case, as JSON lines, one file per task."""
    scores.select(*[c.split(" ")[0] for c in SNAPSHOT.split(", ")]).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON lines; a case without an id or text, or with one that repeats, fails the job that reads it."""
    t = spark.read.schema(LABELLED).json(path)
    n = t.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    t = t.join(n, "case_id", "left")
    bad = F.col("case_id").isNull() | F.col("text").isNull() | (F.col("_n") > 1)
    return t.withColumn("case_id", F.when(bad, F.raise_error(F.concat(F.lit("not a labelled case: "), F.coalesce("case_id", F.lit("without id"))))).otherwise(F.col("case_id"))).drop("_n")


def labels_long(cases: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(doc_id, tier, feature, num, bool, items) from labelled cases; lists are separated by commas."""
    t = cases.select(F.col("case_id").alias("doc_id"), "tier", F.explode("labels").alias("feature", "v"))
    of = lambda *which: F.col("feature").isin(*[k for k, kind in kinds.items() if kind in which])
    return t.select("doc_id", "tier", "feature", F.when(of("number", "int"), F.col("v").try_cast("double")).alias("num"), F.when(of("bool"), F.col("v").try_cast("boolean")).alias("bool"), F.when(of("list"), F.filter(F.split("v", r"\s*,\s*"), lambda x: x != "")).alias("items"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_sql(results: DataFrame, url: str, name: str, properties: dict[str, str] | None = None, mode: str = "append") -> None:
    """Into a table of any JDBC database whose driver the session has; nested columns as JSON."""
    flat = results.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in results.dtypes])
    flat.write.jdbc(url, name, mode=mode, properties=properties or {})
