"""One vector per distinct text, kept in a table by the text's digest.

An embedder is slow, texts repeat within a run and between runs. So texts are reduced to their distinct ones, those without a vector in the
cache are embedded, appended to it, and all vectors are joined back by digest. The cache is a Parquet folder per model, appended to by Spark's
commit, so a failed run adds nothing. Two runs at once may both embed a text; either vector then serves.

A null text has a null vector. A model's name stands for the embedder: another embedder needs another name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR = "digest binary, vector array<double>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Cache:
    """Vectors by digest in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark, self.path = spark, f"{folder}/model={model}"

    def known(self) -> DataFrame:
        try:
            held = self.spark.read.schema(VECTOR).parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], VECTOR)
        return held.groupBy("digest").agg(F.first("vector").alias("vector"))

    def fill(self, texts: DataFrame, text: str, embed: Callable[[Column], Column]) -> None:
        """Embeds the distinct texts that have no vector yet, each once."""
        new = texts.where(F.col(text).isNotNull()).groupBy(digest(F.col(text)).alias("digest")).agg(F.first(text).alias("_text"))
        new = new.join(self.known(), "digest", "left_anti")
        new.select("digest", embed(F.col("_text")).cast("array<double>").alias("vector")).write.mode("append").parquet(self.path)

    def vectors(self, texts: DataFrame, text: str, embed: Callable[[Column], Column], name: str = "vector") -> DataFrame:
        """``texts`` with the vector of each row's text."""
        self.fill(texts, text, embed)
        return texts.withColumn("_digest", digest(F.col(text))).join(self.known().select(F.col("digest").alias("_digest"), F.col("vector").alias(name)), "_digest", "left").drop("_digest")


def distinct_vectors(texts: DataFrame, text: str, embed: Callable[[Column], Column], name: str = "vector") -> DataFrame:
    """The same within one run, without a cache: distinct texts are embedded once and joined back."""
    once = texts.where(F.col(text).isNotNull()).groupBy(digest(F.col(text)).alias("_digest")).agg(F.first(text).alias("_text"))
    return texts.withColumn("_digest", digest(F.col(text))).join(once.select("_digest", embed(F.col("_text")).alias(name)), "_digest", "left").drop("_digest")
