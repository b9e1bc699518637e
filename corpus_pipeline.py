"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input.

Stages work on all rows that the one before kept. Null and empty texts say nothing that could be toxic, repeated or similar: they pass every
stage once. Repeated rows are treated alike until the near-duplicates, of which one stays. Columns other than doc_id, text and source pass
through unchanged, whatever their names, but for n_chars, which follows the text. Empty tables of documents or labels give an empty result, or one
from which nothing was rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bagminhash, common, line_dedup, mixing, sentencepiece_codec, toxicity


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns that have one of the names under another one, and the selection that gives it its own columns back."""
    taken = [c for c in docs.columns if c.lower() in names]
    other = dict(zip(taken, common.spare(docs, *[f"own_{c}" for c in taken]), strict=True))
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; texts of any length are read whole. Null and empty texts score as the intercept, so they stay."""
    model = toxicity.fit(common.table(spark, sf_dir, "labels"), docs)
    own, back = _aside(docs, "score", "predicted")
    return toxicity.score(own, model).where("predicted = 0").select(back)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents that lose all that they say; those that said nothing stay. Ties are repeated rows, and stay alike."""
    own, back = _aside(docs, "n_lines", "n_removed")
    return line_dedup.dedup(own).where(~F.coalesce(line_dedup.emptied(), F.lit(False))).select(back)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; of repeated rows one. Null and empty texts are like nothing: each doc_id keeps one."""
    return bagminhash.survivors(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it; one without words (null and empty texts), which costs nothing, stays once."""
    own, back = _aside(docs, "size", "source_size", "target", "taken")
    times = F.when(F.col("size") > 0, F.floor(F.try_divide(F.col("taken"), F.col("size")))).otherwise(1).cast("int")
    (copy,) = common.spare(own, "copy")
    return mixing.mix(own).withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(back)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text; a null text is an empty one. Other columns end here."""
    docs = docs.select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, sentencepiece_codec.default_model_path(), keep_text=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line dedup", without_repeated_lines),
    ("near-duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None  # learning weights and segmenting words have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with common.scratch() as keep:
            docs = keep(common.written(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
