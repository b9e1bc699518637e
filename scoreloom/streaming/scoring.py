"""Documents scored as they arrive: every micro-batch is written once, with its counters.

A batch is scored by the engine and written under its number. A batch that is already there is left alone, so a replay after a
failure changes nothing; one that failed half-way left nothing, as files are staged first. Counters are observed while the results are written, without a pass of
their own, and kept beside them with the seconds that it took.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreloom.api import Engine
from scoreloom.sources import sinks

COUNTERS = "batch long, documents long, scored long, eligible long, low_confidence long, score_sum double, seconds double"


def counters() -> list[Column]:
    """What is counted of results (doc_id, score, eligible, low_confidence)."""
    return [
        F.count(F.lit(1)).alias("documents"), F.count("score").alias("scored"), F.count_if("eligible").alias("eligible"), F.count_if("low_confidence").alias("low_confidence"),
        F.coalesce(F.sum(F.col("score").cast("decimal(20,4)")).cast("double"), F.lit(0.0)).alias("score_sum"),
    ]


def scored(engine: Engine, docs: DataFrame, category: str) -> DataFrame:
    """Results of readable documents (doc_id, text, ...); those with an error have a row without a score."""
    readable = docs.where("text is not null").select("doc_id", "text")
    return docs.select("doc_id", *[c for c in ("path", "error") if c in docs.columns]).join(engine.analyze(readable, category), "doc_id", "left")


def write_batch(engine: Engine, docs: DataFrame, batch: int, category: str, folder: str) -> None:
    """Scores one batch into ``folder/results`` and its counters into ``folder/counters``, once."""
    began, seen = time.monotonic(), Observation(f"batch {batch}")
    sinks.write_files(scored(engine, docs, category).observe(seen, *counters()), f"{folder}/results", f"batch-{batch}")
    got = seen.get  # of a batch that was there before, too: it is scored again but not written
    row = [(batch, *[got[c] for c in ("documents", "scored", "eligible", "low_confidence", "score_sum")], time.monotonic() - began)]
    sinks.write_files(engine.spark.createDataFrame(row, COUNTERS).coalesce(1), f"{folder}/counters", f"batch-{batch}")


def score_stream(engine: Engine, docs: DataFrame, category: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts scoring a stream of documents; ``trigger`` as for ``DataStreamWriter.trigger``, by default what is there now."""
    write = lambda batch, number: write_batch(engine, batch, number, category, folder)
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
