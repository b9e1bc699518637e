"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (``DIM_BITS`` bits) of its lower-case words, pairs of neighbouring words and
pairs with one word between them; of longer words, the first ``STEMS`` characters are unigrams too, so that inflected
and compound forms share weight, and a stem that ``SEVERAL`` different words of the text have is one more (both chosen on rows with a remainder of 1,
none of which is held out). Learning goes once per epoch over a bounded sample of the labelled rows (the
``SAMPLE`` rows with the smallest hash of doc_id) in one task, with FTRL-proximal's learning rates per coordinate; its
L1 term leaves few weights that are not zero, and only those go to the tasks that score (at most 2**DIM_BITS pairs).
Scoring reads every whole text.

Labels, lang, source and doc_id are never inputs of a score. A null or empty text has no features: its score is that of
the intercept. Without labelled rows the intercept is that of a rare class, so nothing is rejected. Rows of ``labels``
with a null label or doc_id are not learnt from; repeated rows count as often as they occur, within the sample; ties in its order are broken by
the features. Texts of any length are scored whole, one after another. Other columns stay, but for score and predicted, which are set anew. An empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import table

DIM_BITS = 20
SAMPLE = 8192
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
STEMS = (4, 5)  # leading characters of a longer word that count as a further unigram
SEVERAL = 2
NO_LABELS = -4.0  # the intercept without labelled rows
_WORDS = re.compile(r"\w+")
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX, _MANY = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hash of each word; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct feature indices of a text, ascending."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int32)
    one = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    grams = [one, (one[:-1] * _PAIR) ^ one[1:], (one[:-2] * _SKIP) ^ (one[2:] + _PAIR)]
    different = set(words)
    for k in STEMS:
        stems, times = np.unique(np.fromiter((hashes["^" + w[:k]] for w in different if len(w) > k), np.uint64), return_counts=True)
        grams += [stems, stems[times >= SEVERAL] * _MANY]
    every = np.concatenate(grams) * _MIX
    return np.unique((every >> np.uint64(64 - DIM_BITS)).astype(np.int32))


class Ftrl:
    """FTRL-proximal for binary features; index 2**DIM_BITS is the intercept, which has no penalty."""

    def __init__(self, size: int, start: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.z0, self.n0, self.start = 0.0, 0.0, start

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def intercept(self) -> float:
        return self.start - self.z0 / ((BETA + self.n0**0.5) / ALPHA)

    def learn(self, at: np.ndarray, label: float) -> None:
        w, w0 = self.weights(at), self.intercept()
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        sigma0 = ((self.n0 + g * g) ** 0.5 - self.n0**0.5) / ALPHA
        self.z0 += g - sigma0 * (w0 - self.start)
        self.n0 += g * g


def _train(rows: list[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    positive = sum(y for _, y in rows)
    start = float(np.log((positive + 1) / (len(rows) - positive + 1))) if positive else NO_LABELS
    model = Ftrl(1 << DIM_BITS, start)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*rows[k])
    every = model.weights(np.arange(1 << DIM_BITS))
    at = np.flatnonzero(every)
    return model.intercept(), at.astype(np.int32), every[at]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts are Python strings at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def fit(labels: DataFrame, docs: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, and indices and values of the weights that are not zero. Rows that are held out are not used."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "label").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("h", "doc_id", "label", "text")  # at most ``sample`` narrow rows

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches):
            at = [features(x, hashes).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("doc_id"), b.column("label"), pa.array(at, pa.binary())], names=["h", "doc_id", "label", "at"])

    def learn(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("h").to_pylist(), t.column("doc_id").to_pylist(), t.column("label").to_pylist(), t.column("at").to_pylist(), strict=True), key=lambda r: r[:3] + (len(r[3]), r[3]))
        w0, at, w = _train([(np.frombuffer(x, np.int32), y) for _, _, y, x in rows])
        return pa.table({"w0": [w0], "at": pa.array([at.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

    rows = texts.mapInArrow(indexed, "h long, doc_id long, label int, at binary").orderBy("h", "doc_id", "label", F.md5("at")).limit(sample)  # also if doc_ids repeat
    rows = rows.withColumn("task", F.lit(1)).groupBy("task").applyInArrow(learn, "w0 double, at binary, w binary").collect()
    if not rows:
        return NO_LABELS, np.empty(0, np.int32), np.empty(0)
    return rows[0].w0, np.frombuffer(bytes(rows[0].at), np.int32), np.frombuffer(bytes(rows[0].w))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) to every row."""
    w0, at, w = model
    keep = docs.drop("score", "predicted")
    schema = T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << DIM_BITS)
        dense[at] = w
        hashes = WordHashes()
        for b in sliced(batches):
            logit = np.array([dense[features(x, hashes)].sum() + w0 for x in b.column(text).to_pylist()], dtype=np.float64)
            p = 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return keep.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(table(spark, sf_dir, "labels"), docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
