"""Near-duplicate documents by BagMinHash signatures of their shingle multisets.

A document is the multiset of its five-word shingles (lower-case words; a shorter text is one shingle). A shingle's
weight axis is split into the dyadic intervals [0,1), [1,2), [2,4), ...; each has a Poisson process of points (time,
signature component, place on the weight axis) that depends on the shingle alone. The leading bits of the place halve
the interval again and again, so a point belongs to a document if its place lies below the shingle's weight there, and
a weight of w uses about log w processes. Component j of the signature is the document's earliest point in j; two
documents agree there with a probability equal to their weighted Jaccard similarity. Processes of a document run until
its latest component is settled.

``BANDS`` bands of ``ROWS`` components make buckets. Two documents of similarity 0.8 share none with probability
(1 - 0.8**ROWS)**BANDS, under 3e-5. Buckets are worked off in rounds: the member that shares buckets with most others, usually
the original of a group of copies, is compared with the bucket's other members by exact multiset overlap of the whole texts, and
what is then in its component leaves. A group of n copies costs about n comparisons per round. Pairs of one bucket that are in
different components after ``ROUNDS`` rounds are compared as well, unless a parity sketch proves them to be less similar: every occurrence of
a shingle flips one of ``SKETCH`` bits, so each bit in which two sketches differ is an occurrence that only one of the two has. That bound
leaves out no pair that is similar; it is sharp up to some thousand shingles and lets longer texts pass. Exact copies are one vertex.

A null or empty text (no words) is like nothing, not even another one: each such row is a class of its own. A class
has the smallest doc_id of its members as class_id (null only if all are). Repeated rows are exact copies. Texts are read whole, however
long; one batch holds at most 256 of them. Columns besides doc_id and text play no part, and stay in what ``survivors`` returns, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import lean_shuffles, materialised, scratch, spare, table, written
from scoreloom.llm.components import components

WORDS = 5
SIMILAR = 0.8
ROWS, BANDS = 4, 20
SIZE = ROWS * BANDS
ROUNDS = 2
SKETCH = 2048
_WORD = re.compile(r"\w+")
_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        total += _mixed(h[k : k + n] ^ _STEP[k])
    return np.unique(_mixed(total), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum() + b[1].sum()) - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """For each multiset, per component a hash that names its earliest point; an empty multiset has zeros."""
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    if not len(doc):
        return np.zeros((len(bags), size), np.uint64)
    key, weight = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags])
    parts = []
    for level in range(int(weight.max()).bit_length() + 1):  # intervals [0,1), [1,2), [2,4), ...
        low = 0 if level == 0 else 1 << level - 1
        use = np.flatnonzero(weight > low)
        if not len(use):
            break
        width = 1 if level == 0 else low
        parts.append((doc[use], _mixed(key[use] ^ _STEP[1] + np.uint64(level)), np.full(len(use), float(width)), np.minimum(1.0, (weight[use] - low) / width)))
    at, seed, rate, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(at))
    first, name = np.full(len(bags) * size, np.inf), np.zeros(len(bags) * size, np.uint64)
    while len(at):
        seed = seed + _STEP[0]
        point = _mixed(seed)
        time = time - np.log1p(-((point >> np.uint64(11)) / float(1 << 53))) / rate
        second = _mixed(point + _STEP[2])
        place = (second >> np.uint64(32)) / float(1 << 32)
        ok = place < share
        slot = at * size + ((second & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        s, t = slot[ok], time[ok]
        np.minimum.at(first, s, t)
        won = t == first[s]
        name[s[won]] = point[ok][won]
        latest = first.reshape(-1, size).max(axis=1)
        go = time < latest[at]
        at, seed, rate, share, time = at[go], seed[go], rate[go], share[go], time[go]
    return name.reshape(-1, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, with the band's number mixed in."""
    cut = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[3], cut.shape[:2])
    for k in range(ROWS):
        key = _mixed(key + cut[:, :, k])
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, bands) per row: MD5 of the text, number of shingles, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("text").to_pylist()
                bags = [shingles(x, hashes) for x in texts]
                keys = bands(signatures(bags))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([hashlib.md5((x or "").encode()).digest() for x in texts], pa.binary()), pa.array([int(w.sum()) for _, w in bags], pa.int64()), lists],
                    names=["doc_id", "h", "n", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h binary, n long, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds sim, the exact similarity, to pairs (a, b) of text hashes."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"), "text").join(wanted, "h", "left_semi")
    texts = written(texts.groupBy("h").agg(F.first("text").alias("text")))
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: tuple[str | None, tuple] = (None, ())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                    if x != known[0]:
                        known = (x, shingles(x, hashes))
                    out.append(similarity(known[1], shingles(y, hashes)))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], names=["a", "b", "sim"])

    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, sim double"))


def parity(bag: tuple[np.ndarray, np.ndarray], size: int = SKETCH) -> np.ndarray:
    """``size`` bits as longs; each occurrence of a shingle flips one."""
    keys, times = bag
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    places = _mixed(np.repeat(keys, times) + nth.astype(np.uint64) * _STEP[4]) % np.uint64(size)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def sketched(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, size, sketch) for the text hashes (h): number of shingles and parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                bags = [shingles(x, hashes) for x in b.column("text").to_pylist()]
                packed = np.concatenate([parity(bag) for bag in bags]) if bags else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(packed) + 1, SKETCH // 64, dtype=np.int32)), pa.array(packed))
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([int(w.sum()) for _, w in bags], pa.int64()), lists], names=["h", "size", "sketch"])

    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"), "text").join(wanted, "h", "left_semi")
    return written(texts.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(run, "h binary, size long, sketch array<long>"))


def _may_be_similar(x: str, y: str) -> Column:
    """Whether sizes and sketches of two texts allow a similarity of SIMILAR: a first part of the sketch, then all of it."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    most = n + m - 2 * F.ceil((n + m) * (SIMILAR / (1 + SIMILAR)) - 1e-9)
    bits = lambda ks: reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in ks])
    return (F.least(n, m) >= F.greatest(n, m) * SIMILAR - 1e-9) & (bits(range(8)) <= most) & (bits(range(SKETCH // 64)) <= most)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, class_id, keep): class_id is the class's smallest doc_id, keep the text hash of the one text that stays for it."""
    with lean_shuffles(docs.sparkSession), scratch() as keep:
        return keep(written(_near_duplicates(docs)))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    rows = written(signed(docs))
    texts = rows.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    entries = written(texts.select("h", F.explode("bands").alias("key")))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(entries.join(sizes, "key"))
    shared = written(shared.select("key", "h").join(shared.groupBy("h").agg(F.sum("members").alias("known")), "h"))
    good, labels, pending = None, None, shared

    def labelled(part: DataFrame) -> DataFrame:
        return part.withColumn("label", F.col("h")) if labels is None else part.join(labels.withColumnRenamed("v", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))

    for _ in range(ROUNDS):
        own = labelled(pending)
        heads = own.groupBy("key").agg(F.max_by(F.struct("h", "label"), F.struct("known", "h")).alias("head"))
        met = own.join(heads, "key").where(F.col("label") != F.col("head.label"))
        pairs = met.select(F.least("h", "head.h").alias("a"), F.greatest("h", "head.h").alias("b")).distinct()
        found = verified(materialised(pairs), docs).where(F.col("sim") >= SIMILAR).select("a", "b")
        good = found if good is None else good.union(found)
        labels = components(good)
        now = labelled(pending).join(heads.select("key", F.col("head.h").alias("hh")), "key").join(labels.select(F.col("v").alias("hh"), F.col("label").alias("hl")), "hh", "left")
        pending = written(now.where(F.col("label") != F.coalesce("hl", "hh")).select("key", "h", "known"))
    every = labelled(shared)
    open_ = every.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    open_ = written(every.join(open_, "key", "left_semi").select("key", "h", "label"))
    sketch = sketched(open_.select("h").distinct(), docs)
    open_ = written(open_.join(sketch, "h").select("key", "h", "label", "size", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH // 64)]))
    x, y = open_.alias("x"), open_.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & _may_be_similar("x", "y"))
    rest = materialised(rest.select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct())
    if not rest.isEmpty():
        labels = components(good.union(verified(rest, docs).where(F.col("sim") >= SIMILAR).select("a", "b")))
    named = texts.select("h", "least").join(labels.withColumnRenamed("v", "h"), "h", "left").select("h", "least", F.coalesce("label", "h").alias("label"))
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "h"))["h"].alias("keep"))
    named = written(named.join(classes, "label").select("h", "class_id", "keep"))
    return rows.join(named, "h", "left").select("doc_id", "h", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("keep", "h").alias("keep"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the text of its smallest doc_id, once; rows that are like nothing."""
    id_, h, key, rows, row = spare(docs, "id", "h", "key", "rows", "row")
    found = near_duplicates(docs)
    stay = found.where((F.col("h") == F.col("keep")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = written(stay.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.count(F.lit(1)).alias(rows)))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    match = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(h))
    once = keyed.join(stay.where(F.col(rows) == 1), match, "left_semi").select(docs.columns)
    # Rows equal in doc_id and text: the one whose other columns have the smallest hash.
    hashed = F.xxhash64(*[F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in docs.dtypes])
    more = keyed.join(stay.where(F.col(rows) > 1), match, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*docs.columns), hashed).alias(row))
    return once.union(more.select(f"{row}.*"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id")
