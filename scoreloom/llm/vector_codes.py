"""Compression of vectors to codes, a byte per part, by weighted Lloyd over distinct parts.

Components become integers, floor(``SCALE`` * x), and a vector is cut into ``PARTS`` equal consecutive parts. Equal parts of one position
are one weighted row, so copies of a vector, or of a piece of it, are worked on once. A round of Lloyd is a pass over those rows: a task
sums weights and weighted components per entry, and the driver gets one total per entry and component (``ENTRIES`` times the vector's
length). In the end the codes and errors of the distinct parts are joined back to the vectors. A part that more than one vector in ``HOT``
has comes by a broadcast, of under ``PARTS * HOT`` rows whatever the data; all others by a shuffled join, in which no key is hot.

Rows take no part whose vector is null or holds a null or a component that isn't finite. Shorter vectors count as padded with zeros up to
the longest, and all up to a multiple of ``PARTS`` components. A null vec_id is coded like any other, but starts no codebook. With fewer
than ``ENTRIES`` vectors codebooks have fewer entries. Of rows with one vec_id the one with the smaller integers comes first, so results
don't depend on the order of rows; repeated rows count as often as they occur. Ties go to the lower index. Distances must fit in 64 bits, or the job
fails. Other columns take no part, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import finite, floored, scratch, squared_distances, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
HOT = 1000
SMALL_LABELS = 100_000  # up to so many labels, the table of their errors is broadcast
KEY = ["pos", "part"]


def numbered(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows that take part, written once: rid, vec_id, label, v."""
    kept = vectors.where(finite(F.col(column)))
    return written(kept.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "label", floored(F.col(column), scale).alias("v")))


def parts_of(rows: DataFrame, width: int) -> DataFrame:
    """One row per vector and position: the row's other columns, pos, part. A part is packed into 2 bytes a component if they all fit, else 8, so
    equal parts have equal bytes and little is shuffled."""
    others = [c for c in rows.columns if c != "v"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                v, sizes = b.column("v").flatten().to_numpy(zero_copy_only=False), b.column("v").value_lengths().to_numpy(zero_copy_only=False)
                x = np.zeros((b.num_rows, PARTS * width), np.int64)
                x[np.arange(PARTS * width) < sizes[:, None]] = v
                x = x.reshape(-1, width)
                short = np.abs(x).max(axis=1) < 2**15
                packed = [r.tobytes() for r in x.astype(np.int16)]
                for k in np.flatnonzero(~short):
                    packed[k] = x[k].tobytes()
                again = pa.array(np.repeat(np.arange(b.num_rows), PARTS))
                pos = pa.array(np.tile(np.arange(PARTS, dtype=np.int32), b.num_rows))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(again) for c in others), pos, pa.array(packed, pa.binary())], names=[*others, *KEY])

    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("pos", T.IntegerType()), T.StructField("part", T.BinaryType())])
    return rows.select(*others, "v").mapInArrow(cut, schema)


def _unpacked(parts: pa.Array, width: int) -> np.ndarray:
    """Packed parts as rows of integers."""
    size = pa.compute.binary_length(parts).to_numpy(zero_copy_only=False)
    out = np.empty((len(parts), width), np.int64)
    for n in (2, 8):
        at = np.flatnonzero(size == n * width)
        if len(at):
            out[at] = np.frombuffer(b"".join(parts.take(pa.array(at)).to_pylist()), f"i{n}").reshape(-1, width)
    return out


def _nearest(b: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of (pos, part): positions, parts, nearest entries and squared distances."""
    pos, width = b.column("pos").to_numpy(), books.shape[2]
    x = _unpacked(b.column("part"), width)
    entry, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        d = squared_distances(x[at], books[p])
        entry[at] = d.argmin(1)  # the first of equals
        error[at] = d[np.arange(len(at)), entry[at]]
    return pos, x, entry, error


def lloyd(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (position, entry, component) after ``rounds`` rounds over weighted parts (pos, part, n)."""
    count, width = books.shape[1:]
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros((PARTS, count, width + 1), np.int64)  # the weights come last
            for b in batches:
                n = b.column("n").to_numpy()
                pos, x, entry, _ = _nearest(b, books)
                np.add.at(total, (pos, entry), np.concatenate([x * n[:, None], n[:, None]], axis=1))
            p, e, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, i, total[p, e, i])], names=["pos", "entry", "at", "total"])

        sums = distinct.mapInArrow(summed, "pos long, entry long, at long, total long").groupBy("pos", "entry", "at").agg(F.sum("total").alias("total")).collect()
        total = np.zeros((PARTS, count, width + 1), np.int64)
        for r in sums:  # at most PARTS * ENTRIES * (width + 1) rows
            total[r.pos, r.entry, r.at] = r.total
        used = total[:, :, width] > 0
        books = books.copy()
        books[used] = total[used][:, :width] // total[used][:, width:]
    return books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, part, n, entry, error of every weighted part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, entry, error = _nearest(b, books)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEY, "n")), pa.array(entry), pa.array(error)], names=[*KEY, "n", "entry", "error"])

    return distinct.mapInArrow(run, "pos int, part binary, n long, entry long, error long")


def _hex(half: str) -> Column:
    return F.lpad(F.lower(F.hex(half)), PARTS, "0")


def compress(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Of ``numbered`` rows: rid, vec_id, label, code and error of each, and the codebooks. ``entries`` may be up to 256."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    width = max(1, -(-(facts.dim or 0) // PARTS))
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").select("v").limit(entries).collect()
    if not first:  # no entry to be near to
        return rows.select("rid", "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((PARTS, 0, width), np.int64)
    start = np.zeros((len(first), PARTS * width), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r.v)] = r.v
    parts = parts_of(rows, width)
    distinct = written(parts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    books = lloyd(distinct, np.ascontiguousarray(start.reshape(len(first), PARTS, width).transpose(1, 0, 2)), rounds)
    codes = written(coded(distinct, books))
    often = F.col("n") > facts.n // HOT
    hot, rest = F.broadcast(codes.where(often).drop("n")), codes.where(~often).drop("n")
    found = parts.join(hot, KEY).unionByName(parts.join(hot, KEY, "left_anti").join(rest, KEY))
    byte = F.expr(f"shiftleft(entry, 8 * ({PARTS // 2 - 1} - pos % {PARTS // 2}))")
    half = lambda low: F.sum(F.when((F.col("pos") >= PARTS // 2) == F.lit(low), byte).otherwise(0))
    whole = found.groupBy("rid", "vec_id", "label").agg(half(False).alias("high"), half(True).alias("low"), F.sum("error").alias("error"))
    return whole.select("rid", "vec_id", "label", F.concat(_hex("high"), _hex("low")).alias("code"), "error"), books


def label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over rows of an equal label; nulls are one label."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    small = sums.count() <= SMALL_LABELS
    return rows.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        rows = numbered(table(spark, sf_dir, "embeddings"))
        codes, books = compress(rows)
        out = keep(written(codes.drop("rid")))
    return label_errors(out).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def codes_sql(rows: str = "embeddings") -> str:
    """The same rows in DuckDB: every vector's parts are assigned, without the distinct ones."""
    sql = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM {rows} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS MATERIALIZED (SELECT greatest(1, (max(len(v)) + {PARTS - 1}) // {PARTS}) AS w FROM k),
p AS MATERIALIZED (SELECT rid, pos, list_transform(range(pos * w + 1, pos * w + w + 1), lambda i: coalesce(v[i], 0)) AS x FROM k, z, (SELECT unnest(range(0, {PARTS})) AS pos)),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT pos, e, x AS m FROM s JOIN p USING (rid))"""
    near = "SELECT rid, p.pos, x, min(CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS BIGINT) * 256 + e) AS de FROM p JOIN c{} c ON c.pos = p.pos GROUP BY rid, p.pos, x"
    for r in range(1, ROUNDS + 1):
        sql += f""",
a{r} AS MATERIALIZED ({near.format(r - 1)}),
u{r} AS (SELECT pos, de % 256 AS e, i, sum(x[i]) AS total, count(*) AS n FROM a{r}, z, unnest(range(1, z.w + 1)) AS t(i) GROUP BY pos, de % 256, i),
c{r} AS MATERIALIZED (SELECT o.pos, o.e, coalesce(g.m, o.m) AS m FROM c{r - 1} o LEFT JOIN
    (SELECT pos, e, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM u{r} GROUP BY pos, e) g ON g.pos = o.pos AND g.e = o.e)"""
    return sql + f""",
f AS ({near.format(ROUNDS)}),
g AS (SELECT rid, string_agg(printf('%02x', de % 256), '' ORDER BY pos) AS code, CAST(sum(de // 256) AS BIGINT) AS error FROM f GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(list_aggregate(m, 'string_agg', ','), ',' ORDER BY pos, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM g JOIN k USING (rid)"""
