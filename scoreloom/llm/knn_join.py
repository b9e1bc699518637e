"""Exact top-k by inner product as a Voronoi join of queries with all vectors.

Pivots (at most ``PIVOTS`` query vectors, by hash of vec_id) split queries and data into cells. Of every cell the driver gets
a summary: of queries their number and radius r, the largest distance from the pivot p; of data their number, radius and largest length.
For any query q of a cell and any vector v, ``p.v - r|v| <= q.v <= p.v + r|v|``. The pass over the data that makes the summaries takes, per cell of queries,
the k+1 highest lower bounds of different vec_ids (one may be the query's own, however often it is there); the last of them is a score that k
vectors of other ids are certain to reach. From the summaries alone follows which cells of data no query of a cell can need; of the others a second
pass sends v to a cell only if its own upper bound reaches that score. Data are dealt by their cells into blocks of about ``BLOCK`` vectors: small
cells share a block, a large one is spread over several, row by row, so neither a hot cell nor copies of one vector or one vec_id end in one task; cells of
over ``QUERIES`` queries are split by hash. Blocks are solved locally, and their best k are merged per query. Exact for any data; where cells are wide (as
for unclustered vectors) more is sent.

Components are floor(1024 * x), x as double. Rows with a null vec_id or vector, or with null or non-finite components,
take no part; a shorter vector counts as padded with zeros. Repeated rows are separate candidates; a query is asked once per
distinct row. Scores must fit in 64 bits. Vectors may be of any length; a task holds one batch of them, or one block. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import materialised, table, written

SCALE = 1024
PIVOTS = 32
BLOCK = 16_384
QUERIES = 4_096
EVERY = 100
K = 10


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (array of long) of the rows that take part."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal or shorter lists as a matrix of int64, padded with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
        out[k, : b - a] = flat[a:b]
    return out


def _products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact a.b' as int64: in floating point while every partial sum stays below 2**53."""
    if most * most * a.shape[1] < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounded(x: np.ndarray, up: bool) -> np.ndarray:
    """A bound with room for rounding."""
    slack = 1e-9 * np.abs(x) + 1e-6
    return x + slack if up else x - slack


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for (vec_id, v) tables; ties go to the smaller vec_id, and a query's own id is no candidate."""
    spark = vectors.sparkSession
    queries = queries.dropDuplicates()
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    n, dim, most = facts.n, facts.dim or 0, facts.most or 0
    pivots = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect() if n else []
    result = "query_id long, vec_id long, score long"
    if not pivots or not dim:
        return spark.createDataFrame([], result).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    p = np.zeros((len(pivots), dim), np.float64)
    for i, row in enumerate(pivots):
        p[i, : len(row.v)] = row.v
    width = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), dim)
            x = m.astype(np.float64)
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T))
            cell = d.argmin(1)
            raw = [r.tobytes() for r in m.astype(width)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array(raw, pa.binary())], names=["vec_id", "cell", "d", "raw"])

    asked = materialised(queries.mapInArrow(celled, "vec_id long, cell int, d double, raw binary"))
    cells = {r.cell: (r.r, r.n) for r in asked.groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
    own = np.array(sorted(cells))
    centre, radius = p[own], np.array([cells[c][0] for c in own])

    def bounds(m: np.ndarray, up: bool) -> np.ndarray:
        x = m.astype(np.float64)
        reach = np.sqrt((x * x).sum(1))[:, None] * radius
        return _bounded(x @ centre.T + (reach if up else -reach), up)

    def nearest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per vector its cell (as a place in ``own``), its distance from the pivot, and its length."""
        x = m.astype(np.float64)
        squares = (x * x).sum(1)
        d = np.sqrt(np.maximum(0, squares[:, None] + (centre * centre).sum(1) - 2 * x @ centre.T))
        cell = d.argmin(1) if len(d) else np.empty(0, np.int64)
        return cell, d[np.arange(len(d)), cell], np.sqrt(squares)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: the highest lower bounds per cell of queries (vec_id is given), and number, radius and length per cell of data."""
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in own]
        count, reach, length = np.zeros(len(own), np.int64), np.zeros(len(own)), np.zeros(len(own))
        for b in batches:
            m = _matrix(b.column("v"), dim)
            at, d, size = nearest(m)
            count += np.bincount(at, minlength=len(own))
            np.maximum.at(reach, at, d)
            np.maximum.at(length, at, size)
            ids, low = b.column("vec_id").to_numpy(), bounds(m, False)
            order = np.argsort(ids, kind="stable")
            ids, first = np.unique(ids[order], return_index=True)
            low = np.maximum.reduceat(low[order], first) if len(ids) else low
            for c, (known, reached) in enumerate(best):
                i, x = np.concatenate([known, ids]), np.concatenate([reached, low[:, c]])
                at = np.argsort(-x, kind="stable")[: 2 * (k + 1)]  # an id is there twice at most
                at = at[np.sort(np.unique(i[at], return_index=True)[1])][: k + 1]
                best[c] = (i[at], x[at])
        cell = np.concatenate([np.repeat(own, [len(i) for i, _ in best]), own]).astype(np.int32)
        n, none = len(cell) - len(own), lambda t: pa.nulls(len(own), t)
        join = lambda x, y: pa.chunked_array([x, y]).combine_chunks()
        yield pa.RecordBatch.from_arrays([
            pa.array(cell), join(pa.array(np.concatenate([i for i, _ in best])), none(pa.int64())), join(pa.array(np.concatenate([x for _, x in best])), none(pa.float64())),
            join(pa.nulls(n, pa.int64()), pa.array(count)), join(pa.nulls(n, pa.float64()), pa.array(reach)), join(pa.nulls(n, pa.float64()), pa.array(length)),
        ], names=["cell", "vec_id", "low", "n", "reach", "length"])

    by_cell = Window.partitionBy("cell").orderBy(F.col("low").desc())
    seen = materialised(vectors.select("vec_id", "v").mapInArrow(summed, "cell int, vec_id long, low double, n long, reach double, length double"))
    low = seen.where("vec_id is not null").groupBy("cell", "vec_id").agg(F.max("low").alias("low"))
    low = low.withColumn("at", F.row_number().over(by_cell)).where(F.col("at") == k + 1)
    sure = {r.cell: r.low for r in low.select("cell", "low").collect()}
    summary = {r.cell: r for r in seen.where("vec_id is null").groupBy("cell").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.max("length").alias("length")).collect()}  # at most PIVOTS rows
    held, reach, length = (np.array([getattr(summary[c], name) for c in own]) for name in ("n", "reach", "length"))
    least = np.array([sure.get(c, -np.inf) for c in own])
    # needed[i, j]: whether a query of cell i may need a vector of data cell j.
    highest = centre @ centre.T + np.sqrt((centre * centre).sum(1))[:, None] * reach + radius[:, None] * length
    needed = (_bounded(highest, True) >= least[:, None]) & (held > 0)
    spread = np.maximum(1, np.ceil(held / BLOCK).astype(np.int64))  # blocks of a data cell
    first, room, blocks = np.zeros(len(own), np.int64), 0, 0
    for j in np.flatnonzero(held):
        if spread[j] > 1 or room < held[j]:
            first[j], blocks = blocks, blocks + int(spread[j])
            room = 0 if spread[j] > 1 else BLOCK - held[j]
        else:
            first[j], room = blocks - 1, room - held[j]
    blocks = max(1, blocks)
    wanted = [sorted({int(first[j] + t) for j in np.flatnonzero(needed[i]) for t in range(spread[j])}) for i in range(len(own))]
    parts = np.array([max(1, math.ceil(cells[c][1] / QUERIES)) for c in own])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            m = _matrix(b.column("v"), dim)
            raw, ids = np.array([r.tobytes() for r in m.astype(width)], dtype=object), b.column("vec_id").to_numpy()
            own_cell = nearest(m)[0]
            block = first[own_cell] + (done + np.arange(len(m))) % spread[own_cell]
            done += len(m)
            rows, at = np.nonzero((bounds(m, True) >= least) & needed[:, own_cell].T)
            for lo in range(0, len(rows), 20_000):
                r, c = rows[lo : lo + 20_000], at[lo : lo + 20_000]
                times = parts[c]
                part = np.concatenate([np.arange(t) for t in times]) if times.max(initial=1) > 1 else np.zeros(len(r), np.int64)
                r, c = np.repeat(r, times), np.repeat(c, times)
                yield pa.RecordBatch.from_arrays([pa.array(own[c].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(block[r].astype(np.int32)), pa.array(ids[r]), pa.array(raw[r], pa.binary())], names=["cell", "part", "block", "vec_id", "raw"])

    dealt = vectors.mapInArrow(sent, "cell int, part int, block int, vec_id long, raw binary")
    by_own = lambda values: F.element_at(F.create_map(*[x for c, v in zip(own, values, strict=True) for x in (F.lit(int(c)), v)]), F.col("cell"))
    to = by_own([F.array(*[F.lit(t) for t in w]).cast("array<int>") for w in wanted])
    asking = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), by_own([F.lit(int(t)) for t in parts])).cast("int")).withColumn("block", F.explode(to)).select("cell", "part", "block", "vec_id", "raw")

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            read = lambda t: np.frombuffer(b"".join(t.column("raw").to_pylist()), width).reshape(-1, dim)
            q, v, qid, vid = read(left), read(right), left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(vid, kind="stable")
            v, vid = v[order], vid[order]
            for lo in range(0, len(q), 128):
                s = _products(q[lo : lo + 128], v, most)
                for own_id, row in zip(qid[lo : lo + 128], s, strict=True):
                    at = np.flatnonzero(vid != own_id)
                    if len(at) > k:
                        cut = np.partition(row[at], len(at) - k)[len(at) - k]
                        at = np.concatenate([at[row[at] > cut], at[row[at] == cut][:k]])
                        at = at[np.lexsort((vid[at], -row[at]))][:k]
                    out[0].append(np.full(len(at), own_id))
                    out[1].append(vid[at])
                    out[2].append(row[at])
        cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "vec_id", "score"])

    keys = ["cell", "part", "block"]
    found = asking.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(solved, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(quantised(table(spark, sf_dir, "embeddings")))
    return top_k(v, v.where(F.col("vec_id") % EVERY == 0))


KNN_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % {EVERY} = 0) q JOIN v d ON d.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
