"""Centroid clustering by ball-tree filtering.

Every task builds metric trees over its own vectors, at most ``BALL`` to a tree: a node covers a run of the tree's rows and stores their
number, their exact integer sum, and the radius of a ball around their mean. The trees are written once, and each round of Lloyd walks them from the root.
If, by the triangle inequality, no vector of a ball can be nearer to another centroid, the whole ball goes to one centroid and only its
number and sum are added; otherwise its halves are looked at, and the vectors of a leaf are compared exactly. A task returns one
total per centroid and component, so the driver gets ``k`` times the vector's length of numbers a round, whatever the data. Copies of one vector form
a ball of radius 0, which never needs its leaves but for a tie.

Components become integers, floor(``SCALE`` * x). Only vectors of exactly ``DIM`` components, none null or non-finite, take part. The first
centroids are the vectors with the smallest sha256 of ``1:<vec_id>``; a null vec_id is clustered but starts no centroid, and of rows with one vec_id
the one with the smaller integers comes first. Ties go to the smaller number; of equal centroids the later ones get nothing and stay. With
fewer than ``K`` vectors there are fewer centroids. Repeated rows count as often as they occur. Distances and sums must fit in 64 bits, or the job
fails. Other columns take no part, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import finite, floored, scratch, squared_distances, table, written

SCALE, DIM, K, ROUNDS, SEED = 64, 64, 16, 3, 1
BALL, LEAF = 8192, 32
TREE = "vec_ids array<long>, rows binary, starts array<int>, ends array<int>, halves array<int>, radii array<double>, sums binary"


@dataclass
class Tree:
    """Node i covers rows starts[i] to ends[i]; its halves are the nodes halves[i] and halves[i] + 1, or none if that is 0."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    halves: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return self.sums / (self.ends - self.starts)[:, None]


def grow(rows: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over integer rows, and the order in which it holds them. A ball is halved at the median along the line between two far rows."""
    x, order = rows.astype(np.float64), np.arange(len(rows))
    spans, halves, radii, sums = [(0, len(rows))], [], [], []
    for lo, hi in spans:  # grows as balls are halved
        own = order[lo:hi]
        total = rows[own].sum(0)
        away = np.sqrt(((x[own] - total / len(own)) ** 2).sum(1))
        radii.append(away.max() * (1 + 1e-12))
        sums.append(total)
        halves.append(0)
        if len(own) > LEAF and radii[-1] > 0:
            far = x[own[away.argmax()]]
            other = x[own[((x[own] - far) ** 2).sum(1).argmax()]]
            order[lo:hi] = own[np.argsort(x[own] @ (other - far), kind="stable")]
            halves[-1] = len(spans)
            mid = (lo + hi) // 2
            spans += [(lo, mid), (mid, hi)]
    starts, ends = np.array(spans).T
    return Tree(rows[order], starts, ends, np.array(halves), np.array(radii), np.array(sums)), order


def walk(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Balls that go whole, as (node, centroid); and the rows of the leaves that were compared, with the centroids nearest to them."""
    known, names = np.unique(centroids, axis=0, return_index=True)
    known, names = known[np.argsort(names)], np.sort(names)  # of equal centroids the smallest number, in ascending order
    whole: list[tuple[int, int]] = []
    leaves: list[np.ndarray] = []
    at, means = np.array([0]), tree.means
    while len(at):
        d = np.sqrt(((means[at][:, None, :] - known) ** 2).sum(2))
        best = d.argmin(1)
        reach = d[np.arange(len(at)), best] + tree.radii[at]
        d[np.arange(len(at)), best] = np.inf
        sure = d.min(1) - tree.radii[at] > reach + 1e-9 * (1 + reach)  # with room for rounding
        whole += zip(at[sure].tolist(), names[best[sure]].tolist(), strict=True)
        open_ = at[~sure]
        leaves += [np.arange(tree.starts[n], tree.ends[n]) for n in open_[tree.halves[open_] == 0]]
        first = tree.halves[open_[tree.halves[open_] > 0]]
        at = np.concatenate([first, first + 1])
    left = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
    return whole, left, names[squared_distances(tree.rows[left], known).argmin(1)]


def totals(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    """Per centroid the sum of its rows and, last, their number."""
    out = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    whole, left, near = walk(tree, centroids)
    for node, c in whole:
        out[c, :-1] += tree.sums[node]
        out[c, -1] += tree.ends[node] - tree.starts[node]
    np.add.at(out[:, :-1], near, tree.rows[left])
    out[:, -1] += np.bincount(near, minlength=len(centroids))
    return out


def clusters(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its centroid and its squared distance from it."""
    of = np.empty(len(tree.rows), np.int64)
    whole, left, near = walk(tree, centroids)
    for node, c in whole:
        of[tree.starts[node] : tree.ends[node]] = c
    of[left] = near
    distance = np.empty(len(of), np.int64)
    for c in np.unique(of):
        own = np.flatnonzero(of == c)
        distance[own] = squared_distances(tree.rows[own], centroids[c : c + 1])[:, 0]
    return of, distance


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, dim: int = DIM) -> DataFrame:
    """vec_id and v of the rows that take part."""
    kept = vectors.where(finite(F.col(column)) & (F.size(column) == dim))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), floored(F.col(column), scale).alias("v"))


def packed(rows: np.ndarray) -> bytes:
    """In 2 bytes a component, if they fit, or else 8."""
    return rows.astype(np.int16 if np.abs(rows).max(initial=0) < 2**15 else np.int64).tobytes()


def trees_of(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """One row per tree, built within the partitions of ``vectors``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BALL):
                b = whole.slice(lo, BALL)
                tree, order = grow(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim))
                lists = [b.column("vec_id").take(pa.array(order)), *(pa.array(a.astype(np.int32)) for a in (tree.starts, tree.ends, tree.halves)), pa.array(tree.radii)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in lists]
                yield pa.RecordBatch.from_arrays(
                    [lists[0], pa.array([packed(tree.rows)], pa.binary()), *lists[1:], pa.array([tree.sums.tobytes()], pa.binary())],
                    names=["vec_ids", "rows", "starts", "ends", "halves", "radii", "sums"],
                )

    return written(vectors.mapInArrow(build, TREE))


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for b in batches:
        for k in range(b.num_rows):
            ids, rows = b.column("vec_ids")[k].values, b.column("rows")[k].as_py()
            starts, ends, halves, radii = (b.column(name)[k].values.to_numpy() for name in ("starts", "ends", "halves", "radii"))
            x = np.frombuffer(rows, f"i{len(rows) // (len(ids) * dim)}").reshape(-1, dim).astype(np.int64)
            yield ids, Tree(x, starts, ends, halves, radii, np.frombuffer(b.column("sums")[k].as_py(), np.int64).reshape(-1, dim))


def lloyd(trees: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds; empty ones stay."""
    k, dim = centroids.shape
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dim + 1), np.int64)
            for _, tree in _read(batches, dim):
                total += totals(tree, centroids)
            c, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(total[c, i])], names=["c", "at", "total"])

        total = np.zeros((k, dim + 1), np.int64)
        for r in trees.mapInArrow(summed, "c long, at long, total long").groupBy("c", "at").agg(F.sum("total").alias("total")).collect():  # at most k * (dim + 1) rows
            total[r.c, r.at] = r.total
        used = total[:, dim] > 0
        centroids = centroids.copy()
        centroids[used] = total[used][:, :dim] // total[used][:, dim:]
    return centroids


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _read(batches, centroids.shape[1]):
            of, distance = clusters(tree, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(of.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """Of (vec_id, v): vec_id, cluster, distance of each row, and the centroids."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(by, "v").select("v").limit(k).collect()
    if not first:  # no centroid to be near to
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dim), np.int64)
    trees = trees_of(vectors, dim)
    centroids = lloyd(trees, np.array([r.v for r in first], np.int64), rounds)
    return assigned(trees, centroids), centroids


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        of, centroids = cluster(quantised(table(spark, sf_dir, "embeddings")))
        out = keep(written(of))
    sums = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # at most K rows
    facts = [(c, sums.get(c, 0), hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest()) for c, m in enumerate(centroids)]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(about), "cluster")  # at most K rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")


def ball_sql(rows: str = "embeddings") -> str:
    """The same rows in DuckDB, every vector compared with every centroid."""
    sql = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM {rows} WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS m FROM k WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {K})"""
    near = f"SELECT rid, min(CAST(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT) * 256 + c) AS dc FROM k, c{{}} GROUP BY rid"
    for r in range(1, ROUNDS + 1):
        sql += f""",
a{r} AS MATERIALIZED ({near.format(r - 1)}),
u{r} AS (SELECT dc % 256 AS c, i, sum(v[i]) AS total, count(*) AS n FROM a{r} JOIN k USING (rid), unnest(range(1, {DIM + 1})) AS t(i) GROUP BY dc % 256, i),
c{r} AS MATERIALIZED (SELECT o.c, coalesce(g.m, o.m) AS m FROM c{r - 1} o LEFT JOIN
    (SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM u{r} GROUP BY c) g ON g.c = o.c)"""
    return sql + f""",
f AS (SELECT rid, CAST(dc % 256 AS INTEGER) AS cluster, CAST(dc // 256 AS BIGINT) AS distance FROM ({near.format(ROUNDS)}))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(list_aggregate(m, 'string_agg', ',')) AS centroid_sha256
FROM f JOIN k USING (rid) JOIN c{ROUNDS} e ON e.c = f.cluster"""
