"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="scoreloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """Small or narrow results are computed once: checkpointed in the shared folder, so a lost executor costs nothing."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``materialised`` for wider tables: compressed Parquet in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)  # at the latest; discard and scratch are earlier
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    scopes = _scopes.get()
    if scopes:
        scopes[-1].append(out)
    return out


#: Open scopes, innermost last. Each thread has its own, so runs side by side in one driver leave each other's tables alone.
_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what ``written`` wrote within, but for tables given to the function that it yields."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    own: list[DataFrame] = []
    outer = _scopes.get()
    _scopes.set((*outer, own))
    try:
        yield keep
    finally:
        _scopes.set(outer)
        discard(*[t for t in own if not any(t is k for k in kept)])
        if outer:
            outer[-1].extend(kept)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(conf).delete(path, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of ``df`` has, whatever its case."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


@contextlib.contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a finished execution are removed at once instead of when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def floored(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite; false, never null."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer rows: in floating point while no partial sum can reach 2**53, else in Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)
