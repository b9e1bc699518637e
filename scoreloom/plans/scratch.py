"""Tables that several plans read are computed once and kept in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of the open scopes of this thread, innermost last.
_scopes: contextvars.ContextVar[tuple[list[tuple], ...]] = contextvars.ContextVar("saved", default=())


def saved(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table that all executors can read; a local session without a shared folder uses a temporary one.

    With ``by`` its rows stand in buckets of those columns, so whatever groups, joins or windows by them reads it without another shuffle.
    It goes when the innermost ``scope`` ends, or without one when the session's JVM does, as plans are lazy.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scoreloom-")
    path = f"{folder}/{uuid.uuid4().hex}.parquet"
    if by:
        name = f"saved_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).option("path", path).saveAsTable(name)
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # of the catalogue only: the files are where they were, and go as those of any other
    else:
        df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    if _scopes.get():
        _scopes.get()[-1].append((fs, at))
    return out if by else spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables saved within, by this thread: a service that runs for long opens one per request."""
    own: list[tuple] = []
    outer = _scopes.get()
    _scopes.set((*outer, own))
    try:
        yield
    finally:
        _scopes.set(outer)
        for fs, at in own:
            fs.delete(at, True)


def broadcast_if_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A hint to broadcast a table that the caller gave, if it has at most so many rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
