"""Sinks that write all or nothing, by Spark's data source protocol: every task stages what it writes, one commit makes it visible.

``scoreloom_files`` writes rows as JSON lines, or one file per row. ``scoreloom_sql`` inserts rows into a table of a database, or deletes rows by key with
what hangs on them. Each writes a named batch at most once: a batch that was committed is skipped when it is written again, so a retried job or
a replayed micro-batch changes nothing. A task that fails removes what it staged; a job that fails removes the rest. Attempts that were lost with their executor are left out of the
commit, as only files and rows that a finished task reported count.

    df.write.format("scoreloom_files").option("path", folder).option("batch", "7").mode("append").save()

The folder must be one that all executors and the driver share, in any file system that Arrow reads. Register both once per session with ``register``.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSink)
    spark.dataSource.register(SqlSink)


def _attempt() -> str:
    """Names this attempt of this task."""
    t = TaskContext.get()
    return f"{t.partitionId():05d}-{t.taskAttemptId()}" if t else f"00000-{uuid.uuid4().hex}"


# --- files ------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]
    rows: int


class FilesSink(DataSource):
    """Options: path; batch (a name, by default a new one); layout: ``lines`` (JSON lines) or ``files`` (columns name and content)."""

    @classmethod
    def name(cls) -> str:
        return "scoreloom_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("batches are appended; delete a batch's folder to write it again")
        return FilesWriter({k.lower(): v for k, v in self.options.items()}, schema)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.batch, self.layout = options["path"], options.get("batch") or uuid.uuid4().hex, options.get("layout", "lines")
        if self.layout not in ("lines", "files"):
            raise ValueError(f"not a layout: {self.layout}")
        if self.layout == "files" and not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("files need the columns name and content")
        if not self.batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name for a batch: {self.batch}")
        fs, root = self._at()
        self.staged, self.final = f"{root}/_staged/{self.batch}-{uuid.uuid4().hex}", f"{root}/{self.batch}"
        self.done = fs.get_file_info(self.final).type != pafs.FileType.NotFound
        if not self.done:
            fs.create_dir(self.staged)  # here and not by tasks: one that is still running when the job is aborted can't make it again

    def _at(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        if self.done:
            for _ in iterator:  # what is observed of the rows counts them all the same
                pass
            return Written((), 0)
        fs, _ = self._at()
        attempt, files, rows = _attempt(), [], 0
        try:
            if self.layout == "files":
                for b in iterator:
                    for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                        if not name or "/" in name or name.startswith((".", "_")):
                            raise ValueError(f"not a file name: {name!r}")
                        files.append(f"{attempt}.{rows:06d}.{name}")
                        with fs.open_output_stream(f"{self.staged}/{files[-1]}") as out:
                            out.write(content.encode() if isinstance(content, str) else content or b"")
                        rows += 1
            else:
                files.append(f"{attempt}.json")
                with fs.open_output_stream(f"{self.staged}/{files[-1]}") as out:
                    for b in iterator:
                        for r in b.to_pylist():
                            out.write(json.dumps(r, default=str, ensure_ascii=False).encode() + b"\n")
                        rows += b.num_rows
        except BaseException:
            for f in files:  # what an abort didn't take before
                if fs.get_file_info(f"{self.staged}/{f}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{self.staged}/{f}")
            raise
        return Written(tuple(files), rows)

    def commit(self, messages: list[Written | None]) -> None:
        if self.done:
            return
        fs, _ = self._at()
        kept = {f for m in messages if m for f in m.files}
        for info in fs.get_file_info(pafs.FileSelector(self.staged)):
            if info.base_name not in kept:
                fs.delete_file(info.path)
            elif self.layout == "files":  # the attempt's prefix goes; two rows of one name are an error
                name = info.base_name.split(".", 2)[2]
                if fs.get_file_info(f"{self.staged}/{name}").type != pafs.FileType.NotFound:
                    self.abort(messages)
                    raise ValueError(f"two rows are named {name!r}")
                fs.move(info.path, f"{self.staged}/{name}")
        fs.move(self.staged, self.final)  # one rename makes the batch visible

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = self._at()
        for wait in (0.1, 1, 5, None):  # other tasks may still be writing
            try:
                if fs.get_file_info(self.staged).type != pafs.FileType.NotFound:
                    fs.delete_dir(self.staged)
                return
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)


# --- databases --------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class SqlSink(DataSource):
    """Options: connect (``module:function`` of a DB-API driver), dsn (its argument), table, key; batch (a name); operation: ``insert`` or ``delete``;
    cascade (``table.column`` of rows that go with a deleted key, separated by commas); mark (``?`` or ``%s``)."""

    @classmethod
    def name(cls) -> str:
        return "scoreloom_sql"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SqlWriter({k.lower(): v for k, v in self.options.items()}, schema)


class SqlWriter(DataSourceArrowWriter):
    """Tasks insert into a staging table, each in transactions of its own; the commit moves the finished ones' rows into the table in one."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.connect, self.dsn, self.table, self.key = options["connect"], options["dsn"], options["table"], options.get("key", "doc_id")
        self.batch, self.operation, self.mark = options.get("batch") or uuid.uuid4().hex, options.get("operation", "insert"), options.get("mark", "?")
        self.cascade = [tuple(c.strip().split(".")) for c in options.get("cascade", "").split(",") if c.strip()]
        self.columns = schema.fieldNames() if self.operation == "insert" else [self.key]
        names = [self.table, self.key, *self.columns, *(x for c in self.cascade for x in c)]
        if self.operation not in ("insert", "delete") or not all(n.replace("_", "").isalnum() for n in names):
            raise ValueError(f"not an operation or names: {self.operation}, {names}")
        self.staging = f"{self.table}_staged_{uuid.uuid4().hex}"
        with closing(self._open()) as db:
            db.cursor().execute("CREATE TABLE IF NOT EXISTS scoreloom_batches (target VARCHAR(200), batch VARCHAR(200), PRIMARY KEY (target, batch))")
            db.commit()
            self.done = self._is_done(db)
            if not self.done:
                columns = ", ".join(self.columns)
                db.cursor().execute(f"CREATE TABLE {self.staging} AS SELECT {columns}, CAST('' AS VARCHAR(200)) AS task_attempt FROM {self.table} WHERE 1 = 0")
                db.commit()

    def _open(self):
        module, name = self.connect.split(":")
        return getattr(importlib.import_module(module), name)(self.dsn)

    def _is_done(self, db) -> bool:
        found = db.cursor().execute(f"SELECT COUNT(*) FROM scoreloom_batches WHERE target = {self.mark} AND batch = {self.mark}", (self.table, self.batch))
        return found.fetchone()[0] > 0

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        attempt, rows = _attempt(), 0
        if self.done:
            return Staged(attempt, 0)
        with closing(self._open()) as db:
            try:
                for b in iterator:
                    values = [[json.dumps(v, default=str) if isinstance(v, list | dict) else v for v in b.column(c).to_pylist()] for c in self.columns]
                    given = [(*r, attempt) for r in zip(*values, strict=True)]
                    db.cursor().executemany(f"INSERT INTO {self.staging} VALUES ({', '.join([self.mark] * (len(self.columns) + 1))})", given)
                    db.commit()
                    rows += len(given)
            except BaseException:
                db.rollback()
                db.cursor().execute(f"DELETE FROM {self.staging} WHERE task_attempt = {self.mark}", (attempt,))
                db.commit()
                raise
        return Staged(attempt, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        if self.done:
            return
        with closing(self._open()) as db:
            c = db.cursor()
            for lo in range(0, len(messages), 500):  # what lost attempts left goes first
                kept = [m.attempt for m in messages[lo : lo + 500] if m]
                if kept:
                    c.execute(f"UPDATE {self.staging} SET task_attempt = '' WHERE task_attempt IN ({', '.join([self.mark] * len(kept))})", kept)
            mine, key = f"FROM {self.staging} WHERE task_attempt = ''", self.key
            for table, column in self.cascade if self.operation == "delete" else []:
                c.execute(f"DELETE FROM {table} WHERE {column} IN (SELECT {key} {mine})")
            c.execute(f"DELETE FROM {self.table} WHERE {key} IN (SELECT {key} {mine})")  # an insert of a known key replaces it
            if self.operation == "insert":
                columns = ", ".join(self.columns)
                c.execute(f"INSERT INTO {self.table} ({columns}) SELECT {columns} {mine}")
            c.execute(f"INSERT INTO scoreloom_batches VALUES ({self.mark}, {self.mark})", (self.table, self.batch))
            db.commit()
            c.execute(f"DROP TABLE {self.staging}")
            db.commit()

    def abort(self, messages: list[Staged | None]) -> None:
        with closing(self._open()) as db:
            db.cursor().execute(f"DROP TABLE IF EXISTS {self.staging}")
            db.commit()


def write_files(df: DataFrame, path: str, batch: str, layout: str = "lines") -> None:
    register(df.sparkSession)
    df.write.format("scoreloom_files").option("path", path).option("batch", batch).option("layout", layout).mode("append").save()


def write_table(df: DataFrame, connect: str, dsn: str, table: str, batch: str, key: str = "doc_id", operation: str = "insert", cascade: str = "") -> None:
    register(df.sparkSession)
    w = df.write.format("scoreloom_sql").options(connect=connect, dsn=dsn, table=table, batch=batch, key=key, operation=operation, cascade=cascade)
    w.mode("append").save()
