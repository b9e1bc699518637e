"""Documents from folders of files, in batches or as a stream. A file that can't be read is a row with an error, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import text as tx
from scoreloom.sources import docx

IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp")
#: Windows-1252 differs from ISO-8859-1 in these 32 places, five of which it leaves open.
C1 = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0))
NO_READER = "needs a reader of its own"
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def decoded(content: Column) -> Column:
    """UTF-16 with a byte order mark, UTF-8 with or without one, else Windows-1252; null if there are NUL characters."""
    mark = F.hex(F.substring(content, 1, 2))
    utf8 = F.try_validate_utf8(content.cast("string"))
    body = F.when(mark == "FFFE", F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16LE")).when(mark == "FEFF", F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16BE")).otherwise(F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), C1, WINDOWS)))
    body = F.regexp_replace(body, "^﻿", "")
    return F.when(~F.contains(body, F.lit("\x00")), body)


def documents(files: DataFrame, *more: str) -> DataFrame:
    """(doc_id, path, filename, file_type, size_bytes, text, page_count, error) from the ``binaryFile`` format, and the columns ``more`` of it."""
    t = files.withColumn("file_type", extension(F.col("path"))).withColumn("body", F.when(F.col("file_type") == "txt", decoded(F.col("content"))))
    lines = F.filter(F.transform(F.split("body", r"\r\n|\r|\n"), tx.normal), lambda x: x != "")
    t = t.withColumn("text", F.array_join(lines, "\n"))
    error = (
        F.when(F.col("file_type") == "doc", "the old .doc format; save as .docx or PDF").when(F.col("file_type").isin(*IMAGES), "an image; send text").when(~F.col("file_type").isin("txt", "pdf", "docx"), "unknown file type")
        .when(F.col("length") == 0, "empty file").when(F.col("file_type").isin("pdf", "docx"), NO_READER).when(F.col("body").isNull(), "not a text").when(F.col("text") == "", "no text")
    )
    return t.select(F.xxhash64("path").alias("doc_id"), "path", F.regexp_replace("path", r"^.*/", "").alias("filename"), "file_type", F.col("length").alias("size_bytes"), "text", tx.page_estimate(tx.word_count(F.col("text"))).alias("page_count"), error.alias("error"), *more)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder, each by the reader of its kind; a kind without one is a row with an error."""
    return with_readers(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark.readStream.format("binaryFile").schema(SCHEMA).load(folder))


def register_reader(kind: str, read_rows):
    """``read_rows(content) -> text`` for formats whose libraries aren't part of this package; use ``with_readers``."""
    READERS[kind] = read_rows


READERS: dict[str, callable] = {"docx": lambda content: docx.text_of(content)}


def with_readers(files: DataFrame) -> DataFrame:
    """``documents`` with the registered readers applied in Arrow batches to the formats they know. A file that a reader rejects is a row with an error."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    readers, base = dict(READERS), documents(files, "content")
    schema = base.drop("content").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                content = r.pop("content")
                if r["file_type"] in readers and r["error"] == NO_READER:
                    try:
                        r["text"], r["error"] = readers[r["file_type"]](content), None
                        if not r["text"].strip():
                            r["error"] = "no text"
                    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failure
                        r["error"] = f"unreadable: {type(e).__name__}"
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return base.mapInArrow(run, schema).withColumn("page_count", tx.page_estimate(tx.word_count(F.col("text"))))
