import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from scoreloom.sources import sinks


def rows(spark, n=50, fail=None, parts=5):
    df = spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), (F.col("id") * 1.5).alias("score"), F.array(F.lit("a"), F.col("id").cast("string")).alias("items"))
    if fail is not None:
        df = df.withColumn("score", F.when(F.col("doc_id") == fail, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("score")))
    return df


def read(folder, batch):
    return sorted((json.loads(x) for f in os.listdir(f"{folder}/{batch}") for x in open(f"{folder}/{batch}/{f}")), key=lambda r: r["doc_id"])


def test_json_lines_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(Exception, match="broken row"):
        sinks.write_files(rows(spark, fail=37), folder, "one")
    assert not os.path.exists(f"{folder}/one") and not any(files for _, _, files in os.walk(folder))
    sinks.write_files(rows(spark), folder, "one")
    got = read(folder, "one")
    assert [r["doc_id"] for r in got] == list(range(50)) and got[3] == {"doc_id": 3, "score": 4.5, "items": ["a", "3"]} and os.listdir(f"{folder}/_staged") == []
    sinks.write_files(rows(spark, n=7), folder, "one")  # the same batch again, whatever it holds now
    assert read(folder, "one") == got
    sinks.write_files(rows(spark, n=7), folder, "two")
    assert len(read(folder, "two")) == 7 and sorted(os.listdir(folder)) == ["_staged", "one", "two"]
    sinks.write_files(rows(spark, n=0), folder, "none")
    assert read(folder, "none") == []


def test_a_file_per_row(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([("a.txt", "é"), ("b.txt", ""), ("c.docx", None)], "name string, content string").repartition(2)
    sinks.write_files(df, folder, "x", "files")
    assert {f: open(f"{folder}/x/{f}", encoding="utf-8").read() for f in os.listdir(f"{folder}/x")} == {"a.txt": "é", "b.txt": "", "c.docx": ""}
    for bad in (df.union(df), spark.createDataFrame([("../up", "x")], "name string, content string"), spark.createDataFrame([(None, "x")], "name string, content string")):
        with pytest.raises(Exception, match="two rows are named|not a file name"):
            sinks.write_files(bad, folder, "y", "files")
        assert not os.path.exists(f"{folder}/y")
    with pytest.raises(Exception, match="name and content"):
        sinks.write_files(rows(spark), folder, "z", "files")
    with pytest.raises(Exception, match="not a name"):
        sinks.write_files(rows(spark), folder, "../z")


def connect(path):
    return sqlite3.connect(path, timeout=60)


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "reports.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE reports (doc_id INTEGER PRIMARY KEY, score REAL, items TEXT)")
        c.execute("CREATE TABLE notes (report INTEGER, note TEXT)")
        c.executemany("INSERT INTO notes VALUES (?, ?)", [(k, "n") for k in (1, 1, 2, 60)])
    return path


def held(path, sql="SELECT doc_id, score, items FROM reports ORDER BY 1"):
    with sqlite3.connect(path) as c:
        return c.execute(sql).fetchall()


def test_tables_all_or_nothing(spark, db):
    at = ("tests.test_sinks:connect", db, "reports")
    with pytest.raises(Exception, match="broken row"):
        sinks.write_table(rows(spark, fail=37), *at, "one")
    assert held(db) == [] and held(db, "SELECT name FROM sqlite_master WHERE name LIKE '%staged%'") == []
    sinks.write_table(rows(spark), *at, "one")
    first = held(db)
    assert len(first) == 50 and first[3] == (3, 4.5, '["a", "3"]')
    sinks.write_table(rows(spark, n=2).withColumn("score", F.lit(-1.0)), *at, "one")
    assert held(db) == first  # a batch counts once
    sinks.write_table(rows(spark, n=2).withColumn("score", F.lit(-1.0)), *at, "two")
    assert [r[1] for r in held(db)] == [-1.0, -1.0] + [r[1] for r in first[2:]]  # a known key is replaced
    sinks.write_table(rows(spark).where("doc_id < 2"), *at, "three", operation="delete", cascade="notes.report")
    assert len(held(db)) == 48 and held(db, "SELECT report FROM notes ORDER BY 1") == [(2,), (60,)]
    assert held(db, "SELECT batch FROM scoreloom_batches ORDER BY 1") == [("one",), ("three",), ("two",)]
    with pytest.raises(Exception, match="not an operation"):
        sinks.write_table(rows(spark), "tests.test_sinks:connect", db, "reports; drop", "four")
