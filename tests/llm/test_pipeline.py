import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece

import corpus_pipeline
from scoreloom.llm import bagminhash, common, mixing, sentencepiece_codec, toxicity
from tests.llm.test_pairs import brute_classes, brute_lines


def test_stages_keep_columns_and_shrink(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf))
        n = docs.count()
        assert n > 0
        if name != "sentencepiece":
            assert docs.columns == columns
        if name in ("toxicity", "line dedup", "near-duplicates"):
            assert n <= before
            before = n
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    shared, rows = [" ".join(word() for _ in range(12)) for _ in range(3)], []
    for k in range(70):
        body = [" ".join(word() for _ in range(30)) for _ in range(3)]
        if k % 6 == 0:
            body[1] += " vile nasty"
        if k % 4 == 0:
            body.insert(1, shared[k % 3])
        rows.append((k, "\n".join(body), f"s{k % 3}" if k % 7 else None))
    for k in range(70, 80):  # near copies, with other words in a few places, and exact ones
        words = rows[k - 70][1].replace("\n", " ").split(" ")
        words[5] = word()
        rows.append((k, " ".join(words) if k % 2 else rows[k - 70][1], "s1"))
    return [*rows, (80, None, "s0"), (81, "", "s1"), (81, "", "s1"), (82, "\n \n", "s2"), (None, "one of a kind", "s0"), (3, "another text", "s0"), rows[5], rows[5]]


def brute(rows, model):
    """The stages by plain loops over (doc_id, text, source), mixing by a full sort in DuckDB, and the library's own segmentation."""
    w0, at, w = model
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    hashes = toxicity.WordHashes()
    rows = [r for r in rows if w0 + sum(weights.get(int(f), 0.0) for f in toxicity.features(r[1], hashes)) < 0]
    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    lines = brute_lines([r[:2] for r in rows])
    left = [(i, lines[i, digest(t)] if t else t, s, t) for i, t, s in rows]
    rows = [(i, t, s) for i, t, s, before in left if not (before and t != before and not t.strip(" "))]
    words = [k for k, r in enumerate(rows) if len(bagminhash.shingles(r[1], bagminhash.WordHashes())[0])]
    label = dict(zip(words, brute_classes([rows[k][:2] for k in words]), strict=True))
    kept = {}
    for k, (i, t, s) in enumerate(rows):
        if k not in label:
            kept[i, digest(t)] = (i, t, s)
            continue
        of = [rows[j] for j in words if label[j] == label[k]]
        best = min((x is None, x or 0, digest(y)) for x, y, _ in of)
        if (i is None, i or 0, digest(t)) == best:
            kept[i, digest(t)] = (i, t, s)
    documents = pd.DataFrame(list(kept.values()), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    taken = duckdb.sql(mixing.mixing_sql("documents")).fetchall()
    times = {(r[0], r[1]): r[4] // r[1] if r[1] else 1 for r in taken}
    sp, out = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model_path()), []
    for i, t, _ in kept.values():
        ids = sp.encode(t or "")
        out += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] * times[i, len((t or "").split())]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string").selectExpr("doc_id", "text", "'xx' as lang", "source", "cast(length(text) as long) as n_chars", "1 as score", "2 as _key", "3 as n_lines", "4 as taken")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(70)] + [(None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run_is_that_of_brute_force(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(labels, docs)
    want = brute(corpus(), model)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()), key=repr)
    assert got == want and np.count_nonzero(model[2]) > 0 and len({r[0] for r in got}) < 70


def test_stages_leave_other_columns_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, folder))
        assert {(r.score, r._key, r.n_lines, r.taken, r.lang) for r in docs.collect()} == {(1, 2, 3, 4, "xx")}
        assert docs.where("n_chars <> length(text)").isEmpty()


def test_stages_of_nothing(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.toxic(spark, docs, str(tmp_path)).count() == docs.count()
