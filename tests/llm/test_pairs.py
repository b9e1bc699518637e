import collections
import hashlib
import random

import numpy as np
import pytest

from scoreloom.llm import bagminhash as bag
from scoreloom.llm import components, knn_join
from scoreloom.llm import line_dedup as lines
from tests import parity


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [[" ".join(word() for _ in range(14)) for _ in range(5)] for _ in range(8)]
    rows = []
    for k in range(n):
        text = [x.split() for x in base[k % 8]]
        for x in text:
            if rnd.random() < 0.4:
                x[rnd.randrange(len(x))] = word()
        rows.append((k, "\n".join(" ".join(x) for x in text) + ("\nshort line" if k % 5 == 0 else "")))
    return rows + [(n, rows[3][1]), (n + 1, ""), (n + 2, None), (n + 3, ""), (None, rows[4][1]), (n + 4, "a b c"), (n + 4, "a b c"), (n + 5, "a\tb c")]


def brute_lines(rows):
    keep, seen = {}, []
    order = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t) for i, t in rows}, key=lambda r: r[:3])
    for z, i, h, text in order:
        left = []
        for line in text.split("\n") if text else []:
            w = frozenset(x for x in line.lower().replace("\t", " ").split(" ") if x)
            if len(w) < lines.LEAST:
                left.append(line)
                continue
            if not any(len(w & v) >= lines.SIMILAR * len(w | v) - 1e-9 for v in seen):
                left.append(line)
            seen.append(w)
        keep[(None if z else i, h)] = "\n".join(left) if text else text
    return keep


@pytest.mark.parametrize("hot", [lines.HOT, 1])
def test_line_dedup_is_exact(spark, monkeypatch, hot):
    """Also if every word counts as frequent."""
    monkeypatch.setattr(lines, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", len(t or "")) for i, t in rows], "doc_id long, text string, h string, n_chars long")
    want = brute_lines(rows)
    got = lines.dedup(df).collect()
    assert len(got) == len(rows)
    texts = {(i, hashlib.md5((t or "").encode()).digest()): t for i, t in rows}
    by = collections.defaultdict(set)
    for key, text in want.items():
        by[key[0]].add(text)
    for r in got:
        assert r.text in by[r.doc_id] and r.h == "clash" and r.n_chars == (None if r.text is None else len(r.text))
    assert len(texts) == len(want)
    assert sum(r.n_removed for r in got) > 50


def test_line_dedup_takes_lines_of_any_length(spark):
    dull = "never again " * 40
    rows = [(1, f"{dull}\nTo be\n東京は日本の首都です\none two three four\n\none two three"), (2, f"new\nto  BE\n{dull}\n東京は日本の首都です\n\n \t"), (3, "four three two one zero\nto be or"), (4, "new")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("new\n\n \t", 3), 3: ("to be or", 1), 4: ("", 1)}


def test_line_dedup_of_ties_long_lines_and_clashing_columns(spark):
    rnd = random.Random(4)
    long_ = [f"w{k}" for k in range(3000)]
    near = [x if rnd.random() < 0.93 else x + "q" for x in long_]
    far = [x if rnd.random() < 0.75 else x + "q" for x in long_]
    rows = [(1, " ".join(long_), 1), (2, " ".join(near), 2), (3, " ".join(far) + "\nsame\nsame", 3), (3, " ".join(far) + "\nsame\nsame", 4), (None, "same", 5), (None, None, 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int").selectExpr("*", "'x' as _kept", "1 as _h", "2 as _id", "3 as n_lines", "4 as _stays", "5 as _text")
    got = {r._key: r for r in lines.dedup(df).collect()}
    texts = {k: r.text for k, r in got.items()}
    assert texts == {1: rows[0][1], 2: "", 3: " ".join(far) + "\nsame", 4: " ".join(far) + "\nsame", 5: "", 6: None, 7: ""}
    assert all((r._kept, r._h, r._id, r._stays, r._text) == ("x", 1, 2, 4, 5) for r in got.values()) and got[3].n_lines == 3 and got[7].n_lines == 0


def test_line_dedup_of_nothing(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_classes(rows):
    hashes = bag.WordHashes()
    bags = [bag.shingles(t, hashes) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(bags[i][0]) and bag.similarity(bags[i], bags[j]) >= bag.SIMILAR:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_duplicates_of_a_large_loose_group(spark):
    """Many texts around 0.8 similar to one another and to none in particular: what the rounds leave is compared as well."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rnd.sample(range(150), k % 7):
            text[at] = word()
        rows.append((k, " ".join(text[k // 10 :])))
    got = {r.doc_id: r.class_id for r in bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label, first = brute_classes(rows), {}
    for (i, _), x in zip(rows, label, strict=True):
        first.setdefault(x, i)
    assert got == {i: first[x] for (i, _), x in zip(rows, label, strict=True)}


def test_classes_of_a_table_are_those_of_brute_force(spark, sf):
    """Every pair of texts that share a shingle, by an inverted index: recall is complete, and nothing else is merged."""
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    hashes = bag.WordHashes()
    bags = [bag.shingles(t, hashes) for _, t in rows]
    holds, label, pairs = collections.defaultdict(list), list(range(len(rows))), 0
    for i, (keys, times) in enumerate(bags):
        near = {j for k in keys.tolist() for j in holds[k]}
        for j in near:
            n, m = int(times.sum()), int(bags[j][1].sum())
            if min(n, m) >= bag.SIMILAR * max(n, m) and bag.similarity(bags[i], bags[j]) >= bag.SIMILAR:
                pairs += rows[i][1] != rows[j][1]
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
        for k in keys.tolist():
            if len(holds[k]) < 100:
                holds[k].append(i)
    got = {r.doc_id: r.class_id for r in bag.near_duplicates(docs).collect()}
    first = {}
    for (i, _), x in zip(rows, label, strict=True):
        first.setdefault(x, i)
    assert pairs > 5 and got == {i: first[x] for (i, _), x in zip(rows, label, strict=True)}


def test_near_duplicates_are_those_of_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows = []
    for k in range(50):
        text = list(base[k % 6])
        for _ in range(k // 12):
            text[rnd.randrange(120)] = word()
        rows.append((k, " ".join(text)))
    rows += [(50, "one two"), (51, "one two"), (52, ""), (53, None), (54, rows[0][1])]
    got = {r.doc_id: r.class_id for r in bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = brute_classes(rows)
    first = {}
    for (i, _), x in zip(rows, label, strict=True):
        first.setdefault(x, i)
    assert got == {i: first[x] for (i, _), x in zip(rows, label, strict=True)}


def test_one_of_each_class_survives(spark):
    rows = corpus(20)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, extra int")
    kept = bag.survivors(df).collect()
    assert len({r.doc_id for r in kept}) < len(rows)
    assert sum(r.text == "a b c" for r in kept) == 1 and sum(not r.text for r in kept) == 3
    assert bag.survivors(df.limit(0)).count() == 0


def test_parity_never_exceeds_what_differs():
    rng = np.random.default_rng(6)
    for n in (1, 50, 900, 6000):
        keys = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        wa = rng.integers(1, 5, len(keys))
        wb = np.maximum(0, wa + rng.integers(-1, 2, len(keys)))
        a, b = (keys, wa), (keys[wb > 0], wb[wb > 0])
        apart = sum(int(x).bit_count() for x in (bag.parity(a) ^ bag.parity(b)).view(np.uint64))
        assert apart <= np.abs(wa - wb).sum() and (n > 900 or apart >= 0.6 * np.abs(wa - wb).sum())


def test_survivors_keep_other_columns(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 4), (2, "a b c d e f", 3), (3, None, 2), (3, None, 1), (None, "x y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int").selectExpr("*", "_key + 1 as _h", "1 as _id", "2 as _rows", "3 as _row", "4 as keep", "5 as class_id")
    kept = bag.survivors(df).collect()
    assert bag.survivors(df).columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "x y"), (1, "a b c d e f"), (3, "")]
    assert all(r._h == r._key + 1 and (r._id, r._rows, r._row, r.keep, r.class_id) == (1, 2, 3, 4, 5) for r in kept)
    assert {r._key for r in kept} == {r._key for r in bag.survivors(df.repartition(3)).collect()}


def test_signature_is_unbiased():
    rng, miss = np.random.default_rng(1), []
    for _ in range(40):
        keys = np.unique(rng.integers(1, 2**63, 200, dtype=np.uint64))
        wa = rng.integers(1, 9, len(keys))
        a, b = (keys, wa), (keys[20:], np.maximum(1, wa + rng.integers(-3, 4, len(keys)))[20:])
        s = bag.signatures([a, b])
        miss.append((s[0] == s[1]).mean() - bag.similarity(a, b))
    assert abs(np.mean(miss)) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 3), (5, 5)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_knn_sql(spark, sf):
    parity.same(knn_join.op8_knn(spark, sf), parity.connect(sf), knn_join.KNN_SQL)


def test_knn_with_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "BLOCK", 64)
    rng = np.random.default_rng(0)
    rows = [(k, [0.5, 0.25, -0.5]) if k % 3 else (k, rng.normal(size=3).tolist()) for k in range(300)]
    bad = [(300, None), (301, [1.0, None, 0.0]), (302, [1.0, float("nan"), 0.0]), (303, [float("inf"), 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (400, [1.0])]
    v = knn_join.quantised(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in knn_join.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: np.floor(np.array(x + [0.0] * (3 - len(x))) * 1024).astype(np.int64) for i, x in [*rows, bad[-1]]}
    for q in (0, 100, 200, 400):
        want = sorted(((i, int(ints[q] @ x)) for i, x in ints.items() if i != q), key=lambda s: (-s[1], s[0]))[:10]
        assert got[q] == want
    assert set(got) == {0, 100, 200, 400}
    none = v.limit(0)
    assert knn_join.top_k(none, none).count() == 0


def test_knn_with_repeated_rows_of_a_query(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=4) / 4).tolist()) for k in range(250)]
    rows[0], rows[100] = (0, [1.0, 1.0, 0.0, 0.0]), (100, [0.0, 0.0, 1.0, 1.0])
    rows += [rows[0]] + [rows[100]] * 14 + [(7, rows[0][1])] * 3 + [(200, [0.25, 0.0, 0.25, 0.0])]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in knn_join.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = [(i, np.floor(np.array(x) * 1024).astype(np.int64)) for i, x in rows]
    for q in (0, 100, 200):
        want = sorted(((i, int(y @ x)) for y in {tuple(x) for i, x in ints if i == q} for i, x in ints if i != q), key=lambda s: (-s[1], s[0]))[:10]
        assert got[q] == want


@pytest.mark.parametrize("block", [40, 100_000])
def test_knn_in_cells_of_uneven_size(spark, monkeypatch, block):
    """Clusters of which one holds a third of the rows, of copies of one id: far cells of data are not sent."""
    monkeypatch.setattr(knn_join, "BLOCK", block)
    monkeypatch.setattr(knn_join, "QUERIES", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(k, (centres[k % 6] + rng.normal(size=8) / 50).tolist()) for k in range(400)] + [(7, centres[1].tolist())] * 200 + [(50, [])]
    v = knn_join.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in knn_join.top_k(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = [(i, np.floor(np.array(x or [0.0] * 8) * 1024).astype(np.int64)) for i, x in rows]
    assert set(got) == set(range(0, 400, 20))
    for q in got:
        y = dict(ints[:400])[q]
        assert got[q] == sorted(((i, int(y @ x)) for i, x in ints if i != q), key=lambda s: (-s[1], s[0]))[:10]


@pytest.mark.parametrize("text", ["", None])
def test_no_shingles(text):
    assert len(bag.shingles(text, bag.WordHashes())[0]) == 0
