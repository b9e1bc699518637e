import hashlib
import math
import random
import re
import threading
import zlib

import numpy as np
import pytest

from scoreloom.llm import ball_tree, common, vector_codes
from scoreloom.llm import decision_lists as lists
from tests import parity

VECTORS = "vec_id long, embedding array<float>, label int, v string, part string, n string"


def vectors(n=700, dim=64, seed=5, many=200):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.5, (6, dim))
    rows = [(k, (centres[k % 6] + rnd.normal(0, 0.05, dim)).astype(np.float32).tolist(), k % 4 or None, "x", "y", "z") for k in range(n)]
    rows += [(n + k, rows[3][1], 2, "x", "y", "z") for k in range(many)]  # copies of one vector, many of them
    rows += [rows[0], rows[0], (None, rows[1][1], 7, "x", "y", "z"), (5, rows[2][1], None, "x", "y", "z")]  # repeated rows, no id, an id of two vectors
    rows += [(-1, None, 1, "x", "y", "z"), (-2, [float("nan")] * dim, 1, "x", "y", "z"), (-3, [None] * dim, 1, "x", "y", "z"), (-4, [float("inf")] + [0.0] * (dim - 1), 1, "x", "y", "z")]
    return rows


@pytest.mark.parametrize("hot", [1, 10, 100_000])
def test_vector_codes_are_those_of_sql(spark, tmp_path, monkeypatch, hot):
    """Whether all parts, those of copies, or none come by broadcast."""
    monkeypatch.setattr(vector_codes, "HOT", hot)
    spark.createDataFrame(vectors(), VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet/")
    got = vector_codes.op12_vector_codes(spark, str(tmp_path))
    con = parity.duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    parity.same(got, con, vector_codes.codes_sql())


def test_vector_codes_of_uneven_short_and_few_vectors(spark, tmp_path):
    rows = [(3, [0.5, -0.25, 1.0]), (1, [0.1]), (2, []), (2, [0.5] * 11), (None, [0.5] * 11), (9, [1e-9] * 8), (9, [-1e-9] * 8), (4, [9.5] * 11), (5, [-9.5, 9.5] * 5)]
    spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op12_vector_codes(spark, str(tmp_path))
    con = parity.duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    parity.same(got, con, vector_codes.codes_sql())
    assert {r.error for r in got.collect() if r.vec_id == 9} == {0}


def test_vector_codes_with_many_entries(spark):
    """Codes of two digits in every part, against a loop over vectors."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(0, 1, (400, 16))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows, books = vector_codes.compress(vector_codes.numbered(df), entries=200, rounds=2)
    v = np.floor(x * vector_codes.SCALE).astype(np.int64)
    want = v[:200].reshape(200, 8, 2).transpose(1, 0, 2).copy()
    near = lambda p: ((v.reshape(-1, 8, 2)[:, p, None] - want[p]) ** 2).sum(2)
    for _ in range(2):
        for p in range(8):
            of = near(p).argmin(1)
            for e in set(of):
                own = v.reshape(-1, 8, 2)[of == e, p]
                want[p, e] = [math.floor(s / len(own)) for s in own.sum(0)]
    assert (books == want).all()
    got = {r.vec_id: (r.code, r.error) for r in rows.collect()}
    for k in range(400):
        assert got[k] == ("".join(f"{near(p)[k].argmin():02x}" for p in range(8)), sum(int(near(p)[k].min()) for p in range(8)))


@pytest.mark.parametrize(("ball", "leaf"), [(8192, 32), (50, 1), (7, 3)])
def test_ball_tree_is_sql(spark, tmp_path, monkeypatch, ball, leaf):
    monkeypatch.setattr(ball_tree, "BALL", ball)
    monkeypatch.setattr(ball_tree, "LEAF", leaf)
    rows = vectors() + [(8000, [0.5] * 63, 1, "x", "y", "z"), (8001, [], 1, "x", "y", "z")]
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ball_tree.op13_ball_tree(spark, str(tmp_path))
    con = parity.duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    parity.same(got, con, ball_tree.ball_sql())


def test_ball_tree_leaves_out_leaves_and_keeps_ties():
    rnd = np.random.default_rng(4)
    centres = rnd.integers(-2000, 2000, (5, 8))
    x = np.concatenate([c + rnd.integers(-5, 6, (300, 8)) for c in centres] + [np.zeros((500, 8), np.int64)])
    tree, order = ball_tree.grow(x)
    assert sorted(order) == list(range(len(x))) and (tree.rows == x[order]).all()
    for k in range(len(tree.starts)):
        own = tree.rows[tree.starts[k] : tree.ends[k]]
        assert (own.sum(0) == tree.sums[k]).all() and (np.sqrt(((own - tree.means[k]) ** 2).sum(1)) <= tree.radii[k] + 1e-9).all()
    whole, left, _ = ball_tree.walk(tree, centres)
    assert len(left) < len(x) / 4 and len(whole) < 60  # most rows go with their balls
    ties = np.array([[1] * 8, [-1] * 8, [1] * 8])
    of, distance = ball_tree.clusters(tree, ties)
    d = ((tree.rows[:, None] - ties) ** 2).sum(2)
    assert (of == d.argmin(1)).all() and (distance == d.min(1)).all() and not (of == 2).any()
    assert (ball_tree.totals(tree, ties)[:, -1] == np.bincount(d.argmin(1), minlength=3)).all()


def test_distances_of_large_integers():
    x, c = np.array([[2**30, -(2**30)], [0, 1]]), np.array([[0, 0], [2**30, 2**30]])
    want = [[sum((a - b) ** 2 for a, b in zip(r.tolist(), m.tolist(), strict=True)) for m in c] for r in x]
    assert common.squared_distances(x, c).tolist() == want
    assert common.squared_distances(x[1:], c[:1]).dtype == np.int64


@pytest.mark.parametrize("query", [vector_codes.op12_vector_codes, ball_tree.op13_ball_tree])
def test_no_vectors(spark, tmp_path, query):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert query(spark, str(tmp_path)).count() == 0


def test_runs_side_by_side_keep_their_tables(spark):
    """What one thread writes stays there when another one's scope ends."""
    inside, ended, seen = threading.Event(), threading.Event(), []

    def first():
        with common.scratch():
            t = common.written(spark.range(3))
            inside.set()
            ended.wait(60)
            seen.append(t.count())

    def second():
        inside.wait(60)
        with common.scratch():
            common.written(spark.range(2))
        ended.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == [3]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def odd_texts():
    rnd = random.Random(8)
    made = [" ".join(rnd.choice(["a", "b", "cc", "#d", "é", "東京", "\n", "x\ny", "\t|"]) for _ in range(rnd.randrange(200))) for _ in range(80)]
    return [None, "", " ", "\n\n", "a a a a", "a b c a b c", "a b c d a b", "x y z \x1c w", "line\nline\n line\nline \r\nline\r", "#*$%&|<>^", "🙂 é́ 東京\x0bк", "same words " * 40, *made]


def test_counts_are_those_of_regular_expressions(spark):
    rows = [(k, t, 5, "x") for k, t in enumerate(odd_texts())]
    df = spark.createDataFrame([*rows, rows[4], (None, "a b c", 5, "x")], "doc_id long, text string, n_words int, Label string")
    got = lists.judged(df, lists.DecisionList()).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = brute_counts(r.text)
        assert tuple(r[c] for c in lists.COUNTS[:5]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed) and r.Label == "x"
    assert lists.judged(df.limit(0), lists.DecisionList()).count() == 0


def test_counts_of_long_texts_take_linear_time():
    import time

    def took(n):
        text = b" ".join(b"w%d" % (k % 5000) for k in range(n)) + b"\n line" * n
        began = time.perf_counter()
        lists.counts(text)
        return time.perf_counter() - began

    took(1000)
    assert min(took(400_000) for _ in range(3)) < 3.5 * min(took(200_000) for _ in range(3)) + 0.1


def naive_best(x, y):
    best = None
    for k, name in enumerate(lists.STATISTICS):
        values = sorted(set(x[:, k]))
        for a, b in zip(values, values[1:], strict=False):
            for above in (True, False):
                at = x[:, k] >= (a + b) / 2 if above else x[:, k] < (a + b) / 2
                p = y[at].sum()
                gain = p * (math.log2(p / at.sum()) - math.log2(y.sum() / len(y))) if p else 0
                key = (round(gain, 9), (b - a) / (values[-1] - values[0]))
                if gain > 1e-9 and (best is None or key[0] > best[0][0] + 1e-9 or (abs(key[0] - best[0][0]) < 1e-9 and key[1] > best[0][1] + 1e-12)):
                    best = (key, name, above, (a + b) / 2)
    return best[1:] if best else None


@pytest.mark.parametrize("seed", range(6))
def test_conditions_have_the_highest_gain(seed):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(0, 9, (60, len(lists.STATISTICS))) / 10
    y = (x[:, 2] > 0.5) & (rnd.random(60) < 0.8)
    got = lists.best_condition(x, y)
    assert (got.statistic, got.above, pytest.approx(got.bound)) == naive_best(x, y)


def test_lists_are_learned_pruned_and_ordered(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((900, len(lists.STATISTICS)))
    names = list(lists.STATISTICS)
    y = (x[:, 0] > 0.8) | ((x[:, 3] > 0.6) & (x[:, 5] < 0.4))
    got = lists.learn(x, y, np.arange(900) % 3 == 0)
    assert 2 <= len(got.rules) <= 6
    hit = np.zeros(900, bool)
    for r in got.rules:
        hit |= lists.covers(r, x)
    assert (hit == y).mean() > 0.95
    noise = lists.learn(x, rnd.random(900) < 0.2, np.arange(900) % 3 == 0)
    assert noise.rules == ()  # pruning leaves nothing of rules that only fit noise
    assert lists.learn(x[:0], y[:0], y[:0]).rules == () and lists.learn(x, np.zeros(900, bool), y).rules == () and lists.learn(x, np.ones(900, bool), y).rules == ()
    # The Spark expression says the same as the list does in numpy.
    counts = rnd.integers(0, 50, (200, len(lists.COUNTS)))
    df = spark.createDataFrame([tuple(map(int, r)) for r in counts], ", ".join(f"{c} long" for c in lists.COUNTS))
    stats = np.array(df.select(*[lists.statistic(n).alias(n) for n in names]).collect())
    want = [next((k for k, r in enumerate(got.rules, 1) if lists.covers(r, stats[i : i + 1])[0]), None) for i in range(200)]
    assert [r[0] for r in df.select(got.rule_number()).collect()] == want and len(set(want)) > 1
    assert str(got).count("reject") == len(got.rules) and str(got).endswith("keep")


def test_quality_of_held_out_documents(spark):
    """At scale 0.1: of documents that were not learnt from, those of low quality go and the others stay."""
    sf = "/root/testdata/sf0.1"
    got = lists.op11_decision_lists(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null"), "doc_id").where("not base_failed").collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    low, high = [r for r in out if r.quality == 0], [r for r in out if r.quality == 1]
    assert len(low) > 40 and sum(not r.kept for r in low) >= 0.95 * len(low)
    assert sum(r.kept for r in high) >= 0.995 * len(high)


def test_labels_with_nulls_and_none(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}{'#' * (k % 2) * 3}" for i in range(80))) for k in range(400)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 1) for k in range(400)] + [(None, 0, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rules = lists.fit(labels, docs)
    assert len(rules.rules) == 1
    got = {r.doc_id: r.kept for r in lists.judged(docs, rules).collect()}
    assert got == {k: k % 2 == 0 for k in range(400)} | {None: False}
    assert lists.fit(labels.limit(0), docs).rules == () and lists.fit(labels.where("quality = 1"), docs).rules == () and lists.fit(labels, docs.limit(0)).rules == ()
    assert hashlib.sha256(str(rules).encode()).digest() == hashlib.sha256(str(lists.fit(labels.repartition(3), docs.repartition(5))).encode()).digest()
