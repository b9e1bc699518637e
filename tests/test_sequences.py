import difflib
import random

from pyspark.sql import functions as F

from scoreloom.functions import sequences


def made(rnd, n, letters):
    return [rnd.choice(letters) for _ in range(n)]


def pairs():
    rnd = random.Random(3)
    out = [([], []), ([], ["a"]), (["a"], []), (["a"], ["a"]), (["a"] * 9, ["a"] * 5), (list("abxcd"), list("abcd")), (list("qabxcd"), list("abycdf"))]
    for _ in range(150):
        letters = "ab" if rnd.random() < 0.3 else "abcdefghijkl"
        a = made(rnd, rnd.randrange(40), letters)
        b = made(rnd, rnd.randrange(40), letters)
        if rnd.random() < 0.5:  # b is a with pieces moved
            k = rnd.randrange(len(a) + 1)
            b = a[k:] + made(rnd, rnd.randrange(4), letters) + a[:k]
        out.append((a, b))
    return out


def test_ratio_is_that_of_difflib(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs())]
    df = spark.createDataFrame([*rows, (-1, None, ["a"]), (-2, ["a"], None)], "k int, a array<string>, b array<string>").repartition(4)
    got = {r.k: (r.ratio, r.places) for r in df.select("k", sequences.ratio(F.col("a"), F.col("b")).alias("ratio"), sequences.common_places(F.col("a"), F.col("b")).alias("places")).collect()}
    assert got[-1][0] is None and got[-2][0] is None
    for k, a, b in rows:
        assert abs(got[k][0] - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) < 1e-12, (a, b)
        assert got[k][1] == sum(x == y for x in a for y in b)


def test_ratio_of_given_texts(spark, sf):
    """Every document of a table against the next one and against its own words turned by a third."""
    t = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").select("doc_id", F.split("text", r"\s+").alias("a"))
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    n = F.floor(F.size("a") / 3).cast("int")
    turned = F.concat(F.slice("a", n + 1, F.size("a")), F.slice("a", F.lit(1), n))
    both = t.join(nxt, "doc_id").unionByName(t.select("doc_id", "a", turned.alias("b")))
    got = both.select("a", "b", sequences.ratio(F.col("a"), F.col("b")).alias("ratio")).collect()
    assert len(got) > 250
    for r in got:
        assert abs(r.ratio - difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()) < 1e-12
    plan = both.select(sequences.ratio(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
