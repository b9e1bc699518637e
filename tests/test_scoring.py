import pytest
from pyspark.sql import functions as F

from scoreloom.operators import evaluate
from scoreloom.plans import business, rules, scoring


@pytest.mark.parametrize(("x", "want"), [(-5, 0.0), (0, 0.0), (25, 0.25), (50, 0.5), (75, 0.75), (500, 1.0), (None, None)])
def test_bands(spark, x, want):
    df = spark.createDataFrame([(None if x is None else float(x),)], "x double")
    assert df.select(scoring.interpolate(F.col("x"), ((0.0, 0.0), (50.0, 0.5), (100.0, 1.0)))).first()[0] == want


def test_step_and_match_count(spark):
    df = spark.createDataFrame([(0.0, ["Java", "java", "Go"]), (1.0, []), (3.0, None)], "x double, items array<string>")
    got = df.select(scoring.step(F.col("x"), ((1.0, 0.5), (2.0, 0.85)), 0.1), scoring.match_count(F.col("items"), ("JAVA",))).collect()
    assert [tuple(r) for r in got] == [(0.1, 2), (0.5, 0), (0.85, None)]


def test_compiled_and_tabular_plans_agree(spark, sf):
    a = business.scored(spark, sf).select("c_custkey", "score", "confidence")
    b = business.overall_by_tables(spark, sf)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_order_of_rows_does_not_matter(spark, sf):
    c = business.customers(spark, sf)
    one = scoring.scored(c.orderBy("c_custkey"), business.customer_rules(), dict(business.NAMES)).select("c_custkey", "score")
    two = scoring.scored(c.orderBy(F.desc("balance")).repartition(7), business.customer_rules(), dict(business.NAMES)).select("c_custkey", "score")
    assert one.exceptAll(two).isEmpty()


def test_ties_round_to_even(spark):
    from scoreloom.functions.numbers import rounded

    df = spark.createDataFrame([(62.05,), (62.15,), (52.25,), (2.675,)], "x double")
    assert [r[0] for r in df.select(rounded("x", 1)).collect()] == [62.0, 62.2, 52.2, 2.7]


def test_relaxations_stack_or_take_the_largest(spark):
    c = rules.load()["psu_via_gate"]
    df = spark.createDataFrame([(30.0, 56.0, "SC", True), (40.0, 60.0, "GEN", None)], "age double, pct double, cat string, pw boolean")
    g = scoring.gated(df, c, {"candidate.age": "age", "academics.ug_pct_est": "pct"}, {"reservation_category": F.col("cat"), "pwbd": F.col("pw")})
    got = [{x.gate: (x.status, x.limit) for x in r.gates} for r in g.collect()]
    assert got[0]["max_age"] == ("pass", 41.0) and got[0]["min_ug_pct"] == ("pass", 55.0)
    assert got[1]["max_age"] == ("warn", 26.0) and got[1]["min_ug_pct"] == ("warn", 65.0)
    assert got[0]["gate_present"] == ("fail", 1.0)


def test_accuracy_treats_missing_as_missing(spark):
    labels = spark.createDataFrame([(1, "x", "projects.count", 2.0, None, None), (1, "x", "academics.ug_cgpa", 8.0, None, None)], "doc_id long, cat string, feature string, num double, bool boolean, items array<string>")
    got = spark.createDataFrame([(1, "projects.count", 2.02, None, None), (1, "contact.github", None, False, None)], "doc_id long, feature string, num double, bool boolean, items array<string>")
    kinds = spark.createDataFrame([("projects.count", "int"), ("academics.ug_cgpa", "number"), ("contact.github", "bool")], "feature string, kind string")
    rows = {r.cat: (r.fields, r.right) for r in evaluate.accuracy(labels, got, kinds, "cat").where("cat = 'x'").collect()}
    assert rows == {"x": (2, 1)}
