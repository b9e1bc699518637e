import pytest
from pyspark.sql import functions as F

from scoreloom.api import Engine
from scoreloom.functions.vocabulary import DERIVED, FEATURES
from scoreloom.operators import evaluate
from scoreloom.plans import rules
from tests import golden

TIERS = [golden.STRONG, golden.AVERAGE, golden.WEAK]


@pytest.fixture(scope="module")
def ran(spark):
    engine = Engine(spark)
    docs = spark.createDataFrame([(c["doc_id"], golden.text_of(c), f"Person_{c['doc_id']}_Resume.pdf") for c in golden.CASES], "doc_id long, text string, filename string")
    lines = engine.lines(docs)
    features = engine.features(docs, lines=lines).cache()
    scores = {}
    for category in {c["category"] for c in golden.CASES}:
        own = [c["doc_id"] for c in golden.CASES if c["category"] == category]
        scores |= {r.doc_id: r for r in engine.score(features.where(F.col("doc_id").isin(own)), category).select("doc_id", "score", "confidence", "eligible").collect()}
    return engine, docs, lines, features, scores


def test_features_are_as_labelled(spark, ran):
    """Every labelled field of every document, through the accuracy operator; what fails is named."""
    features = ran[3]
    kind = {n: {"int": "int", "number": "number", "bool": "bool", "list": "list"}.get(k) for n, k in FEATURES.items() if n not in DERIVED}
    labels, dates = [], {}
    for c in golden.CASES:
        for name, v in golden.features_of(c).items():
            if kind[name] is None:
                dates[c["doc_id"]] = v
            else:
                bool_, list_ = kind[name] == "bool", kind[name] == "list"
                labels.append((c["doc_id"], c["tier"], name, None if bool_ or list_ else float(v), v if bool_ else None, v if list_ else None))
    want = spark.createDataFrame(labels, "doc_id long, tier string, feature string, num double, bool boolean, items array<string>")
    kinds = spark.createDataFrame([(n, k) for n, k in kind.items() if k], "feature string, kind string")
    got = features.where(F.col("feature").isin(*[n for n, k in kind.items() if k]))
    wrong = want.alias("w").join(got.alias("g"), ["doc_id", "feature"], "full_outer").collect()
    close = lambda a, b: (a is None and b in (None, 0.0)) or (a is not None and b is not None and abs(a - b) <= 0.05)
    bad = [(r.doc_id, r.feature, (r[3], r[4], r[5]), (r[6], r[7], r[8])) for r in wrong if not (close(r[3], r[6]) and (r[4] or False) == (r[7] or False) and sorted(r[5] or []) == sorted(r[8] or []))]
    (total,) = evaluate.accuracy(want, got.select("doc_id", "feature", "num", "bool", "items"), kinds, "tier").where("level = 1").collect()
    assert total.fields >= 700 and total.right >= 0.98 * total.fields, bad
    assert bad == []
    assert {r.doc_id: r.str for r in features.where("feature = 'candidate.date_of_birth'").collect()} == dates


def test_scores_are_those_of_the_labels(ran):
    """Strength, confidence and eligibility of the extracted features equal those that another scorer gives the labels."""
    engine, scores = ran[0], ran[4]
    for c in golden.CASES:
        want = golden.score_of(rules.lookup(engine.categories, c["category"]), golden.derived_of(golden.features_of(c)))
        got = scores[c["doc_id"]]
        assert abs(got.score - want[0]) <= 0.15 and abs(got.confidence - want[1]) <= 0.011 and got.eligible == want[2], (c["doc_id"], c["category"], c["tier"], got, want)


def test_tiers_bands_and_the_whole_scale(spark, ran):
    scores = ran[4]
    rows = [(c["doc_id"], c["category"], c["tier"], scores[c["doc_id"]].score) for c in golden.CASES]
    cases = spark.createDataFrame(rows, "doc_id long, category string, tier string, score double")
    said = sorted((r[1], r[2], r[3]) for r in rows)
    assert evaluate.outside_bands(cases, ["tier"], "tier", "score", {golden.STRONG: (70, None), golden.AVERAGE: (35, 75), golden.WEAK: (None, 30)}).where("outside > 0").isEmpty(), said
    assert evaluate.tier_order(cases.where("tier <> 'edge'"), "category", "tier", "score", TIERS).where("not ordered").isEmpty(), said
    s = evaluate.spread(cases, "tier", "score", golden.STRONG, golden.WEAK).first()
    assert s.range >= 60 and s.bands >= 8 and s.gap >= 25 and s.lowest < 30 < 90 < s.highest


def test_eligibility_has_both_outcomes(ran):
    out = {c["doc_id"]: ran[4][c["doc_id"]].eligible for c in golden.CASES}
    failed = [(c["category"], c["tier"]) for c in golden.CASES if not out[c["doc_id"]]]
    assert sorted(failed) == [(k, golden.WEAK) for k in ("govt_civil_services", "higher_ed_ms_phd_research", "higher_ed_mtech", "psu_via_gate")]


def test_readability_of_documents(ran):
    """What the checks find, and their total from the weights of what a text has."""
    engine, docs, lines, _, _ = ran
    got = {r.doc_id: r for r in engine.checks(docs.where("doc_id in (1, 9, 24)"), "tech_product_fulltime", lines.where("doc_id in (1, 9, 24)")).collect()}
    weights = {"text_layer": 3.0, "glyphs": 1.0, "headings_found": 1.0, "standard_headings": 1.5, "expected_sections": 1.5, "file_type": 1.0, "length": 1.0, "filename": 1.0, "date_formats": 1.0, "file_size": 0.5, "email": 0.5, "phone": 0.35, "linkedin": 0.15}
    groups = {"text_layer": "p", "glyphs": "p", "headings_found": "s", "standard_headings": "s", "expected_sections": "s", "email": "c", "phone": "c", "linkedin": "c"}
    share = {"p": 0.3, "s": 0.2, "c": 0.1, "h": 0.1}
    for r in got.values():
        found = {c.check: c for c in r.checks if c.score is not None}
        assert set(found) == set(weights)
        means = {}
        for g in share:
            own = [n for n in weights if groups.get(n, "h") == g]
            means[g] = round(100 * sum(found[n].score * weights[n] for n in own) / sum(weights[n] for n in own), 1)
        assert abs(r.ats - round(sum(means[g] * share[g] for g in share) / sum(share.values()), 1)) <= 0.05
        assert found["email"].status == found["phone"].status == found["linkedin"].status == "pass" and found["file_type"].status == "warn"
    status = {i: {c.check: c.status for c in r.checks} for i, r in got.items()}
    assert [status[i]["expected_sections"] for i in (1, 9, 24)] == ["pass", "fail", "fail"] and [status[i]["text_layer"] for i in (1, 9, 24)] == ["pass", "pass", "fail"]
    assert [got[i].ats for i in (1, 9, 24)] == [97.6, 88.0, 55.0] and not any(r.fatal for r in got.values())
