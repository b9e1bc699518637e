import pytest
from pyspark.sql import functions as F

from scoreloom.api import Engine
from scoreloom.operators import generate, intervals
from scoreloom.sources import files
from scoreloom.streaming import ttl

DOC = """Asha Example
asha@example.com | +91 98765 43210 | linkedin.com/in/asha-example

EDUCATION
B.Tech in Computing, Some College, CGPA: 8.4/10, 2020 - 2024
Class XII, Some School, 91%

EXPERIENCE
Software Engineering Intern - Microsoft | Jun 2023 - Aug 2023
- Cut latency by 30% for 2000 users

PROJECTS
Chat App: realtime chat
- Deployed at https://chat.example.app

SKILLS
Languages: Python, C++, Go
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, DOC), (2, ""), (3, None), (4, "one two three")], "doc_id long, text string")


def test_features(engine, docs):
    got = {r.feature: r for r in engine.features(docs).where("doc_id = 1").collect()}
    assert got["academics.ug_cgpa"].num == 8.4 and got["academics.class12_pct"].num == 91.0
    assert got["experience.internship_months"].num == 3.0 and got["experience.product_company_count"].num == 1.0
    assert got["projects.deployed_count"].num == 1.0 and got["projects.quantified_count"].num == 0.0
    assert got["skills.languages"]["items"] == ["C++", "Python", "Go"] or set(got["skills.languages"]["items"]) == {"C++", "Python", "Go"}
    assert "academics.pg_cgpa" not in got and got["education.has_master"].bool is False


def test_analyze_keeps_every_document(engine, docs):
    got = {r.doc_id: r for r in engine.analyze(docs, "tech_product_fulltime").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].score > 30 and got[1].overall is None and got[1].eligible


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Name  here\r\n\r\nnext".encode())
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.doc").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"a\x00b")
    (tmp_path / "e.txt").write_bytes("dé".encode("utf-16"))
    got = {r.filename: (r.text, r.error) for r in files.read(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("Name here\nnext", None) and got["b.txt"] == ("café", None) and got["e.txt"] == ("dé", None)
    assert "old .doc" in got["c.doc"][1] and got["d.txt"][1] == "not a text"


def test_gutter(spark):
    words = [(1, 50.0, 250.0, y, y + 10.0) for y in range(0, 700, 15)] + [(1, 320.0, 550.0, y, y + 10.0) for y in range(0, 700, 15)]
    w = spark.createDataFrame([(p, a, b, float(t), float(u)) for p, a, b, t, u in words], "page_id long, x0 double, x1 double, top double, bottom double")
    pages = spark.createDataFrame([(1, 600.0, 700.0)], "page_id long, width double, height double")
    (r,) = intervals.gutters(w, pages).collect()
    assert 250 <= r.x <= 320 and r.clear_share == 1.0


def test_generated_text(spark):
    rows = [(1, 1, "Education", [("B.Tech", ["8.4"])]), (1, 2, "Skills", [("Python", [])])]
    df = spark.createDataFrame(rows, "d long, place int, heading string, blocks array<struct<text:string,bullets:array<string>>>")
    assert generate.rendered(df, "d").first().text == "EDUCATION\nB.Tech\n- 8.4\n\nSKILLS\nPython"


def test_form_rows(spark):
    df = spark.createDataFrame([(1, "role__0__title", " Dev "), (1, "role__0__end", ""), (1, "role__1__title", "Ops"), (1, "name", "x")], "d long, field string, value string")
    got = {(r.prefix, r.n): r["values"] for r in generate.form_rows(df, "d", "field", "value").collect()}
    assert got == {("role", 0): {"title": "Dev"}, ("role", 1): {"title": "Ops"}}


def test_stream_store(spark, tmp_path):
    import datetime as dt

    src, at = tmp_path / "in", dt.datetime(2026, 1, 1, 12)
    spark.createDataFrame([("a", "1", at), ("a", "2", at + dt.timedelta(minutes=5)), ("b", "3", at)], "k string, v string, at timestamp").write.parquet(str(src))
    stream = spark.readStream.schema("k string, v string, at timestamp").parquet(str(src))
    seen = []
    q = ttl.run_once(ttl.streamed(stream, "k", "at", "v"), lambda b, i: seen.extend(b.collect()), str(tmp_path / "cp"), "update")
    q.awaitTermination(60)
    assert {(r.k, r.v) for r in seen} == {("a", "2"), ("b", "3")}
    now = F.lit(at + dt.timedelta(minutes=62))
    puts = spark.createDataFrame([("a", at), ("b", at + dt.timedelta(minutes=5))], "k string, at timestamp")
    assert [r.k for r in ttl.alive(puts, "k", "at", now).collect()] == ["b"]


def _docx(paragraphs: str, more: dict[str, str] | None = None) -> bytes:
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{paragraphs}</w:body></w:document>')
        for name, text in (more or {}).items():
            z.writestr(name, text.replace("<w:hdr>", f'<w:hdr xmlns:w="{w}">'))
    return out.getvalue()


P = "<w:p><w:pPr><w:pStyle w:val='{}'/></w:pPr><w:r><w:rPr>{}<w:sz w:val='{}'/></w:rPr><w:t>{}</w:t></w:r></w:p>"


def test_docx(spark, tmp_path):
    from scoreloom.sources import docx

    cell = "<w:tc>{}" + P.format("", "", 20, "cell {}") + "</w:tc>"
    table = "<w:tbl><w:tr>" + cell.format("<w:tcPr><w:vMerge w:val='restart'/></w:tcPr>", 1) + cell.format("", 2) + "</w:tr><w:tr>" + cell.format("<w:tcPr><w:vMerge/></w:tcPr>", 3) + cell.format("", 4) + "</w:tr></w:tbl>"
    box = "<w:p><w:r><w:txbxContent>" + P.format("", "", 20, "in a box") + "</w:txbxContent></w:r><w:r><w:t>outside</w:t></w:r></w:p>"
    body = P.format("Heading1", "<w:b/>", 28, "Asha  Example") + P.format("", "<w:b w:val='0'/>", 20, "plain") + table + box + "<w:sectPr><w:cols w:num='2'/></w:sectPr>"
    more = {"word/header1.xml": "<w:hdr>" + P.format("", "", 20, "top of page") + "</w:hdr>", "word/media/a.png": "x", "docProps/app.xml": '<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Pages>3</Pages></Properties>'}
    (tmp_path / "a.docx").write_bytes(_docx(body, more))
    (tmp_path / "b.docx").write_bytes(b"PK broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.docx").write_bytes(_docx(""))
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.docx for r in docx.documents(raw).collect()}
    a = got["a.docx"]
    assert [(x.text, x.zone, x.size, x.bold, x.style) for x in a.lines] == [
        ("Asha Example", "body", 14.0, True, "Heading1"), ("plain", "body", 10.0, False, ""), ("cell 1", "table", 10.0, False, ""), ("cell 2", "table", 10.0, False, ""), ("cell 4", "table", 10.0, False, ""), ("outside", "body", None, False, ""),
    ]
    assert (a.docx_columns, a.table_count, a.textbox_words, a.header_footer_words, a.image_count, a.stated_pages, a.error) == (2, 1, 3, 3, 1, 3, None)
    assert got["b.docx"].error == "unreadable: BadZipFile" and got["d.docx"].lines == []
    read = {r.filename: r for r in files.with_readers(raw).collect()}
    assert read["a.docx"].text.split("\n")[0] == "Asha Example" and read["a.docx"].error is None and read["a.docx"].page_count == 1
    assert read["b.docx"].error.startswith("unreadable") and read["c.pdf"].error == files.NO_READER and read["d.docx"].error == "no text"


def test_checks_follow_the_category(engine, spark):
    long_ = DOC + "\n".join("word " * 20 for _ in range(60))
    docs = spark.createDataFrame([(1, DOC, "resume_final.pdf"), (2, long_, "asha_example.pdf")], "doc_id long, text string, filename string").withColumn("file_type", F.lit("pdf"))
    of = lambda c: {r.doc_id: {x.check: x.status for x in r.checks} for r in engine.checks(docs, c).collect()}
    one, two = of("tech_internship"), of("higher_ed_ms_phd_research")
    assert (one[2]["length"], two[2]["length"]) == ("fail", "pass")
    assert one[1]["filename"] == "warn" and one[2]["filename"] == "pass" and one[1]["keywords"] == "na" and one[1]["linkedin"] == "pass"
    assert of("govt_ssc_banking")[1]["linkedin"] == "na"


def test_fit_with_skills_and_notes(engine, spark):
    jds = spark.createDataFrame([(1, "Engineer\nRequirements\n- Work with Python and Docker every day\n- Cut latency by 30% for 2000 users\nPreferred\n- Some taste of Kafka at work\n"), (2, "Title only")], "jd_id long, text string")
    docs = spark.createDataFrame([(1, DOC, 1), (2, DOC, 2), (3, "", 1), (4, DOC, None)], "doc_id long, text string, jd_id long")
    m = {r.req_no: r for r in engine.matches(docs, jds).where("doc_id = 1").collect()}
    assert (m[1].wanted, m[1].missing, m[3].importance) == (["Docker", "Python"], ["Docker"], "preferred") and m[2].status == "strong" and m[2].evidence and m[3].rank == 3 and m[1].rank < m[2].rank
    got = {r.doc_id: (r.fit, r.note) for r in engine.fit(docs, jds).collect()}
    assert got[1][0] > 20 and got[1][1] is None and got[2] == (0.0, "no requirements in the description") and got[3] == (0.0, "nothing to compare in the document") and 4 not in got
    assert engine.fit(docs, jds, embed=None).first().note == "no embedder"
    out = {r.doc_id: r for r in engine.analyze(docs, "tech_product_fulltime", jds).collect()}
    assert out[1].overall is not None and out[2].overall is None and out[4].overall is None and out[3].score is None and out[1].low_confidence is False
    hits = {r.skill: r for r in engine.keywords(docs.where("doc_id = 1"), jds, engine.lines(docs.where("doc_id = 1"))).collect()}
    assert hits["Python"].status == "exact" and not hits["Python"].in_context and hits["Docker"].status == "missing"


def test_unknown_features_are_rejected(spark):
    from scoreloom.operators import extract

    f = spark.createDataFrame([(1, "no.such", 1.0, None, None, None, None)], "doc_id long, feature string, num double, bool boolean, items array<string>, str string, evidence string")
    for name in ("no.such", "candidate.age"):
        with pytest.raises(Exception, match="not a feature that can be stated"):
            extract.derived_features(f.withColumn("feature", F.lit(name)), "2026-09-22").collect()


def test_report(engine, docs):
    import json

    features = engine.features(docs)
    got = {r.doc_id: json.loads(r.json) for r in engine.report(engine.analyze(docs, "tech_product_fulltime"), features).collect()}
    assert [c["card"] for c in got[1]["cards"]] == ["strength", "ats"] and got[2]["cards"][-1]["note"] and got[1]["low_confidence"] is False
    assert "academics.ug_cgpa" in [f["feature"] for f in got[1]["facts"]] and "skills.list" not in [f["feature"] for f in got[1]["facts"]]


def test_messages_and_templates(spark):
    from scoreloom.functions.vocabulary import register_feature
    from scoreloom.plans import rules, scoring

    for name, kind in (("t.n", "number"), ("t.m", "number"), ("t.l", "list")):
        register_feature(name, kind)
    band = lambda f, hi: {"feature": f, "rule": {"type": "bands", "points": [[0, 0], [hi, 1]]}}
    c = rules.category_of({
        "id": "t", "subscores": {"a": {"weight": 1}}, "signals": [{"id": "s", "subscore": "a", "any_of": [band("t.n", 100), band("t.m", 10)], "suggest": {"text": "{value} or {value_pct}", "text_missing": "state it"}}],
        "eligibility": [{"id": "g", "feature": "t.n", "min": 5, "message": "{value} is below {limit}", "message_missing": "not there"}, {"id": "h", "feature": "t.n", "max": 50, "message": "{value} over {limit}"}],
    })
    df = spark.createDataFrame([(1, 4.5, 0.25), (2, 60.0, 0.5), (3, None, None)], "doc_id long, n double, m double")
    names = {"t.n": "n", "t.m": "m"}
    said = {r.doc_id: [g.message for g in r.gates] for r in scoring.gated(df, c, names).collect()}
    assert said == {1: ["4.5 is below 5", "4.5 meets the requirement of 50."], 2: ["60 meets the requirement of 5.", "60 over 50"], 3: ["not there", "not stated over 50"]}
    text = {r.doc_id: r.text for r in scoring.suggestions(scoring.scored(df, c, names), c, names, "doc_id").collect()}
    assert text == {1: "4.5 or 450%", 2: "60 or 6000%", 3: "state it"}


def test_snapshots_labels_and_entities(spark, tmp_path):
    from scoreloom.operators import evaluate, extract
    from scoreloom.sources import results

    rows = [("a", "t", "strong", 80.0, 70.0, None, 0.9, True), ("b", "t", "weak", 20.0, 60.0, None, 0.5, False)]
    old = spark.createDataFrame(rows, results.SNAPSHOT)
    results.write_snapshot(old, f"{tmp_path}/s")
    back = results.read_snapshot(spark, f"{tmp_path}/s")
    assert sorted(back.collect()) == sorted(old.collect())
    new = back.withColumn("strength", F.when(F.col("case_id") == "b", 30.0).otherwise(F.col("strength"))).withColumn("eligible", F.lit(True))
    moved = evaluate.snapshot_diff(back, new, "case_id", ["strength", "ats"], flags=["eligible"]).collect()
    assert sorted((r.case_id, r.change, r.field) for r in moved) == [("b", "flipped", "eligible"), ("b", "moved", "strength")]
    cases = [{"case_id": "a", "tier": "strong", "text": "x", "labels": {"projects.count": "2", "skills.languages": "Python, Go", "research.faculty_guided": "true"}}]
    spark.createDataFrame([(__import__("json").dumps(x),) for x in cases], "value string").write.text(f"{tmp_path}/l")
    long_ = {r.feature: (r.num, r.bool, r["items"]) for r in results.labels_long(results.read_labelled(spark, f"{tmp_path}/l"), {"projects.count": "int", "skills.languages": "list", "research.faculty_guided": "bool"}).collect()}
    assert long_ == {"projects.count": (2.0, None, None), "skills.languages": (None, None, ["Python", "Go"]), "research.faculty_guided": (None, True, None)}
    texts = spark.createDataFrame([(1, "Asha met Bob")], "doc_id long, text string")
    assert extract.entities(texts).count() == 0
    assert [r.entity for r in extract.entities(texts, lambda c: F.transform(F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), 0), lambda x: F.struct(F.lit("PERSON").alias("label"), x.alias("entity")))).collect()] == ["Asha", "Bob"]


def test_an_extractor_of_ones_own(spark, docs):
    from scoreloom.operators import extract

    engine = Engine(spark)
    engine.register_extractor({"own.lines": "int"}, lambda lines: extract._long(lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "own.lines", num=F.col("n")))
    assert {r.doc_id: r.num for r in engine.features(docs).where("feature = 'own.lines'").collect()} == {1: 13.0, 4: 1.0}


def test_stream_store_keeps_later_puts_only(spark, tmp_path):
    import datetime as dt

    src, at = tmp_path / "in", dt.datetime(2026, 1, 1, 12)
    put = lambda rows, n: spark.createDataFrame(rows, "k string, v string, at timestamp").write.parquet(str(src / str(n)))
    put([("a", "1", at), ("a", "2", at + dt.timedelta(minutes=50))], 1)
    seen = []

    def run():
        stream = spark.readStream.schema("k string, v string, at timestamp").option("recursiveFileLookup", "true").parquet(str(src))
        ttl.run_once(ttl.streamed(stream, "k", "at", "v"), lambda b, i: seen.extend((r.k, r.v, r.expires_at) for r in b.collect()), str(tmp_path / "cp"), "update").awaitTermination(60)

    run()
    put([("a", "late", at + dt.timedelta(minutes=20)), ("b", "3", at + dt.timedelta(minutes=55))], 2)
    run()
    put([("a", "4", at + dt.timedelta(minutes=70))], 3)  # across the hour's border
    run()
    hour = dt.timedelta(hours=1)
    assert seen == [("a", "2", at + dt.timedelta(minutes=50) + hour), ("b", "3", at + dt.timedelta(minutes=55) + hour), ("a", "4", at + dt.timedelta(minutes=70) + hour)]


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one  two")
    (tmp_path / "in" / "b.doc").write_bytes(b"x")
    seen = {}
    ttl.run_once(files.stream(spark, str(tmp_path / "in")), lambda b, i: seen.update({r.filename: (r.text, r.error) for r in b.collect()}), str(tmp_path / "cp")).awaitTermination(60)
    assert seen["a.txt"] == ("one two", None) and "old .doc" in seen["b.doc"][1]


STRONG = DOC.replace("CGPA: 8.4/10", "CGPA: 9.6/10").replace("Languages: Python, C++, Go", "Languages: Python, C++, Go, Java, SQL\nReact, Docker, AWS, PostgreSQL, Data Structures, Operating Systems, DBMS, Computer Networks, System Design") + """
PROJECTS
Search: finds things
- Serves 5000 users with 20 ms latency, live at https://search.example.app
Tables: reads tables
- Handles 900 req/s, deployed at https://tables.example.app

ACHIEVEMENTS
- Winner of the national Hackathon
- Gold medal

CODING PROFILES
LeetCode: 650 problems solved, easy: 150, medium: 380, hard: 120
Codeforces rating 1900
"""
WEAK = "Asha Example\nasha@example.com\n\nEDUCATION\nB.Tech in Computing, Some College, CGPA: 5.1/10\n\nSKILLS\nLanguages: C\n"


def test_tiers_score_in_order(engine, spark):
    """Fresh labelled documents through extraction and scoring: every feature as labelled, and strong above average above weak."""
    from scoreloom.operators import evaluate

    docs = spark.createDataFrame([(1, STRONG, "strong"), (2, DOC, "average"), (3, WEAK, "weak")], "doc_id long, text string, tier string")
    features = engine.features(docs)
    want = {1: {"projects.count": 3.0, "projects.deployed_count": 3.0, "projects.quantified_count": 2.0, "achievements.hackathon_wins": 1.0, "coding.leetcode.total": 650.0, "coding.leetcode.hard": 120.0, "coding.codeforces.rating": 1900.0, "academics.ug_cgpa": 9.6}, 2: {"projects.count": 1.0, "academics.ug_cgpa": 8.4}, 3: {"academics.ug_cgpa": 5.1}}
    rows = [(i, {1: "strong", 2: "average", 3: "weak"}[i], f, v, None, None) for i, own in want.items() for f, v in own.items()]
    labels = spark.createDataFrame(rows, "doc_id long, tier string, feature string, num double, bool boolean, items array<string>")
    kinds = spark.createDataFrame([(f, "number") for f in sorted({r[2] for r in rows})], "feature string, kind string")
    labelled = features.join(labels.select("doc_id", "feature"), ["doc_id", "feature"], "left_semi")
    assert [(r.fields, r.right) for r in evaluate.accuracy(labels, labelled, kinds, "tier").where("level = 1").collect()] == [(len(rows), len(rows))]
    scores = engine.score(features, "tech_product_fulltime").select("doc_id", "score").join(docs.select("doc_id", "tier"), "doc_id").withColumn("g", F.lit(1))
    got = evaluate.tier_order(scores, "g", "tier", "score", ["strong", "average", "weak"]).first()
    assert got.ordered and got.strong_min >= 70 and got.weak_max <= 35
