import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from scoreloom.api import Engine
from scoreloom.operators import drafts, embedding, extract, match
from scoreloom.plans import inputs, rules
from scoreloom.sources import docx, files, results, sinks
from scoreloom.streaming import scoring

TEXT = "Some Person\nEducation\nB.Tech, Some College, CGPA: 8.4/10, {0}\nExperience\nIntern, Some Company, May 2025 - Jul 2025\n- Did work\nSkills\nPython, Go, C++\n"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def lines_of(folder):
    return sorted((json.loads(x) for f in glob.glob(f"{folder}/batch-*/*") for x in open(f, encoding="utf-8")), key=str)


def test_a_replayed_batch_changes_nothing(spark, engine, tmp_path):
    inbox, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()
    (inbox / "a.txt").write_text(TEXT.format(2024))
    (inbox / "b.doc").write_bytes(b"x")
    run = lambda: scoring.score_stream(engine, files.stream(spark, str(inbox)), "tech_internship", out, at).awaitTermination(300)
    run()
    (inbox / "c.txt").write_text(TEXT.format(2025))
    run()
    first, counted = lines_of(f"{out}/results"), lines_of(f"{out}/counters")
    assert len(first) == 3 and [(r["documents"], r["scored"]) for r in counted] == [(2, 1), (1, 1)] and counted[0]["score_sum"] > 0
    assert sum(r["error"] is not None for r in first) == 1
    stamps = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/*/batch-*/*")}
    for log in ("1", ".1.crc"):  # as if the driver died after writing and before it noted that
        os.remove(f"{at}/commits/{log}")
    run()
    assert lines_of(f"{out}/results") == first and lines_of(f"{out}/counters") == counted and {f: os.stat(f).st_mtime_ns for f in stamps} == stamps


def test_texts_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(texts):
        import pandas as pd

        assert isinstance(texts, pd.Series)
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0])

    cache = embedding.Cache(spark, str(tmp_path / "vectors"), "length")
    rows = [(k, f"text {k % 5}" if k else None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.vector for r in cache.vectors(df, "text", embed).collect()}
    assert calls.value == 5 and got == {k: t and [float(len(t)), 1.0] for k, t in rows}
    more = df.union(spark.createDataFrame([(99, "another")], "doc_id long, text string"))
    assert cache.vectors(more, "text", embed).where("doc_id = 99").first().vector == [7.0, 1.0] and calls.value == 6
    once = {r.doc_id: r.vector for r in embedding.distinct_vectors(df, "text", lambda c: F.array(F.length(c).cast("double"))).collect()}
    assert once[1] == [6.0] and once[0] is None


def test_fit_with_a_cache_of_vectors(spark, engine, tmp_path):
    docs = spark.createDataFrame([(1, TEXT.format(2024), 7), (2, TEXT.format(2025), 7)], "doc_id long, text string, jd_id long")
    jds = spark.createDataFrame([(7, "Engineer\nRequirements\nYou know how to write Python and Go\nYou did work at some company before\n")], "jd_id long, text string")
    cache = embedding.Cache(spark, str(tmp_path / "v"), "hashed")
    plain = sorted(map(tuple, engine.fit(docs, jds).collect()))
    assert sorted(map(tuple, engine.fit(docs, jds, cache=cache).collect())) == plain and plain[0][2] > 0
    assert cache.known().count() > 3


def test_inputs_that_cannot_be_read_become_rows(spark, engine):
    docs = spark.createDataFrame([(k, TEXT.format(2024)) for k in (1, 2, 3)], "doc_id long, text string")
    forms = spark.createDataFrame([(1, "2001-05-12", "GEN", "yes", "2"), (2, "soon", "other", "perhaps", "two"), (3, None, " ", "", "1.0")], "doc_id long, born string, kind string, pwbd string, tries string")
    given = {"date_of_birth": "born", "reservation_category": "kind", "pwbd": "pwbd", "attempts_used": "tries"}
    scores, errors = engine.score_forms(engine.features(docs), "govt_civil_services", forms, given)
    assert {r.doc_id for r in scores.collect()} == {1, 3}
    got = sorted((r.doc_id, r.input, r.type, r.value) for r in errors.collect())
    assert got == [(2, "attempts_used", "int", "two"), (2, "date_of_birth", "date", "soon"), (2, "pwbd", "bool", "perhaps"), (2, "reservation_category", "choice", "other")]
    with pytest.raises(rules.RuleError, match="unknown input"):
        inputs.checked(forms, rules.lookup(engine.categories, "govt_civil_services"), {"nothing": "kind"})


def test_drafts_with_other_and_missing_fields(spark, engine):
    rows = spark.sql("""SELECT 1 AS doc_id, named_struct('phone', '1', 'name', 'N', 'more', 2) AS contact, array(named_struct('bullets', array(' ', 'did it', null), 'title', 'T', 'start', '05/2025', 'end', 'now')) AS internships,
        array('x', ' ', null) AS languages, array('GATE 2026', 'other exam') AS exams UNION ALL SELECT 2, null, null, null, null""")
    got = {r.doc_id: r for r in engine.layouts(rows, "tech_internship").collect()}
    sections = {s.key: s for s in got[1].sections}
    assert sections["experience"].heading == "INTERNSHIPS" and sections["experience"].blocks[0].text == "T | May 2025 - Present" and sections["experience"].blocks[0].bullets == ["did it"]
    assert sections["languages"].blocks[0].text == "x" and [b.bullets for b in sections["exams"].blocks] == [["GATE 2026"]]
    assert any("No measurable result under 'T'" in w for w in got[1].warnings) and any("email" in w for w in got[1].warnings)
    assert got[2].sections == [] and got[2].pages == 1 and sum(w.startswith("No ") for w in got[2].warnings) == len(rules.lookup(engine.categories, "tech_internship").sections)
    own = drafts.order_of(rules.lookup(engine.categories, "tech_internship"))
    assert len(own) == len(set(own)) and set(drafts.fixed.DRAFT_ORDER) <= set(own)


def test_drafts_as_word_files(spark, engine, tmp_path):
    """Laid out, written in one batch and read again by the package's own reader."""
    rows = spark.sql("""SELECT 1 AS doc_id, named_struct('name', 'Asha <Ex> & Co', 'email', 'a@b.c', 'phone', '1') AS contact, 'About é' AS summary, array('Gold medal') AS achievements,
        array(named_struct('title', 'Tool', 'bullets', array('cut time by 5%', 'x < y'))) AS projects UNION ALL SELECT 2, null, null, null, null""")
    category = rules.lookup(engine.categories, "tech_internship")
    files_ = docx.of_layouts(drafts.to_render(rows, engine.layouts(rows, "tech_internship"), category))
    sinks.write_files(files_, str(tmp_path), "drafts", "files")
    got = {r.filename: r for r in files.read(spark, str(tmp_path / "drafts")).collect()}
    assert sorted(got) == ["Asha_Ex_Co_Resume_" + category.role + ".docx", "Draft_2_Resume_" + category.role + ".docx"] and all(r.error is None for r in got.values())
    assert got[min(got)].text.split("\n") == ["Asha <Ex> & Co", "a@b.c | 1", "SUMMARY", "About é", "PROJECTS", "Tool", "cut time by 5%", "x < y", "ACHIEVEMENTS", "Gold medal"]
    raw = (tmp_path / "drafts" / min(got)).read_bytes()
    read = docx.read(raw)
    assert [(x["style"], x["bold"], x["size"]) for x in read["lines"]][2:4] == [("Heading1", True, 12.0), ("", False, 10.5)] and read["table_count"] == 0
    assert docx.rendered("a\x00b", "", []) == docx.rendered("ab", "", [])


def test_skills_of_all_categories(spark, engine):
    docs = spark.createDataFrame([(1, "Docker and Python, Excel\nJava, Python"), (2, "nothing")], "doc_id long, text string")
    found = match.mentions(docs, engine.lexicon.drop("category"), ["doc_id"])
    got = {r.category: r.skills for r in extract.skills_by_category(found, engine.lexicon).collect()}
    assert got == {"languages": ["Python", "Java"], "cloud_devops": ["Docker"], "office": ["Excel"]}


def test_results_as_json_and_in_a_database(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 0.5), (2, None, None)], "doc_id long, items array<long>, score double")
    results.write_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()))[0] == (1, [1, 2], 0.5)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        results.write_sql(df, url, "scores", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no such driver here: {type(e).__name__}")
    back = spark.read.jdbc(url, "scores", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"}).collect()
    assert {r[0]: r[1] for r in back} == {1: "[1,2]", 2: None}


def test_what_plans_keep_goes_with_the_engine(spark, tmp_path):
    from scoreloom.plans import scratch

    docs = spark.createDataFrame([(1, TEXT.format(2024))], "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    held = lambda: {x for x in os.listdir(folder) if x.endswith(".parquet")}
    before = held()
    with Engine(spark) as own:
        assert own.analyze(docs, "tech_internship").count() == 1 and len(held()) > len(before)
    assert held() == before
    kept = scratch.saved(spark.range(3))
    with scratch.scope():
        inner = scratch.saved(spark.range(2))
        assert inner.count() == 2
    assert kept.count() == 3 and len(held()) == len(before) + 1
