import pytest
from pyspark.sql import functions as F

from scoreloom.functions import dates
from scoreloom.operators import match, segment
from scoreloom.operators import text as tx

TODAY = "2026-09-22"


def one(spark, build, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "months"),
    [
        ("Jun 2023 - Aug 2023", 3.0), ("2020 - 2024", 48.0), ("2024 - 2020", None), ("Jan 2024 - Present", 33.0), ("6 weeks", 1.5), ("1.5 years", 18.0), ("06/2023 to 07/2023", 2.0),
        ("May 2024", 1.0), ("2024", None), ("no date", None), ("Summary 2024", None), ("2021 - 2021", 12.0),
    ],
)
def test_durations(spark, text, months):
    assert one(spark, lambda c: dates.months(c, TODAY), text) == months


@pytest.mark.parametrize(("text", "want"), [("12/05/2001", "2001-05-12"), ("05/13/2001", "2001-05-13"), ("30 Feb 2001", None), ("4th March 1999", "1999-03-04"), ("March 4, 1999", "1999-03-04"), ("31/04/2000", None), ("none", None)])
def test_dates_of_birth(spark, text, want):
    got = one(spark, dates.date_of_birth, text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("text", "key"), [("Work Experience", "experience"), ("PROJECTS (Academic)", "projects"), ("Technical Skills & Tools", "skills"), ("My quiet summer garden", None), ("", None)])
def test_headings(spark, text, key):
    assert one(spark, lambda c: segment.match_heading(c)[0], text) == key


def test_suggested_heading(spark):
    assert one(spark, segment.suggest_standard, "My Toolbox") == "skills"
    assert one(spark, segment.suggest_standard, "Educatoin") == "education"


@pytest.mark.parametrize(("text", "want"), [("march 2024", "Mar 2024"), ("3/2024", "Mar 2024"), ("2024-03", "Mar 2024"), ("MAR, 2024", "Mar 2024"), ("Mar '24", "Mar 2024"), ("till date", "Present"), ("spring", "spring"), ("13/2024", "13/2024")])
def test_months(spark, text, want):
    assert one(spark, tx.normal_month, text) == want


def test_blanking_keeps_offsets(spark):
    got = one(spark, tx.blank_urls, "see https://a.example/x now a@b.example.com end")
    assert len(got) == len("see https://a.example/x now a@b.example.com end") and got.split() == ["see", "now", "end"]


def test_small_text_functions(spark):
    assert one(spark, tx.strip_bullet, "•  1. item") == "item"
    assert one(spark, tx.phone, "id 123 call +91 98765 43210.") == "+91 98765 43210"
    assert one(spark, tx.tidy_name, "ASHA K EXAMPLE") == "Asha K Example"
    assert one(spark, lambda c: F.array_join(tx.filename_tokens(c), " "), "Asha_Resume_final2.pdf") == "asha"
    assert one(spark, tx.evidence, None) is None


def test_longest_mentions_win(spark):
    lex = spark.createDataFrame([("data", "Data", "data", 0, False, False), ("data structures", "DS", "data structures", 1, False, False), ("c", "C", "C", 2, False, True), ("go", "Go", "Go", 3, False, True)], "form string, skill string, name string, `order` int, exact_case boolean, list_only boolean")
    docs = spark.createDataFrame([(1, "Data structures and data\nLanguages: C, Go\nI go to C level"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r.line_no, r.start, r.skill) for r in match.mentions(docs, lex, ["doc_id"]).collect())
    assert got == [(0, 0, "DS"), (0, 20, "Data"), (1, 11, "C"), (1, 14, "Go")]


def test_requirements(spark):
    jd = "Backend Engineer\nAbout us\nWe build things for many people\nRequirements\n- Write services in a typed language\n- Short one\nPreferred qualifications\n- Some exposure to cloud systems\n"
    df = spark.createDataFrame([(1, jd)], "jd_id long, text string")
    assert [(r.req_no, r.importance) for r in match.requirements(df).orderBy("req_no").collect()] == [(1, "required"), (2, "preferred")]


def test_order_similarity(spark):
    words = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(words, words), (words, "few")], "a string, b string")
    assert [r.similarity for r in match.order_similarity(df, "a", "b").collect()] == [1.0, None]


def test_word_order_similarity_reads_whole_texts(spark, tmp_path):
    from scoreloom.plans import textual

    first = " ".join(f"word{k}" for k in range(1500))
    rows = [(1, first + " " + " ".join(f"left{k}" for k in range(1500))), (2, first + " " + " ".join(f"right{k}" for k in range(1500)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.similarity for r in textual.word_order_similarity(spark, str(tmp_path)).collect()] == [0.5]


DATED = [
    ("Jun 2023 - 2024", [(0, 2023, 6)]), ("Jun 2023 and, a good while later, 2024", [(0, 2023, 6), (34, 2024, None)]), ("06/2023 2024", [(0, 2023, 6)]), ("2020-2024", [(0, 2020, None), (5, 2024, None)]),
    ("Sept. 21, then 7-1999", [(0, 2021, 9), (15, 1999, 7)]), ("June '98", [(0, 1998, 6)]), ("20234 1/12/2020 a1999", [(17, 1999, None)]), ("Summary 12, Marching 2001", [(12, 2001, 3)]), ("13/2020 00/2021", []), ("", []), ("no digits in May", []), ("é May 2020", [(2, 2020, 5)]),
]


@pytest.mark.parametrize(("text", "want"), DATED)
def test_points_by_their_places(spark, text, want):
    assert [tuple(p) for p in one(spark, dates.points, text)] == want


@pytest.mark.parametrize(("text", "want"), [("from 10 - 15 months", 15.0), ("2.5 weeks, then 3 years", 0.62), ("for 6-month terms", 6.0), ("4 weekly", None), ("1 Years", 12.0), ("in 3.monthly", None)])
def test_durations_with_units(spark, text, want):
    assert one(spark, lambda c: dates.months(c, TODAY), text) == want
