"""The text operators over documents that are written from the business tables, so that SQL knows from the numbers what must be found in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions import dates, fixed, lexicons
from scoreloom.functions.numbers import rounded
from scoreloom.operators import drafts, embedding, evaluate, extract, generate, layout, match, reading, report, segment
from scoreloom.operators import text as tx
from scoreloom.plans import business, inputs, rules
from scoreloom.plans.business import query as _query
from scoreloom.plans.business import spread, table
from scoreloom.plans.scratch import saved

Q: dict = {}
SQL: dict[str, str] = {}
TODAY = "2026-09-22"


def query(name: str, sql: str | None):
    return _query(name, sql, Q, SQL)


# --- single texts ------------------------------------------------------------------------


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the period from order to shipment, written in one of six ways."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"))
    t = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k", (F.col("l_orderkey") + F.col("l_linenumber")) % 6)
    on = lambda c, form: F.date_format(c, form)
    text = (
        F.when(F.col("k") == 0, F.concat(F.lit("Engineer, "), on("a", "MMM yyyy"), F.lit(" - "), on("l_shipdate", "MMM yyyy"))).when(F.col("k") == 1, F.concat(on("a", "MM/yyyy"), F.lit(" to "), on("l_shipdate", "MM/yyyy")))
        .when(F.col("k") == 2, F.concat(F.lit("College "), on("a", "yyyy"), F.lit(" - "), on("l_shipdate", "yyyy"))).when(F.col("k") == 3, F.concat(on("a", "MMMM yyyy"), F.lit(" – Present")))
        .when(F.col("k") == 4, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" weeks"))).otherwise(F.lit("nothing about when"))
    )
    return t.select("l_orderkey", "l_linenumber", "k", "a", F.col("l_shipdate").alias("b"), text.alias("text"))


SPANS = """t AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 6 AS k, o_orderdate AS a, l_shipdate AS b, l_quantity AS q, (year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS both_in FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("duration_months", f"""WITH {SPANS} SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN CAST(CASE WHEN both_in > 0 THEN both_in END AS DOUBLE) WHEN 1 THEN CAST(CASE WHEN both_in > 0 THEN both_in END AS DOUBLE) WHEN 2 THEN CASE WHEN year(a) = year(b) THEN 12.0 WHEN year(b) > year(a) THEN (year(b) - year(a)) * 12.0 END
WHEN 3 THEN (2026 - year(a)) * 12.0 + 9 - month(a) + 1 WHEN 4 THEN round_even(CAST(q AS INTEGER) / 4, 2) END AS months, k <= 3 AS dated FROM t""")  # fmt: skip
def duration_months(spark, d):
    return spans(spark, d).select("l_orderkey", "l_linenumber", dates.months(F.col("text"), TODAY).alias("months"), dates.has_date(F.col("text")).alias("dated"))


@query("date_points", f"""WITH {SPANS} SELECT l_orderkey, l_linenumber, CASE WHEN k IN (0, 1) THEN strftime(a, '%Y-') || month(a) || ' ' || strftime(b, '%Y-') || month(b) WHEN k = 2 THEN strftime(a, '%Y') || ' ' || strftime(b, '%Y') WHEN k = 3 THEN strftime(a, '%Y-') || month(a) ELSE '' END AS points FROM t""")
def date_points(spark, d):
    said = F.transform(dates.points(F.col("text")), lambda p: F.concat_ws("-", p["year"].cast("string"), p["month"].cast("string")))
    return spans(spark, d).select("l_orderkey", "l_linenumber", F.array_join(said, " ").alias("points"))


@query("date_points_near_and_far", """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, (l_orderkey + l_linenumber) % 7 AS k, o_orderdate AS a, l_shipdate AS b, CAST(l_quantity AS INTEGER) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, strftime(a, '%Y-') || month(a) AS am, strftime(b, '%Y-') || month(b) AS bm, strftime(b, '%Y') AS y, length(strftime(a, '%b %Y')) AS w FROM t)
SELECT l_orderkey, l_linenumber, l_suppkey, q, CASE k WHEN 0 THEN '0 ' || am || CASE WHEN w + q > 20 THEN ', ' || CAST(w + q AS VARCHAR) || ' ' || y ELSE '' END WHEN 1 THEN '0 ' || am || CASE WHEN 7 + q > 20 THEN ', ' || CAST(7 + q AS VARCHAR) || ' ' || y ELSE '' END
WHEN 2 THEN CAST(q AS VARCHAR) || ' ' || y || ', ' || CAST(q + 5 AS VARCHAR) || ' ' || am WHEN 3 THEN '0 ' || strftime(a, '%Y') || ', ' || CAST(4 + q AS VARCHAR) || ' ' || y WHEN 4 THEN '0 20' || strftime(b, '%m') || '-' || month(a) || ', 4 ' || bm
WHEN 5 THEN '' WHEN 6 THEN CASE WHEN q % 2 = 0 THEN '' ELSE CAST(q AS VARCHAR) || ' ' || strftime(a, '%Y-') || month(a) END END AS points FROM n""")  # fmt: skip
def date_points_near_and_far(spark, d):
    """Two dates of an order with as many characters between them as it has pieces: a bare year counts only if it stands far enough from a month, a month's name only if it starts a word."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"))
    t = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "a", F.col("l_shipdate").alias("b"))
    on, gap = lambda c, form: F.date_format(c, form), F.rpad(F.lit(" "), F.col("q"), "x ")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    text = (
        F.when(k == 0, F.concat(on("a", "MMM yyyy"), gap, on("b", "yyyy"))).when(k == 1, F.concat(on("a", "MM/yyyy"), gap, on("b", "yyyy"))).when(k == 2, F.concat(gap, on("b", "yyyy"), F.lit(" "), on("a", "MM-yyyy")))
        .when(k == 3, F.concat(on("a", "yyyy"), gap, on("b", "yyyy"))).when(k == 4, F.concat(on("a", "MMM"), F.lit(" "), on("b", "MM/yyyy"))).when(k == 5, F.concat(F.lit("5/"), on("a", "MM/yyyy"), F.lit(" /"), on("b", "yyyy"))).otherwise(F.concat(gap, on("a", "MMM"), F.lit("'"), on("a", "yy")))
    )
    said = F.transform(dates.points(F.col("text")), lambda p: F.concat(p["at"].cast("string"), F.lit(" "), F.concat_ws("-", p["year"].cast("string"), p["month"].cast("string"))))
    return t.withColumn("text", text).select("l_orderkey", "l_linenumber", "l_suppkey", "q", F.array_join(said, ", ").alias("points"))


@query("date_of_birth", """WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN k < 3 THEN d WHEN k = 3 AND day(d) > 12 THEN d WHEN k = 3 THEN make_date(year(d), day(d), month(d)) END AS born, CAST(CASE WHEN o_orderkey % 100 < 70 THEN 2000 + o_orderkey % 100 ELSE 1900 + o_orderkey % 100 END AS INTEGER) AS full_year FROM t""")  # fmt: skip
def date_of_birth(spark, d):
    k, on = F.col("o_orderkey") % 5, lambda form: F.date_format("o_orderdate", form)
    text = F.when(k == 0, on("dd/MM/yyyy")).when(k == 1, on("d MMMM yyyy")).when(k == 2, on("MMM d, yyyy")).when(k == 3, on("MM-dd-yyyy")).otherwise(F.concat(F.lit("31.02."), on("yyyy")))
    short = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    born = F.get(F.transform(F.array(text), lambda c: dates.date_of_birth(c)), 0)  # the text is made once, however often the rules read it
    return table(spark, d, "orders").select("o_orderkey", born.alias("born"), dates.full_year(short).alias("full_year"))


@query("grade_points", """WITH t AS (SELECT p_partkey, p_partkey % 5 AS k, (p_partkey % 60 + 40) / 10.0 AS v, (p_partkey % 30 + 10) / 10.0 AS g FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1, 3) THEN round_even(v, 3) WHEN k = 2 THEN round_even(g * 10 / 4, 3) END AS cgpa FROM t""")  # fmt: skip
def grade_points(spark, d):
    k, v, g = F.col("p_partkey") % 5, F.format_string("%.1f", (F.col("p_partkey") % 60 + 40) / 10), F.format_string("%.1f", (F.col("p_partkey") % 30 + 10) / 10)
    text = F.when(k == 0, F.concat(F.lit("CGPA: "), v, F.lit("/10"))).when(k == 1, F.concat(v, F.lit(" C.G.P.A"))).when(k == 2, F.concat(F.lit("GPA "), g, F.lit("/4"))).when(k == 3, F.concat(F.lit("B.Tech, CPI of "), v)).otherwise(F.concat(F.lit("marks "), v))
    return table(spark, d, "part").select("p_partkey", extract.cgpa(text).alias("cgpa"))


def picked(spark: SparkSession, d: str, rows: list[tuple]) -> tuple[DataFrame, Column]:
    """Orders, each with one of a few texts by its key."""
    return table(spark, d, "orders").select("o_orderkey"), F.element_at(F.array(*[F.lit(r[0]) for r in rows]), (F.col("o_orderkey") % len(rows) + 1).cast("int"))


def picked_sql(rows: list[tuple], names: str) -> str:
    value = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool | int) else "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({n}, {', '.join(value(x) for x in r[1:])})" for n, r in enumerate(rows))
    return f"SELECT o_orderkey, v.* EXCLUDE (n) FROM orders JOIN (VALUES {listed}) AS v(n, {names}) ON o_orderkey % {len(rows)} = n"


DEGREES = [
    ("B.Tech in Computing, Some College", "ug"), ("M.Sc Physics 2020", "pg"), ("Class XII, Some School", "class12"), ("SSLC board, 2015", "class10"), ("Ph.D. (Chemistry)", "phd"), ("MBA, finance", "pg"), ("Diploma in printing", None),
    ("10th standard", "class10"), ("HSC 2018", "class12"), ("Bachelor of Arts and MBA", "ug pg"), ("Post-graduation 2021", "pg ug"), ("LL.B from a college", "ug"), ("Higher Secondary with 91%", "class12"), ("Matriculation", "class10"),
]


@query("degree_levels", picked_sql(DEGREES, "levels"))
def degree_levels(spark, d):
    t, text = picked(spark, d, DEGREES)
    return t.select("o_orderkey", F.nullif(F.array_join(F.transform(extract.level_spans(text), lambda s: s["level"]), " "), F.lit("")).alias("levels"))


HEADINGS = [
    ("Work Experience", "work experience", "experience", True), ("SKILLS & TOOLS", "skills and tools", "skills", True), ("Projects (Academic)", "projects academic", "projects", False), ("My quiet summer garden", "my quiet summer garden", None, False),
    ("EDUCATION:", "education", "education", True), ("Awards and Achievements 2020", "awards and achievements", "achievements", True), ("Personal  Details", "personal details", "personal", True), ("12345", "", None, False),
    ("Key Technical Skills", "key technical skills", "skills", False), ("One of the many things said about work here", "one of the many things said about work here", None, False),
]


@query("heading_match", picked_sql(HEADINGS, "form, section, exact"))
def heading_match(spark, d):
    t, text = picked(spark, d, HEADINGS)
    key, exact = segment.match_heading(text)
    return t.select("o_orderkey", tx.heading_form(text).alias("form"), key.alias("section"), exact.alias("exact"))


SUGGESTED = [("My Toolbox", "skills"), ("Educatoin", "education"), ("Where I went to school", "education"), ("Career path", "experience"), ("Zzzz qqqq xxxx", None), ("My story", "summary"), ("Projcts", "projects")]


@query("heading_suggested", picked_sql(SUGGESTED, "section"))
def heading_suggested(spark, d):
    t, text = picked(spark, d, SUGGESTED)
    return t.select("o_orderkey", segment.suggest_standard(text).alias("section"))


ROLES = [
    ("Software Engineering Intern - Microsoft", True, False, True, False), ("Graduate Engineer Trainee, ONGC", False, True, False, True), ("Trainee at a mill", True, False, False, False), ("Thesis student with Prof. Rao", False, False, False, False),
    ("Engineer, Tata Steel", False, False, False, True), ("Analyst at TCS", False, False, False, False), ("Summer of Code at Google", True, False, True, False), ("Metallurgist, Some Works", False, False, False, False),
]


@query("role_classes", picked_sql(ROLES, "intern, career, product, core"))
def role_classes(spark, d):
    t, text = picked(spark, d, ROLES)
    hit = lambda names: text.rlike(extract.company_pattern(names))
    intern = text.rlike(extract.INTERN) | (text.rlike(extract.TRAINEE) & ~text.rlike(extract.CAREER))
    return t.select("o_orderkey", intern.alias("intern"), text.rlike(extract.CAREER).alias("career"), hit(fixed.PRODUCT).alias("product"), hit(fixed.CORE).alias("core"))


QUALITIES = [
    ("Cut latency by 30%", True, False), ("Live at example.com for 2,000 users", True, True), ("Wrote a parser", False, False), ("Deployed to the play store", False, True), ("Accuracy of the model was 91.2", True, False), ("Draws 12 kV from the grid", True, False),
    ("Handles 500 req/s", True, False), ("A game in 3 parts", False, False), ("Moved 5 elo up", True, False), ("see https://x.example/y", False, True),
]


@query("project_quality", picked_sql(QUALITIES, "quantified, deployed"))
def project_quality(spark, d):
    t, text = picked(spark, d, QUALITIES)
    return t.select("o_orderkey", text.rlike(extract.METRIC).alias("quantified"), text.rlike(extract.DEPLOYED).alias("deployed"))


FILES = [
    ("Asha_Rao_Resume.pdf", "asha rao", False), ("resume_final.pdf", "", True), ("cv-v2.docx", "v", True), ("asha(1).pdf", "asha", False), ("/in/box/Rao.Finale.txt", "finale rao", False), ("scan 003.pdf", "", False), ("asha updated.pdf", "asha", True),
]


@query("filename_flags", picked_sql(FILES, "tokens, draft"))
def filename_flags(spark, d):
    t, name = picked(spark, d, FILES)
    return t.select("o_orderkey", F.array_join(F.array_sort(tx.filename_tokens(name)), " ").alias("tokens"), tx.stem(name).rlike(tx.DRAFT).alias("draft"))


STATEMENTS = [
    ("I wish to work with Prof. Rao of the department of physics", 0.4, 12.0), ("My thesis gave 20% better results; I plan to study how to go on", 0.6, 14.0), ("Since my childhood I dreamt of an esteemed institute. I am a hard-working person", 0.0, 14.0), ("", None, None),
    ("The lab of Dr. Rao, an open problem, I built 3 datasets", 1.0, 12.0), ("My work: 5 papers. AI is the future", 0.27, 8.0),
]


@query("statement_features", "SELECT o_orderkey, v.s AS specificity, v.w AS words FROM orders LEFT JOIN (VALUES " + ", ".join(f"({n}, CAST({s} AS DOUBLE), CAST({w} AS DOUBLE))" for n, (_, s, w) in enumerate(STATEMENTS) if s is not None) + f") AS v(n, s, w) ON o_orderkey % {len(STATEMENTS)} = n")
def statement_features(spark, d):
    t, text = picked(spark, d, STATEMENTS)
    f = extract.statement(t.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    f = f.groupBy("doc_id").pivot("feature", ["sop.specificity", "sop.word_count"]).agg(F.first("num")).toDF("doc_id", "specificity", "words")
    return t.join(f, F.col("o_orderkey") == F.col("doc_id"), "left").select("o_orderkey", "specificity", "words")


@query("bullets_stripped", "SELECT p_partkey, p_name AS stripped, p_partkey % 6 < 4 AS bullet FROM part")
def bullets_stripped(spark, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("• ", "  - ", "(cid:127) ", " ", "12. ", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.concat(lead, "p_name")
    return table(spark, d, "part").select("p_partkey", tx.strip_bullet(text).alias("stripped"), tx.is_bullet(text).alias("bullet"))


@query("urls_blanked", "SELECT page_id, 'see ' || repeat(' ', CAST(length(url) AS INTEGER)) || ' or ' || repeat(' ', CAST(length('a' || page_id || '@b.example.com') AS INTEGER)) || ' end' AS blanked FROM pages")
def urls_blanked(spark, d):
    text = F.concat(F.lit("see "), "url", F.lit(" or a"), F.col("page_id").cast("string"), F.lit("@b.example.com end"))
    return table(spark, d, "pages").select("page_id", tx.blank_urls(text).alias("blanked"))


@query("name_case", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'J ' || array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE 'j ' || lower(n_name) END AS name FROM nation")
def name_case(spark, d):
    said = F.concat(F.lit("J "), F.upper("n_name"))
    return table(spark, d, "nation").select("n_nationkey", tx.tidy_name(F.when(F.col("n_nationkey") % 2 == 0, said).otherwise(F.lower(said))).alias("name"))


@query("contacts", """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN '+1 (312) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone, 'linkedin.com/in/c-' || c_custkey AS linkedin, 'c' || c_custkey || '@example.com' AS email FROM customer""")
def contacts(spark, d):
    k = F.col("c_custkey")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    text = F.concat(F.lit("no 1234567 "), F.when(k % 3 > 0, F.concat(F.lit("+1 (312) 555-"), four)).otherwise(F.concat(F.lit("4111 1111 1111 "), four)), F.lit(" | https://www.linkedin.com/in/c-"), k.cast("string"), F.lit(" | c"), k.cast("string"), F.lit("@example.com"))
    return table(spark, d, "customer").select("c_custkey", tx.phone(text).alias("phone"), F.regexp_extract(text, tx.LINKEDIN, 0).alias("linkedin"), tx.email(text).alias("email"))


@query("date_style_counts", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MM/YYYY:1 Mon YYYY:2' WHEN 1 THEN 'YYYY-MM:1' WHEN 2 THEN 'MM-YYYY:1 Mon ''YY:1' ELSE '' END AS styles FROM orders")
def date_style_counts(spark, d):
    on, k = lambda form: F.date_format("o_orderdate", form), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat_ws(" and ", on("MMM yyyy"), on("MM/yyyy"), on("MMMM yyyy"))).when(k == 1, F.concat(on("yyyy-MM"), F.lit(" not "), on("yyyy-MM-dd"))).when(k == 2, F.concat_ws(" or ", on("MM-yyyy"), on("MMM ''yy"))).otherwise(on("yyyy"))
    said = F.transform(F.map_entries(tx.date_styles(text)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(said), " ").alias("styles"))


# --- whole documents ---------------------------------------------------------------------


def written(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): a document per customer; what it says follows from the customer's key."""
    k = F.col("c_custkey")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    if_ = lambda cond, *parts: F.when(cond, say(*parts))
    mark = F.format_string("%.1f", (k % 50 + 50) / 10)
    text = F.concat_ws(
        "\n", F.lit("Asha Example"), say("asha", k, "@example.com | +91 98765 43210"), F.lit("EDUCATION"), say("B.Tech in Computing, Some College, CGPA: ", mark, "/10, 2018 - 2022"), if_(k % 7 == 0, "M.Tech in Computing, 88%"),
        say("Class XII, Some School, ", k % 60 + 40, "%"), if_(k % 3 == 0, "Class X, Some School, ", k % 50 + 50, "%"), if_(k % 4 == 0, "Relevant coursework: Compilers, Networks, Graphs"),
        F.lit("EXPERIENCE"), if_(k % 2 == 0, "Software Engineering Intern - Microsoft | Jun 2023 - Aug 2023"), if_(k % 2 == 0, "- Cut latency by 30% under Prof. Rao"), F.lit("Engineer - TCS | Jan 2020 - Dec 2021"), F.lit("- Kept things going"),
        F.lit("PROJECTS"), say("Chat App: realtime chat"), F.lit("- Deployed at https://chat.example.app"), if_(k % 3 > 0, "Parser: reads tables"), if_(k % 3 > 0, "- Handles ", k % 90 + 10, " requests"),
        F.lit("ACHIEVEMENTS"), F.lit("- Took part in a state Hackathon"), if_(k % 3 == 1, "- Winner of the city Hackathon"), if_(k % 5 == 0, "- Gold medal"), if_(k % 7 == 0, "- Team captain"), if_(k % 2 == 1, "- NSS camp"),
        F.lit("CERTIFICATIONS"), F.lit("- Course of a local club"), if_(k % 6 == 0, "- AWS developer"),
        F.lit("PUBLICATIONS"), F.lit("- On tables, arXiv preprint"), if_(k % 8 == 0, "- On trees, in an IEEE conference"),
        F.lit("SKILLS"), say("Languages: Python, C++", F.when(k % 2 == 0, ", Go").otherwise("")), F.lit("Data Structures, Docker"),
        F.lit("LANGUAGES KNOWN"), say("English, Hindi", F.when(k % 3 == 0, ", French").otherwise("")),
        F.lit("CODING PROFILES"), say("LeetCode: ", k % 500 + 200, " problems solved; easy 50, LeetCode medium: 40, hard: ", k % 20 + 1), say("Codeforces rating ", k % 800 + 1200), if_(k % 2 == 0, "CodeChef ", k % 7 + 1, "★"),
        F.lit("EXAMS"), say("GATE 2024: score ", k % 600 + 300, ", AIR ", k % 9000 + 10, ", 95.5 percentile"), if_(k % 4 == 0, "Cleared UPSC mains"), if_(k % 5 == 0, "Qualified SSC CGL tier 1"),
        F.lit("PERSONAL DETAILS"), F.lit("Date of birth: 12/05/2001"), F.when(k % 3 == 0, F.lit("No active backlogs")).otherwise(say(k % 3, " backlogs")), if_(k % 2 == 0, "github.com/asha"),
    )
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("doc_id"), text.alias("text"))


def written_lines(spark: SparkSession, d: str) -> DataFrame:
    t = tx.lines(written(spark, d)).withColumns({"size": F.lit(None).cast("double"), "bold": F.lit(False), "style": F.lit("")})
    return saved(segment.sections(t))


def shown(features: DataFrame, names: list[str]) -> DataFrame:
    """(c_custkey, feature, value) as text, to compare features of all types."""
    number = F.when(F.col("num") == F.floor("num"), F.col("num").cast("long").cast("string")).otherwise(F.col("num").cast("string"))
    value = F.coalesce(number, F.col("bool").cast("string"), F.array_join("items", ","), F.col("str"))
    return features.where(F.col("feature").isin(*names)).select(F.col("doc_id").alias("c_custkey"), "feature", value.alias("value"))


def expected(features: dict[str, str]) -> str:
    """SQL for (c_custkey, feature, value) from an expression in k per feature; null where it isn't stated."""
    rows = " UNION ALL ".join(f"SELECT c_custkey, '{name}' AS feature, CAST({x} AS VARCHAR) AS value FROM c" for name, x in features.items())
    return f"WITH c AS (SELECT c_custkey, c_custkey AS k FROM customer), e AS ({rows}) SELECT * FROM e WHERE value IS NOT NULL"


SECTIONS_SQL = "WITH c AS (SELECT c_custkey FROM customer) SELECT c_custkey, 'education,experience,projects,achievements,certifications,publications,skills,languages,coding_profiles,exams,personal' AS found, '' AS nonstandard FROM c"


@query("written_sections", SECTIONS_SQL)
def written_sections(spark, d):
    m = segment.section_map(written_lines(spark, d))
    return m.select(F.col("doc_id").alias("c_custkey"), F.array_join("found", ",").alias("found"), F.array_join("nonstandard", ",").alias("nonstandard"))


def written_entries_of(lines: DataFrame) -> DataFrame:
    e = segment.entries(lines.where("not is_heading"), TODAY)
    return e.join(lines.groupBy("doc_id", "section_no").agg(F.first("section_key").alias("section_key")), ["doc_id", "section_no"])


@query("written_entries", """WITH c AS (SELECT c_custkey, c_custkey AS k FROM customer), e AS (SELECT c_custkey, 'experience' AS section, 0 AS entry_no, 'Software Engineering Intern - Microsoft | Jun 2023 - Aug 2023' AS header, 1 AS body, 3.0 AS months FROM c WHERE k % 2 = 0
UNION ALL SELECT c_custkey, 'experience', CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, 'Engineer - TCS | Jan 2020 - Dec 2021', 1, 24.0 FROM c UNION ALL SELECT c_custkey, 'projects', 0, 'Chat App: realtime chat', 1, NULL FROM c
UNION ALL SELECT c_custkey, 'projects', 1, 'Parser: reads tables', 1, NULL FROM c WHERE k % 3 > 0) SELECT c_custkey, section, CAST(entry_no AS BIGINT) AS entry_no, header, CAST(body AS INTEGER) AS body, CAST(months AS DOUBLE) AS months FROM e""")  # fmt: skip
def written_entries(spark, d):
    e = written_entries_of(written_lines(spark, d)).where("section_key in ('experience', 'projects')")
    return e.select(F.col("doc_id").alias("c_custkey"), F.col("section_key").alias("section"), F.col("entry_no").cast("long").alias("entry_no"), "header", F.size("body").alias("body"), "months")


EDUCATION = {
    "academics.ug_cgpa": "CASE WHEN k % 10 = 0 THEN CAST((k % 50 + 50) // 10 AS VARCHAR) ELSE CAST((k % 50 + 50) / 10.0 AS VARCHAR) END", "academics.pg_cgpa": "NULL", "academics.class12_pct": "k % 60 + 40", "academics.class10_pct": "CASE WHEN k % 3 = 0 THEN k % 50 + 50 END",
    "education.has_bachelor": "true", "education.has_master": "k % 7 = 0", "academics.coursework": "CASE WHEN k % 4 = 0 THEN 'Compilers,Networks,Graphs' END",
}


@query("written_education", expected(EDUCATION))
def written_education(spark, d):
    lines = written_lines(spark, d)
    return shown(extract.education(lines).unionByName(extract.coursework(lines)), list(EDUCATION))


ENTRIES = {
    "experience.internship_count": "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "experience.product_company_count": "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "experience.core_company_count": "0", "experience.internship_months": "CASE WHEN k % 2 = 0 THEN 3 END",
    "experience.fulltime_months": "24", "projects.count": "CASE WHEN k % 3 > 0 THEN 2 ELSE 1 END", "projects.quantified_count": "CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END", "projects.deployed_count": "1",
}
DEEDS = {
    "achievements.hackathon_participations": "CASE WHEN k % 3 = 1 THEN 2 ELSE 1 END", "achievements.hackathon_wins": "CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END", "achievements.awards_count": "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END",
    "achievements.leadership_count": "CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END", "achievements.service_count": "CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END", "certifications.count": "CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END",
    "certifications.recognized_count": "CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END", "publications.count": "CASE WHEN k % 8 = 0 THEN 2 ELSE 1 END", "publications.peer_reviewed_count": "CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END",
}


def entry_features(spark, d) -> DataFrame:
    return extract.entry_features(saved(written_entries_of(written_lines(spark, d))), fixed.PRODUCT, fixed.CORE, fixed.ISSUERS)


@query("written_experience", expected(ENTRIES))
def written_experience(spark, d):
    return shown(entry_features(spark, d), list(ENTRIES))


@query("written_achievements", expected(DEEDS))
def written_achievements(spark, d):
    return shown(entry_features(spark, d), list(DEEDS))


CODING = {
    "coding.leetcode.total": "k % 500 + 200", "coding.leetcode.medium": "40", "coding.codeforces.rating": "k % 800 + 1200",
    "coding.codechef.rating": "CASE WHEN k % 2 = 0 THEN [1000, 1400, 1600, 1800, 2000, 2200, 2500][k % 7 + 1] END",
}
EXAMS = {
    "exam.gate.score": "k % 600 + 300", "exam.gate.air": "k % 9000 + 10", "exam.gate.percentile": "95.5", "exam.gate.year": "2024",
    "exam.upsc.stage": "CASE WHEN k % 4 = 0 THEN 2 END", "exam.ssc_bank.stage": "CASE WHEN k % 5 = 0 THEN 1 END",
}


@query("written_coding", expected(CODING))
def written_coding(spark, d):
    return shown(extract.coding(written_lines(spark, d)), list(CODING))


@query("written_exams", expected(EXAMS))
def written_exams(spark, d):
    lines = written_lines(spark, d)
    return shown(extract.gate_exam(lines).unionByName(extract.exam_stages(lines)), list(EXAMS))


SAID = {
    "languages.spoken": "CASE WHEN k % 3 = 0 THEN 'English,Hindi,French' ELSE 'English,Hindi' END", "candidate.date_of_birth": "'2001-05-12'", "academics.active_backlogs": "k % 3", "contact.github": "k % 2 = 0", "contact.linkedin": "false",
    "research.faculty_guided": "k % 2 = 0",
}


@query("written_personal", expected(SAID))
def written_personal(spark, d):
    lines = written_lines(spark, d)
    return shown(extract.spoken(lines).unionByName(extract.personal(lines)).unionByName(extract.faculty(lines)), list(SAID))


SKILLED = {
    "skills.list": "CASE WHEN k % 2 = 0 THEN 'Python,C++,Go,Data Structures,Docker' ELSE 'Python,C++,Data Structures,Docker' END", "skills.languages": "CASE WHEN k % 2 = 0 THEN 'Python,C++,Go' ELSE 'Python,C++' END",
    "skills.cs_fundamentals": "'Data Structures,Algorithms'",
}


@query("written_skills", expected(SKILLED))
def written_skills(spark, d):
    lex = lexicons.lexicon(spark)
    lines = written_lines(spark, d).where("section_key = 'skills' and not is_heading").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return shown(extract.skills(match.mentions(lines, lex.drop("category"), ["doc_id"]), lex), list(SKILLED))


MADE = {
    "candidate.age": "25", "coding.leetcode.medium_hard_share": "CASE WHEN k % 20 < 10 THEN 'some' ELSE 'more' END", "academics.ug_pct_est": "CAST(round_even((k % 50 + 50) / 10.0 * 9.5, 1) AS VARCHAR)",
    "experience.total_months": "CASE WHEN k % 2 = 0 THEN 27 ELSE 24 END", "exam.gate.years_since": "2", "languages.spoken_count": "CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END", "academics.coursework_count": "CASE WHEN k % 4 = 0 THEN 3 END",
}


@query("written_derived", "WITH c AS (SELECT c_custkey, c_custkey AS k FROM customer) SELECT c_custkey, 25.0::DOUBLE AS age, round_even(least(1.0, (40 + k % 20 + 1) / (k % 500 + 200)), 4) AS share, round_even((k % 50 + 50) / 10.0 * 9.5, 1) AS pct, CASE WHEN k % 2 = 0 THEN 27.0::DOUBLE ELSE 24.0 END AS months, 2.0::DOUBLE AS years, CASE WHEN k % 3 = 0 THEN 3.0::DOUBLE ELSE 2.0 END AS spoken, CASE WHEN k % 4 = 0 THEN 3.0::DOUBLE END AS courses FROM c")
def written_derived(spark, d):
    from scoreloom.functions.numbers import rounded

    lines = written_lines(spark, d)
    parts = [extract.education(lines), extract.coursework(lines), extract.coding(lines), extract.gate_exam(lines), extract.spoken(lines), extract.personal(lines), extract.entry_features(saved(written_entries_of(lines)), fixed.PRODUCT, fixed.CORE, fixed.ISSUERS)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    f = extract.derived_features(saved(every), TODAY)
    of = lambda name: F.max(F.when(F.col("feature") == name, F.col("num")))
    return f.groupBy(F.col("doc_id").alias("c_custkey")).agg(
        of("candidate.age").alias("age"), rounded(of("coding.leetcode.medium_hard_share"), 4).alias("share"), of("academics.ug_pct_est").alias("pct"), of("experience.total_months").alias("months"), of("exam.gate.years_since").alias("years"),
        of("languages.spoken_count").alias("spoken"), of("academics.coursework_count").alias("courses"),
    )


@query("written_names", "SELECT c_custkey, 'Asha Example' AS name FROM customer")
def written_names(spark, d):
    return extract.candidate_name(written_lines(spark, d)).select(F.col("doc_id").alias("c_custkey"), "name")


@query("written_label_accuracy", """WITH c AS (SELECT c_custkey AS k FROM customer) SELECT CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS tier, 3 * count(*) AS fields, CAST(sum(2 + CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS "right" FROM c GROUP BY ROLLUP (tier)""")
def written_label_accuracy(spark, d):
    """Labels that are right but for every fifth document's projects, against the extracted features."""
    names = ["projects.count", "projects.deployed_count", "experience.internship_count"]
    k = F.col("c_custkey")
    values = F.array(
        F.struct(F.lit(names[0]).alias("feature"), (F.when(k % 3 > 0, 2.0).otherwise(1.0) + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("num")), F.struct(F.lit(names[1]).alias("feature"), F.lit(1.0).alias("num")),
        F.struct(F.lit(names[2]).alias("feature"), F.when(k % 2 == 0, 1.0).otherwise(0.0).alias("num")),
    )
    empty = {"bool": F.lit(None).cast("boolean"), "items": F.lit(None).cast("array<string>")}
    labels = table(spark, d, "customer").select(k.alias("doc_id"), F.when(k % 2 == 0, "even").otherwise("odd").alias("tier"), F.explode(values).alias("v")).select("doc_id", "tier", "v.*").withColumns(empty)
    kinds = spark.createDataFrame([(n, "int") for n in names], "feature string, kind string")
    features = entry_features(spark, d).where(F.col("feature").isin(*names))
    return evaluate.accuracy(labels, features, kinds, "tier").select("tier", "fields", "right")


# --- layout ------------------------------------------------------------------------------


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    """Line items as lines of a page: an order is a block of a page of a thousand orders, its quantity says how far a line reaches."""
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).alias("page"), F.col("l_orderkey").alias("block"), (k * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 100 + q).cast("long").alias("line_no"), F.element_at(F.array(F.lit("body"), F.lit("table"), F.lit("header")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("zone"),
        F.concat(F.when(q % 7 == 0, "• ").otherwise(""), F.lit("w"), q.cast("int").cast("string"), F.when(k % 3 == 0, ".").otherwise("")).alias("text"), F.when(q % 5 == 0, 40.0).otherwise(50.0).alias("x0"), (k * 12.0 + F.when(q % 11 == 0, 30.0).otherwise(0.0)).alias("top"),
        F.when(q > 20, 540.0 + q / 10).otherwise(300.0).alias("x1"), (k * 12.0 + 10.0 + F.when(q % 11 == 0, 30.0).otherwise(0.0)).alias("bottom"), F.lit(10.0).alias("size"), (F.col("l_partkey") % 4 == 0).alias("bold"),
    )


LAID = """g AS (SELECT l_orderkey // 1000 AS page, l_orderkey AS block, l_linenumber AS k, CAST(l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey * 100 + l_quantity AS BIGINT) AS line_no, CAST(l_quantity AS INTEGER) AS q, l_suppkey % 3 AS z, l_partkey % 4 = 0 AS bold,
  CASE WHEN q % 7 = 0 THEN '• ' ELSE '' END || 'w' || q || CASE WHEN k % 3 = 0 THEN '.' ELSE '' END AS text, CASE WHEN q % 5 = 0 THEN 40.0 ELSE 50.0 END AS x0, k * 12.0 + CASE WHEN q % 11 = 0 THEN 30.0 ELSE 0.0 END AS top, CASE WHEN q > 20 THEN 540.0 + q / 10.0 ELSE 300.0 END AS x1 FROM lineitem)"""


@query("zone_filter", f"WITH {LAID} SELECT block, line_no FROM g WHERE z < 2")
def zone_filter(spark, d):
    return layout.read_by_parsers(laid_out(spark, d)).select("block", "line_no")


@query("wrapped_lines", f"""WITH {LAID}, b AS (SELECT *, lag(top + 10) OVER w AS under, lag(x1) OVER w AS px1, lag(x0) OVER w AS px0, lag(text) OVER w AS ptext, lag(bold) OVER w AS pbold, max(x1) OVER (PARTITION BY page, block) AS edge FROM g WINDOW w AS (PARTITION BY page, block ORDER BY line_no)),
s AS (SELECT page, gap, row_number() OVER (PARTITION BY page ORDER BY gap) AS r, count(*) OVER (PARTITION BY page) AS n FROM (SELECT page, round(top - under, 1) AS gap FROM b WHERE top - under BETWEEN -2 AND 40)), l AS (SELECT page, gap AS lead_gap FROM s WHERE r = greatest(1, floor(n * 0.1))),
c AS (SELECT b.*, coalesce(px1 >= edge - 12 AND top - under <= coalesce(lead_gap, 0) * 1.4 + 0.6 AND x0 >= px0 - 1 AND bold = pbold AND q % 7 <> 0 AND NOT ends_with(ptext, '.'), false) AS on_ FROM b LEFT JOIN l USING (page)),
f AS (SELECT *, sum((NOT on_)::INT) OVER (PARTITION BY page, block ORDER BY line_no) AS first FROM c) SELECT page, block, min(line_no) AS line_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM f GROUP BY page, block, first""")  # fmt: skip
def wrapped_lines(spark, d):
    return layout.rejoined(laid_out(spark, d), ["page"], ["block"], "line_no").select("page", "block", "line_no", "text")


# --- requirements and reports ------------------------------------------------------------


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    """(jd_id, text): a description per part."""
    k = F.col("p_partkey")
    text = F.concat_ws(
        "\n", F.lit("Backend Engineer"), F.lit("About us"), F.lit("We build things for many people"), F.lit("Requirements:"), F.lit("- Write services in Python and Scala"), F.concat(F.lit("- Know "), F.when(k % 2 == 0, "Docker and Kubernetes").otherwise("PostgreSQL and Redis"), F.lit(" in depth")),
        F.when(k % 3 == 0, F.lit("- Short one")), F.lit("- We are looking for people who like to work"), F.lit("Nice to have"), F.lit("* Has seen Apache Kafka at work"), F.when(k % 5 == 0, F.lit("* Some years with Python behind them")),
    )
    return table(spark, d, "part").select(k.alias("jd_id"), text.alias("text"))


@query("requirement_lines", """WITH p AS (SELECT p_partkey AS k FROM part), r AS (SELECT k AS jd_id, 1 AS req_no, 'Write services in Python and Scala' AS requirement, 'required' AS importance FROM p
UNION ALL SELECT k, 2, 'Know ' || CASE WHEN k % 2 = 0 THEN 'Docker and Kubernetes' ELSE 'PostgreSQL and Redis' END || ' in depth', 'required' FROM p UNION ALL SELECT k, 3, 'Has seen Apache Kafka at work', 'preferred' FROM p
UNION ALL SELECT k, 4, 'Some years with Python behind them', 'preferred' FROM p WHERE k % 5 = 0) SELECT * FROM r""")  # fmt: skip
def requirement_lines(spark, d):
    return match.requirements(descriptions(spark, d))


@query("wanted_keywords", """WITH p AS (SELECT p_partkey AS k FROM part), r AS (SELECT k AS jd_id, unnest(['Python', 'Scala']) AS skill, 'required' AS importance FROM p UNION ALL SELECT k, unnest(['Docker', 'Kubernetes']), 'required' FROM p WHERE k % 2 = 0
UNION ALL SELECT k, unnest(['PostgreSQL', 'Redis']), 'required' FROM p WHERE k % 2 = 1 UNION ALL SELECT k, 'Kafka', 'preferred' FROM p) SELECT jd_id, skill, importance, CASE skill WHEN 'Kafka' THEN 'Apache Kafka' ELSE skill END AS terms FROM r""")  # fmt: skip
def wanted_keywords(spark, d):
    w = match.wanted_skills(descriptions(spark, d), lexicons.lexicon(spark).drop("category"))
    return w.select("jd_id", "skill", "importance", F.array_join("terms", ",").alias("terms"))


@query("keyword_statuses", """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'variant' ELSE 'exact' END AS status, CASE k % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.85 ELSE 1.0 END AS credit FROM o""")
def keyword_statuses(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    wanted = o.select("o_orderkey", F.lit("Kafka").alias("skill"), F.lit("required").alias("importance"), F.array(F.lit("Apache-Kafka")).alias("terms"))
    present = o.where(k % 4 > 0).select("o_orderkey", F.lit("Kafka").alias("skill"), F.array(F.when(k % 4 == 1, "Kafka").otherwise("apache kafka")).alias("terms"), (k % 4 == 3).alias("in_context"))
    return match.coverage(wanted, present, ["o_orderkey"]).select("o_orderkey", "status", F.col("credit").cast("double").alias("credit"))


@query("requirement_scores", """WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 40 + 45) / 100.0 AS sim, o_orderkey % 3 AS wanted, least(o_orderkey % 2, o_orderkey % 3) AS missing FROM orders), c AS (SELECT *, greatest(0.0, least(1.0, (sim - 0.5) / (0.72 - 0.5))) AS cal FROM o),
s AS (SELECT *, round_even(CASE WHEN wanted > 0 THEN 0.5 * cal + 0.5 * (wanted - missing) / wanted ELSE cal END, 3) AS score, CASE WHEN k % 4 = 0 THEN 'preferred' ELSE 'required' END AS importance FROM c)
SELECT k AS o_orderkey, score, CASE WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.3 THEN 'partial' ELSE 'missing' END AS status, CAST(row_number() OVER (PARTITION BY k // 50 ORDER BY CASE importance WHEN 'required' THEN 0 ELSE 1 END, score, k) AS INTEGER) AS rank FROM s""")  # fmt: skip
def requirement_scores(spark, d):
    from scoreloom.functions.numbers import rounded

    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.floor(k / 50).alias("g"), ((k % 40 + 45) / 100).alias("sim"), (k % 3).alias("wanted"), F.least(k % 2, k % 3).alias("missing"), F.when(k % 4 == 0, "preferred").otherwise("required").alias("importance"))
    o = o.withColumn("score", rounded(match.requirement_score(F.col("sim"), F.col("wanted"), F.col("missing")), 3)).withColumn("status", match.fit_status(F.col("score")))
    return match.ranked_matches(o, ["g"], "o_orderkey").select("o_orderkey", "score", "status", "rank")


@query("order_similarity_rotated", "WITH p AS (SELECT p_partkey, p_size + 20 AS n, p_partkey % 15 AS k FROM part) SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN k = 0 THEN 1.0 ELSE round_even(greatest(k, n - k) / n, 3) END AS similarity FROM p")
def order_similarity_rotated(spark, d):
    """Texts of which the second begins with word k of the first and ends with what stood before; below 20 words there is no value."""
    k, n = (F.col("p_partkey") % 15).cast("int"), F.when(F.col("p_partkey") % 11 == 0, 19).otherwise(F.col("p_size") + 20).cast("int")
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("word"), i.cast("string")))
    t = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", words.alias("w"), k.alias("k"))
    t = t.select("p_partkey", F.array_join("w", " ").alias("a"), F.array_join(F.concat(F.slice("w", F.col("k") + 1, F.size("w")), F.slice("w", F.lit(1), F.col("k"))), " ").alias("b"))
    return match.order_similarity(t, "a", "b", most=None).select("p_partkey", "similarity")


RESULTS = "r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey * 7 % 100)::DOUBLE END AS overall, (c_custkey * 13 % 100)::DOUBLE AS strength, (c_custkey % 100)::DOUBLE AS ats, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey * 3 % 100)::DOUBLE END AS fit, c_custkey % 10 = 0 AS fatal, c_custkey % 100 / 100.0 AS confidence FROM customer)"


def results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    of = lambda n: F.when(k % 3 > 0, (k * n % 100).cast("double"))
    return table(spark, d, "customer").select("c_custkey", of(7).alias("overall"), (k * 13 % 100).cast("double").alias("strength"), (k % 100).cast("double").alias("ats"), of(3).alias("fit"), (k % 10 == 0).alias("fatal"), (k % 100 / 100).alias("confidence"))


BANDED = "CASE WHEN value >= 85 THEN 'Excellent' WHEN value >= 70 THEN 'Strong' WHEN value >= 55 THEN 'Fair' WHEN value >= 35 THEN 'Weak' ELSE 'Very weak' END"


@query("score_cards", f"""WITH {RESULTS}, c AS (SELECT c_custkey, fatal, 0 AS o, 'overall' AS card, overall AS value FROM r UNION ALL SELECT c_custkey, fatal, 1, 'strength', strength FROM r UNION ALL SELECT c_custkey, fatal, 2, 'ats', ats FROM r UNION ALL SELECT c_custkey, fatal, 3, 'fit', fit FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o) - 1 AS place, count(*) OVER (PARTITION BY c_custkey) AS n FROM c WHERE value IS NOT NULL) SELECT c_custkey, CAST(place AS INTEGER) AS place, card, value, {BANDED} AS band, CASE WHEN fatal AND place = n - 1 THEN 'no text could be read, so only the file was checked' ELSE '' END AS note FROM n""")  # fmt: skip
def score_cards(spark, d):
    return report.cards(results(spark, d), "c_custkey")


@query("low_confidence", f"WITH {RESULTS} SELECT c_custkey, confidence < 0.25 AS low FROM r")
def low_confidence(spark, d):
    return results(spark, d).select("c_custkey", report.low_confidence(F.col("confidence")).alias("low"))


@query("facts_table", """WITH c AS (SELECT c_custkey, c_custkey AS k FROM customer), f AS (SELECT c_custkey, 0 AS place, 'academics.coursework' AS feature, CASE WHEN k % 2 = 0 THEN 'Compilers, Networks' ELSE 'none' END AS value FROM c UNION ALL SELECT c_custkey, 1, 'academics.ug_cgpa', CASE WHEN k % 10 = 0 THEN CAST(k // 10 % 10 AS VARCHAR) ELSE CAST(k % 100 / 10.0 AS VARCHAR) END FROM c
UNION ALL SELECT c_custkey, 2, 'candidate.date_of_birth', '2001-05-12' FROM c UNION ALL SELECT c_custkey, 3, 'education.has_master', CASE WHEN k % 3 = 0 THEN 'True' ELSE 'False' END FROM c) SELECT * FROM f""")  # fmt: skip
def facts_table(spark, d):
    k, none = F.col("c_custkey"), lambda t: F.lit(None).cast(t)
    row = lambda name, num=None, flag=None, items=None, said=None: F.struct(F.lit(name).alias("feature"), (none("double") if num is None else num.cast("double")).alias("num"), (none("boolean") if flag is None else flag).alias("bool"), (none("array<string>") if items is None else items).alias("items"), (none("string") if said is None else said).alias("str"), none("string").alias("evidence"))
    both = F.array(F.lit("Compilers"), F.lit("Networks"))
    rows = F.array(row("education.has_master", flag=k % 3 == 0), row("academics.ug_cgpa", num=k % 100 / 10), row("skills.list", items=both), row("candidate.date_of_birth", said=F.lit("2001-05-12")), row("academics.coursework", items=F.when(k % 2 == 0, both).otherwise(F.array().cast("array<string>"))))
    f = table(spark, d, "customer").select(k.alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")
    return report.facts(f).select(F.col("doc_id").alias("c_custkey"), "place", "feature", "value")


MENTIONED = [
    ("Data Structures and Algorithms, C++ and Python 3", "Data Structures@0,C++@32,Python@40"), ("Languages: C, Go", "C@11,Go@14"), ("I go to C level", ""), ("used React and react", "React@5"), ("see https://python.example/x", ""),
    ("Docker/Kubernetes (K8s)", "Docker@0,Kubernetes@7,Kubernetes@19"), ("ASP.NET Core on .NET", "ASP.NET@0,.NET@17"), ("sql and SQL", "SQL@8"),
]


@query("mention_spans", "SELECT o_orderkey, nullif(s, '') AS mentions FROM (" + picked_sql(MENTIONED, "s") + ")")
def mention_spans(spark, d):
    t, text = picked(spark, d, MENTIONED)
    m = match.mentions(t.select("o_orderkey", text.alias("text")), lexicons.lexicon(spark).drop("category"), ["o_orderkey"])
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "skill"))), lambda x: F.concat(x["skill"], F.lit("@"), x["start"].cast("string"))), ",")
    return t.join(m.groupBy("o_orderkey").agg(said.alias("mentions")), "o_orderkey", "left")


@query("body_sizes", """WITH l AS (SELECT l_orderkey, 9 + l_suppkey % 3 AS size, greatest(1, CAST(l_quantity AS INTEGER) // 10) AS w, l_linenumber * 1000000 + l_partkey AS line_no FROM lineitem WHERE l_suppkey % 4 > 0), s AS (SELECT l_orderkey, size, sum(w) AS w, min(line_no) AS f FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, f) AS r FROM s) SELECT l_orderkey, CAST(size AS DOUBLE) AS body FROM r WHERE r = 1""")  # fmt: skip
def body_sizes(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("line_no"), F.repeat(F.lit("x"), F.rint("l_quantity").cast("int")).alias("text"),
        F.when(F.col("l_suppkey") % 4 > 0, (9 + F.col("l_suppkey") % 3).cast("double")).alias("size"),
    )
    return segment.body_size(lines).select(F.col("doc_id").alias("l_orderkey"), "body")


STYLED = [("Asha Example", 18.0, True), ("Education", 14.0, True), ("B.Tech in Computing", 10.0, False), ("My Journey", 14.0, True), ("walked far and wide", 10.0, False), ("Projects", 10.0, False), ("Skills", 14.0, True), ("python and sql", 10.0, False)]


@query("styled_sections", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'preamble:1,education:2,My Journey:3,skills:2' ELSE 'preamble:1,education:3,projects:1,skills:2' END AS sections FROM customer")
def styled_sections(spark, d):
    """Headings in a style of their own: for even keys an unknown one counts as a heading and a known word in the body's style doesn't; without styles exact names count."""
    plain = (F.col("c_custkey") % 2 == 1)
    rows = F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(t).alias("text"), F.when(~plain, z).alias("size"), (F.lit(b) & ~plain).alias("bold"), F.lit("").alias("style")) for k, (t, z, b) in enumerate(STYLED)])
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), plain.alias("plain"), F.explode(rows).alias("r")).select("doc_id", "plain", "r.*").where(~(F.col("plain") & (F.col("text") == "My Journey"))).drop("plain")
    s = segment.sections(lines).groupBy("doc_id", "section_no").agg(F.max(F.coalesce("section_key", "heading")).alias("k"), F.count(F.lit(1)).alias("n"))
    return s.groupBy(F.col("doc_id").alias("c_custkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "k", "n"))), lambda x: F.concat(x["k"], F.lit(":"), x["n"].cast("string"))), ",").alias("sections"))


@query("suggestion_texts", business.suggestion_texts_sql())
def suggestion_texts(spark, d):
    return business.advice(spark, d).where("signal = 'balance'").select("c_custkey", "text")


# --- generator ---------------------------------------------------------------------------


@query("draft_lines", """WITH p AS (SELECT p_partkey AS k, p_name FROM part) SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN 'Dev | Works' WHEN 1 THEN 'Dev' ELSE 'Works' END AS line, CASE k % 4 WHEN 0 THEN '2020 - 2022' WHEN 1 THEN '2020' WHEN 2 THEN '2022' ELSE '' END AS period,
CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS items, 'Asha_Rao_Resume' || CASE WHEN k % 2 = 0 THEN '_SDE' ELSE '' END || '.pdf' AS filename, CAST(ceil((4 + k % 100) / 46) AS BIGINT) AS pages, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 18 ELSE 19 END AS place FROM p""")  # fmt: skip
def draft_lines(spark, d):
    k = F.col("p_partkey")
    or_ = lambda cond, text: F.when(cond, text).otherwise(" ")
    name = F.element_at(F.array(F.lit("summary"), F.lit("education"), F.lit("declaration"), F.lit("else")), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", generate.joined(" | ", or_(k % 3 < 2, " Dev "), or_(k % 3 != 1, "Works")).alias("line"), generate.period(or_(k % 4 < 2, "2020"), or_((k % 4 == 0) | (k % 4 == 2), "2022")).alias("period"),
        F.size(generate.compact(F.array(F.lit("a "), F.lit(" "), F.lit(None).cast("string"), or_(k % 2 == 0, "b")))).alias("items"), generate.filename(F.lit(" Asha  Rao "), or_(k % 2 == 0, "SDE")).alias("filename"),
        generate.pages(k % 100).cast("long").alias("pages"), generate.fallback_place(name).cast("int").alias("place"),
    )


@query("form_fields", "SELECT o_orderkey, 'role' AS prefix, CAST(n AS INTEGER) AS n, CASE WHEN (o_orderkey + n) % 3 = 0 THEN 'title=Dev' ELSE 'end=2020,title=Dev' END AS fields FROM orders, range(2) AS r(n)")
def form_fields(spark, d):
    k = F.col("o_orderkey")
    fields = [F.struct(F.lit(f"role__{n}__{name}").alias("field"), value.alias("value")) for n in range(2) for name, value in (("title", F.lit(" Dev ")), ("end", F.when((k + n) % 3 > 0, "2020").otherwise(" ")))]
    t = table(spark, d, "orders").select(k, F.explode(F.array(*fields, F.struct(F.lit("name").alias("field"), F.lit("x").alias("value")))).alias("f")).select("o_orderkey", "f.*")
    said = F.array_join(F.array_sort(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return generate.form_rows(t, "o_orderkey", "field", "value").select("o_orderkey", "prefix", "n", said.alias("fields"))


# --- reading order --------------------------------------------------------------------------


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A page per part: its line items as word boxes, set in one, two or three columns, or under two lines across the page. Only places say which."""
    item = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
    t = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    t = t.withColumns({"i": F.row_number().over(item) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("l_partkey"))})
    kind = F.when(F.col("n") < 12, 0).otherwise(F.col("l_partkey") % 4)
    t = t.withColumn("kind", kind).withColumn("head", F.when(F.col("kind") == 2, 2).otherwise(0)).withColumn("columns", F.greatest(F.lit(1), F.when(F.col("kind") == 2, 2).otherwise(F.col("kind")) + (F.col("kind") == 1).cast("int")))
    t = t.withColumn("deep", F.ceil((F.col("n") - F.col("head")) / F.col("columns")).cast("int"))
    above, body = F.col("i") < F.col("head"), F.col("i") - F.col("head")
    t = t.withColumns({"at": F.when(above, F.col("i")).otherwise(F.col("head") + body % F.col("deep")), "c": F.when(above, 0).otherwise(F.floor(body / F.col("deep")))})
    said = F.array(F.concat(F.lit("o"), F.col("l_orderkey")), F.concat(F.lit("n"), F.col("l_linenumber")), F.concat(F.lit("s"), F.col("l_suppkey")))
    t = t.select("*", above.alias("above"), F.posexplode(said).alias("j", "text"))
    wide = F.when(F.col("above"), 165.0).when(F.col("columns") == 3, 40.0).otherwise(50.0)
    x0 = 50.0 + F.col("c") * F.when(F.col("columns") == 3, 180.0).otherwise(260.0) + F.col("j") * (wide + F.when(F.col("above"), 5.0).otherwise(10.0))
    top = 40.0 + 12 * F.col("at") + 14 * F.floor(F.col("at") / 5) + F.col("j") % 2
    return t.select("l_partkey", "text", x0.alias("x0"), (x0 + wide).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


BOXES = """b AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
k AS (SELECT *, CASE WHEN n < 12 THEN 0 ELSE l_partkey % 4 END AS kind FROM b), h AS (SELECT *, CASE WHEN kind = 2 THEN 2 ELSE 0 END AS head, CASE kind WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS columns FROM k),
p AS (SELECT *, CASE WHEN i < head THEN i ELSE head + (i - head) % CAST(ceil((n - head) / columns) AS BIGINT) END AS line, CASE WHEN i < head THEN 0 ELSE (i - head) // CAST(ceil((n - head) / columns) AS BIGINT) END AS c, i >= head AS band,
  'o' || l_orderkey || ' n' || l_linenumber || ' s' || l_suppkey AS said FROM h)"""


@query("reading_order", f"""WITH {BOXES}, r AS (SELECT l_partkey, line, string_agg(said, ' ' ORDER BY c) AS said FROM p GROUP BY 1, 2),
x AS (SELECT l_partkey, md5(string_agg(said, chr(10) ORDER BY band, c, line)) AS read, any_value(columns) AS columns, count(DISTINCT CASE WHEN band THEN 1000 * c + 500 + line // 5 ELSE line // 5 END) AS blocks FROM p GROUP BY 1),
y AS (SELECT l_partkey, md5(string_agg(said, chr(10) ORDER BY line)) AS naive FROM r GROUP BY 1)
SELECT l_partkey, naive, read, CAST(columns AS BIGINT) AS columns, blocks FROM x JOIN y USING (l_partkey)""")  # fmt: skip
def reading_order(spark, d):
    t = reading.two_readings(saved(boxes(spark, d), ["l_partkey"]), ["l_partkey"])
    return t.select("l_partkey", F.md5(F.col("naive").cast("binary")).alias("naive"), F.md5(F.col("read").cast("binary")).alias("read"), F.col("columns").cast("long").alias("columns"), "blocks")


# --- drafts, inputs, vectors of distinct texts ----------------------------------------------


def draft_rules(order: list[str]) -> rules.Category:
    return rules.category_of({
        "id": "drafts", "label": "Order", "subscores": {"a": {"weight": 1}}, "signals": [{"id": "b", "subscore": "a", "feature": "customer.balance", "rule": {"type": "bands", "points": [[0, 0], [1, 1]]}}],
        "ats": {"sections": ["education", "internships", "skills"], "max_pages": 1}, "generator": {"order": order},
    })


def order_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as drafts: urgent orders are roles, the others projects, their line items bullets; a returned item states a result."""
    said = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("cut returns by "), F.col("l_linenumber").cast("string"), F.lit("%"))).otherwise("sent things")
    items = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.collect_list(said).alias("bullets"))
    none, text = F.array().cast("array<string>"), lambda c: F.col(c).cast("string")
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("bullets", F.coalesce("bullets", none)).withColumn("role", F.col("o_orderpriority").startswith("1"))
    blank = F.lit("").alias
    one = F.struct(F.concat(F.lit("o"), text("o_orderkey")).alias("title"), blank("organisation"), blank("location"), F.date_format("o_orderdate", "MM/yyyy").alias("start"), blank("end"), "bullets", blank("stack"), blank("link"))
    kept = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, one)))
    o = o.groupBy("o_custkey").agg(kept(True).alias("roles"), kept(False).alias("projects"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    some = lambda cond, value: F.when(cond, F.array(value)).otherwise(none)
    contact = F.struct(F.lit("n").alias("name"), F.when(k % 4 > 0, "a@b.c").alias("email"), F.lit("1").alias("phone"), *[F.lit("").alias(x) for x in ("location", "linkedin", "github", "portfolio")])
    return c.select(
        k.alias("doc_id"), contact.alias("contact"), F.when(k % 3 == 0, "about").alias("summary"), F.col("roles").alias("experience"), "projects",
        some(k % 5 == 0, F.lit("GATE 2026")).alias("exams"), some(k % 2 == 0, F.lit("Tamil")).alias("languages"), F.when(k % 7 > 0, F.array(F.struct(F.lit("L").alias("label"), F.array(F.lit("C")).alias("items")))).alias("skills"),
    )


NESTED = """b AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS result FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
o AS (SELECT o_custkey, o_orderkey, coalesce(n, 0) AS n, coalesce(result, false) AS result, o_orderpriority LIKE '1%' AS role FROM orders LEFT JOIN b ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, count(*) FILTER (role) AS roles, count(*) FILTER (NOT role) AS projects, coalesce(sum(1 + n) FILTER (role), 0) AS rl, coalesce(sum(1 + n) FILTER (NOT role), 0) AS pl,
  count(*) FILTER (role AND n = 0) AS silent, count(*) FILTER (role AND n > 0 AND NOT result) AS vague, count(*) FILTER (NOT role AND n > 0 AND NOT result) AS flat,
  string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey) FILTER (NOT role AND n > 0 AND NOT result) AS named FROM o GROUP BY 1),
c AS (SELECT c_custkey AS doc_id, coalesce(roles, 0) AS roles, coalesce(projects, 0) AS projects, coalesce(rl, 0) AS rl, coalesce(pl, 0) AS pl, coalesce(silent, 0) AS silent, coalesce(vague, 0) AS vague, coalesce(flat, 0) AS flat, coalesce(named, '') AS named FROM customer LEFT JOIN g ON o_custkey = c_custkey),
s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN ['summary'] ELSE [] END || CASE WHEN projects > 0 THEN ['projects'] ELSE [] END || CASE WHEN doc_id % 5 = 0 THEN ['exams'] ELSE [] END || CASE WHEN roles > 0 THEN ['experience'] ELSE [] END
  || CASE WHEN doc_id % 7 > 0 THEN ['skills'] ELSE [] END || CASE WHEN doc_id % 2 = 0 THEN ['languages'] ELSE [] END AS keys, CAST(greatest(1, ceil((4 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN projects > 0 THEN 1 + pl ELSE 0 END
  + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN roles > 0 THEN 1 + rl ELSE 0 END + CASE WHEN doc_id % 7 > 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END) / 46.0)) AS INTEGER) AS pages FROM c)"""


@query("nested_layout", f"""WITH {NESTED} SELECT doc_id, array_to_string(keys, ',') AS sections, pages, CAST(1 + CASE WHEN roles > 0 THEN 0 ELSE 1 END + CASE WHEN doc_id % 7 > 0 THEN 0 ELSE 1 END AS BIGINT) AS absent, doc_id % 4 = 0 AS contact, silent, vague, flat, named, pages > 1 AS long FROM s""")
def nested_layout(spark, d):
    """Order and all kinds of warning of nested drafts; of projects without a result also their names, in the order of the draft."""
    t = drafts.layouts(order_drafts(spark, d), draft_rules(["header", "projects", "gate_scorecard", "experience"]))
    of = lambda pattern: F.filter("warnings", lambda w: w.rlike(pattern))
    n = lambda pattern: F.size(of(pattern)).cast("long")
    named = F.array_join(F.transform(of("because it exists"), lambda w: F.regexp_extract(w, "'(.*?)'", 1)), ",")
    return t.select("doc_id", F.array_join(F.transform("sections", lambda s: s["key"]), ",").alias("sections"), "pages", n("^No .* section").alias("absent"), (n("^Add both") == 1).alias("contact"), n("no bullet points").alias("silent"), n("you can defend").alias("vague"), n("because it exists").alias("flat"), named.alias("named"), (n("^The draft is about") == 1).alias("long"))


INPUT_RULES = {
    "id": "typed", "subscores": {"a": {"weight": 1}}, "signals": [{"id": "b", "subscore": "a", "feature": "customer.balance", "rule": {"type": "bands", "points": [[0, 0], [1, 1]]}}],
    "inputs": [
        {"id": "funds", "type": "number", "feature": "customer.balance"}, {"id": "orders", "type": "number", "feature": "customer.orders"}, {"id": "urgent", "type": "bool"}, {"id": "since", "type": "date"}, {"id": "state", "type": "choice", "options": ["F", "O"]},
    ],
}


@query("inputs_typed", """WITH t AS (SELECT o_orderkey AS k, o_orderkey % 4 AS a, o_orderkey % 5 AS b, o_orderkey % 6 AS c, o_orderkey % 7 AS e, o_orderstatus AS s, o_totalprice AS p, o_custkey AS u, CAST(o_orderdate AS DATE) AS day FROM orders),
v AS (SELECT k, CASE WHEN a < 2 THEN CAST(floor(p + 0.5) AS DOUBLE) END AS funds, a = 2 AS bad_funds, CASE WHEN b < 3 THEN u END AS orders, b = 3 AS bad_orders, CASE WHEN c < 2 THEN true WHEN c < 4 THEN false END AS urgent, c = 4 AS bad_urgent,
  CASE WHEN e < 3 THEN CAST(day AS VARCHAR) END AS since, e IN (3, 4) AS bad_since, CASE WHEN s IN ('F', 'O') THEN s END AS state, s NOT IN ('F', 'O') AS bad_state FROM t)
SELECT k AS o_orderkey, funds, orders, urgent, since, state, array_to_string(list_filter([CASE WHEN bad_funds THEN 'funds' END, CASE WHEN bad_orders THEN 'orders' END, CASE WHEN bad_urgent THEN 'urgent' END, CASE WHEN bad_since THEN 'since' END, CASE WHEN bad_state THEN 'state' END], lambda x: x IS NOT NULL), ',') AS errors FROM v""")  # fmt: skip
def inputs_typed(spark, d):
    """Orders as forms that were filled in well or badly: numbers, whole numbers, yes or no, dates and choices as texts."""
    k = F.col("o_orderkey")
    of = lambda m, *values: F.element_at(F.array(*[v.cast("string") if isinstance(v, Column) else F.lit(v) for v in values]), (k % m + 1).cast("int"))
    price, user = F.floor(F.col("o_totalprice") + 0.5), F.col("o_custkey")
    t = table(spark, d, "orders").select(
        "o_orderkey", of(4, price, F.concat(F.lit(" "), price.cast("string"), F.lit(".0 ")), "much", "").alias("funds"), of(5, user, F.concat(user.cast("string"), F.lit(".00")), F.concat(F.lit("+"), user.cast("string")), "1.5", " ").alias("orders"),
        of(6, "Yes", "1", "no", "FALSE", "maybe", None).alias("urgent"), of(7, F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "d MMMM yyyy"), "2020-13-40", "soon", "", None).alias("since"), F.col("o_orderstatus").alias("state"),
    )
    t = inputs.checked(t, rules.category_of(INPUT_RULES), {c: c for c in ("funds", "orders", "urgent", "since", "state")})
    return t.select("o_orderkey", "funds", "orders", "urgent", "since", "state", F.array_join(F.transform("input_errors", lambda e: e["input"]), ",").alias("errors"))


@query("vectors_of_distinct_texts", "SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM conversations")
def vectors_of_distinct_texts(spark, d):
    """Turns with a vector of their text, which is made once however often it was said."""
    embed = lambda c: F.array(F.length(c).cast("double"), (F.length(c) - F.length(F.replace(c, F.lit("e"), F.lit("")))).cast("double"))
    t = embedding.distinct_vectors(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", embed)
    return t.select("conv_id", "turn", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("es"))


# --- phrases of one given table in the texts of another ---------------------------------------

PHRASE = r"[\p{L}\p{N}+#]+(?:\.[\p{L}\p{N}+#]+)*"


@query("phrases_in_documents", f"""WITH f AS (SELECT DISTINCT lower(array_to_string(list_slice(t, 3, 6), ' ')) AS form FROM (SELECT regexp_extract_all(text, '{PHRASE}') AS t FROM benchmark) WHERE len(t) >= 6),
k AS (SELECT doc_id, line, regexp_extract_all(line, '{PHRASE}') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
w AS (SELECT doc_id, line, lower(array_to_string(list_slice(t, i, i + 3), ' ')) AS form FROM k, unnest(range(1, len(t) - 2)) AS u(i))
SELECT doc_id, form AS phrase, count(*) AS times FROM w JOIN f USING (form) WHERE contains(lower(line), form) GROUP BY ALL""")  # fmt: skip
def phrases_in_documents(spark, d):
    """Mentions of phrases of four words, one of each benchmark item, in the lines of all documents."""
    words = F.regexp_extract_all("text", F.lit(match.TOKEN), 0)
    phrases = table(spark, d, "benchmark").where(F.size(words) >= 6).select(F.lower(F.array_join(F.slice(words, 3, 4), " ")).alias("form")).distinct()
    no = F.lit(False)
    lexicon = phrases.select("form", F.col("form").alias("skill"), F.col("form").alias("name"), F.lit(0).alias("order"), no.alias("exact_case"), no.alias("list_only"))
    found = match.mentions(table(spark, d, "documents").select("doc_id", "text"), lexicon, ["doc_id"])
    return found.groupBy("doc_id", F.col("skill").alias("phrase")).agg(F.count(F.lit(1)).alias("times"))


@query("conversation_sections", """WITH t AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no, text FROM conversations WHERE role IS NOT NULL),
l AS (SELECT conv_id, no, role, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM (SELECT conv_id, no, role, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t)),
g AS (SELECT conv_id, no, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS said FROM l WHERE line <> '' GROUP BY 1, 2)
SELECT t.conv_id, t.no AS section, t.role AS key, upper(t.role) AS heading, coalesce(n, 0) AS lines, coalesce(said, md5('')) AS said FROM t LEFT JOIN g USING (conv_id, no)""")  # fmt: skip
def conversation_sections(spark, d):
    """Whole conversations as documents, the speakers' names in capitals as headings: sections must be the turns, and every other line of the given texts must not be a heading."""
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = table(spark, d, "conversations").where("role is not null").withColumn("no", turn)
    said = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), tx.normal), lambda x: x != "")
    rows = t.select("conv_id", "no", F.posexplode(F.concat(F.array(F.upper("role")), said)).alias("at", "text"))
    rows = rows.select(F.col("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("no", "at")).alias("line_no"), "text", F.lit(None).cast("double").alias("size"), F.lit(False).alias("bold"), F.lit("").alias("style"))
    s = segment.sections(rows, {"user": "user", "assistant": "assistant", "system": "system", "tool": "tool"})
    text = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "text")))), lambda x: x["text"])
    g = s.groupBy("doc_id", "section_no").agg(F.first("section_key").alias("key"), F.first("heading").alias("heading"), F.count_if(~F.col("is_heading")).alias("lines"), F.md5(F.array_join(text, "\n").cast("binary")).alias("said"))
    return g.select(F.col("doc_id").alias("conv_id"), F.col("section_no").cast("long").alias("section"), "key", "heading", "lines", "said")


@query("entry_durations", """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderdate AS a, min(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, CASE WHEN k = 0 THEN 'Order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ', ' || strftime(a, '%b %Y') || ' - ' || strftime(b, '%b %Y') ELSE 'Order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS header, 2 AS lines,
  CASE WHEN k < 3 THEN CASE WHEN (year(b) - year(a)) * 12 + month(b) - month(a) + 1 > 0 THEN CAST((year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS DOUBLE) END END AS months FROM o""")  # fmt: skip
def entry_durations(spark, d):
    """Orders as entries whose period stands in the header, in the first or second line below it, or nowhere."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("b"))
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    k, on = F.col("o_orderkey") % 4, lambda c: F.date_format(c, "MMM yyyy")
    name = F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))  # a number that is no year
    below = lambda at: F.when(k == at, F.concat(F.lit("- from "), on("o_orderdate"), F.lit(" to "), on("b"))).otherwise(F.lit("- looked after it"))
    text = F.array(F.when(k == 0, F.concat(name, F.lit(", "), on("o_orderdate"), F.lit(" - "), on("b"))).otherwise(name), below(1), below(2))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("section_no"), F.posexplode(text).alias("line_no", "text"), F.lit(False).alias("bold"), F.lit("").alias("style"))
    e = segment.entries(rows, TODAY)
    return e.select(F.col("doc_id").alias("o_orderkey"), "header", F.size("body").alias("lines"), "months")


@query("scale_spread", """WITH c AS (SELECT c_mktsegment AS tier, round_even((c_acctbal + 999) / 110, 1) AS score FROM customer)
SELECT min(score) AS lowest, max(score) AS highest, max(score) - min(score) AS range, count(DISTINCT round_even(score / 5, 0)) AS bands, min(score) FILTER (tier = 'BUILDING') - max(score) FILTER (tier = 'MACHINERY') AS gap FROM c""")  # fmt: skip
def scale_spread(spark, d):
    """How much of a scale customers' balances use, and how far two segments are apart."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("tier"), rounded((F.col("c_acctbal") + 999) / 110, 1).alias("score"))
    return evaluate.spread(c, "tier", "score", "BUILDING", "MACHINERY")
