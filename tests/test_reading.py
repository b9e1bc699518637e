import random

from scoreloom.api import Engine
from scoreloom.operators import reading

WORDS = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean"


def placed(doc, page, lines, x=50.0, top=40.0, size=10.0, bold=False):
    """Words of lines set from x on, six points a letter."""
    out = []
    for k, line in enumerate(lines):
        at = float(x)
        for w in line.split():
            y = float(top + 12 * k)
            out.append((doc, page, w, at, at + 6.0 * len(w), y, y + 10, size, bold))
            at += 6.0 * len(w) + 6
    return out


def said(seed, n, words=4):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice("abcdefgh") * rnd.randint(3, 7) + str(rnd.randrange(99)) for _ in range(words)) for _ in range(n)]


def table(spark, rows, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, WORDS).repartition(4)


def test_columns_under_a_title_are_read_one_after_the_other(spark):
    left, right, title = said(1, 20), said(2, 17), ["Title of it all that runs over both of the columns on this page without any gap"]
    words = table(spark, placed(1, 1, title) + placed(1, 1, left, top=52) + placed(1, 1, right, x=330, top=52))
    got = reading.lines(words, ["doc_id", "page"]).orderBy("line_no").collect()
    assert [r.text for r in got] == [*title, *left, *right] and [r.col for r in got] == [0] * 21 + [1] * 17 and got[0].size == 10
    naive = [r.text for r in reading.naive_lines(words, ["doc_id", "page"]).orderBy("line_no").collect()]
    assert naive == [*title, *[" ".join(x) for x in zip(left, right, strict=False)], *left[17:]]


def test_blocks_uneven_baselines_and_no_words(spark):
    rows = placed(1, 1, said(3, 4)) + placed(1, 1, said(4, 3), top=40 + 4 * 12 + 9)
    rows = [(*r[:5], r[5] + (k % 2) * 1.5, *r[6:]) for k, r in enumerate(rows)]  # raised by a little
    more = [(2, 1, None, 1.0, 2.0, 3.0, 4.0, 5.0, False), (2, 1, "  ", 1.0, 2.0, 3.0, 4.0, 5.0, False), (2, 1, "x", None, 2.0, 3.0, 4.0, 5.0, False)]
    got = reading.two_readings(table(spark, rows + more), ["doc_id", "page"]).collect()
    assert [(r.doc_id, r.columns, r.blocks) for r in got] == [(1, 1, 2)] and got[0].read == got[0].naive == "\n".join(said(3, 4) + said(4, 3))
    assert reading.two_readings(table(spark, rows).limit(0), ["doc_id", "page"]).count() == 0


def test_documents_of_boxes_go_through_the_engine(spark):
    body = ["Education", *said(5, 12), "Experience", *said(6, 12), "Skills", *said(7, 12)]
    one = [placed(1, 1, [line + " and more words up to the far end of it"], top=40 + 12 * k, bold=len(line.split()) == 1, size=10.0) for k, line in enumerate(body)]
    rows = [w for p in one for w in p] + placed(1, 2, said(8, 5)) + placed(2, 1, said(9, 40)) + placed(2, 1, said(10, 40), x=330)
    docs = reading.documents(table(spark, rows)).cache()
    got = {r.doc_id: r for r in docs.collect()}
    assert got[1].page_count == 2 and got[1].gutters == 0 and got[1].order_similarity == 1.0 and got[1].text.endswith("\n".join(said(8, 5)))
    assert got[2].gutters == 1 and got[2].order_similarity < 0.75 and got[2].text == "\n".join(said(9, 40) + said(10, 40))
    checks = {r.doc_id: {c.check: c.status for c in r.checks} for r in Engine(spark).checks(docs).collect()}
    assert checks[1]["layout"] == "pass" and checks[2]["layout"] == "fail"
