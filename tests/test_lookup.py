import random

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.lookup import Phrases
from scoreloom.operators import segment


def brute(words, known, more):
    """The longest phrase among all that the words contain as a run, by comparing with every phrase."""
    said = f" {' '.join(words)} "
    held = [p for p in known if f" {p} " in said and 0 <= len(words) - len(p.split()) <= more]
    return min(held, key=lambda p: (-len(p), p), default=None)


@pytest.mark.parametrize("more", [0, 1, 2, 4])
def test_phrases_within_are_those_that_a_search_finds(spark, more):
    rnd = random.Random(more)
    names = ["a", "bb", "ccc", "dd", "e"]
    known = {" ".join(rnd.choice(names) for _ in range(rnd.randint(1, 4))): f"v{k}" for k in range(60)}
    rows = [(" ".join(rnd.choice([*names, "x"]) for _ in range(rnd.randint(1, 7))),) for _ in range(400)] + [("",), (None,)]
    table = Phrases(known)
    df = spark.createDataFrame(rows, "t string").withColumn("w", F.split("t", " "))
    got = df.select("t", table.entry(F.col("t"))["value"].alias("exact"), table.within(F.col("w"), more).alias("best")).collect()
    assert sum(r.best is not None for r in got) > 50
    for r in got:
        want = None if r.t is None else brute(r.t.split(" "), known, more)
        assert (r.best and (r.best.phrase, r.best.value)) == (want and (want, known[want])) and r.exact == known.get(r.t)


def test_no_phrases(spark):
    none = Phrases({})
    assert spark.range(1).select(none.within(F.array(F.lit("a")), 2).alias("x")).first().x is None


def test_headings_of_every_alias_with_words_around(spark):
    rnd = random.Random(4)
    rows = []
    for alias in segment.ALIASES:
        for n in range(4):
            extra = [rnd.choice(["my", "zz", "other", "work", "skills"]) for _ in range(n)]
            at = rnd.randint(0, n)
            rows.append((" ".join([*extra[:at], alias, *extra[at:]]).title(),))
    h = segment.heading(F.col("t"))
    for r in spark.createDataFrame(rows, "t string").select("t", h["key"].alias("key"), h["exact"].alias("exact")).collect():
        words = r.t.lower().split(" ")
        want = brute(words, segment.ALIASES, 2) if len(words) <= 6 else None
        assert (r.key, r.exact) == (want and segment.ALIASES[want], r.t.lower() in segment.ALIASES), r.t


def test_suggested_names_are_the_closest_matches(spark):
    import difflib

    rnd = random.Random(6)
    rows = [(n,) for n in segment.NAMES]
    for _ in range(250):
        name = list(rnd.choice(list(segment.NAMES)))
        for _ in range(rnd.randint(1, 5)):
            at = rnd.randrange(len(name)) if name else 0
            name[at : at + 1] = rnd.choice([[], [rnd.choice("abcdeginorst ")], name[at : at + 1] * 2])
        rows.append((" ".join("".join(name).split()),))
    hints = {w for words in segment.HINTS.values() for w in words}
    n = 0
    for r in spark.createDataFrame(rows, "t string").select("t", segment.suggest_standard(F.col("t")).alias("key")).collect():
        if not any(w in r.t for w in hints):
            close = difflib.get_close_matches(r.t, list(segment.NAMES), n=1, cutoff=segment.CLOSE)
            assert r.key == (segment.NAMES[close[0]] if close else None), r.t
            n += 1
    assert n > 60


def test_mentions_are_the_same_whether_the_lexicon_is_small_or_not(spark, sf):
    """In given texts, with phrases that overlap, against a search by regular expressions for the longest first."""
    import re

    from scoreloom.functions import lexicons
    from scoreloom.operators import match

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", "text").limit(60)
    names = {"one": ["the", "of the", "in"], "two": ["and the", "is", "C++"], "three": ["on/of"]}
    lexicon = spark.createDataFrame(
        [(lexicons.form_of(n), s, n, k, False, False) for k, (s, n) in enumerate((s, n) for s, own in names.items() for n in own)], "form string, skill string, name string, `order` int, exact_case boolean, list_only boolean"
    )
    extra = spark.createDataFrame([(-1, "the C++, of the on/of on of\nin of, the"), (-2, None), (-3, "")], "doc_id long, text string")
    texts = docs.unionByName(extra)
    both = [sorted(map(tuple, match.mentions(texts, lexicon, ["doc_id"], small=n).collect())) for n in (5000, 0)]
    assert both[0] == both[1] and len(both[0]) > 200
    every = sorted([n for own in names.values() for n in own], key=lambda n: -len(n))
    pattern = re.compile("|".join(rf"(?<![^\W_+#])(?<![+#.]){re.escape(n)}(?![\w+#]|\.\w)" for n in every), re.I)
    got = sorted((line, start, surface) for d, line, _, surface, start, _ in both[0] if d == -1)
    assert got == [(k, m.start(), m[0]) for k, x in enumerate(extra.first().text.split("\n")) for m in pattern.finditer(x)]


def test_phrases_within_a_conditional_build_no_table_per_row(spark):
    df = spark.createDataFrame([("Education", True)], "t string, c boolean").select(F.when(F.col("c"), segment.heading(F.col("t"))).alias("h"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first().h.key == "education" and plan.count("named_struct") + plan.count("struct(") < 20 and "INSET" in plan
