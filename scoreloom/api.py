"""The engine: documents in, features, scores, gates, checks, advice and fits out, all as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import fixed, lexicons
from scoreloom.functions.numbers import rounded
from scoreloom.functions.vocabulary import FEATURES, register_feature
from scoreloom.operators import checks, drafts, embedding, evaluate, extract, match, report, segment
from scoreloom.operators import text as tx
from scoreloom.plans import inputs as forms_of
from scoreloom.plans import rules, scoring, scratch
from scoreloom.plans.scratch import saved


class Engine:
    def __init__(self, spark: SparkSession, rulesets: str | None = None, lexicon: DataFrame | None = None, today: str = "2026-09-22"):
        self.spark, self.today = spark, today
        self.categories = rules.load(rulesets) if rulesets else rules.load()
        self.lexicon = lexicon if lexicon is not None else lexicons.lexicon(spark)
        self.extractors: list[Callable[[DataFrame], DataFrame]] = []

    def __enter__(self) -> Engine:
        """Within ``with``, tables that plans keep are deleted at the end; take what is lazy out before."""
        self._scope = scratch.scope()
        self._scope.__enter__()
        return self

    def __exit__(self, *error) -> None:
        self._scope.__exit__(*error)

    def register_extractor(self, kinds: Mapping[str, str], extractor: Callable[[DataFrame], DataFrame]) -> None:
        """An extractor of the caller's own: from sectioned lines to long features, whose names and types go to the vocabulary."""
        for name, kind in kinds.items():
            register_feature(name, kind)
        self.extractors.append(extractor)

    def lines(self, docs: DataFrame) -> DataFrame:
        """Sectioned lines of plain texts (doc_id, text), computed once: a dozen extractors read them."""
        t = tx.lines(docs).withColumns({"size": F.lit(None).cast("double"), "bold": F.lit(False), "style": F.lit("")})
        return saved(segment.sections(t))

    def entries(self, lines: DataFrame) -> DataFrame:
        e = segment.entries(lines.where("not is_heading"), self.today)
        keys = lines.groupBy("doc_id", "section_no").agg(F.first("section_key").alias("section_key"))
        return e.join(keys, ["doc_id", "section_no"])

    def features(self, docs: DataFrame, statements: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """Long features of every document, derived ones included."""
        lines = self.lines(docs) if lines is None else lines
        entries = saved(self.entries(lines))
        found = match.mentions(docs, self.lexicon.drop("category"), ["doc_id"])
        parts = [
            extract.education(lines), extract.coursework(lines), extract.coding(lines), extract.gate_exam(lines), extract.exam_stages(lines), extract.faculty(lines), extract.spoken(lines), extract.personal(lines),
            extract.entry_features(entries, fixed.PRODUCT, fixed.CORE, fixed.ISSUERS, lines), extract.skills(found, self.lexicon),
        ]
        parts += [own(lines) for own in self.extractors]
        if statements is not None:
            parts.append(extract.statement(statements))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return extract.derived_features(saved(every), self.today)

    def wide(self, features: DataFrame, names: list[str] | None = None) -> DataFrame:
        """One row per document with a typed column per feature; null means not stated."""
        kinds = {"number": "num", "int": "num", "bool": "bool", "list": "items", "str": "str", "date": "str"}
        return features.groupBy("doc_id").agg(*[F.max(F.when(F.col("feature") == n, F.col(kinds[FEATURES[n]]))).alias(n) for n in names or FEATURES])

    def score(self, features: DataFrame, category: str, inputs: DataFrame | None = None, given: Mapping[str, str] | None = None) -> DataFrame:
        """Strength under one category: signals, sub-scores, score, confidence, gates, eligible. ``inputs``: (doc_id, ...), ``given``: input id to its column."""
        c = rules.lookup(self.categories, category)
        names, given = {n: n for n in FEATURES}, dict(given or {})
        wide = self.wide(features)
        if inputs is not None:
            wide = scoring.with_inputs(wide.join(inputs, "doc_id", "left"), c, names, given)
            if "date_of_birth" in given:
                from scoreloom.functions import derived

                wide = wide.withColumn("candidate.age", F.coalesce(derived.age(F.try_to_date(F.col("`candidate.date_of_birth`")), F.to_date(F.lit(self.today))).cast("double"), F.col("`candidate.age`")))
        s = scoring.scored(wide, c, names)
        return scoring.gated(s, c, names, {i: F.col(col) for i, col in given.items()})

    def score_forms(self, features: DataFrame, category: str, forms: DataFrame, given: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
        """(scores, errors): like ``score`` with inputs that users typed. A document whose form has an input that can't be read isn't scored but has a row per error."""
        c = rules.lookup(self.categories, category)
        checked = saved(forms_of.checked(forms.select("doc_id", *dict.fromkeys(given.values())), c, dict(given)))
        good, errors = forms_of.split(checked, "doc_id")
        rejected = checked.where(F.size("input_errors") > 0).select("doc_id")
        return self.score(features.join(rejected, "doc_id", "left_anti"), category, good, given), errors

    def suggestions(self, scores: DataFrame, category: str) -> DataFrame:
        return scoring.suggestions(scores, rules.lookup(self.categories, category), {n: n for n in FEATURES}, "doc_id")

    def keywords(self, docs: DataFrame, jds: DataFrame, lines: DataFrame) -> DataFrame:
        """(doc_id, skill, importance, terms, found_terms, in_context, status, credit): what the description of each document (jd_id) names, against the document."""
        own = match.mentions(lines.select("doc_id", F.col("line_no").alias("at"), "section_key", "text"), self.lexicon.drop("category"), ["doc_id", "at", "section_key"])
        used = F.max(F.coalesce(F.col("section_key").isin(*match.CONTEXT), F.lit(False)))
        present = own.groupBy("doc_id", "skill").agg(F.array_sort(F.collect_set("surface")).alias("terms"), used.alias("in_context"))
        wanted = docs.select("doc_id", "jd_id").join(match.wanted_skills(jds, self.lexicon.drop("category")), "jd_id").drop("jd_id")
        return match.coverage(wanted, present, ["doc_id"])

    def checks(self, docs: DataFrame, category: str | None = None, lines: DataFrame | None = None, jds: DataFrame | None = None) -> DataFrame:
        """(doc_id, ats, fatal, checks): the documents' readability, by the category's limits; keywords count where there are descriptions."""
        lines = self.lines(docs) if lines is None else lines
        c = rules.lookup(self.categories, category) if category else None
        e = checks.evidence_of(docs).join(segment.section_map(lines), "doc_id", "left")
        expected = c.sections if c else ("education", "experience", "skills")
        e = e.withColumns({
            "headings_found": F.coalesce(F.size("found"), F.lit(0)), "headings_odd": F.coalesce(F.size("nonstandard"), F.lit(0)), "sections_expected": F.lit(len(expected)),
            "sections_missing": sum((F.when(F.coalesce(segment.has_section(F.col("found"), k), F.lit(False)), 0).otherwise(1) for k in expected), F.lit(0)),
            "max_pages": F.lit(c.max_pages if c else 2), "linkedin_expected": F.lit(c.linkedin_expected if c else True),
        })
        if "filename" in docs.columns:
            tokens = tx.filename_tokens(F.col("filename"))
            e = e.join(extract.candidate_name(lines), "doc_id", "left")
            e = e.withColumns({"filename_generic": F.size(tokens) == 0, "filename_draft": tx.stem(F.col("filename")).rlike(tx.DRAFT), "filename_named": F.col("name").isNull() | F.arrays_overlap(tokens, F.split(F.lower("name"), " "))})
        if jds is not None:
            hits = self.keywords(docs, jds, lines)
            share = match.covered_share(hits, ["doc_id"]).join(hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("keyword_hits")), "doc_id")
            e = e.join(share.withColumnRenamed("coverage", "keyword_coverage"), "doc_id", "left").withColumn("keyword_hits", F.coalesce("keyword_hits", F.lit(0)))
        found = checks.checks_of(e)
        said = F.array_sort(F.transform("checks", lambda x: F.struct(x["check"].alias("check"), x["status"].alias("status"), x["score"].alias("score"))))
        return found.select("doc_id", checks.total(F.col("checks")).alias("ats"), F.exists("checks", lambda x: x["fatal"]).alias("fatal"), said.alias("checks"))

    def matches(self, docs: DataFrame, jds: DataFrame, embed=match.hashed_embedding, lines: DataFrame | None = None, cache: embedding.Cache | None = None) -> DataFrame:
        """Every text is embedded once, with a ``cache`` once for all runs. (doc_id, jd_id, req_no, requirement, importance, similarity, wanted, missing, score, status, evidence, rank) of every requirement that a document meets text for."""
        lines = self.lines(docs) if lines is None else lines
        reqs = saved(match.requirements(jds))
        embedded = (lambda t, text: cache.vectors(t, text, embed)) if cache else (lambda t, text: t.withColumn("vector", embed(F.col(text)))) if embed is match.hashed_embedding else (lambda t, text: embedding.distinct_vectors(t, text, embed))
        pieces = embedded(match.chunks(lines), "text").join(docs.select("doc_id", "jd_id"), "doc_id")
        asked = embedded(reqs, "requirement").select("jd_id", "req_no", "vector")
        pairs = docs.select("doc_id", "jd_id").join(reqs, "jd_id")
        keys = ["doc_id", "jd_id"]
        best = match.best_chunks(pairs.select(*keys, "req_no").join(asked, ["jd_id", "req_no"]), pieces.select(*keys, "chunk_no", "vector"), keys, "req_no", "chunk_no")
        lex = self.lexicon.drop("category")
        named = match.mentions(reqs, lex, ["jd_id", "req_no"], "requirement").groupBy("jd_id", "req_no").agg(F.array_sort(F.collect_set("skill")).alias("wanted"))
        shown = match.mentions(docs.select("doc_id", "text"), lex, ["doc_id"]).groupBy("doc_id").agg(F.collect_set("skill").alias("shown"))
        none = F.array().cast("array<string>")
        m = pairs.join(best, [*keys, "req_no"]).join(named, ["jd_id", "req_no"], "left").join(shown, "doc_id", "left").withColumn("wanted", F.coalesce("wanted", none))
        m = m.withColumn("missing", F.array_except("wanted", F.coalesce("shown", none)))
        m = m.withColumn("score", rounded(match.requirement_score(F.col("similarity"), F.size("wanted"), F.size("missing")), 3)).withColumn("status", match.fit_status(F.col("score")))
        said = match.chunks(lines).select("doc_id", F.col("chunk_no").alias("best"), F.col("text").alias("said"))
        m = m.join(said, ["doc_id", "best"], "left").withColumn("evidence", F.when(F.col("score") >= match.PARTIAL, F.col("said")))
        return match.ranked_matches(m, keys, "req_no").select(*keys, "req_no", "requirement", "importance", rounded("similarity", 3).alias("similarity"), "wanted", "missing", "score", "status", "evidence", "rank")

    def fit(self, docs: DataFrame, jds: DataFrame, embed=match.hashed_embedding, lines: DataFrame | None = None, cache: embedding.Cache | None = None) -> DataFrame:
        """(doc_id, jd_id, fit, note): every document against the description it names in jd_id; 0 and a note where there is nothing to compare."""
        lines = self.lines(docs) if lines is None else lines
        if embed is None:
            return docs.where("jd_id is not null").select("doc_id", "jd_id", F.lit(0.0).alias("fit"), match.fit_note(F.lit(1), F.lit(1), F.lit(False)).alias("note"))
        got = match.fit(self.matches(docs, jds, embed, lines, cache), ["doc_id", "jd_id"])
        asked = match.requirements(jds).groupBy("jd_id").agg(F.count(F.lit(1)).alias("n"))
        has = match.chunks(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
        t = docs.where("jd_id is not null").select("doc_id", "jd_id").join(asked, "jd_id", "left").join(has, "doc_id", "left").join(got, ["doc_id", "jd_id"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return t.select("doc_id", "jd_id", F.coalesce("fit", F.lit(0.0)).alias("fit"), match.fit_note(zero("n"), zero("m"), F.lit(True)).alias("note"))

    def layouts(self, given: DataFrame, category: str) -> DataFrame:
        """(doc_id, sections, pages, warnings) of nested drafts for a category."""
        return drafts.layouts(given, rules.lookup(self.categories, category))

    def analyze(self, docs: DataFrame, category: str, jds: DataFrame | None = None, statements: DataFrame | None = None) -> DataFrame:
        """One row per document: score, confidence, eligible, ats, fatal, fit, overall and their levels. Without a comparable description there is no overall score."""
        lines = self.lines(docs)
        s = self.score(self.features(docs, statements, lines), category).select("doc_id", "score", "confidence", "eligible")
        out = docs.select("doc_id").join(s, "doc_id", "left").join(self.checks(docs, category, lines, jds).select("doc_id", "ats", "fatal"), "doc_id", "left")
        none = lambda t: F.lit(None).cast(t)
        out = out.join(self.fit(docs, jds, lines=lines).drop("jd_id"), "doc_id", "left") if jds is not None else out.withColumns({"fit": none("double"), "note": none("string")})
        blended = scoring.blend(F.col("score"), F.when(F.col("note").isNull(), F.col("fit")), F.col("ats"))
        return out.withColumns({"overall": blended, "level": scoring.level(F.col("score")), "low_confidence": report.low_confidence(F.col("confidence"))})

    def report(self, results: DataFrame, features: DataFrame) -> DataFrame:
        """(doc_id, json): what ``analyze`` gave, with cards and facts."""
        return report.assembled(results.withColumnRenamed("score", "strength"), features)

    @staticmethod
    def as_json(result: DataFrame) -> DataFrame:
        return result.select("doc_id", F.to_json(F.struct(*result.columns)).alias("json"))
