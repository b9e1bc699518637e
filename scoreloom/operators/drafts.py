"""Nested drafts to ordered layouts, with what is missing in them: rules over arrays of structs, one projection without a shuffle.

A draft is a row: doc_id, contact (struct of name, email, phone, location, linkedin, github, portfolio), summary, date_of_birth, education,
experience, internships, research and projects (arrays of structs), skills (label, items), and plain lists. What a table doesn't have counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed
from scoreloom.functions.lookup import let
from scoreloom.operators import text as tx
from scoreloom.operators.extract import METRIC
from scoreloom.operators.generate import LINES_PER_PAGE, compact, filename, joined
from scoreloom.plans.rules import Category

ROLE = "array<struct<title:string,organisation:string,location:string,start:string,end:string,bullets:array<string>>>"
DRAFT = {
    "contact": "struct<name:string,email:string,phone:string,location:string,linkedin:string,github:string,portfolio:string>", "summary": "string", "date_of_birth": "string",
    "education": "array<struct<qualification:string,institution:string,start:string,end:string,score:string>>", "experience": ROLE, "internships": ROLE, "research": ROLE,
    "projects": "array<struct<title:string,stack:string,start:string,end:string,link:string,bullets:array<string>>>", "skills": "array<struct<label:string,items:array<string>>>",
    **dict.fromkeys(("coding_profiles", "exams", "publications", "achievements", "certifications", "activities", "coursework", "languages", "interests"), "array<string>"),
}
BLOCKS = "array<struct<text:string,bullets:array<string>>>"
SECTION = f"struct<key:string,heading:string,blocks:{BLOCKS}>"


def complete(drafts: DataFrame) -> DataFrame:
    """Drafts with every field, of the type it has here; null lists are empty and lists hold no empty items. Fields of structs go by name: what is missing is null, what is more goes."""
    own = dict(drafts.dtypes)
    rows = drafts.withColumns({c: F.lit(None).cast(t) for c, t in DRAFT.items() if c not in drafts.columns})
    fields = {}
    for c, t in DRAFT.items():
        nested = t.startswith(("struct", "array<struct")) and own.get(c, t) not in (t, "void")
        value = F.from_json(F.to_json(F.col(c)), t) if nested else F.col(c).cast(t)
        if t == "array<string>":
            value = compact(F.coalesce(value, F.array().cast(t)))
        elif t.startswith("array"):
            value = F.filter(F.coalesce(value, F.array().cast(t)), lambda x: x.isNotNull())
        elif t == "string":
            value = F.coalesce(F.trim(value), F.lit(""))
        fields[c] = value
    return rows.withColumns(fields)


def _period(x: Column) -> Column:
    return joined(" - ", *[F.when(F.trim(x[c]) != "", tx.normal_month(x[c])) for c in ("start", "end")])


def _bullets(x: Column) -> Column:
    return compact(F.coalesce(x["bullets"], F.array().cast("array<string>")))


def _block(text: Column, bullets: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.array().cast("array<string>") if bullets is None else bullets).alias("bullets"))


def _role(x: Column) -> Column:
    return _block(joined(" | ", joined(", ", x["title"], x["organisation"], x["location"]), _period(x)), _bullets(x))


def _project(x: Column) -> Column:
    link = F.when(F.trim(x["link"]) != "", F.array(F.concat(F.lit("Live: "), x["link"]))).otherwise(F.array().cast("array<string>"))
    return _block(joined(" | ", x["title"], x["stack"], _period(x)), F.concat(_bullets(x), link))


def _section(key: str, heading: Column | str, blocks: Column, when: Column) -> Column:
    title = F.lit(heading) if isinstance(heading, str) else heading
    return F.when(when, F.struct(F.lit(key).alias("key"), title.alias("heading"), blocks.alias("blocks")).cast(SECTION))


def builders() -> dict[str, Column]:
    """A section per name that an order may hold; null where a draft has nothing for it."""
    c = F.col
    roles = F.concat("experience", "internships")
    lists = lambda key, heading, items: _section(key, heading, F.array(_block(F.lit(""), items)), F.size(items) > 0)
    inline = lambda key, heading: _section(key, heading, F.array(_block(F.array_join(c(key), ", "))), F.size(c(key)) > 0)
    gate = F.filter("exams", lambda e: e.rlike(r"(?i)\bGATE\b"))
    other = F.filter("exams", lambda e: ~e.rlike(r"(?i)\bGATE\b"))
    said = lambda heading: _section("summary", heading, F.array(_block(c("summary"))), c("summary") != "")
    experience = _section("experience", F.when(F.size("experience") > 0, "EXPERIENCE").otherwise("INTERNSHIPS"), F.transform(roles, _role), F.size(roles) > 0)
    service = lists("activities", "POSITIONS OF RESPONSIBILITY", c("activities"))
    skills = F.transform("skills", lambda g: _block(F.concat(g["label"], F.lit(": "), F.array_join(compact(g["items"]), ", "))))
    study = F.transform("education", lambda e: _block(joined(" | ", e["qualification"], e["institution"], _period(e), e["score"])))
    born = F.array(F.concat(F.lit("Date of Birth: "), c("date_of_birth")))
    exams = lists("exams", "COMPETITIVE EXAMS", other)
    return {
        "summary": said("SUMMARY"), "research_interests": said("RESEARCH INTERESTS"), "education": _section("education", "EDUCATION", study, F.size("education") > 0), "experience": experience, "internships": experience,
        "research": _section("research", "RESEARCH EXPERIENCE", F.transform("research", _role), F.size("research") > 0), "projects": _section("projects", "PROJECTS", F.transform("projects", _project), F.size("projects") > 0),
        "skills": _section("skills", "TECHNICAL SKILLS", skills, F.size("skills") > 0), "coding_profiles": lists("coding_profiles", "CODING PROFILES", c("coding_profiles")), "gate_scorecard": lists("exams", "GATE", gate),
        "exam_progress": exams, "exams": exams, "publications": lists("publications", "PUBLICATIONS", c("publications")), "achievements": lists("achievements", "ACHIEVEMENTS", c("achievements")),
        "certifications": lists("certifications", "CERTIFICATIONS", c("certifications")), "service": service, "activities": service, "coursework": inline("coursework", "RELEVANT COURSEWORK"),
        "languages": inline("languages", "LANGUAGES"), "interests": inline("interests", "INTERESTS"), "personal": _section("personal", "PERSONAL DETAILS", F.array(_block(F.lit(""), born)), c("date_of_birth") != ""),
    }


def order_of(category: Category) -> list[str]:
    """The category's order, then what it leaves out; a summary that it doesn't place comes first."""
    own = [k for k in category.order if k != "header"]
    rest = [k for k in fixed.DRAFT_ORDER if k not in own]
    hoisted = ["summary"] if not {"summary", "research_interests"} & set(own) else []
    return [*hoisted, *[k for k in (*own, *rest) if k not in hoisted]]


def warnings(category: Category, sections: Column, pages: Column) -> Column:
    """What an expert would say about a draft: sections, contact, every role and project, length."""
    keys = F.transform(sections, lambda s: s["key"])
    there = F.when(F.array_contains(keys, "experience"), F.concat(keys, F.array(F.lit("internships")))).otherwise(keys)
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    parts = [one(~F.array_contains(there, k), F.lit(f"No {k.replace('_', ' ')} section: {category.label} applications are expected to have one.")) for k in category.sections]
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    parts.append(one(blank(F.col("contact.email")) | blank(F.col("contact.phone")), F.lit("Add both an email address and a phone number; parsers look for them in the first lines.")))
    about = lambda text: lambda x: F.format_string(text, F.coalesce(x["title"], F.lit("")))
    unmeasured = lambda x: (F.size(_bullets(x)) > 0) & ~F.exists(_bullets(x), lambda b: b.rlike(METRIC))
    silent, vague, same = (about(t) for t in (fixed.NO_BULLETS, fixed.NO_RESULT_IN_ROLE, fixed.NO_RESULT_IN_PROJECT))
    roles = F.concat("experience", "internships", "research")
    parts.append(F.flatten(F.transform(roles, lambda x: F.array_compact(F.array(F.when(F.size(_bullets(x)) == 0, silent(x)), F.when(unmeasured(x), vague(x)))))))
    parts.append(F.transform(F.filter("projects", unmeasured), same))
    parts.append(one(pages > category.max_pages, F.format_string(fixed.TOO_LONG, pages, F.lit(category.max_pages), F.lit(category.label))))
    return F.concat(*parts)


def layouts(drafts: DataFrame, category: Category, key: str = "doc_id") -> DataFrame:
    """(key, sections, pages, warnings) of every draft for a category; ``generate.rendered`` makes text of exploded sections."""
    made = builders()
    rows = complete(drafts).withColumn("_every", F.array(*[made[k] for k in order_of(category) if k in made]))
    first = F.filter("_every", lambda s, i: s.isNotNull() & ~F.exists(F.slice("_every", F.lit(1), i), lambda p: F.coalesce(p["key"] == s["key"], F.lit(False))))
    rows = rows.withColumn("sections", first)
    height = F.aggregate("sections", F.lit(4), lambda n, s: n + 1 + F.aggregate(s["blocks"], F.lit(0), lambda m, b: m + 1 + F.size(b["bullets"])))
    rows = rows.withColumn("pages", F.greatest(F.lit(1), F.ceil(height / LINES_PER_PAGE).cast("int")))
    return rows.select(key, "sections", "pages", let(F.col("sections"), lambda s: warnings(category, s, F.col("pages"))).alias("warnings"))


def to_render(drafts: DataFrame, laid: DataFrame, category: Category, key: str = "doc_id") -> DataFrame:
    """(name, title, contact, sections) of drafts and their ``layouts``: what ``sources.docx.of_layouts`` writes files from."""
    c = F.col("contact")
    line = joined(" | ", *[c[x] for x in ("email", "phone", "location", "linkedin", "github", "portfolio")])
    name = F.coalesce(F.nullif(F.trim(c["name"]), F.lit("")), F.concat(F.lit("Draft "), F.col(key).cast("string")))
    rows = complete(drafts).select(key, filename(name, F.lit(category.role), "docx").alias("name"), name.alias("title"), line.alias("contact"))
    return rows.join(laid.select(key, "sections"), key)
