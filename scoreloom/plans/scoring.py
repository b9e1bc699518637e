"""Scoring plans: a category compiled to columns over one wide row per document, or joined as tables to long features.

The compiled plan is a projection: no join and no shuffle however many rules there are. The tabular plan serves
tables in which every row names its own category; rule tables are a few hundred rows and are joined by broadcast. Both
sum exact decimals and round half to even, so a result doesn't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded
from scoreloom.functions.vocabulary import FEATURES
from scoreloom.plans.rules import Category, Gate, Rule, RuleError, Signal

# Fixed values.
LEVELS = ((85.0, "Excellent"), (70.0, "Strong"), (55.0, "Fair"), (35.0, "Weak"), (0.0, "Very weak"))
HIGH, MEDIUM = 6.0, 2.5
BLEND = {"strength": 0.5, "fit": 0.3, "ats": 0.2}


def dec(x: Column | float, scale: int = 4) -> Column:
    return (F.lit(x) if isinstance(x, int | float) else x).cast(f"decimal(18,{scale})")


# --- rules as columns ----------------------------------------------------------------


def interpolate(x: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise linear, constant beyond the first and the last point; null stays null."""
    out = F.when(x.isNull(), None).when(x <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + F.lit(y1 - y0) * ((x - F.lit(x0)) / F.lit(x1 - x0)))
    return out.otherwise(points[-1][1])


def step(x: Column, tiers: tuple[tuple[float, float], ...], below: float) -> Column:
    out = F.when(x.isNull(), None)
    for least, y in reversed(tiers):
        out = out.when(x >= least, y)
    return out.otherwise(below)


def match_count(items: Column, values: tuple[str, ...]) -> Column:
    """How many items are among the values, whatever their case; repeated items count each time."""
    known = F.array(*[F.lit(v.lower()) for v in values]) if values else F.array().cast("array<string>")
    return F.when(items.isNotNull(), F.size(F.filter(items, lambda i: F.array_contains(known, F.lower(i)))))


CUSTOM: dict[str, callable] = {}


def register_rule(kind: str, build) -> None:
    """``build(column, rule)`` gives the score column of a rule kind of the caller's own."""
    CUSTOM[kind] = build


def rule_score(x: Column, rule: Rule) -> Column:
    if rule.kind in CUSTOM:
        return CUSTOM[rule.kind](x, rule)
    if rule.kind == "bands":
        return interpolate(x.cast("double"), rule.points)
    if rule.kind == "step":
        return step(x.cast("double"), rule.points, rule.below)
    if rule.kind == "boolean":
        return F.when(x.isNull(), None).when(x, rule.yes).otherwise(rule.no)
    return interpolate(match_count(x, rule.values).cast("double"), rule.points)


def _empty(value: Column, kind: str) -> Column:
    """Stated, but with nothing in it."""
    return {"bool": ~value, "list": F.size(value) == 0, "str": value == "", "date": F.lit(False)}.get(kind, value.cast("double") == 0) if kind in ("bool", "list", "str", "date") else value.cast("double") == 0


class Wide:
    """Columns of a wide feature row by feature name."""

    def __init__(self, names: dict[str, str]):
        self.names = names

    def __getitem__(self, feature: str) -> Column:
        return F.col(f"`{self.names[feature]}`")

    def __contains__(self, feature: str) -> bool:
        return feature in self.names


def signal_struct(s: Signal, nominal: float, wide: Wide) -> Column:
    """score (null if not found), found, counted, empty, feature, nominal of one signal."""
    terms = [(t, wide[t.feature]) for t in s.terms if t.feature in wide]
    options = [F.struct(rule_score(x, t.rule).alias("score"), F.lit(-k).alias("place"), F.lit(t.feature).alias("feature"), _empty(x, FEATURES[t.feature]).alias("empty")) for k, (t, x) in enumerate(terms)]
    best = F.array_max(F.filter(F.array(*options), lambda o: o["score"].isNotNull())) if options else F.lit(None).cast("struct<score:double,place:int,feature:string,empty:boolean>")
    found = best.isNotNull()
    score = F.when(found, rounded(best["score"], 4)).when(F.lit(s.missing == "zero"), 0.0)
    return F.struct(
        F.lit(s.id).alias("signal"), F.lit(s.subscore).alias("subscore"), dec(score).alias("score"), dec(s.weight).alias("weight"), found.alias("found"),
        (found | F.lit(s.missing == "zero")).alias("counted"), F.coalesce(best["empty"], F.lit(True)).alias("empty"), best["feature"].alias("feature"), F.lit(nominal).alias("nominal"),
    )


def _weighted(items: list[tuple[Column, Column]]) -> Column:
    """Weighted mean of the scores that aren't null; null if there is none."""
    top = reduce(lambda a, b: a + b, [F.coalesce(s * w, dec(0.0, 8)) for s, w in items])
    low = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(dec(0.0)) for s, w in items])
    return F.try_divide(top.cast("double"), F.nullif(low.cast("double"), F.lit(0.0)))


def scored(features: DataFrame, category: Category, names: dict[str, str]) -> DataFrame:
    """Adds signals (array), one column per sub-score (sub_<id>), score, confidence. ``names``: column of each feature."""
    wide = Wide(names)
    structs = {s.id: signal_struct(s, category.nominal(s), wide) for s in category.signals}
    out = features.withColumns({f"_{k}": v for k, v in structs.items()})
    subs = {}
    for sub in category.subscores:
        mean = _weighted([(F.col(f"_{s.id}.score"), F.col(f"_{s.id}.weight")) for s in category.of(sub)])
        subs[f"sub_{sub}"] = rounded(mean * 100, 1)
    out = out.withColumns(subs)
    overall = F.coalesce(rounded(_weighted([(dec(F.col(f"sub_{k}")), dec(w)) for k, w in category.subscores.items()]), 1), F.lit(0.0))
    known = reduce(lambda a, b: a + b, [F.when(F.col(f"_{s.id}.found") & ~F.col(f"_{s.id}.empty"), dec(category.nominal(s), 8)).otherwise(dec(0.0, 8)) for s in category.signals])
    out = out.withColumns({"score": overall, "confidence": rounded(known.cast("double"), 2), "signals": F.array(*[F.col(f"_{s.id}") for s in category.signals])})
    return out.drop(*[f"_{s.id}" for s in category.signals])


# --- gates ------------------------------------------------------------------------------


def gate_delta(gate: Gate, inputs: dict[str, Column]) -> Column:
    """What the relaxations that apply come to: their sum, or the largest by absolute value."""
    parts = []
    for a in gate.adjust:
        x = inputs.get(a.input)
        applies = F.coalesce(x.isin(*a.values), F.lit(False)) if x is not None else F.lit(False)
        parts.append(F.when(applies, a.delta).otherwise(0.0))
    if not parts:
        return F.lit(0.0)
    if gate.mode == "sum":
        return reduce(lambda a, b: a + b, parts)
    return F.array_max(F.array(*[F.struct(F.abs(p).alias("size"), F.lit(-k).alias("place"), p.alias("delta")) for k, p in enumerate(parts)]))["delta"]


def gate_struct(gate: Gate, wide: Wide, inputs: dict[str, Column]) -> Column:
    """gate, status (null if skipped), value (as double), limit, message."""
    delta = gate_delta(gate, inputs)
    x = wide[gate.feature] if gate.feature in wide else F.lit(None).cast("double")
    limit = F.lit(gate.min if gate.min is not None else gate.max).cast("double") + delta
    ok = F.lit(True)
    if gate.min is not None:
        ok = ok & (x.cast("double") >= gate.min + delta)
    if gate.max is not None:
        ok = ok & (x.cast("double") <= gate.max + delta)
    if gate.equals is not None:
        ok = ok & (x == F.lit(gate.equals))
    missing = F.lit(None).cast("string") if gate.missing == "skip" else F.lit(gate.missing)
    status = F.when(x.isNull(), missing).when(ok, "pass").otherwise(gate.level)
    shown = as_text(x, FEATURES.get(gate.feature, "number"))
    met = F.concat(shown, F.lit(" meets the requirement of "), as_text(limit), F.lit(".")) if gate.min is not None or gate.max is not None else F.lit("Requirement met.")
    said = filled(F.when(x.isNull() & F.lit(bool(gate.message_missing)), gate.message_missing).otherwise(gate.message), value=F.coalesce(shown, F.lit("not stated")), limit=F.coalesce(as_text(limit), F.lit("")))
    return F.struct(F.lit(gate.id).alias("gate"), status.alias("status"), x.cast("double").alias("value"), limit.alias("limit"), F.when(status == "pass", met).otherwise(said).alias("message"))


def gated(features: DataFrame, category: Category, names: dict[str, str], inputs: dict[str, Column] | None = None) -> DataFrame:
    """Adds gates (array; skipped ones are not in it) and eligible (no gate failed; never changes the score)."""
    wide = Wide(names)
    structs = [gate_struct(g, wide, inputs or {}) for g in category.gates]
    gates = F.filter(F.array(*structs), lambda g: g["status"].isNotNull()) if structs else F.array()
    return features.withColumn("gates", gates).withColumn("eligible", ~F.exists("gates", lambda g: g["status"] == "fail") if structs else F.lit(True))


def with_inputs(features: DataFrame, category: Category, names: dict[str, str], given: dict[str, str]) -> DataFrame:
    """User inputs win over parsed features; a choice that isn't an option gives input_error. ``given``: input id to column."""
    known = {i.id: i for i in category.inputs}
    if extra := set(given) - set(known):
        raise RuleError(f"unknown input(s) for {category.id}: {sorted(extra)}")
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*known[i].options), F.lit(i)) for i, c in given.items() if known[i].type == "choice"]
    out = features
    for i, c in given.items():
        if known[i].feature:
            column = names.setdefault(known[i].feature, known[i].feature)
            old = F.col(f"`{column}`") if column in features.columns else F.lit(None)
            out = out.withColumn(column, F.coalesce(F.col(c), old))
    return out.withColumn("input_error", F.coalesce(*wrong) if wrong else F.lit(None).cast("string"))


# --- advice -----------------------------------------------------------------------------


def impact(points: Column) -> Column:
    return F.when(points >= HIGH, "high").when(points >= MEDIUM, "medium").otherwise("low")


def level(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for least, label in LEVELS:
        out = out.when(score >= least, label)
    return out


def as_text(x: Column, kind: str = "number") -> Column:
    """A value as advice shows it: a number without needless decimals, a list with commas or as none, a flag as True or False."""
    if kind == "list":
        return F.when(F.size(x) > 0, F.array_join(x, ", ")).when(x.isNotNull(), "none")
    if kind == "bool":
        return F.initcap(x.cast("string"))
    if kind not in ("number", "int"):
        return x.cast("string")
    x = x.cast("double")
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).when(x.isNotNull(), F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", ""))


def as_percent(x: Column, kind: str) -> Column:
    return F.concat(F.when(x.isNotNull(), F.format_string("%d", rounded(x.cast("double") * 100, 0).cast("long"))), F.lit("%")) if kind in ("number", "int") else as_text(x, kind)


def filled(template: Column, **values: Column) -> Column:
    """A template with its {names} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def suggestions(scores: DataFrame, category: Category, names: dict[str, str], key: str) -> DataFrame:
    """(key, signal, subscore, points, impact, text, rank) of what would raise the score, the most first; ties in the order of the rules."""
    wide, options = Wide(names), []
    order = {(s.id): (list(category.subscores).index(s.subscore), k) for k, s in enumerate(category.signals)}
    for k, s in enumerate(category.signals):
        if not (g := s.suggest):
            continue
        own = F.col("signals")[k]
        found = own["found"]
        now = F.when(found, own["score"].cast("double")).otherwise(0.0)
        points = rounded(F.greatest(F.lit(0.0), F.lit(g.target) - now) * own["nominal"] * 100, 1)
        silent = ~found & F.lit(s.missing == "exclude" and not g.text_missing)
        if g.only_if:
            silent = silent | (wide[g.only_if].isNull() if g.only_if in wide else F.lit(True))
        # The value of the term that scored best.
        stated = lambda show: F.coalesce(*[F.when(found & (own["feature"] == t.feature), show(wide[t.feature], FEATURES[t.feature])) for t in s.terms if t.feature in wide], F.lit("not stated"))  # noqa: B023, E731
        text = filled(F.when(found, g.text).otherwise(g.text_missing or g.text), value=stated(as_text), value_pct=stated(as_percent))
        use = ~silent & (~found | (now < g.below)) & (points > 0)
        options.append(F.when(use, F.struct(F.lit(s.id).alias("signal"), F.lit(s.subscore).alias("subscore"), points.alias("points"), impact(points).alias("impact"), text.alias("text"), F.lit(order[s.id][0]).alias("so"), F.lit(order[s.id][1]).alias("go"))))
    rows = scores.select(key, F.explode(F.filter(F.array(*options), lambda o: o.isNotNull())).alias("s")).select(key, "s.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("points").desc(), "so", "go"))
    return rows.withColumn("rank", rank).drop("so", "go")


def blend(strength: Column, fit: Column, ats: Column) -> Column:
    """The overall score, where there is a fit."""
    total = dec(strength) * dec(BLEND["strength"]) + dec(fit) * dec(BLEND["fit"]) + dec(ats) * dec(BLEND["ats"])
    return F.when(fit.isNotNull(), rounded(total.cast("double"), 1))


# --- rules as tables -------------------------------------------------------------------


def rule_tables(spark: SparkSession, categories: list[Category]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, signals, subscores) as small tables."""
    terms, signals, subs = [], [], []
    for c in categories:
        for so, (sub, w) in enumerate(c.subscores.items()):
            subs.append((c.id, sub, w, so))
        for go, s in enumerate(c.signals):
            signals.append((c.id, s.id, s.subscore, s.weight, s.missing, c.nominal(s), go))
            for k, t in enumerate(s.terms):
                r = t.rule
                terms.append((c.id, s.id, k, t.feature, r.kind, [(float(a), float(b)) for a, b in r.points], r.below, r.yes, r.no, [v.lower() for v in r.values]))
    point = "array<struct<x:double,y:double>>"
    return (
        spark.createDataFrame(terms, f"category string, signal string, term int, feature string, kind string, points {point}, below double, yes double, no double, known array<string>"),
        spark.createDataFrame(signals, "category string, signal string, subscore string, weight double, missing string, nominal double, go int"),
        spark.createDataFrame(subs, "category string, subscore string, sub_weight double, so int"),
    )


def table_score() -> Column:
    """The score of a joined (feature, term) row, with the points in a column."""
    x = F.when(F.col("kind") == "match_count", F.size(F.filter("items", lambda i: F.array_contains("known", F.lower(i)))).cast("double")).otherwise(F.col("num"))
    p = F.col("points")
    at = F.filter(p, lambda q: q["x"] <= x)
    low, high = F.try_element_at(at, F.lit(-1)), F.try_element_at(F.filter(p, lambda q: q["x"] > x), F.lit(1))
    line = F.when(low.isNull(), F.try_element_at(p, F.lit(1))["y"]).when(high.isNull(), F.try_element_at(p, F.lit(-1))["y"]).otherwise(
        low["y"] + (high["y"] - low["y"]) * ((x - low["x"]) / (high["x"] - low["x"]))
    )
    return F.when(F.col("kind") == "boolean", F.when(F.col("bool"), F.col("yes")).otherwise(F.col("no"))).when(F.col("kind") == "step", F.coalesce(low["y"], F.col("below"))).otherwise(line)


def scored_by_tables(features: DataFrame, docs: DataFrame, categories: list[Category]) -> DataFrame:
    """(doc_id, category, score, confidence) from long features (doc_id, feature, num, bool, items) and docs (doc_id, category)."""
    terms, signals, subs = rule_tables(features.sparkSession, categories)
    asked = docs.select("doc_id", "category")
    hits = asked.join(features, "doc_id").join(F.broadcast(terms), ["category", "feature"])  # terms: a fixed rule table
    empty = F.coalesce(~F.col("bool"), F.size("items") == 0, F.col("num") == 0, F.lit(False))
    best = hits.select("doc_id", "category", "signal", F.struct(table_score().alias("score"), (-F.col("term")).alias("place"), empty.alias("empty")).alias("b"))
    best = best.where("b.score is not null").groupBy("doc_id", "category", "signal").agg(F.max("b").alias("b"))
    every = asked.join(F.broadcast(signals), "category").join(best, ["doc_id", "category", "signal"], "left")
    score = F.when(F.col("b").isNotNull(), rounded("b.score", 4)).when(F.col("missing") == "zero", 0.0)
    every = every.withColumn("score", dec(score))
    mean = F.try_divide(F.sum(F.col("score") * dec(F.col("weight"))).cast("double"), F.nullif(F.sum(F.when(F.col("score").isNotNull(), dec(F.col("weight")))).cast("double"), F.lit(0.0)))
    known = F.sum(F.when(F.col("b").isNotNull() & ~F.col("b.empty"), dec(F.col("nominal"), 8)))
    per = every.groupBy("doc_id", "category", "subscore").agg(rounded(mean * 100, 1).alias("sub"), known.alias("known"))
    per = per.join(F.broadcast(subs), ["category", "subscore"])
    w = dec(F.col("sub_weight"))
    overall = F.try_divide(F.sum(dec(F.col("sub")) * w).cast("double"), F.sum(F.when(F.col("sub").isNotNull(), w)).cast("double"))
    return per.groupBy("doc_id", "category").agg(F.coalesce(rounded(overall, 1), F.lit(0.0)).alias("score"), F.coalesce(rounded(F.sum("known").cast("double"), 2), F.lit(0.0)).alias("confidence"))
