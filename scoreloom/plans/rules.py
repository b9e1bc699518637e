"""The rule language: category files, inheritance, validation, and the typed form that plans are built from.

A category is a mapping with ``id``, ``label``, ``subscores`` ({id: {label, weight}}), ``signals``, ``eligibility``
(gates), ``inputs`` and hints. Files are JSON, or YAML where PyYAML is installed. ``extends`` names a parent: mappings
merge deeply, lists of mappings with ids merge by id, ``remove_<list>`` drops ids, ``abstract`` categories can only be
extended. Everything here runs on the driver; a rule set is a few kilobytes.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from scoreloom.functions.vocabulary import FEATURES

# Points and weights in these files are fixed values.
RULESETS = Path(__file__).resolve().parent.parent / "rulesets"
NUMERIC, TOLERANCE = ("number", "int"), 1e-3


class RuleError(ValueError):
    """A rule file that can't be used; the message names the file and the place."""


@dataclass(frozen=True)
class Rule:
    kind: str  # bands, step, boolean, match_count
    points: tuple[tuple[float, float], ...] = ()
    below: float = 0.0
    yes: float = 1.0
    no: float = 0.0
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Term:
    feature: str
    rule: Rule


@dataclass(frozen=True)
class Suggest:
    text: str
    below: float = 0.7
    target: float = 1.0
    text_missing: str | None = None
    only_if: str | None = None


@dataclass(frozen=True)
class Signal:
    id: str
    label: str
    subscore: str
    terms: tuple[Term, ...]
    weight: float = 1.0
    missing: str = "zero"
    suggest: Suggest | None = None


@dataclass(frozen=True)
class Adjust:
    input: str
    values: tuple[Any, ...]
    delta: float


@dataclass(frozen=True)
class Gate:
    id: str
    label: str
    feature: str
    min: float | None = None
    max: float | None = None
    equals: Any = None
    level: str = "fail"
    missing: str = "unknown"
    adjust: tuple[Adjust, ...] = ()
    mode: str = "sum"
    message: str = ""
    message_missing: str = ""


@dataclass(frozen=True)
class Input:
    id: str
    type: str
    feature: str | None = None
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    id: str
    label: str
    subscores: dict[str, float]
    signals: tuple[Signal, ...]
    gates: tuple[Gate, ...] = ()
    inputs: tuple[Input, ...] = ()
    sections: tuple[str, ...] = ()
    max_pages: int = 2
    role: str = ""
    linkedin_expected: bool = True
    order: tuple[str, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)

    def of(self, subscore: str) -> list[Signal]:
        return [s for s in self.signals if s.subscore == subscore]

    def nominal(self, signal: Signal) -> float:
        """A signal's share of the whole score."""
        return self.subscores[signal.subscore] * signal.weight / sum(s.weight for s in self.of(signal.subscore))


# --- validation -------------------------------------------------------------------

ALLOWED = {
    "category": {"id", "label", "description", "score_label", "last_reviewed", "notes", "sources", "examples", "inputs", "subscores", "signals", "eligibility", "ats", "generator"},
    "signal": {"id", "label", "subscore", "weight", "missing", "feature", "rule", "any_of", "suggest"},
    "suggest": {"text", "below", "target", "text_missing", "only_if"},
    "gate": {"id", "label", "feature", "min", "max", "equals", "level", "when_missing", "adjust", "adjust_mode", "message", "message_missing", "note"},
    "adjust": {"when", "delta"},
    "input": {"id", "label", "type", "feature", "options"},
    "rule": {"type", "points", "tiers", "below", "true", "false", "values"},
    "term": {"feature", "rule"},
    "ats": {"sections", "max_pages", "role", "linkedin_expected"},
    "generator": {"order"},
}
NEEDS = {"bands": NUMERIC, "step": NUMERIC, "boolean": ("bool",), "match_count": ("list",)}


def _known(kind: str, raw: Mapping[str, Any], where: str) -> None:
    if extra := set(raw) - ALLOWED[kind]:
        raise RuleError(f"{where}: unknown {kind} key(s) {sorted(extra)}")


def points_of(raw: Any, where: str, least: int = 2) -> tuple[tuple[float, float], ...]:
    points = tuple((float(x), float(y)) for x, y in raw or ())
    if len(points) < least:
        raise RuleError(f"{where}: at least {least} points are needed")
    if any(a[0] >= b[0] for a, b in zip(points, points[1:], strict=False)):
        raise RuleError(f"{where}: points must be strictly increasing in x")
    if any(not 0 <= y <= 1 for _, y in points):
        raise RuleError(f"{where}: scores must be between 0 and 1")
    return points


def _feature(name: Any, where: str) -> str:
    if name not in FEATURES:
        raise RuleError(f"{where}: unknown feature {name!r}")
    return name


def _rule(raw: Mapping[str, Any], feature: str, where: str) -> Rule:
    _known("rule", raw, where)
    kind = raw.get("type")
    if kind not in NEEDS:
        raise RuleError(f"{where}: unknown rule type {kind!r}")
    if FEATURES[feature] not in NEEDS[kind]:
        raise RuleError(f"{where}: a {kind} rule can't score {feature}, which is {FEATURES[feature]}")
    if kind == "boolean":
        return Rule(kind, yes=float(raw.get("true", 1)), no=float(raw.get("false", 0)))
    if kind == "step":
        return Rule(kind, points_of(raw.get("tiers", raw.get("points")), where, 1), below=float(raw.get("below", 0)))
    return Rule(kind, points_of(raw.get("points"), where), values=tuple(raw.get("values", ())))


def _signal(raw: Mapping[str, Any], where: str) -> Signal:
    where = f"{where}, signal {raw.get('id')}"
    _known("signal", raw, where)
    single, many = "feature" in raw or "rule" in raw, "any_of" in raw
    if single == many or (single and not {"feature", "rule"} <= set(raw)):
        raise RuleError(f"{where}: give either feature and rule, or any_of")
    terms = raw["any_of"] if many else [{"feature": raw["feature"], "rule": raw["rule"]}]
    if not terms:
        raise RuleError(f"{where}: any_of is empty")
    made = []
    for t in terms:
        _known("term", t, where)
        name = _feature(t.get("feature"), where)
        made.append(Term(name, _rule(t["rule"], name, where)))
    suggest = None
    if s := raw.get("suggest"):
        _known("suggest", s, where)
        if s.get("only_if"):
            _feature(s["only_if"], where)
        suggest = Suggest(s.get("text", ""), float(s.get("below", 0.7)), float(s.get("target", 1)), s.get("text_missing"), s.get("only_if"))
    weight, missing = float(raw.get("weight", 1)), raw.get("missing", "zero")
    if weight <= 0 or missing not in ("zero", "exclude"):
        raise RuleError(f"{where}: weight must be positive and missing zero or exclude")
    return Signal(raw["id"], raw.get("label", raw["id"]), raw["subscore"], tuple(made), weight, missing, suggest)


def _gate(raw: Mapping[str, Any], inputs: set[str], where: str) -> Gate:
    where = f"{where}, gate {raw.get('id')}"
    _known("gate", raw, where)
    if all(raw.get(k) is None for k in ("min", "max", "equals")):
        raise RuleError(f"{where}: min, max or equals is needed")
    adjust = []
    for a in raw.get("adjust", ()):
        _known("adjust", a, where)
        ((name, value),) = a["when"].items()
        if name not in inputs:
            raise RuleError(f"{where}: undeclared input {name!r}")
        adjust.append(Adjust(name, tuple(value) if isinstance(value, list) else (value,), float(a["delta"])))
    level, missing, mode = raw.get("level", "fail"), raw.get("when_missing", "unknown"), raw.get("adjust_mode", "sum")
    if level not in ("fail", "warn") or missing not in ("unknown", "warn", "fail", "skip") or mode not in ("sum", "largest"):
        raise RuleError(f"{where}: unknown level, when_missing or adjust_mode")
    number = lambda k: None if raw.get(k) is None else float(raw[k])
    return Gate(raw["id"], raw.get("label", raw["id"]), _feature(raw.get("feature"), where), number("min"), number("max"), raw.get("equals"), level, missing, tuple(adjust), mode, raw.get("message", ""), raw.get("message_missing", ""))


def category_of(raw: Mapping[str, Any], where: str = "category") -> Category:
    """Validates a merged category."""
    _known("category", raw, where)
    subs = {k: float(v["weight"]) for k, v in raw.get("subscores", {}).items()}
    if abs(sum(subs.values()) - 1) > TOLERANCE:
        raise RuleError(f"{where}: sub-score weights sum to {sum(subs.values()):g}, not 1")
    inputs = []
    for i in raw.get("inputs", ()):
        _known("input", i, where)
        if i.get("type") not in ("choice", "bool", "number", "date") or (i["type"] == "choice") != bool(i.get("options")):
            raise RuleError(f"{where}: input {i.get('id')!r} needs a known type, and options exactly if it is a choice")
        inputs.append(Input(i["id"], i["type"], _feature(i["feature"], where) if i.get("feature") else None, tuple(i.get("options", ()))))
    signals = [_signal(s, where) for s in raw.get("signals", ())]
    gates = [_gate(g, {i.id for i in inputs}, where) for g in raw.get("eligibility", ())]
    for what, ids in (("signal", [s.id for s in signals]), ("gate", [g.id for g in gates]), ("input", [i.id for i in inputs])):
        if len(set(ids)) < len(ids):
            raise RuleError(f"{where}: duplicate {what} id")
    if wrong := {s.subscore for s in signals} - set(subs):
        raise RuleError(f"{where}: unknown sub-score(s) {sorted(wrong)}")
    if bare := set(subs) - {s.subscore for s in signals}:
        raise RuleError(f"{where}: sub-score(s) without signals {sorted(bare)}")
    ats, gen = raw.get("ats", {}), raw.get("generator", {})
    _known("ats", ats, where)
    _known("generator", gen, where)
    return Category(
        raw["id"], raw.get("label", raw["id"]), subs, tuple(signals), tuple(gates), tuple(inputs),
        tuple(ats.get("sections", ())), int(ats.get("max_pages", 2)), ats.get("role", ""), bool(ats.get("linkedin_expected", True)), tuple(gen.get("order", ())),
    )


# --- files and inheritance ----------------------------------------------------------


def parse(text: str, suffix: str = ".json") -> dict[str, Any]:
    if suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuleError("YAML rule files need PyYAML; JSON files always work") from e
    return yaml.safe_load(text)


def merged(parent: dict[str, Any], child: dict[str, Any]) -> dict[str, Any]:
    """``child`` over ``parent``; keys ``remove_<list>`` of the child drop the parent's items of those ids."""
    out = dict(parent)
    for key, value in child.items():
        if key.startswith("remove_"):
            continue
        old = out.get(key)
        if isinstance(old, dict) and isinstance(value, dict):
            out[key] = merged(old, value)
        elif isinstance(old, list) and isinstance(value, list) and all(isinstance(x, dict) and "id" in x for x in old + value):
            mine = {x["id"]: x for x in value}
            out[key] = [merged(x, mine.pop(x["id"])) if x["id"] in mine else x for x in old] + [x for x in value if x["id"] in mine]
        else:
            out[key] = value
    for key, ids in child.items():
        if key.startswith("remove_") and isinstance(out.get(name := key.removeprefix("remove_")), list):
            out[name] = [x for x in out[name] if x.get("id") not in ids]
        elif key.startswith("remove_") and isinstance(out.get(name), dict):
            out[name] = {k: v for k, v in out[name].items() if k not in ids}
    for item in out.get("signals", ()):  # an override of one kind of source ends the other kind
        if "any_of" in item and "feature" in item:
            item.pop("any_of")
    return out


def resolve(raw: dict[str, dict[str, Any]]) -> dict[str, Category]:
    """All categories by id that aren't abstract; parents are validated before their children."""
    done: dict[str, dict[str, Any]] = {}
    made: dict[str, Category] = {}

    def visit(name: str, path: tuple[str, ...]) -> dict[str, Any]:
        if name in path:
            raise RuleError(f"{name}: extends itself by way of {' > '.join(path)}")
        if name not in raw:
            raise RuleError(f"{path[-1] if path else name}: unknown parent {name!r}")
        if name not in done:
            own = {k: v for k, v in raw[name].items() if k not in ("extends", "abstract")}
            if parent := raw[name].get("extends"):
                own = merged(visit(parent, (*path, name)), own)
            done[name] = {k: v for k, v in own.items() if not k.startswith("remove_")}
            if not raw[name].get("abstract"):
                made[name] = category_of(done[name], name)
        return done[name]

    for name in sorted(raw):
        visit(name, ())
    return made


def load(folder: str | Path = RULESETS) -> dict[str, Category]:
    raw = {}
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".json", ".yaml", ".yml")):
        own = parse(path.read_text(encoding="utf-8"), path.suffix)
        if own.get("id") != path.stem:
            raise RuleError(f"{path.name}: id {own.get('id')!r} differs from the file's name")
        raw[path.stem] = own
    return resolve(raw)


def lookup(categories: Mapping[str, Category], name: str) -> Category:
    if name not in categories:
        raise RuleError(f"unknown category {name!r}; there are {', '.join(sorted(categories))}")
    return categories[name]
