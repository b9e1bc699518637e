import copy
import json

import pytest

from scoreloom.plans import rules

BASE = {
    "id": "base", "subscores": {"a": {"weight": 1}}, "inputs": [{"id": "kind", "type": "choice", "options": ["x", "y"]}],
    "signals": [{"id": "s", "subscore": "a", "feature": "projects.count", "rule": {"type": "bands", "points": [[0, 0], [2, 1]]}}],
    "eligibility": [{"id": "g", "feature": "academics.ug_cgpa", "min": 6, "adjust": [{"when": {"kind": "x"}, "delta": -1}]}],
}


def changed(path, value):
    raw = copy.deepcopy(BASE)
    at = raw
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return raw


def test_shipped_rule_sets_load():
    found = rules.load()
    assert len(found) == 7
    for c in found.values():
        assert abs(sum(c.nominal(s) for s in c.signals) - 1) < 1e-9
    assert found["tech_internship"].gates == found["tech_product_fulltime"].gates
    assert [s.missing for s in found["tech_internship"].signals if s.id == "product_company"] == ["exclude"]


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        (["colour"], 1, "unknown category key"),
        (["subscores", "a", "weight"], 0.5, "sum to 0.5"),
        (["signals", 0, "rule", "points"], [[0, 0]], "at least 2"),
        (["signals", 0, "rule", "points"], [[0, 0], [0, 1]], "strictly increasing"),
        (["signals", 0, "rule", "points"], [[0, 0], [1, 2]], "between 0 and 1"),
        (["signals", 0, "feature"], "no.such", "unknown feature"),
        (["signals", 0, "feature"], "contact.github", "can't score"),
        (["signals", 0, "any_of"], [], "either feature and rule, or any_of"),
        (["signals", 0, "subscore"], "b", "unknown sub-score"),
        (["subscores"], {"a": {"weight": 0.5}, "b": {"weight": 0.5}}, "without signals"),
        (["eligibility", 0, "min"], None, "min, max or equals"),
        (["eligibility", 0, "adjust", 0, "when"], {"age": 1}, "undeclared input"),
        (["inputs", 0, "options"], [], "options exactly"),
    ],
)
def test_errors_name_the_place(path, value, message):
    with pytest.raises(rules.RuleError, match=message):
        rules.category_of(changed(path, value))


def test_inheritance_merges_by_id_and_removes():
    child = {"id": "child", "extends": "base", "signals": [{"id": "s", "weight": 2}, {"id": "t", "subscore": "a", "feature": "contact.github", "rule": {"type": "boolean"}}], "remove_eligibility": ["g"]}
    found = rules.resolve({"base": BASE | {"abstract": True}, "child": child})
    assert set(found) == {"child"}
    assert [(s.id, s.weight) for s in found["child"].signals] == [("s", 2.0), ("t", 1.0)]
    assert not found["child"].gates


def test_cycles_and_unknown_parents():
    with pytest.raises(rules.RuleError, match="extends itself"):
        rules.resolve({"a": {"id": "a", "extends": "b"}, "b": {"id": "b", "extends": "a"}})
    with pytest.raises(rules.RuleError, match="unknown parent"):
        rules.resolve({"a": {"id": "a", "extends": "z"}})


def test_file_names_and_lookup(tmp_path):
    (tmp_path / "other.json").write_text(json.dumps(BASE))
    with pytest.raises(rules.RuleError, match="differs from the file"):
        rules.load(tmp_path)
    with pytest.raises(rules.RuleError, match="there are"):
        rules.lookup(rules.load(), "nothing")
