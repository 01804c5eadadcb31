import json

import pytest

from scanloom.fixed_values import LANGUAGE_KEYS
from scanloom.operators.dependencies import load_advisories, read_advisories
from scanloom.rules import (
    RULES_PATH_CONF, builtin_rules, catalog_df, collect_rules, language_rules, load_rules, merge_rules, parse_rule_packs,
    read_rule_pack,
)


def pack(tmp_path, rules, name="pack.json"):
    path = tmp_path / name
    path.write_text(json.dumps({"name": "p", "rules": rules}))
    return str(path)


def test_catalogue_counts():
    rules = builtin_rules()
    assert len(rules) == 93 and len({r.id for r in rules}) == 93
    assert sum(len(r.patterns) for r in rules) == 318
    assert sum(len(r.multi_line_patterns) for r in rules) == 37
    severities = [r.severity for r in rules]
    assert [severities.count(s) for s in ("Critical", "High", "Medium", "Low")] == [34, 41, 17, 1]
    categories = [r.category for r in rules]
    assert {c: categories.count(c) for c in set(categories)} == {
        "A01": 7, "A02": 8, "A03": 30, "A04": 6, "A05": 18, "A06": 3, "A07": 4, "A08": 6, "A09": 3, "A10": 4,
        "Best Practice": 4}
    ecosystems = [a["ecosystem"] for a in load_advisories()]
    assert [ecosystems.count(e) for e in ("npm", "pypi", "go", "cargo")] == [25, 20, 4, 3]


def test_rules_of_a_language():
    rules = builtin_rules()
    assert [r.id for r in language_rules(rules, "typescript")] == [r.id for r in language_rules(rules, "javascript")]
    assert {x for x in LANGUAGE_KEYS if not language_rules(rules, x)} == {"html", "css", "xml", "json", "rust", "dart"}
    assert "DOCKER-005" in [r.id for r in language_rules(rules, "yaml")]


def test_custom_rule_defaults(spark, tmp_path):
    path = pack(tmp_path, [{}, {"id": "X", "severity": "CRITICAL", "patterns": ["a"], "languages": ["go"]},
                           {"id": "Y", "severity": "weird", "multi_line_patterns": ["b"]}])
    rows = read_rule_pack(spark, path).orderBy("position").collect()
    assert [(r.id, r.name, r.category, r.severity) for r in rows] == [
        ("CUSTOM-000", "Custom Rule", "Custom", "Medium"), ("X", "Custom Rule", "Custom", "Critical"),
        ("Y", "Custom Rule", "Custom", "Medium")]
    assert [(r.patterns, r.multi_line_patterns, r.languages) for r in rows] == [
        ([], [], []), (["a"], [], ["go"]), ([], ["b"], [])]


@pytest.mark.parametrize("text", ["{ not json", "", "{'rules': []}", '{"rules": []} x', '{"rules": []},{}'])
def test_missing_pack_has_no_rules_and_broken_pack_fails(spark, tmp_path, text):
    assert read_rule_pack(spark, str(tmp_path / "none.json")).count() == 0
    broken = tmp_path / "broken.json"
    broken.write_text(text)
    with pytest.raises(Exception):
        read_rule_pack(spark, str(broken)).collect()


def test_merge_replaces_in_place_and_appends(spark, tmp_path):
    path = pack(tmp_path, [
        {"id": "A02-PHP-001", "name": "first"}, {"id": "NEW", "name": "n1"}, {"id": "A02-PHP-001", "name": "last"},
        {"id": "NEW", "name": "n2"}])
    builtin = builtin_rules()
    merged = collect_rules(spark, merge_rules(catalog_df(spark, builtin), read_rule_pack(spark, path)))
    assert len(merged) == 95
    at = [r.id for r in builtin].index("A02-PHP-001")
    assert (merged[at].id, merged[at].name) == ("A02-PHP-001", "last")
    assert [(r.id, r.name) for r in merged[93:]] == [("NEW", "n1"), ("NEW", "n2")]
    assert [r.ord for r in merged] == list(range(1, 96))
    assert [r.patterns for i, r in enumerate(merged[:93]) if i != at] == [r.patterns for i, r in enumerate(builtin) if i != at]


def test_rule_path_is_a_parameter(spark, tmp_path):
    path = pack(tmp_path, [{"id": "NEW", "patterns": ["x"], "languages": ["go"]}])
    spark.conf.set(RULES_PATH_CONF, path)
    try:
        assert len(load_rules(spark)) == 94
    finally:
        spark.conf.unset(RULES_PATH_CONF)
    assert len(load_rules(spark)) == 93


def test_patterns_java_cannot_run_are_reported_early(spark, tmp_path):
    path = pack(tmp_path, [{"id": "NEW", "patterns": ["(a)?(?(1)b|c)"], "languages": ["go"]}])
    with pytest.raises(Exception):
        load_rules(spark, path)


def test_bad_patterns_never_match(spark, tmp_path):
    path = pack(tmp_path, [{"id": "NEW", "patterns": ["(", "ok"], "languages": ["go"]}])
    rule = load_rules(spark, path)[-1]
    assert rule.patterns == ("(", "ok") and [p.idx for p in rule.single] == [1]


def test_packs_in_a_table(spark):
    df = spark.createDataFrame([(1, '{"rules": [{"id": "a"}, {"id": "b"}]}'), (2, "{}")], "k int, json string")
    assert [(r.k, r.position, r.id) for r in parse_rule_packs(df).collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_extra_advisories_win(tmp_path):
    path = tmp_path / "adv.json"
    path.write_text(json.dumps({"advisories": [
        {"ecosystem": "npm", "package": "lodash", "severity": "Low", "reason": "r", "safe_version": "1"},
        {"ecosystem": "go", "package": "example.org/x", "severity": "High", "reason": "r"}]}))
    listed = {(a["ecosystem"], a["package"]): a["severity"] for a in read_advisories(str(path))}
    assert len(listed) == 53 and listed["npm", "lodash"] == "Low"
