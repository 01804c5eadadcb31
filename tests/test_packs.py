"""Packs larger than what may be broadcast at once."""

import json
import time
from collections import Counter

from pyspark.sql import functions as F
from test_match import code_like_texts

from scanloom.operators import match
from scanloom.plans.scan import FINDING_COLUMNS, ORDER_COLUMNS, scan_code
from scanloom.rules import Rule, builtin_rules, load_rules, secret_rules


def rows_of(found):
    return Counter(tuple(r) for r in found.collect())


def test_each_rule_is_in_one_chunk_of_bounded_size():
    limit = 60_000
    chunks = match.rule_chunks(builtin_rules(), secret_rules(), limit)
    assert len(chunks) > 2
    assert Counter(r.ord for rules, _ in chunks for r in rules) == Counter(r.ord for r in builtin_rules())
    assert Counter(r.ord for _, secrets in chunks for r in secrets) == Counter(r.ord for r in secret_rules())
    for rules, secrets in chunks:
        size = sum(map(match._bytes_of, rules)) + sum(match._bytes_of(r, everywhere=True) for r in secrets)
        assert size <= limit or len({r.id for r in rules}) + len(secrets) == 1
    assert match.rule_chunks([], []) == [([], [])]


def test_rules_of_one_id_with_multi_line_patterns_stay_together():
    def rule(i, name, multi=()):
        return Rule.of(i, {"id": name, "name": "n", "category": "c", "severity": "Low", "languages": ["python"], "patterns": [f"word{i}"],
                           "multi_line_patterns": multi, "description": "", "remediation": ""})

    rules = [rule(1, "A", [r"a\nb"]), rule(2, "B"), rule(3, "A"), rule(4, "B")]
    chunks = [[r.ord for r in chunk] for chunk, _ in match.rule_chunks(rules, [], 1)]
    assert chunks == [[1, 3], [2], [4]]


def test_chunks_find_what_one_pass_finds(spark):
    texts = code_like_texts(150, 7) + [("python", None), ("cobol", "x"), (None, "token = 'abcdef'"), ("python", "")]
    files = spark.createDataFrame(
        [(f"f{i}", t, lang, bytes([i % 250])) for i, (lang, t) in enumerate(texts)], "path string, content string, language string, raw binary")
    for options in ({}, {"keep_clean": True, "once": ["raw"]}, {"multi_line": False}):
        whole = scan_code(files, **options)
        parts = scan_code(files, **options, chunk_bytes=100_000)
        assert whole.schema == parts.schema
        order = [c for c in whole.columns if c != "raw"]
        assert rows_of(whole.select(order)) == rows_of(parts.select(order))
        if "once" in options:
            # Each file hands its bytes on once, whether it has findings or not.
            given = parts.filter(F.col("raw").isNotNull()).groupBy("file_path").count().collect()
            assert sorted(r["file_path"] for r in given) == sorted(f"f{i}" for i in range(len(texts)))
            assert {r["count"] for r in given} == {1}
    assert {*FINDING_COLUMNS, *ORDER_COLUMNS} <= set(whole.columns)


def test_pack_of_fifty_thousand_rules_scans_completely(spark, tmp_path):
    count, per_file = 50_000, 25
    path = tmp_path / "pack.json"
    path.write_text(json.dumps({"rules": [
        {"id": f"X-{i}", "name": "x", "category": "x", "severity": "High", "languages": ["python"], "patterns": [rf"needle{i:05d}_\w+\("],
         "multi_line_patterns": [], "description": "d" * 40, "remediation": "r" * 40} for i in range(count)]}))
    began = time.monotonic()
    rules = load_rules(spark, str(path))
    assert len(rules) == len(builtin_rules()) + count
    assert len(match.rule_chunks(rules, [])) >= 2
    step = count // 40
    texts = [(f"f{k}.py", "\n".join(f"needle{(k * step + j * 37) % count:05d}_call(x)" for j in range(per_file)), "python") for k in range(40)]
    files = spark.createDataFrame(texts, "path string, content string, language string").repartition(8)
    found = scan_code(files, rules, []).filter(F.col("rule_id").startswith("X-")).select("file_path", "line_number", "rule_id").collect()
    expected = {(f"f{k}.py", j + 1, f"X-{(k * step + j * 37) % count}") for k in range(40) for j in range(per_file)}
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    assert time.monotonic() - began < 300
