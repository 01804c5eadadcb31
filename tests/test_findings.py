import csv
import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanloom.operators import findings as fnd
from scanloom.operators import metrics as met
from scanloom.plans import queries
from scanloom.plans.scan import FINDING_COLUMNS
from scanloom.sources import reports


def rows(spark, specs):
    """Findings from (repo, path, pass, rule, line, severity) tuples."""
    base = spark.createDataFrame(specs, "repo string, file_path string, pass_ord int, rule_id string, line_number int, severity string")
    types = ["single-line", "multi-line", "secret", "dependency"]
    return base.select(
        "*", F.lit("n").alias("rule_name"), F.lit("A01").alias("category"), F.lit(None).cast("int").alias("line_end"),
        F.lit("s").alias("code_snippet"), F.lit("d, \"q\"").alias("description"), F.lit("r").alias("remediation"),
        F.lit("p").alias("matched_pattern"), F.get(F.array(*[F.lit(t) for t in types]), "pass_ord").alias("match_type"),
        F.lit("").alias("cwe"), F.lit("").alias("owasp"), F.lit(1).alias("rule_ord"), F.lit(0).alias("pattern_idx"),
        F.lit(0).alias("match_idx"))


def test_numbering_with_one_repo_holding_most_rows(spark):
    specs = [("hot", f"f{i % 97:03d}", i % 4, f"R{i % 5}", i, "Low") for i in range(5000)]
    specs += [(f"r{i % 40}", "f", 0, "R", i, "Low") for i in range(300)]
    df = rows(spark, specs).repartition(6)
    got = fnd.number_findings(df, "repo")
    w = Window.partitionBy("repo").orderBy(*fnd.report_order())
    want = df.withColumn("finding_number", F.row_number().over(w))
    cols = ["repo", "file_path", "pass_ord", "rule_id", "line_number", "finding_number"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    totals = {r.repo: r.findings_in_group for r in got.collect()}
    assert totals["hot"] == 5000 and sum(totals.values()) == 5300


def test_numbering_spreads_a_hot_group(spark):
    """The placement must split one group over several partitions."""
    df = rows(spark, [("hot", f"f{i}", 0, "R", i, "Low") for i in range(20000)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        keys = [F.col("repo"), *fnd.report_order()]
        parts = df.repartitionByRange(*keys).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert len(parts) == 8 and max(r["count"] for r in parts) < 5000


def test_first_findings(spark):
    df = rows(spark, [("a", "f", 0, "R", i, "Low") for i in range(25)] + [("b", "f", 0, "R", 1, "Low")])
    got = fnd.first_findings(df, "repo").collect()
    assert sorted((r.finding_number, r.remaining) for r in got if r.repo == "a") == [(i, 5) for i in range(1, 21)]
    assert [(r.finding_number, r.remaining) for r in got if r.repo == "b"] == [(1, 0)]


def test_report_order(spark):
    specs = [("a", "f", 3, "D", 1, "Low"), ("a", "f", 1, "B", 1, "Low"), ("a", "f", 1, "A", 9, "Low"), ("a", "f", 2, "S", 2, "Low"),
             ("a", "f", 0, "Z", 7, "Low"), ("a", "f", 0, "Z", 2, "Low")]
    got = fnd.canonical_order(rows(spark, specs)).collect()
    assert [(r.pass_ord, r.rule_id, r.line_number) for r in got] == [
        (0, "Z", 2), (0, "Z", 7), (1, "A", 9), (1, "B", 1), (2, "S", 2), (3, "D", 1)]


@pytest.mark.parametrize("kind, want", [
    ("repository", [(0, "a"), (1, "a"), (0, "b"), (2, "a"), (3, "a"), (2, "b")]),
    ("zip", [(0, "a"), (1, "a"), (0, "b"), (2, "a"), (3, "a"), (2, "b")]),
    ("multi_file", [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (0, "b"), (2, "b")]),
])
def test_order_by_kind_of_scan(spark, kind, want):
    specs = [("r", f, p, "R", 1, "Low") for f, p in [("b", 2), ("a", 3), ("b", 0), ("a", 2), ("a", 1), ("a", 0)]]
    df = rows(spark, specs)
    assert [(r.pass_ord, r.file_path) for r in fnd.canonical_order(df, scan_type=kind).collect()] == want
    numbered = fnd.number_findings(df, "repo", kind).collect()
    assert [(r.pass_ord, r.file_path) for r in sorted(numbered, key=lambda r: r.finding_number)] == want
    first = fnd.first_findings(df, "repo", 4, kind).collect()
    assert [(r.pass_ord, r.file_path, r.remaining) for r in sorted(first, key=lambda r: r.finding_number)] == [(*w, 2) for w in want[:4]]


def test_numbering_of_a_group_without_a_name(spark):
    df = rows(spark, [(None, "f", 0, "R", i, "Low") for i in range(3)] + [("a", "f", 0, "R", 1, "Low")])
    assert sorted((r.repo or "", r.finding_number, r.findings_in_group) for r in fnd.number_findings(df, "repo").collect()) == [
        ("", 1, 3), ("", 2, 3), ("", 3, 3), ("a", 1, 1)]
    assert fnd.first_findings(df, "repo", 2).count() == 3


def test_only_keys_are_ranked(spark):
    """What is shuffled, sorted and kept by rank must not carry the findings' texts."""
    df = fnd._with_row_id(rows(spark, [("a", "f", 0, "R", 1, "Low")]))
    keys, order = fnd._keys(df, "repo", "zip")
    assert keys.columns == ["_group", *order] and len(order) == len(fnd.report_order("zip")) + 1


def test_order_by_severity(spark):
    specs = [("a", "f", 0, "R", i, s) for i, s in enumerate(["Low", "odd", "Critical", "Medium", "High", "Critical"])]
    got = fnd.order_by_severity(rows(spark, specs)).collect()
    assert [(r.severity, r.line_number) for r in got] == [
        ("Critical", 2), ("Critical", 5), ("High", 4), ("Medium", 3), ("Low", 0), ("odd", 1)]


def test_filters_and_search(spark):
    df = rows(spark, [("a", "F.py", 0, "R", 1, "High"), ("a", "g.js", 0, "R", 2, "Low")])
    assert fnd.filter_findings(df).count() == 2
    assert fnd.filter_findings(df, severity="High").count() == 1
    assert fnd.filter_findings(df, category="A02").count() == 0
    assert [r.line_number for r in fnd.search_findings(df, "f.PY").collect()] == [1]
    assert fnd.search_findings(df, "").count() == 2 and fnd.search_findings(df, "%").count() == 0
    assert [r.severity for r in fnd.at_least(df, "Medium").collect()] == ["High"]


def test_wire_round_trip(spark):
    df = rows(spark, [("a", "f", 1, "R", 1, "High")])
    sent = fnd.wire(df).select(F.to_json(F.struct("*")).alias("json"))
    assert fnd.wire(fnd.from_wire(sent)).collect() == fnd.wire(df).collect()
    least = spark.createDataFrame([('{"rule_id": "R", "line_number": 3}',)], "json string")
    row = fnd.from_wire(least).first()
    assert (row.match_type, row.cwe, row.owasp, row.line_end, row.matched_pattern) == ("single-line", "", "", None, "")


def test_union_keeps_duplicates(spark):
    df = rows(spark, [("a", "f", 0, "R", 1, "Low")])
    assert fnd.union_findings(df, df, df).count() == 3


def test_finding_columns(spark, sf):
    assert set(FINDING_COLUMNS) <= set(queries.everything(spark, sf).columns)


def test_scores(spark):
    specs = [("a", "f", 0, "R", 1, "Critical"), ("a", "f", 0, "R", 2, "High"), ("b", "f", 0, None, None, None)]
    specs += [("c", "f", 0, "R", i, "Critical") for i in range(11)] + [("d", "f", 0, "R", 1, "odd")]
    got = {r.repo: (r.total, r.score, r.grade, r.band) for r in met.security_grade(rows(spark, specs), ["repo"]).collect()}
    assert got == {"a": (2, 85.0, "A", "good"), "b": (0, 100.0, "A+", "good"), "c": (11, 0.0, "F", "poor"),
                   "d": (1, 100.0, "A+", "good")}


@pytest.mark.parametrize("score, grade", [(100, "A+"), (95, "A+"), (94.9, "A"), (85, "A"), (75, "B"), (60, "C"), (40, "D"), (39, "F")])
def test_grades(spark, score, grade):
    from scanloom.functions.scoring import grade as of
    assert spark.range(1).select(of(F.lit(float(score))).alias("g")).first().g == grade


def test_zero_filled_counts(spark):
    df = rows(spark, [("a", "f", 2, "R", 1, "High"), ("a", "f", 0, "R", 2, "odd")])
    assert {r.severity: r.findings for r in met.by_severity(df).collect()} == {"Critical": 0, "High": 1, "Medium": 0, "Low": 0}
    assert {r.match_type: r.findings for r in met.by_match_type(df).collect()} == {
        "single-line": 1, "multi-line": 0, "secret": 1, "dependency": 0}


def test_quality_gate(spark):
    df = rows(spark, [("a", "f", 0, "R", 1, "High"), ("b", "f", 0, "R", 1, "Critical"), ("c", "f", 0, None, None, None)])
    got = {r.repo: (r.reported, r.failed) for r in met.quality_gate(df, ["repo"]).collect()}
    assert got == {"a": (1, False), "b": (1, True), "c": (0, False)}
    got = {r.repo: (r.reported, r.failed) for r in met.quality_gate(df, ["repo"], "Critical", False, True).collect()}
    assert got == {"a": (0, True), "b": (1, False), "c": (0, False)}


def test_summary_override(spark):
    df = rows(spark, [("a", "f", 0, "R", 1, "High")])
    extra = spark.createDataFrame([("a", 7, 99)], "repo string, files_scanned int, total int")
    row = met.scan_summary(df, ["repo"], extra).first()
    assert (row.files_scanned, row.total, row.high, row.grade) == (7, 99, 1, "A+")


def test_csv_and_json_reports(spark, tmp_path):
    df = rows(spark, [("a", "f,\"x\"", 0, "R", 1, "High"), ("a", "g", 1, "R", 2, "Low")]).withColumn(
        "line_end", F.when(F.col("pass_ord") == 1, 4))
    reports.write_csv(df, str(tmp_path / "csv"))
    parts = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    lines = []
    for f in sorted(parts):
        with open(tmp_path / "csv" / f, newline="") as h:
            lines += list(csv.DictReader(h))
    assert [(x["file_path"], x["line_end"], x["description"]) for x in lines] == [
        ('f,"x"', "", 'd, "q"'), ("g", "4", 'd, "q"')]
    assert list(lines[0]) == fnd.CSV_COLUMNS
    header = reports.report_header(met.scan_summary(df, ["repo"]), met.by_category(df, ["repo"]), "repo", F.lit("t"))
    reports.write_json(df, header, "repo", str(tmp_path / "json"))
    text = spark.read.text(str(tmp_path / "json" / "header")).collect()
    head = json.loads(text[0][0])
    assert head["metadata"] == {"generated_at": "t", "total_vulnerabilities": 2, "security_score": 94.0, "security_grade": "A"}
    assert head["statistics"]["by_category"] == {"A01": 2} and head["statistics"]["by_severity"]["Low"] == 1
    one = json.loads(spark.read.text(str(tmp_path / "json" / "vulnerabilities")).filter("value like '%f,%'").first()[0])
    assert one["line_end"] is None and set(one) == {"repo", *fnd.WIRE_COLUMNS}


def test_scans_without_findings_are_summed_up(spark):
    found = spark.createDataFrame([("one", "R", "High", "secret")], "repo string, rule_id string, severity string, match_type string")
    scanned = spark.createDataFrame([("one", 3), ("two", 5)], "repo string, files_scanned long")
    got = {r.repo: (r.total, r.high, r.secret, r.score, r.grade, r.files_scanned) for r in met.scan_summary(found, ["repo"], scanned).collect()}
    assert got["two"] == (0, 0, 0, 100.0, "A+", 5) and got["one"][:3] == (1, 1, 1)
    files = spark.createDataFrame([("a", "python"), ("a", "go"), ("a", "unknown"), ("b", "unknown")], "repo string, language string")
    assert {r.repo: r.languages for r in met.languages_detected(files, ["repo"]).collect()} == {"a": "go,python", "b": ""}
