"""Roll-ups of findings. ``findings`` may hold one row with a null rule_id for each clean file (keep_clean)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.fixed_values import MATCH_TYPES, SEVERITY_ORDER
from scanloom.functions.scoring import grade, score_band, score_of_penalty, severity_order, severity_weight

SEVERITIES = list(SEVERITY_ORDER)


def _total() -> Column:
    return F.count("rule_id").alias("total")


def _counts(column: str, values: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names)]


def severity_counts() -> list[Column]:
    return _counts("severity", SEVERITIES, [s.lower() for s in SEVERITIES])


def finding_totals(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings.groupBy(*by).agg(_total())


def _zero_filled(findings: DataFrame, column: str, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count of every listed value, also where it is nought; other values are left out."""
    names = [f"n{i}" for i in range(len(values))]
    wide = findings.groupBy(*by).agg(*_counts(column, values, names))
    pairs = ", ".join(f"'{v}', {n}" for v, n in zip(values, names))
    return wide.select(*by, F.expr(f"stack({len(values)}, {pairs}) as ({column}, findings)"))


def by_severity(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _zero_filled(findings, "severity", SEVERITIES, by)


def by_match_type(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _zero_filled(findings, "match_type", MATCH_TYPES, by)


def by_category(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings.filter(F.col("rule_id").isNotNull()).groupBy(*by, "category").agg(
        F.count("*").alias("findings")).orderBy(*by, "category")


def by_file(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings.filter(F.col("rule_id").isNotNull()).groupBy(*by, "file_path").agg(F.count("*").alias("findings"))


def distinct_categories(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


def security_score(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score per group; groups need a row even without findings, which keep_clean provides."""
    penalty = F.sum(severity_weight(F.col("severity")))
    return findings.groupBy(*by).agg(_total(), score_of_penalty(penalty).alias("score"))


def security_grade(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    scored = security_score(findings, by)
    return scored.withColumns({"grade": grade(F.col("score")), "band": score_band(F.col("score"))})


def scan_summary(findings: DataFrame, by: Sequence[str], extra: DataFrame | None = None) -> DataFrame:
    """One row per scan: totals, severities, score and grade; columns of ``extra`` (by scan) replace those here.

    Scans of ``extra`` without findings have totals of nought and the best score.
    """
    summary = findings.groupBy(*by).agg(
        _total(), *severity_counts(),
        *_counts("match_type", MATCH_TYPES, ["single_line", "multi_line", "secret", "dependency"]),
        score_of_penalty(F.sum(severity_weight(F.col("severity")))).alias("score"),
    ).withColumn("grade", grade(F.col("score")))
    if extra is None:
        return summary
    replaced = [c for c in extra.columns if c not in by]
    joined = summary.drop(*replaced).join(extra, list(by), "full")
    best = F.lit(100.0)
    nothing = {c: F.lit("A+") if c == "grade" else best if c == "score" else F.lit(0)
               for c in summary.columns if c not in (*by, *replaced)}
    return joined.withColumns({c: F.coalesce(c, value) for c, value in nothing.items()})


def languages_detected(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sorted languages of each scan, no more than the known languages; empty where none is known."""
    known = F.collect_set(F.when(F.col("language") != "unknown", F.col("language")))
    return files.groupBy(*by).agg(F.array_join(F.array_sort(known), ",").alias("languages"))


def executive_summary(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """The summary as metric/value rows, in the order a report shows them."""
    metrics = [
        ("Total Vulnerabilities", F.col("total").cast("string")),
        *[(s, F.col(s.lower()).cast("string")) for s in SEVERITIES],
        ("Security Score", F.concat(F.col("score").cast("int").cast("string"), F.lit("/100"))),
        ("Security Grade", F.col("grade")),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
        for i, (name, value) in enumerate(metrics, 1)
    ])
    return summary.select(*by, F.inline(rows))


def quality_gate(findings: DataFrame, by: Sequence[str], minimum: str = "Low", fail_on_critical: bool = True,
                 fail_on_high: bool = False) -> DataFrame:
    """Findings at or above ``minimum`` per group, and whether the group fails the gate."""
    reported = severity_order(F.col("severity")) <= SEVERITY_ORDER[minimum]
    failing = F.lit(False)
    if fail_on_critical:
        failing = failing | (F.col("severity") == "Critical")
    if fail_on_high:
        failing = failing | (F.col("severity") == "High")
    return findings.groupBy(*by).agg(
        F.count_if(reported).alias("reported"),
        F.coalesce(F.bool_or(failing), F.lit(False)).alias("failed"))


def files_scanned(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files left after pruning folders, of any kind."""
    return files.groupBy(*by).agg(F.count_if(F.col("listed")).alias("files_scanned"))
