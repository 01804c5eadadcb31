"""Operators over the scan history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.fixed_values import HISTORY_KEEP, TREND_SCANS
from scanloom.functions.scoring import age_bucket, grade, js_round, risk_status, scan_type_label
from scanloom.operators.findings import search


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("id").desc()]


def newest(history: DataFrame, n: int = HISTORY_KEEP) -> DataFrame:
    return history.orderBy(*newest_first()).limit(n)


def trend(history: DataFrame, n: int = TREND_SCANS) -> DataFrame:
    """The last ``n`` scans, oldest first."""
    return newest(history, n).orderBy("ts", "id").select("id", "source", "critical", "high", "medium", "low")


def kpis(history: DataFrame) -> DataFrame:
    """Totals over all scans, their mean score (100 without scans) and the latest scan."""
    mean = js_round(F.avg("score"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_found") for c in ("total", "critical", "high", "medium", "low")]
    latest = F.max_by("id", F.struct("ts", "id"))
    return history.agg(F.count("*").alias("scans"), F.coalesce(mean, F.lit(100)).cast("long").alias("average_score"),
                       *sums, latest.alias("latest_scan")).withColumn("grade", grade(F.col("average_score")))


def with_risk(history: DataFrame) -> DataFrame:
    args = F.col("critical"), F.col("high"), F.col("total")
    return history.withColumns({
        "project_status": risk_status(*args),
        "report_risk": risk_status(*args, clean="Low"),
        "scan_type_label": scan_type_label(F.col("scan_type")),
    })


def with_age(history: DataFrame, as_of: Column) -> DataFrame:
    return history.withColumn("age", age_bucket(F.col("ts"), as_of))


def search_history(history: DataFrame, text: str) -> DataFrame:
    return search(history, text, ["source", "scan_type"])
