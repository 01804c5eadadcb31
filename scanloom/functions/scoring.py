"""Severity, score, grade and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.fixed_values import (
    GRADE_FLOORS, LOWEST_GRADE, SCAN_TYPE_LABELS, SEVERITY_ORDER, SEVERITY_WEIGHT, UNKNOWN_SEVERITY_ORDER,
)


def _by_name(name: Column, table: dict, default) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def severity_weight(severity: Column) -> Column:
    return _by_name(severity, SEVERITY_WEIGHT, 0)


def severity_order(severity: Column) -> Column:
    return _by_name(severity, SEVERITY_ORDER, UNKNOWN_SEVERITY_ORDER)


def score_of_penalty(penalty: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.least(F.coalesce(penalty, F.lit(0)), F.lit(100))).cast("double")


def grade(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= floor, F.lit(g)) for floor, g in GRADE_FLOORS], F.lit(LOWEST_GRADE))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def risk_status(critical: Column, high: Column, total: Column, clean: str = "Clean") -> Column:
    return (F.when(critical > 0, "Critical").when(F.coalesce(high, F.lit(0)) > 0, "High")
            .when(total > 0, "Medium").otherwise(clean))


def scan_type_label(scan_type: Column) -> Column:
    return F.coalesce(*[F.when(scan_type == k, F.lit(v)) for k, v in SCAN_TYPE_LABELS.items()], scan_type)


def age_bucket(then: Column, as_of: Column) -> Column:
    """Age at ``as_of`` in whole minutes, hours or days, each rounded down."""
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(then)) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{unit} ago"))

    return (F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m"))
            .when(hours < 24, ago(hours, "h")).otherwise(ago(days, "d")))


def js_round(x: Column) -> Column:
    """Half rounds up, also below zero."""
    return F.floor(x + 0.5)
