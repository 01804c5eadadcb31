from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scanloom.operators import history as hist
from scanloom.sources.history import HISTORY_SCHEMA, append_history, read_history


def history(spark, specs):
    """Scans from (id, type, source, time, critical, high, medium, low, score)."""
    data = [(i, t, s, datetime.fromisoformat(ts), c + h + m + lo, c, h, m, lo, float(score), "A")
            for i, t, s, ts, c, h, m, lo, score in specs]
    return spark.createDataFrame(data, HISTORY_SCHEMA)


SCANS = [
    ("1", "zip", "App.zip", "2024-01-01T00:00:00", 1, 0, 0, 0, 90), ("2", "repository", "repo", "2024-01-03T00:00:00", 0, 2, 0, 1, 89),
    ("3", "text", "x", "2024-01-02T00:00:00", 0, 0, 0, 0, 100), ("4", "odd", "y", "2024-01-04T00:00:00", 0, 0, 3, 0, 94),
]


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "h")
    assert read_history(spark, path).count() == 0
    append_history(history(spark, SCANS[:2]), path)
    append_history(history(spark, SCANS[2:]), path)
    got = read_history(spark, path)
    assert [r.id for r in hist.newest(got).collect()] == ["4", "2", "1"]  # pasted text is not recorded


def test_only_the_newest_are_listed(spark):
    many = history(spark, [(f"{i:03d}", "zip", "s", "2024-01-01T00:00:00", 0, 0, 0, 0, 100) for i in range(120)])
    assert [r.id for r in hist.newest(many).collect()] == [f"{i:03d}" for i in range(119, 69, -1)]
    assert [r.id for r in hist.trend(many).collect()] == [f"{i:03d}" for i in range(113, 120)]


def test_kpis(spark):
    row = hist.kpis(history(spark, SCANS)).first()
    assert (row.scans, row.average_score, row.total_found, row.latest_scan, row.grade) == (4, 93, 7, "4", "A")
    none = hist.kpis(history(spark, [])).first()
    assert (none.scans, none.average_score, none.total_found, none.latest_scan, none.grade) == (0, 100, 0, None, "A+")


def test_half_points_round_up(spark):
    two = [("1", "zip", "s", "2024-01-01T00:00:00", 0, 0, 0, 0, 90), ("2", "zip", "s", "2024-01-01T00:00:00", 0, 0, 0, 0, 91)]
    assert hist.kpis(history(spark, two)).first().average_score == 91


def test_risk_and_labels(spark):
    got = {r.id: (r.project_status, r.report_risk, r.scan_type_label) for r in hist.with_risk(history(spark, SCANS)).collect()}
    assert got == {"1": ("Critical", "Critical", "ZIP Archive"), "2": ("High", "High", "Repository"),
                   "3": ("Clean", "Low", "Code Snippet"), "4": ("Medium", "Medium", "odd")}


@pytest.mark.parametrize("as_of, age", [
    ("2024-01-01 00:00:59", "just now"), ("2024-01-01 00:01:00", "1m ago"), ("2024-01-01 00:59:59", "59m ago"),
    ("2024-01-01 01:00:00", "1h ago"), ("2024-01-01 23:59:59", "23h ago"), ("2024-01-02 00:00:00", "1d ago"),
    ("2024-03-01 00:00:00", "60d ago"), ("2023-12-31 00:00:00", "just now"),
])
def test_age(spark, as_of, age):
    got = hist.with_age(history(spark, SCANS[:1]), F.lit(as_of).cast("timestamp"))
    assert got.first().age == age


def test_search(spark):
    df = history(spark, SCANS)
    assert [r.id for r in hist.search_history(df, "APP").collect()] == ["1"]
    assert {r.id for r in hist.search_history(df, "Repo").collect()} == {"2"}
    assert hist.search_history(df, "").count() == 4
