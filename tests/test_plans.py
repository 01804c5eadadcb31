"""What the physical plans must and must not hold."""

import re

from scanloom.plans import queries
from scanloom.plans.scan import scan_code, scan_sast, with_language
from scanloom.sources import derived


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(spark, rows=3):
    text = [(f"r{i}", f"r{i}/a.py", "except:") for i in range(rows)]
    return with_language(spark.createDataFrame(text, "repo string, path string, content string"))


def test_a_scan_is_one_pass_without_shuffle_or_python(spark):
    text = plan(scan_code(files(spark), keep=["repo"]))
    assert " Exchange " not in text and "Python" not in text and "SortMergeJoin" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert text.count("BroadcastHashJoin") >= 2


def test_hits_are_computed_once(spark):
    """The expression that matches lines must be in the plan once, not again in an inferred filter."""
    text = scan_sast(files(spark), multi_line=False)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\((?:CASE WHEN )?lambda", text)) == 1


def test_roll_ups_shuffle_counts_only(spark, sf):
    text = plan(queries.QUERIES["repo_security"](spark, sf))
    exchanges = re.findall(r"Exchange (\w+)", text)
    # One shuffle of partial sums; the input is not dealt out.
    assert exchanges.count("hashpartitioning") == 1 and exchanges.count("RoundRobinPartitioning") == 0
    assert "partial_sum" in text and "Python" not in text


def test_only_needed_columns_are_read(spark, sf):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(queries.QUERIES["scan_by_repo"](spark, sf)))
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan(queries.QUERIES["files_scanned_by_repo"](spark, sf)))
    assert re.search(r"ReadSchema: struct<doc_id:bigint>", plan(queries.QUERIES["files_x_rules"](spark, sf)))


def test_no_query_has_a_cross_join(spark, sf):
    slow = {"stream_scan", "stream_all_findings", "stream_daily_kpis"}
    for name, query in queries.QUERIES.items():
        if name not in slow:
            text = plan(query(spark, sf))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_manifests_are_read_once(spark, sf):
    text = plan(queries.QUERIES["dependency_findings"](spark, sf))
    assert text.count("FileScan parquet") == 1


def test_first_findings_are_cut_before_the_shuffle(spark, sf):
    text = plan(queries.QUERIES["first_20"](spark, sf))
    assert re.search(r"WindowGroupLimit.*Partial", text)
