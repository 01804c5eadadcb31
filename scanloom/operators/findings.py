"""Operators over findings: union, projections, filters, search, order and numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.fixed_values import CODE_FIRST_SCANS, FIRST_FINDINGS, SEVERITY_ORDER
from scanloom.functions.scoring import severity_order
from scanloom.sources.checkpoint import checkpointed

WIRE_COLUMNS = [
    "rule_id", "rule_name", "category", "severity", "file_path", "line_number", "line_end", "code_snippet",
    "description", "remediation", "match_type", "cwe", "owasp",
]
WIRE_SCHEMA = ", ".join(f"{c} {'int' if c.startswith('line_') else 'string'}" for c in WIRE_COLUMNS)
CSV_COLUMNS = [c for c in WIRE_COLUMNS if c != "code_snippet"]
ALL = "All"


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings of all passes; none is dropped for being found twice."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def wire(findings: DataFrame, keep: list[str] = ()) -> DataFrame:
    return findings.select(*keep, *WIRE_COLUMNS)


def from_wire(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Findings out of JSON texts, with the defaults of the optional fields."""
    keep = [c for c in rows.columns if c != json_col]
    parsed = rows.select(*keep, F.from_json(json_col, WIRE_SCHEMA).alias("f")).select(*keep, "f.*")
    defaults = {"match_type": "single-line", "cwe": "", "owasp": ""}
    return parsed.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()}
                              | {"matched_pattern": F.lit("")})


def filter_findings(findings: DataFrame, severity: str = ALL, category: str = ALL) -> DataFrame:
    for column, wanted in (("severity", severity), ("category", category)):
        if wanted != ALL:
            findings = findings.filter(F.col(column) == wanted)
    return findings


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in one of the columns, case ignored; the empty text finds all."""
    if not text:
        return rows
    return rows.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns]))


def search_findings(findings: DataFrame, text: str) -> DataFrame:
    return search(findings, text, ["rule_name", "file_path", "description"])


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(severity_order(F.col("severity")) <= SEVERITY_ORDER[severity])


def report_order(scan_type: str = "single_file") -> list[Column]:
    """Findings as a report lists them: by file and in it by line, then multi-line by rule id, secrets, dependencies.

    Scans of archives and repositories list the language rules' findings of all files first, and then, file by file, the rest.
    All keys are short, since a sort sends samples of them to the driver.
    """
    single = F.col("pass_ord") != 1
    code_first = [F.col("pass_ord") > 1] if scan_type in CODE_FIRST_SCANS else []
    return [
        *code_first,
        F.col("file_path"),
        F.col("pass_ord"),
        F.when(~single, F.col("rule_id")),
        F.col("line_number"),
        F.col("rule_ord"),
        F.col("pattern_idx"),
        F.col("match_idx"),
        F.col("rule_id"),
        F.col("rule_name"),  # names the package of a dependency finding
    ]


def _with_row_id(findings: DataFrame) -> DataFrame:
    """Findings, checkpointed with a number each: what is ranked is the number and the order, not the findings."""
    return checkpointed(findings.withColumn("_id", F.monotonically_increasing_id()))


def _keys(rows: DataFrame, group: str, scan_type: str) -> tuple[DataFrame, list[str]]:
    """Group, row number and order of each row, and the names of the columns to order by."""
    order = [c.alias(f"_k{i}") for i, c in enumerate(report_order(scan_type))]
    return rows.select(F.col(group).alias("_group"), *order, "_id"), [*[f"_k{i}" for i in range(len(order))], "_id"]


def canonical_order(findings: DataFrame, first: list[str] = (), scan_type: str = "single_file") -> DataFrame:
    """Findings in report order. They are checkpointed first: a sort samples its input, and would scan files twice."""
    return checkpointed(findings).orderBy(*first, *report_order(scan_type))


def order_by_severity(findings: DataFrame, first: list[str] = (), scan_type: str = "single_file") -> DataFrame:
    return checkpointed(findings).orderBy(*first, severity_order(F.col("severity")), *report_order(scan_type))


def number_findings(findings: DataFrame, group: str, scan_type: str = "single_file") -> DataFrame:
    """Number the findings of each ``group`` in report order, and count them.

    A window over the group would put a large group into one task. Instead the keys alone are range-partitioned on
    group and report order, so a large group covers many partitions; rows are counted within their partition, and each
    partition adds what the group has in the partitions before it. The placed keys are checkpointed, because
    partition numbers must not change between their two uses, and the findings are, because they are read twice: for
    their keys, and to be joined with their numbers.
    """
    rows = _with_row_id(findings)
    keys, order = _keys(rows, group, scan_type)
    ranged = keys.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    placed = checkpointed(ranged.select("_group", "_id", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))

    per_part = placed.groupBy("_group", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # One row per group and partition it covers: at most groups + partitions rows in all.
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_group", "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_group")).alias("findings_in_group"))
    same = placed["_group"].eqNullSafe(offsets["_group"]) & (placed["_part"] == offsets["_part"])
    numbers = placed.join(offsets, same).select(
        "_id", (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias("finding_number"), "findings_in_group")
    return rows.join(numbers, "_id").drop("_id")


def first_findings(findings: DataFrame, group: str, n: int = FIRST_FINDINGS, scan_type: str = "single_file") -> DataFrame:
    """The first ``n`` findings of each group, and how many more there are.

    Spark keeps the first ``n`` of each group in every partition before it shuffles, and only their keys, so a large
    group stays cheap; the findings themselves are looked up by their number.
    """
    rows = _with_row_id(findings)
    keys, order = _keys(rows, group, scan_type)
    numbered = keys.withColumn("finding_number", F.row_number().over(Window.partitionBy("_group").orderBy(*order)).cast("long"))
    totals = rows.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_total"))
    first = numbered.filter(F.col("finding_number") <= n).select("_group", "_id", "finding_number")
    first = first.join(totals, first["_group"].eqNullSafe(totals["_of"])).select(
        "_id", "finding_number", F.greatest(F.col("_total") - n, F.lit(0)).alias("remaining"))
    return rows.join(first, "_id").drop("_id")
