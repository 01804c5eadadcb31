"""Report sinks: findings and their statistics as JSON and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.fixed_values import MATCH_TYPES
from scanloom.operators.findings import CSV_COLUMNS, WIRE_SCHEMA, canonical_order, wire
from scanloom.operators.metrics import SEVERITIES, by_file


def _map(names: Sequence[str], columns: Sequence[str]) -> Column:
    return F.create_map(*[x for n, c in zip(names, columns) for x in (F.lit(n), F.col(c))])


def report_header(summary: DataFrame, categories: DataFrame, by: str, generated_at: Column) -> DataFrame:
    """Metadata and statistics of each scan as one nested row.

    The maps have as many entries as there are severities, match types and rule categories. Counts per file are
    rows of their own (``write_json``), for a scan may have any number of files.
    """
    per_category = categories.groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "findings")))).alias("by_category"))
    return summary.join(per_category, by, "left").select(
        by,
        F.struct(
            generated_at.cast("string").alias("generated_at"), F.col("total").alias("total_vulnerabilities"),
            F.col("score").alias("security_score"), F.col("grade").alias("security_grade"),
        ).alias("metadata"),
        F.struct(
            "total",
            _map(SEVERITIES, [s.lower() for s in SEVERITIES]).alias("by_severity"),
            F.coalesce("by_category", F.map_from_arrays(F.array().cast("array<string>"),
                                                        F.array().cast("array<bigint>"))).alias("by_category"),
            _map(MATCH_TYPES, [m.replace("-", "_") for m in MATCH_TYPES]).alias("by_match_type"),
        ).alias("statistics"),
    )


def write_json(findings: DataFrame, header: DataFrame, by: str, path: str) -> None:
    """``header``, ``by_file`` and ``vulnerabilities`` as JSON lines below ``path``."""
    header.write.mode("overwrite").json(f"{path}/header")
    by_file(findings, [by]).write.mode("overwrite").json(f"{path}/by_file")
    wire(findings, [by]).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/vulnerabilities")


def read_json_findings(spark: SparkSession, path: str, by: str) -> DataFrame:
    return spark.read.schema(f"{by} string, {WIRE_SCHEMA}").json(f"{path}/vulnerabilities")


def write_csv(findings: DataFrame, path: str) -> None:
    """Twelve columns without the snippet, in report order; a missing end line is an empty field."""
    (canonical_order(findings).select(*CSV_COLUMNS).write.mode("overwrite")
     .option("header", True).option("nullValue", "").option("emptyValue", "")
     .option("quote", '"').option("escape", '"').csv(path))


def read_csv_findings(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'int' if c.startswith('line_') else 'string'}" for c in CSV_COLUMNS)
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).csv(path))
