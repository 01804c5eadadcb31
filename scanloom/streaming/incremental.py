"""Scans and scan figures over streams. A scan is stateless per file, so a stream of files needs no state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators.dependencies import dependency_findings, dependency_issues
from scanloom.operators.findings import union_findings
from scanloom.plans.scan import scan_code


def append_findings(findings: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (findings.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", output)
            .trigger(availableNow=True).start())


def scan_stream(files: DataFrame, output: str, checkpoint: str, manifests: DataFrame | None = None,
                advisories: Sequence[dict] | None = None, **options) -> StreamingQuery:
    """Scan new files as they arrive and append their findings to ``output``; every file is scanned once.

    ``manifests`` (path, content and the ``keep`` columns) is the stream of manifests: the advisories are a static
    table that it is joined with, in the same query as the code.
    """
    found = scan_code(files, **options)
    if manifests is not None:
        keep = list(options.get("keep", ()))
        found = union_findings(found, dependency_findings(dependency_issues(manifests, keep, advisories), keep))
    return append_findings(found, output, checkpoint)


# ---- daily figures --------------------------------------------------------------------------------------

SEVERITIES = ["Critical", "High", "Medium", "Low"]
DAILY = ["total", *[n.lower() for n in SEVERITIES]]
#: Batches after which their counts are merged into one table.
COMPACT_EVERY = 50


def daily_severity(events: DataFrame) -> DataFrame:
    """Findings per day and severity of (ts, severity): counts of parts add up to those of the whole."""
    counts = [F.count_if(F.col("severity") == n).alias(n.lower()) for n in SEVERITIES]
    per_day = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*counts)
    return per_day.select("day", sum((F.col(n) for n in DAILY[2:]), F.col(DAILY[1])).alias("total"), *DAILY[1:])


def _numbers(spark: SparkSession, folder: str) -> dict[int, str]:
    """The complete tables below ``folder``, by the number of the last batch that each holds."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    pattern = hadoop(f"{folder}/upto=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = [s.getPath().getParent() for s in found]
    return {int(p.getName().removeprefix("upto=")): p.toString() for p in paths}


def _drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _parts(spark: SparkSession, output: str) -> tuple[int, list[str]]:
    """The last merged batch (-1: none) and the tables that hold each batch once."""
    merged = _numbers(spark, f"{output}/merged")
    last = max(merged, default=-1)
    batches = _numbers(spark, f"{output}/batches")
    return last, [merged[n] for n in merged if n == last] + [path for n, path in sorted(batches.items()) if n > last]


def _summed(spark: SparkSession, tables: list[str]) -> DataFrame:
    schema = "day string, " + ", ".join(f"{c} bigint" for c in DAILY)
    rows = spark.read.schema(schema).parquet(*tables) if tables else spark.createDataFrame([], schema)
    return rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in DAILY])


def count_daily(events: DataFrame, output: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep daily figures of a stream of (ts, severity) that are exact however late a row comes.

    Each batch leaves its own counts, a few rows per day it touches, under its number; a batch that is tried again
    replaces them. There is no state and no watermark, so nothing is late. Now and then all counts are merged into one
    table, which counts once it is complete; only then are its parts deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= _parts(spark, output)[0]:
            return  # tried again after it was merged
        daily_severity(batch).write.mode("overwrite").parquet(f"{output}/batches/upto={number}")
        if (number + 1) % compact_every == 0:
            last, tables = _parts(spark, output)
            _summed(spark, tables).write.mode("overwrite").parquet(f"{output}/merged/upto={number}")
            for table in tables:
                _drop(spark, table)

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_daily(spark: SparkSession, output: str) -> DataFrame:
    """The figures of all batches so far: day, total and one column per severity."""
    return _summed(spark, _parts(spark, output)[1])


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    query = start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
