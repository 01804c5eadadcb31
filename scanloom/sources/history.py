"""Scan history as an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = (
    "id string, scan_type string, source string, ts timestamp, total bigint, critical bigint, high bigint, "
    "medium bigint, low bigint, score double, grade string"
)
HISTORY_COLUMNS = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All recorded scans; a history that was never written is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def append_history(scans: DataFrame, path: str) -> None:
    """Record scans; scans of pasted text are not kept. Nothing is rewritten: readers take the newest."""
    kept = scans.filter(~F.col("scan_type").eqNullSafe("text"))
    kept.select(*[F.col(c) for c in HISTORY_COLUMNS]).withColumn("ts", F.col("ts").cast("timestamp")) \
        .write.mode("append").parquet(path)
