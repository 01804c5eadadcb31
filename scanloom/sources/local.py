"""Small driver-side tables (rules, advisories) as DataFrames, without a Python worker to feed them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: list[dict], schema: str | StructType) -> DataFrame:
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(struct)), struct)
