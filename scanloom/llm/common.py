"""What the operators share: input tables, white space, keys and stable order."""

from __future__ import annotations

import gc
import os
import time

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The tokenizer file of the queries, which must lie there on the driver and on every executor.
TOKENIZER = os.environ.get("SCANLOOM_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = os.environ.get("SCANLOOM_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Parts that an order is cut into so that no key's rows must be sorted by one task.
ORDER_BUCKETS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_pattern() -> str:
    """The pattern that cuts a text before byte-level merges."""
    return public_tokenizers.PATTERN


def text_of(column: str | Column) -> Column:
    """The text, null being empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalized(column: str | Column) -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(text_of(column), rf"[{SPACE}]+", " ")


def group_key(column: str | Column) -> Column:
    """A key that is never null and tells null from every value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit("null"))


def running_sum(
    rows: DataFrame, group: str, order: str, ties: list[str], value: str, out: str, per_group: DataFrame | None = None
) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same group that come earlier, and the group's ``per_group``.

    ``order`` is a string of hexadecimal digits that are spread evenly, such as a digest. Its first three digits cut each
    group into 4,096 parts; sums per part are combined before the shuffle and only within a part are rows sorted, so a
    group of any size is worked on by many tasks. What ``per_group`` has (one row per group) comes with the sums of the
    parts, so the rows are shuffled once.
    """
    rows = rows.withColumn("__part", F.substring(order, 1, 3))
    parts = rows.groupBy(group, "__part").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    if per_group is not None:
        parts = parts.join(per_group, group)
    inside = Window.partitionBy(group, "__part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(parts, [group, "__part"]).withColumn(
        out, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    )
    return summed.drop("__part", "__before")


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A hint to broadcast a checkpointed table of narrow rows, if counting shows that it is small; the same rows either way."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, where lambda functions would compute it for every element."""
    return F.transform(F.array(value), use)[0]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of earlier phases now: it does so once the driver has collected their plans."""
    for _ in range(3):
        gc.collect()
        time.sleep(1)  # Python tells the JVM once a second which plans it no longer refers to
        spark.sparkContext._jvm.System.gc()
