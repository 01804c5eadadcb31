"""Exact duplicates: groups of a 128-bit content hash whose bytes are compared, of which the smallest id stays.

Two texts are equal when they are identical after each run of ASCII white space became one space. Only DataFrame
functions are used.

Defined results: a null text counts as empty. A null id is larger than every other. Rows that repeat both id and text
are copies of each other, and exactly one of them stays. Extra columns are carried by ``keep_first`` and ignored by
``classify``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import normalized


def content_hash(text: Column) -> Column:
    return F.md5(text)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: ``h``, ``text_sha256``, ``keep_id``, ``group_size``.

    Rows are grouped by hash and bytes at once, so texts that share a hash but differ stay apart. Copies are combined
    within each task before the shuffle; of a text, one copy per task travels, whatever the size of its group.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalized(text_col).alias("bytes"))
    rows = rows.withColumn("h", content_hash(F.col("bytes")))
    classes = rows.groupBy("h", "bytes").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("h", F.sha2("bytes", 256).alias("text_sha256"), "keep_id", "group_size")
    # Members find their class by both digests. Should two classes share both, the job must not merge them in silence.
    alone = classes.groupBy("h", "text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("classes")
    )
    collision = F.raise_error(F.lit("different texts share both content digests")).cast("long")
    return alone.select(
        "h", "text_sha256", "keep_id",
        F.when(F.col("classes") == 1, F.col("group_size")).otherwise(collision).alias("group_size"),
    )


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    text = normalized(text_col)
    members = docs.select(F.col(id_col).alias("doc_id"), text.alias("bytes"))
    members = members.select("doc_id", content_hash(F.col("bytes")).alias("h"), F.sha2("bytes", 256).alias("text_sha256"))
    members = members.groupBy("doc_id", "h", "text_sha256").agg(F.count(F.lit(1)).alias("repeats"))
    # On a key of its own both sides are dealt out anew, so that a large group of copies can be split over tasks.
    key = F.concat("h", "text_sha256").alias("key")
    classes = text_classes(docs, id_col, text_col).select(key, "keep_id", "group_size")
    found = members.select("doc_id", key, "text_sha256", "repeats").join(classes, "key")
    rows = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the smallest id.

    Rows that repeat that id are ordered by their other columns. One grouping does it all: partial results hold one row
    per text and task.
    """
    others = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.struct(*others).alias("row"))
    rows = docs.select(row.alias("r"), normalized(text_col).alias("bytes"))
    rows = rows.withColumn("h", content_hash(F.col("bytes")))
    return rows.groupBy("h", "bytes").agg(F.min("r").alias("r")).select("r.row.*")
