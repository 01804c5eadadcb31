"""Mixing of sources to target weights as a curriculum that changes over training time.

Each source gets a target (``targets``) and a schedule: its weight at training time t (0 to 1) is 1 + a (2t - 1). The
integral of the schedule, scaled to the target, is the source's cumulative token demand D(t). Its documents, in a stable
order that a digest of their ids gives, supply tokens one after the other, and start over when all were used. A copy of
a document is trained on at the time when demand reaches its middle, the inverse of D, and copies whose middle demand
never reaches are not taken. ``schedule`` sorts all copies by that position.

Only DataFrame functions are used. Defined results: a null text has size 0; a null source is a source of its own, the
last; documents of size 0 take nothing; rows that repeat are separate documents next to each other in the order; extra
columns are carried by ``schedule``; an empty table gives an empty result. All sizes 0: all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import WORD, group_key, running_sum, text_of
from scanloom.sources.checkpoint import checkpointed

#: Weights of sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Slopes of the weight schedules, repeating: more and more, even, less and less.
SLOPES = (0.5, 0.0, -0.5)
#: A source, and so a document, is used this many times at most.
MAX_EPOCHS = 3


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sized: DataFrame, source_col: str = "source") -> DataFrame:
    """One row per source: ``skey, source_size, target, slope``.

    Sources share the sum of all sizes by weight. A target stops at MAX_EPOCHS times its source's size and the excess is
    shared anew, until none is above. The end of that is found at once: with the sources in order of cap over weight,
    the first for which an equal share of the rest stays below its cap fixes the share of all that follow.
    """
    sources = sized.groupBy(group_key(source_col).alias("skey"), F.col(source_col).alias("source")).agg(
        F.sum("size").alias("source_size")
    )
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    sources = sources.withColumn("rank", rank)
    sources = sources.withColumn("weight", _pick(WEIGHTS, F.col("rank"))).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier, later = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sources = sources.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).alias("rest"),
        F.sum("weight").over(later).alias("rest_weight"),
        F.row_number().over(by_limit).alias("nth"),
    )
    fits = F.col("weight") * F.col("rest") <= F.col("cap") * F.col("rest_weight")
    first = F.min(F.when(fits, F.struct("nth", "rest", "rest_weight"))).over(everything)
    sources = sources.withColumn("first", first)
    share = (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.rest_weight")
    return sources.select(
        "skey", "source_size",
        F.when(F.col("nth") < F.col("first.nth"), F.col("cap").cast("double")).otherwise(share).alias("target"),
        _pick(SLOPES, F.col("rank")).alias("slope"),
    )


def time_of(supplied: Column, target: Column, slope: Column) -> Column:
    """The training time at which a source's cumulative demand reaches ``supplied``: the inverse of its integral."""
    share = supplied / target
    rise = 1.0 - slope
    curved = (F.sqrt(rise * rise + 4.0 * slope * share) - rise) / (2.0 * slope)
    return F.when(slope == 0.0, share).otherwise(curved)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: bool) -> DataFrame:
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(
        F.col(id_col).alias("id"), group_key(source_col).alias("skey"), F.col(source_col).alias("source"),
        word_count(text_col).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("digest"),
        F.xxhash64(text_of(text_col)).alias("tie"), *whole,
    )


def positions(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with ``source_size, target, positions``: the training positions of the copies that are taken."""
    rows = running_sum(sized, "skey", "digest", ["size", "tie"], "size", "before", plan)
    middle = F.col("before") + F.col("size") / 2.0
    supplied = F.transform(F.array(*map(F.lit, range(MAX_EPOCHS))), lambda e: e * F.col("source_size") + middle)
    taken = F.filter(supplied, lambda m: (m <= F.col("target")) & (F.col("size") > 0))
    return rows.withColumn("positions", F.transform(taken, lambda m: time_of(m, F.col("target"), F.col("slope"))))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per copy that is taken, with all columns of ``docs``, range-sorted by training position."""
    plan = checkpointed(targets(_sized(docs, id_col, text_col, source_col, carry=False)))
    copies = positions(_sized(docs, id_col, text_col, source_col, carry=True), plan)
    copies = copies.select("row", "id", F.explode("positions").alias("position"))
    return copies.sort("position", "id").select("row.*")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, first_position``.

    ``first_position`` is null for documents that are not taken.
    """
    sized = checkpointed(_sized(docs, id_col, text_col, source_col, carry=False))
    return positions(sized, checkpointed(targets(sized))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.size("positions")).alias("taken"), F.get("positions", F.lit(0)).alias("first_position"),
    )
