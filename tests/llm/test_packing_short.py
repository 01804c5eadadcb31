"""Short texts fill their sequences, and every plan holds each piece once."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.llm import packing
from scanloom.llm.common import TOKENIZER

DRAW = random.Random(3)


@pytest.mark.parametrize("lengths", [
    {}, {1: 10_000}, {2: 10_000, 3: 1}, {1: 5_000, 2: 3_000, 3: 2_000}, {n: DRAW.randrange(1, 900) for n in range(1, 128)},
    {3: 200_000} | {n: 3 for n in range(100, 1025, 7)}, {2048: 7, 1024: 3, 127: 40, 128: 40},
])
def test_plans_hold_all_pieces_with_little_padding(lengths):
    sizes, patterns = packing.plan(lengths)
    held: dict[int, int] = {}
    for pattern, times in patterns:
        assert sum(size * n for size, n in pattern.items()) <= packing.SEQUENCE
        for size, n in pattern.items():
            held[size] = held.get(size, 0) + n * times
    want: dict[int, int] = {}
    for n, pieces in lengths.items():
        assert sizes[n] >= n
        want[sizes[n]] = want.get(sizes[n], 0) + pieces
    assert held == want
    used = sum(n * pieces for n, pieces in lengths.items())
    assert sum(times for _, times in patterns) <= 1.02 * used / packing.SEQUENCE + 2


def test_table_of_empty_and_short_texts(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, "a").alias("text"))
    rows = packing.pack(docs, TOKENIZER).cache()
    assert rows.count() == 30_000
    filled = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= packing.SEQUENCE for r in filled)
    assert len(filled) <= 21 and sum(r.n for r in filled) == 40_000
