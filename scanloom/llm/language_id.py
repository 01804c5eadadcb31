"""Language identification by rank-order profiles of n-grams.

A profile is the list of a language's ``PROFILE`` most frequent n-grams (one to three letters; a run of anything else
counts as one blank), most frequent first. A document's own list is compared with each profile by the out-of-place
distance: the sum, over its n-grams, of how far their ranks differ, where an n-gram that the profile lacks counts as the
largest difference. The nearest profile names the language. Ties of frequency go by the n-gram's code, ties of distance
by the language's name.

Learning counts n-grams over all labelled documents in Arrow batches: partial counts per task are summed by Spark and
cut to the top of each language, so the profiles that are broadcast hold ``PROFILE`` numbers per language at most.
Prediction reads each text once and shuffles nothing. Letters are folded to lower case; code points share 1,024 codes,
each below 768 (Latin and accents) having its own.

Defined results: ``und`` and score 0 for a null text, one without a letter, or when nothing was learned; null languages
and null texts are not learned from; rows that repeat count and are predicted each by itself; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: N-grams in a profile, and in the list of a document.
PROFILE = 400
UNKNOWN = "und"
#: Every fifth document, by a checksum of its id, is held out of learning.
FOLDS = 5
CODE_BITS, OWN_CODES = 10, 768
#: Code points of texts counted together while learning.
BATCH_CHARS = 4_000_000
#: Unicode has no letters beyond this code point.
LAST_LETTER = 0x33FFF
_TABLE: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """For each code point its code from 1 on, or 0 if it isn't a letter. There are no letters beyond the table."""
    if not _TABLE:
        points = np.arange(LAST_LETTER + 2)
        letters = np.fromiter(map(str.isalpha, map(chr, range(len(points)))), bool, len(points))
        spread = OWN_CODES + points % ((1 << CODE_BITS) - OWN_CODES)
        _TABLE.append(np.where(letters, np.where(points < OWN_CODES, points, spread), 0).astype(np.uint32))
    return _TABLE[0]


def _letters(text: str) -> np.ndarray:
    """Codes of the text's letters, with one blank (0) before, after and between runs of them; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[0], _codes()[np.minimum(points, LAST_LETTER + 1)], [0]]).astype(np.uint32)
    keep = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[np.concatenate([[True], keep])] if keep.any() else codes[:0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one to three codes, each as a number that also tells its length; blanks alone are none."""
    two = (codes[:-1] << CODE_BITS) | codes[1:]
    three = (two[:-1] << CODE_BITS) | codes[2:]
    one = codes[codes != 0]
    return np.concatenate([one | (1 << 30), two | (2 << 30), three | (0 if len(codes) < 3 else 3 << 30)]).astype(np.uint32)


def ranked(text: str) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first."""
    codes = _letters(text)
    if not len(codes):
        return codes
    grams, counts = np.unique(_grams(codes), return_counts=True)
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, of many texts at a time."""
    waiting: dict[str, list[np.ndarray]] = {}
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "gram", "n"],
            )

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            codes = _letters(text.as_py())
            if len(codes):
                waiting.setdefault(lang.as_py(), []).append(_grams(codes))
                held += len(codes)
            if held >= BATCH_CHARS:
                yield from counted()
                waiting.clear()
                held = 0
    yield from counted()


def held_out(id_col: str | Column) -> Column:
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """The profile of each language of ``labelled``: PROFILE numbers for each language at most come to the driver."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in top.select("lang", "gram", "rank").orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def nearest(grams: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> tuple[int, float]:
    """Index of the nearest profile and the score: how much nearer than all the others, from 0 to 1.

    ``known``: all n-grams of the profiles, sorted; ``ranks``: their ranks by language, PROFILE where a language lacks one.
    """
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    there = known[at] == grams
    theirs = np.where(there[None, :], ranks[:, at], PROFILE)
    own = np.arange(len(grams))
    apart = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - own)).sum(axis=1)
    best = int(np.argmin(apart))
    near = 1.0 - apart[best] / (PROFILE * len(grams))
    others = np.delete(apart, best)
    second = 1.0 - others.min() / (PROFILE * len(grams)) if len(others) else 0.0
    return best, float(near / (near + second)) if near > 0 else 0.0


def _predictor(profiles: dict[str, list[int]]):
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[x], np.uint32) for x in langs])) if langs else np.zeros(0, np.uint32)
    ranks = np.full((len(langs), len(known)), PROFILE, np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, np.array(profiles[lang], np.uint32))] = np.arange(len(profiles[lang]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column(batch.num_columns - 1):
                grams = ranked(value.as_py() or "")
                best, points = nearest(grams, known, ranks) if len(grams) and langs else (-1, 0.0)
                names.append(langs[best] if best >= 0 else UNKNOWN)
                scores.append(points)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return predict


def identify(
    docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(profiles), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language."""
    predict = _predictor(profiles)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            for found in predict(iter([pa.RecordBatch.from_arrays([text], ["text"])])):
                yield batch.filter(pa.compute.not_equal(found.column(0), UNKNOWN))

    return docs.mapInArrow(known, docs.schema)
