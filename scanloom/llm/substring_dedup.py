"""Repeated passages, found by difference-cover anchors and removed word by word.

A window is ``length`` consecutive words of one document; every word of a window that also starts anywhere else, in the
same document or another, is removed. With a difference cover D modulo 21, any two places have an offset below 21 at
which both lie in D. So two equal windows of 35 words share an anchor: the hash of 15 words at a position in D that lies
in both at the same place. Anchors are a quarter of all positions.

1. Anchors are counted by hash. Those that occur twice or more go back to their texts.
2. A window is a candidate if an anchor in it occurs elsewhere. Only candidates are extended to all their words, as
   128-bit hashes, and counted.
3. Words under windows that occur twice or more are removed; windows are judged on the input, so the order doesn't matter.

Equal texts are one row from step 2 on, with their number as weight. Counts are combined within tasks before shuffles,
and rows go back to their texts by joins whose one side has each key once, so a passage that a third of all documents
share is split over tasks. Texts travel compressed, and only those with candidates are kept.

Defined results: a null text has no words; a text of fewer words than a window keeps all; rows that repeat are equal
texts, so windows of one occur in the other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import release, text_of
from scanloom.llm.wordhash import M1, M2, M3, mixed, words_of
from scanloom.sources.checkpoint import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 35
#: A perfect difference set: every difference modulo PERIOD is one of two of its members.
COVER, PERIOD = (3, 6, 7, 12, 14), 21
#: Bytes of a text that are hashed at once; a longer word is hashed by itself.
STRETCH = 1 << 20
#: Which bytes are not ASCII white space.
IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def anchor_positions(words: int, length: int) -> np.ndarray:
    """Positions of the anchors of a text of so many words; an anchor has ``length - PERIOD + 1`` words."""
    last = words - (length - PERIOD + 1)
    if words < length:
        return np.zeros(0, np.int32)
    at = np.arange(last + 1, dtype=np.int32)
    return at[np.isin(at % PERIOD, COVER)]


def candidates(anchors: np.ndarray, words: int, length: int) -> np.ndarray:
    """Starts of the windows that hold an anchor of ``anchors`` at a place that two equal windows may share."""
    anchors = anchors[anchors <= words - (length - PERIOD + 1)]  # others belong to a text that shares the short key
    marks = np.zeros(words + 2, np.int32)
    np.add.at(marks, np.maximum(anchors - (PERIOD - 1), 0), 1)
    np.add.at(marks, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: max(0, words - length + 1)] > 0)


class Runs:
    """Hashes of runs of words of any length, from sums of the words' hashes times powers of one odd number.

    The sums are taken once for a text; a run is a difference of two of them, divided by the power that it begins with.
    """

    def __init__(self, base: np.uint64):
        self.base = base
        self.back = np.uint64(pow(int(base), -1, 1 << 64))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def of(self, hashes: np.ndarray, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        if len(self.powers) < len(hashes):
            n = 2 * len(hashes)
            self.powers, self.inverse = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (self.base, self.back))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=sums[1:])
        return mixed((sums[starts + size] - sums[starts]) * self.inverse[starts])


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text, and where its words start and end."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


class WordHashes:
    """A hash for each word of a text, from sums over its bytes, a stretch of the text at a time."""

    def __init__(self):
        self.runs = Runs(M2)
        self.codes = mixed(np.arange(1, 257, dtype=np.uint64) * M1)

    def of(self, raw: bytes) -> np.ndarray:
        data, starts, ends = word_places(raw)
        found, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, "right")))
            low, high = int(starts[at]), int(ends[to - 1])
            if high - low > STRETCH:  # one long word
                found[at] = xxhash.xxh3_64_intdigest(raw[low:high])
            else:
                found[at:to] = self.runs.of(self.codes[data[low:high]], starts[at:to] - low, ends[at:to] - starts[at:to])
            at = to
        return found


def covered(starts: np.ndarray, words: int, length: int) -> np.ndarray:
    """Which words lie under the windows that begin at ``starts``."""
    marks = np.zeros(words + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks[:-1]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs, size = WordHashes(), Runs(M1), length - PERIOD + 1
        for batch in batches:
            keys, found, places = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = hashes.of((text.as_py() or "").encode("utf-8", "replace"))
                at = anchor_positions(len(own), length)
                if len(at):
                    keys.append(np.full(len(at), key, np.int64))
                    found.append(runs.of(own, at, size).view(np.int64))
                    places.append(at)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, found, places)], ["short_key", "anchor", "place"]
                )

    return find


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and digest of each text as it is."""
    for batch in batches:
        words = [words_of(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array(list(map(_digest, words)), pa.string())],
            ["doc_id", "key", "n_words", "whole"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, compressed."""
    for batch in batches:
        raw = [b" ".join(words_of(t.as_py())) for t in batch.column(1)]
        blobs = pa.array([pa.compress(r, codec="zstd", asbytes=True) for r in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), blobs, pa.array(list(map(len, raw)), pa.int64())], ["key", "blob", "size"])


def _unpacked(blob: pa.Scalar, size: pa.Scalar) -> bytes:
    return pa.decompress(blob.as_py(), size.as_py(), codec="zstd", asbytes=True)


def _windows(length: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs, others = WordHashes(), Runs(M1), Runs(M3)
        for batch in batches:
            for key, blob, size, copies, places in zip(*batch.columns, strict=True):
                own = hashes.of(_unpacked(blob, size))
                starts = candidates(np.asarray(places.as_py(), np.int64), len(own), length)
                if len(starts):
                    # Two hashes of different mixtures of the words by different powers, 128 bits together.
                    one = runs.of(own, starts, length).view(np.int64)
                    two = others.of(mixed(own ^ M1), starts, length).view(np.int64)
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * n, pa.binary()), pa.array(one), pa.array(two), pa.array(starts.astype(np.int32)),
                         pa.array(np.full(n, copies.as_py(), np.int64))],
                        ["key", "one", "two", "start", "copies"],
                    )

    return extend


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for _, blob, size, starts in zip(*batch.columns, strict=True):
                words = _unpacked(blob, size).split()
                gone = covered(np.asarray(starts.as_py(), np.int64), len(words), length)
                removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array([t.decode() for t in texts], pa.string())],
                ["key", "n_removed", "kept_text"],
            )

    return cut


def _with_candidates(texts: DataFrame, length: int) -> DataFrame:
    """Distinct texts in which some anchor occurs elsewhere too, with the places of such anchors."""
    short_key = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long").alias("short_key")
    anchors = texts.select(short_key, "text").mapInArrow(_anchors(length), "short_key long, anchor long, place int")
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    found = anchors.join(often, "anchor").groupBy("short_key").agg(F.collect_set("place").alias("places"))

    packed = texts.mapInArrow(_packed, "key binary, blob binary, size long")
    packed = packed.groupBy("key").agg(F.first("blob").alias("blob"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    # Texts that share the short key only get each other's places, which makes candidates but no results:
    # places beyond a text are left out, and windows are compared by all their words.
    return checkpointed(packed.select("*", short_key).join(found, "short_key").select("key", "blob", "size", "copies", "places"))


def _repeated_starts(held: DataFrame, length: int) -> DataFrame:
    """Starts of the windows of each text that occur elsewhere too."""
    spread = held.mapInArrow(_windows(length), "key binary, one long, two long, start int, copies long")
    twice = spread.groupBy("one", "two").agg(F.sum("copies").alias("n")).filter("n > 1").select("one", "two")
    starts = spread.select("key", "one", "two", "start").join(twice, ["one", "two"])
    return checkpointed(starts.groupBy("key").agg(F.sort_array(F.collect_set("start")).alias("starts")))


def cut_texts(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """``key, n_removed, kept_text`` of each distinct text that loses words; ``key`` is the digest of the text."""
    texts = docs.select(F.unhex(F.md5(text_of(text_col))).alias("key"), text_of(text_col).alias("text"))
    held = _with_candidates(texts, length)
    release(docs.sparkSession)
    starts = _repeated_starts(held, length)
    release(docs.sparkSession)
    rows = held.join(starts, "key").select("key", "blob", "size", "starts")
    return rows.mapInArrow(_cut(length), "key binary, n_removed long, kept_text string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_described, f"doc_id {kind}, key binary, n_words long, whole string")
    cut = cut_texts(docs, length, text_col).select("key", "n_removed", F.sha2("kept_text", 256).alias("digest"))
    rows = rows.join(cut, "key", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("digest", "whole").alias("kept_sha256")
    )
