"""Hard-negative mining by the threshold algorithm over per-dimension sorted lists.

For an anchor, the score of a row is the integer inner product of both vectors. Each dimension has a list of the candidates
sorted by their component; an anchor reads a list from its high end where its own component is positive and from its low
end where it is negative, so what it has not seen yet can score no more than the threshold: its components times those it
stands at. Every row that comes up is scored at once from the full vector. Reading ends once the threshold is strictly
below the score that is needed: strictly, as a row that ties may win by its id.

Rows are dealt to blocks of about ``BLOCK`` by their id and anchors to tiles of about ``TILE``; each (block, tile) is one
group of bounded size, in which the lists are built once. A block gives each anchor its own first rows, and the first of
those over all blocks are the first of all rows, which Spark ranks. That is done twice: first for the positives (lists of the anchor's own label), then
with the windows that the positives' scores open: an anchor reads until the threshold is below the last wanted score in
each window, or below the window. Rows of the anchor's label are passed over.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part; rows that repeat count
once (of several with the same id the one with the least label, then vector); missing components of shorter vectors
count as 0; ties go to the smaller id; anchors without positives, and positives without a row in their window, have no rows; scores
beyond 64 bits are given as the nearest 64-bit number; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.checkpoint import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positives of an anchor, negatives of a positive, and the window of negatives' scores in hundredths of the positive's.
POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
#: Which ids are anchors.
ANCHOR_STEP = 50
#: Components are counted in units of 1/256.
SCALE = 256
#: Rows in a block and anchors in a tile, about. A group holds BLOCK x dimensions numbers twice and TILE x dimensions once.
BLOCK, TILE = 4096, 8192
#: How far the lists are read first; each time reading goes on, twice as far.
FIRST_DEPTH = 8
LONG = (-(1 << 63), (1 << 63) - 1)


def integers(vectors: list[list[float]], width: int) -> np.ndarray:
    """Components in units of 1/256, rounded down: 64-bit numbers where no sum of products can leave them, else Python's."""
    padded = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        padded[i, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(padded * SCALE)
    if not len(vectors) or np.abs(scaled).max(initial=0) ** 2 * max(width, 1) < 2.0**62:
        return scaled.astype(np.int64)
    exact = [[math.floor(x * SCALE) if abs(x) < 2**53 else int(x) * SCALE for x in row] for row in padded.tolist()]
    return np.array(exact, object).reshape(padded.shape)


class Lists:
    """Candidates with a list per dimension, sorted by component."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray | None = None):
        self.vectors = vectors
        #: A column per dimension: row numbers by ascending component.
        self.order = np.argsort(vectors, axis=0, kind="stable") if order is None else order

    def only(self, keep: np.ndarray) -> Lists:
        """The lists of some rows, which keep their numbers and their order."""
        left = self.order.T[keep[self.order.T]].reshape(self.order.shape[1], -1)
        return Lists(self.vectors, left.T)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Row numbers not seen before, their scores, and the most that rows still unseen can score (None: all are seen)."""
        n = len(self.order)
        used = np.flatnonzero(anchor != 0)
        if not len(used):  # every row scores 0, so there is no list to go by
            rows = self.order[:, 0] if self.order.shape[1] else np.zeros(0, np.int64)
            yield rows, np.zeros(len(rows), self.vectors.dtype), None
            return
        seen = np.zeros(len(self.vectors), bool)
        at, depth, signs = 0, FIRST_DEPTH, anchor[used] > 0
        while at < n:
            end = min(at + depth, n)
            new = np.zeros(len(self.vectors), bool)
            new[self.order[n - end : n - at, used[signs]].ravel()] = True
            new[self.order[at:end, used[~signs]].ravel()] = True
            rows = np.flatnonzero(new & ~seen)
            seen |= new
            stand = np.where(signs, self.order[n - end, used], self.order[end - 1, used])
            most = int((self.vectors[stand, used] * anchor[used]).sum())
            at, depth = end, depth * 2
            yield rows, self.vectors[rows] @ anchor, most if end < n else None


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k by score, ties by id."""
    if len(scores) > k:
        least = np.sort(scores)[-k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def positives_in(lists: Lists, ids: np.ndarray, anchor: np.ndarray, own: int, k: int = POSITIVES) -> list[tuple[int, int]]:
    """The first k of the rows in the lists other than the anchor itself: (id, score)."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, lists.vectors.dtype)
    for new, points, most in lists.read(anchor):
        other = ids[new] != own
        rows, scores = np.concatenate([rows, new[other]]), np.concatenate([scores, points[other]])
        last = _kth(scores, k)
        if most is None or last is not None and most < last:
            break
    best = _first(scores, ids[rows], k)
    return [(int(ids[rows[i]]), int(scores[i])) for i in best]


def negatives_in(
    lists: Lists, ids: np.ndarray, other: np.ndarray, anchor: np.ndarray, windows: list[tuple[int, int]], k: int = NEGATIVES
) -> list[list[tuple[int, int]]]:
    """For each window of scores, the first k of the rows of another label in it: (id, score)."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, lists.vectors.dtype)
    for new, points, most in lists.read(anchor):
        fit = other[new]
        rows, scores = np.concatenate([rows, new[fit]]), np.concatenate([scores, points[fit]])
        if most is None:
            break
        if any(most >= low for low, _ in windows):
            lasts = [_kth(scores[(scores >= low) & (scores <= high)], k) for low, high in windows]
            if any(most >= (low if last is None else last) for (low, _), last in zip(windows, lasts, strict=True)):
                continue
        break
    found = []
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        best = inside[_first(scores[inside], ids[rows[inside]], k)]
        found.append([(int(ids[rows[i]]), int(scores[i])) for i in best])
    return found


def window(score: int) -> tuple[int, int]:
    """The least and the highest score of a negative to a positive of this score; empty if it is negative."""
    return -(-LOW_PERCENT * score // 100), HIGH_PERCENT * score // 100


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block against one tile of anchors: first rows of the same label, or, for anchors with positives, of their windows."""
    table = pa.Table.from_batches(list(batches))
    data = {name: table.column(name).to_pylist() for name in ("vec_id", "label", "vec", "positives")}
    is_anchor = np.array(table.column("is_anchor").to_pylist(), bool)
    matrix = integers(data["vec"], max(map(len, data["vec"]), default=0))
    ids, labels = np.array(data["vec_id"], np.int64), np.array(data["label"], np.int64)
    block = np.flatnonzero(~is_anchor)
    lists, block_ids, block_labels = Lists(matrix[block]), ids[block], labels[block]
    out = []
    anchors = np.flatnonzero(is_anchor)
    for label in np.unique(labels[anchors]):
        same = block_labels == label
        of_label = lists.only(same)
        for i in anchors[labels[anchors] == label]:
            own, scores = int(ids[i]), data["positives"][i]
            if scores is None:
                out += [(own, -1, *found) for found in positives_in(of_label, block_ids, matrix[i], own)]
                continue
            wanted = sorted(set(scores))
            windows = [window(s) for s in wanted]
            for score, found in zip(wanted, negatives_in(lists, block_ids, ~same, matrix[i], windows), strict=True):
                out += [(own, score, *x) for x in found]
    clamp = lambda x: min(max(x, LONG[0]), LONG[1])
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    arrays = [pa.array([clamp(x) for x in c], pa.int64()) for c in columns]
    yield pa.RecordBatch.from_arrays(arrays, ["anchor_id", "of_score", "vec_id", "score"])


def _against_all(rows: DataFrame, anchors: DataFrame, blocks: int, tiles: int) -> DataFrame:
    """What each block gives each anchor: ``anchor_id, of_score, vec_id, score``."""
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    columns = ["block", "tile", "is_anchor", "vec_id", "label", "vec", "positives"]
    sides = rows.withColumns({
        "block": deal(blocks, 1), "tile": number(tiles), "is_anchor": F.lit(False), "positives": F.lit(None).cast("array<long>"),
    }).select(*columns).unionByName(anchors.withColumns({"tile": deal(tiles, 2), "block": number(blocks), "is_anchor": F.lit(True)}).select(*columns))
    return sides.groupBy("block", "tile").applyInArrow(_mine, "anchor_id long, of_score long, vec_id long, score long")


def mine(
    embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among the rows."""
    label = F.col(label_col).cast("long")
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    rows = checkpointed(rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec"))
    anchors = rows.filter(F.col("vec_id") % ANCHOR_STEP == 0)
    blocks, tiles = (max(1, math.ceil(n.count() / size)) for n, size in ((rows, block), (anchors, tile)))

    none = F.lit(None).cast("array<long>")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = _against_all(rows, anchors.withColumn("positives", none), blocks, tiles)
    positives = checkpointed(positives.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= POSITIVES).drop("nth", "of_score"))
    scores = positives.groupBy("anchor_id").agg(F.collect_set("score").alias("positives"))  # POSITIVES at most
    with_positives = anchors.join(scores, anchors.vec_id == scores.anchor_id).drop("anchor_id")
    order = Window.partitionBy("anchor_id", "of_score").orderBy(F.desc("score"), "vec_id")
    negatives = _against_all(rows, with_positives, blocks, tiles)
    negatives = negatives.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        negatives.select("anchor_id", F.col("of_score").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
        ["anchor_id", "positive_score"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
