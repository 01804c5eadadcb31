"""Packing of documents into training sequences as a cutting-stock problem, solved by column generation.

Each document becomes token ids and an end id, cut into full sequences, then half a one where more than half a one is
left, then the rest: without the half, pieces that fit with few others would leave 4 % of the room empty.
Lengths are counted in classes of ``GRAIN`` tokens, which the rounding loses; so lengths below ``SHORT`` are also tried as
they are, in sequences of their own, and the plan with fewer sequences is taken. The histogram of at most ``SEQUENCE``
numbers is all the driver sees. A linear
program over patterns (how many pieces of each class share a sequence) starts from patterns of one class each; its dual
values price the classes, a knapsack by dynamic programming finds the pattern worth most, and that enters the basis until
no pattern is worth more than a sequence. Patterns are used as often as their rounded-down values say, and the few pieces
left over are placed by best fit. Pieces are ranked within their class and take the places of the patterns in that order.

Tokens are made in Arrow batches and leave them as lengths and checksums; ids are never shuffled. Ranks come from sums per
part of a digest, so a class that holds most pieces is ranked by many tasks.

Defined results: a null or empty text is the end id alone; rows that repeat are packed each by itself; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import running_sum
from scanloom.sources.checkpoint import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 2048
END_ID = 1
#: Tokens by which classes of lengths differ, and the length below which pieces may keep theirs.
GRAIN, SHORT = 8, 128
#: The search ends when no pattern is worth more than a sequence by this share, which bounds the distance from the optimum
#: by the same share, or after so many patterns; the patterns found until then always hold all pieces.
GAP, MAX_PATTERNS = 0.002, 1_500
#: Runs of white space beyond this are left to the tokenizer itself, as the faster one may exhaust its stack on them.
LONG_SPACE = re.compile(r"\s{5000}")

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


# ---- tokens ---------------------------------------------------------------------------------------------

def encoder(path: str):
    """Text to ids as the tokenizer file ``path`` (byte-level BPE) gives them.

    Where the same vocabulary lies beside it as ranks, those do the work several times faster with the same ids; texts
    with a special token's string or very long white space go to the tokenizer itself.
    """
    import os

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    # The split of byte-level BPE: contractions, words, numbers and signs with the space before, white space.
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or LONG_SPACE.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cuts(n: int) -> Iterator[tuple[int, int]]:
    """Start and end of each piece of a document of n tokens: whole sequences, then half a one, then the rest."""
    start = 0
    while n - start > SEQUENCE // 2:
        end = start + (SEQUENCE if n - start >= SEQUENCE else SEQUENCE // 2)
        yield start, end
        start = end
    if n > start:
        yield start, n


def _cutter(path: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or encoder(path)
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py() or ""), END_ID], "<u4")
                for start, end in cuts(len(ids)):
                    piece = ids[start:end]
                    at.append(i)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(numbers[:, j]) for j in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


# ---- patterns -------------------------------------------------------------------------------------------

def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern worth most that fits: dynamic programming over the room used. One size, of ascending ones, may repeat."""
    useful = np.flatnonzero(prices > 1e-12)
    size, price = sizes[useful], prices[useful]
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    for used, n in enumerate(np.searchsorted(size, np.arange(room + 1), "right")):
        if used:
            worth[used] = worth[used - 1]
        if n:
            values = worth[used - size[:n]] + price[:n]
            best = values.argmax()
            if values[best] > worth[used] + 1e-12:
                worth[used], last[used] = values[best], best
    pattern, used = np.zeros(len(sizes)), room
    while used > 0:
        if last[used] < 0:
            used -= 1
        else:
            pattern[useful[last[used]]] += 1
            used -= size[last[used]]
    return float(worth[room]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination. At most 255 rows; no linear algebra library, whose threads would compete with the JVM's."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0.0
        both -= factors[:, None] * both[i]
    return both[:, n:]


def solve(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, from the simplex method with priced columns."""
    basis = np.diag((room // sizes).astype(float))
    for step in range(MAX_PATTERNS):
        if step % 250 == 0:
            inverse = _inverse(basis)
            uses = np.maximum((inverse * counts).sum(axis=1), 0.0)
        worth, pattern = best_pattern(sizes, inverse.sum(axis=0), room)
        change = (inverse * pattern).sum(axis=1)
        rising = change > 1e-9
        if worth <= 1 + GAP or not rising.any():
            break
        ratios = np.where(rising, uses / np.where(rising, change, 1.0), np.inf)
        out = int(np.argmin(ratios))
        step_size = ratios[out]
        uses = np.maximum(uses - step_size * change, 0.0)
        uses[out] = step_size
        basis[:, out] = pattern
        inverse[out] /= change[out]
        others = change.copy()
        others[out] = 0.0
        inverse -= others[:, None] * inverse[out]
    return basis, np.maximum((_inverse(basis) * counts).sum(axis=1), 0.0)


def _best_fit(left: np.ndarray, sizes: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns used once each, for the pieces that rounding down has left: largest first, into the fullest that fits."""
    opened: list[np.ndarray] = []
    free = np.zeros(0, int)
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            fits = np.flatnonzero(free >= sizes[i])
            if len(fits):
                at = fits[np.argmin(free[fits])]
            else:
                at, free = len(opened), np.append(free, room)
                opened.append(np.zeros(len(sizes)))
            opened[at][i] += 1
            free[at] -= sizes[i]
    return opened


def patterns_for(histogram: dict[int, int], room: int = SEQUENCE // GRAIN) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, times used) that together hold each class's pieces exactly."""
    whole = [({size: 1}, n) for size, n in histogram.items() if size == room]
    sizes = np.array(sorted(s for s in histogram if s < room), int)
    if not len(sizes):
        return whole
    counts = np.array([histogram[int(s)] for s in sizes])
    columns, uses = solve(sizes, counts, room)
    left, found = counts.copy(), []
    for column, times in zip(columns.T, np.floor(uses + 1e-6), strict=True):
        column = column.astype(int)
        times = min([int(times), *(left[column > 0] // column[column > 0])])
        if times > 0:
            left -= column * times
            found.append((column, times))
    found += [(column.astype(int), 1) for column in _best_fit(left, sizes, room)]
    return whole + [({int(sizes[i]): int(c[i]) for i in np.flatnonzero(c)}, int(times)) for c, times in found]


def plan(lengths: dict[int, int]) -> tuple[dict[int, int], list[tuple[dict[int, int], int]]]:
    """The class of each length in tokens, and patterns of classes: of two plans the one with fewer sequences."""

    def planned(short: int) -> tuple[dict[int, int], list[tuple[dict[int, int], int]]]:
        sizes = {n: n if n < short else -(-n // GRAIN) * GRAIN for n in lengths}
        exact, rounded = {}, {}
        for n, pieces in lengths.items():
            if n < short:
                exact[n] = pieces
            else:
                rounded[sizes[n] // GRAIN] = rounded.get(sizes[n] // GRAIN, 0) + pieces
        patterns = [({size * GRAIN: k for size, k in pattern.items()}, times) for pattern, times in patterns_for(rounded)]
        return sizes, patterns + patterns_for(exact, SEQUENCE)

    return min(planned(0), planned(SHORT), key=lambda found: sum(times for _, times in found[1]))


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, pieces of it in the pattern, first rank, rank after the last, first sequence) of each class and pattern."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        for size, n in pattern.items():
            first = taken.get(size, 0)
            taken[size] = first + n * times
            rows.append((size, n, first, taken[size], sequence))
        sequence += times
    return rows


# ---- operator -------------------------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = pieces_of(docs, tokenizer_path, id_col, text_col)
    pieces = checkpointed(pieces)
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, patterns = plan(lengths)
    pieces = pieces.join(F.broadcast(spark.createDataFrame(list(sizes.items()), "length long, size int")), "length")
    # At most a few thousand rows, however many pieces: patterns are as many as classes, and each leaves a few pieces over.
    found = spark.createDataFrame(
        places(patterns), "size int, per_sequence long, first_rank long, end_rank long, first_sequence long"
    )
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "ids_crc32"))
    ranked = running_sum(
        pieces.select("*", digest.alias("digest"), F.lit(1).alias("one")), "size", "digest", ["length", "doc_tokens"], "one", "rank"
    )
    here = [ranked["size"] == found["size"], ranked["rank"] >= found["first_rank"], ranked["rank"] < found["end_rank"]]
    placed = ranked.join(F.broadcast(found), here).drop(found["size"])
    since = F.col("rank") - F.col("first_rank")
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(since / F.col("per_sequence")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
    )
