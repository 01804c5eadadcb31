"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by ``public_tokenizers.PATTERN`` and each match is merged by itself. A match starts as one token per byte;
the leaf of a live token's first byte holds the rank of the token that it and its right neighbour would make, and every
inner node the leftmost smallest rank below it. The root is the next merge; it changes three leaves (the merged token, its
left neighbour, the right one that is gone), each a point update of logarithmic cost, so a match of n bytes takes n log n steps: one run
of a million letters ends like a million words. Matches that are tokens themselves are taken as they are, as the
``tiktoken`` library does. Short matches recur, so each task remembers some of them (``REMEMBERED``) with their ids;
what is remembered changes no result.

Everything happens inside a row, in Arrow batches: nothing is shuffled and no state is shared, so a lost executor costs its
batches only. A task holds one batch of texts, and ids of part of it.

The rank file is read from a path on every executor. Letters, numbers and white space are those of Unicode 16, which
``tiktoken`` knows; later ones, in ``LATER_LETTERS``, count as other signs there and so here.

Defined results: a null or empty text has no ids and decodes to nothing; very long texts are encoded whole; ids come in
the order of the text, and of equal ranks the leftmost pair merges first; rows that repeat are encoded each by itself;
other columns stay as they are, but for those named as the result, which are replaced; an empty table gives an empty result.
Ids to decode: null is no ids; an unknown or null id decodes to nothing.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Matches that a task remembers with their ids (these and as many earlier ones), and the longest it does that for.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 48
#: A node of the tree has 16 children: most matches are short, and the least of 16 numbers is found fast.
FAN_BITS = 4
#: Results leave a task in batches of about so many ids.
BATCH_IDS = 500_000
#: Larger than any rank.
NO_RANK = 1 << 31
#: Code points that became letters or numbers after Unicode 16, first and last of each run.
LATER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file (base64 of the bytes, blank, rank) with their ranks, which are their ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match, by merges of the leftmost pair of least rank until no pair makes a token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = n.bit_length()
    never = NO_RANK << width
    rank_of = ranks.get
    # A node is (rank, position) as one number, so the smaller of two is the smaller rank, and of equal ones the leftmost.
    leaves = [never] * max(n - 1, 1)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank << width | i
    levels = _levels(leaves)
    depth, highest = len(levels), levels[-1]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := min(highest)) < never:
        first = least & ((1 << width) - 1)
        second = after[first]
        third = after[first] = after[second]
        if third < n:  # the right token gives its pair to the merged one
            before[third] = first
            rank = rank_of(piece[first : after[third]])
            leaves[first] = never if rank is None else rank << width | first
            leaves[second] = never
        else:
            leaves[first] = never
        left = before[first]
        if first:
            rank = rank_of(piece[left:third])
            leaves[left] = never if rank is None else rank << width | left
        if depth > 1:
            for at in {first >> FAN_BITS, min(second, n - 2) >> FAN_BITS, max(left, 0) >> FAN_BITS}:
                for below, nodes in zip(levels, levels[1:]):
                    least = min(below[at << FAN_BITS : (at + 1) << FAN_BITS])
                    if nodes[at] == least:
                        break
                    nodes[at] = least
                    at >>= FAN_BITS
    ids, start = [], 0
    while start < n:
        ids.append(ranks[piece[start : after[start]]])
        start = after[start]
    return ids


def _levels(leaves: list[int]) -> list[list[int]]:
    """The tree by levels, from the leaves up: each node the least of 16 below it. The last level has 16 at most; their least is the root."""
    levels = [leaves]
    while len(levels[-1]) > 1 << FAN_BITS:
        below = levels[-1]
        levels.append([min(below[i : i + (1 << FAN_BITS)]) for i in range(0, len(below), 1 << FAN_BITS)])
    return levels


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """Text to ids; ``pattern`` cuts it into the matches that are merged each by itself."""
    later = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in LATER_LETTERS)
    split, has_later = regex.compile(pattern).findall, regex.compile(f"[{later}]").search
    # Within a set that is negated, what was no letter then is let in by being no letter now: only a new pattern tells that.
    older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])")
    older = regex.sub(r"(?<!\[\^\\s)(?<!\\p\{L\})\\p\{([LN])\}(?!\\p|\])", rf"[\\p{{\1}}--[{later}]]", older)
    split_older = regex.compile(older, regex.V1).findall
    recent: dict[str, list[int]] = {}
    earlier: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        nonlocal recent, earlier
        ids: list[int] = []
        for match in (split_older if not text.isascii() and has_later(text) else split)(text):
            found = recent.get(match)
            if found is None:
                found = earlier.get(match) or merge(match.encode(), ranks)
                if len(match) <= REMEMBERED_LENGTH:
                    if len(recent) >= REMEMBERED:
                        recent, earlier = {}, recent
                    recent[match] = found
            ids += found
        return ids

    return encode


def _with_column(df: DataFrame, name: str, kind: DataType) -> tuple[list[str], StructType]:
    """The columns of ``df`` that stay, and the schema with the new one last."""
    stays = [f for f in df.schema.fields if f.name != name]
    return [f.name for f in stays], StructType(stays).add(name, kind)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text as ``array<int>``."""
    stays, schema = _with_column(docs, ids_col, ArrayType(IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            of = of or encoder(read_ranks(ranks_path), pattern)
            ids, ends, start = array("i"), array("i", [0]), 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                ids.extend(of(text.as_py() or ""))
                ends.append(len(ids))
                if len(ids) >= BATCH_IDS or i == batch.num_rows - 1:
                    found = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(ids, np.int32)))
                    same = [c.slice(start, i + 1 - start) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*same, found], schema.names)
                    ids, ends, start = array("i"), array("i", [0]), i + 1

    rows = docs.select(*[_named(x) for x in stays], _named(text_col).alias("__text"))
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids stand for, as ``binary``: a token may end inside a character."""
    stays, schema = _with_column(rows, out_col, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or {rank: token for token, rank in read_ranks(ranks_path).items()}
            decoded, start, held = [], 0, 0
            for i, ids in enumerate(batch.column(batch.num_columns - 1)):
                numbers = ids.values if ids.is_valid else pa.array([], pa.int32())
                numbers = numbers.to_pylist() if numbers.null_count else numbers.to_numpy().tolist()
                decoded.append(b"".join([tokens.get(n, b"") for n in numbers]))
                held += len(numbers)
                if held >= BATCH_IDS or i == batch.num_rows - 1:
                    same = [c.slice(start, i + 1 - start) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(decoded, pa.binary())], schema.names)
                    decoded, start, held = [], i + 1, 0

    return rows.select(*[_named(x) for x in stays], _named(ids_col).alias("__ids")).mapInArrow(run, schema)


def _named(column: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of its ids and of what they decode to."""
    rows = docs.select(_named(id_col).alias("doc_id"), _named(text_col).alias("text"))
    rows = decode(encode(rows, ranks_path, pattern).drop("text"), ranks_path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
