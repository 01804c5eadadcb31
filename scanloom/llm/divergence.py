"""Source divergence audit with hash-consed segment trees over term ids.

For each language, the terms that enough of its documents hold get ids. A source's counts by term id are the leaves of a
segment tree; subtrees with the same counts are one node, whoever they belong to, so the long stretches of terms that a
source lacks, or has once, exist once. Two trees are compared by going down both at once, level by level: equal pairs of
nodes are merged before they are priced, so each is priced once, and sums come back up the same way.

Ids are (block, place): a hash deals a language's terms to blocks of about ``BLOCK``, where they lie in order of their
count, so rare terms and their equal counts lie together. A block is the lower part of every tree; what stands above is
sums, which Spark adds up. Sources meet in tiles of ``TILE`` by ``TILE``, so a task holds 2 x TILE x BLOCK counts at most
and neither a large language nor one with many sources meets in one task. Counting is done per Arrow batch first, so a
hot source or term is added up before the shuffle. Blocks are laid out by joins on (language, term) and by exploding
the block numbers of a language; nothing is collected.

All arithmetic is on integers: shares are floor(1000000000 (count + 2) / (N + 2 V)) + 1 by long division in steps of a thousand,
exact for totals up to nine quadrillion words.

Defined results: null text, language and source count as ''; a source without a kept term still has its rows of part
``pair``; of a language with one source there are none; a language without kept terms has distance 0 throughout; equal values are ranked by the item's
UTF-8 bytes; rows that repeat count as often as they occur; very long texts are counted whole; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.checkpoint import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of a language that must hold a term for it to be kept, and terms that a source is reported with.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Terms in a block and sources in a tile, about.
BLOCK, TILE = 4096, 64
#: Different terms that a task counts before it passes them on.
HELD = 400_000
#: Shares are counted in units of one billionth.
UNIT = 1_000_000_000
#: Letters as they are (A-Z in lower case, bytes of other characters unchanged); all other bytes of ASCII end a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and characters beyond ASCII, A-Z folded to lower case."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a row without a term for each source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurrences, documents) in held.items():
            n = len(occurrences) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n), pa.array([source] * n),
                    pa.array([None, *(term.decode() for term in occurrences)], pa.string()),
                    pa.array([0, *occurrences.values()], pa.int64()), pa.array([0, *map(documents.__getitem__, occurrences)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            key = lang.as_py(), source.as_py()
            occurrences, documents = held.setdefault(key, (Counter(), Counter()))
            terms = terms_of(text.as_py().encode())
            before = len(occurrences)
            occurrences.update(terms)
            documents.update(set(terms))
            size += len(occurrences) - before
            if size >= HELD:
                yield from counted()
                held.clear()
                size = 0
    yield from counted()


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """floor(UNIT (count + 2) / (total + 2 terms)) + 1, in 64 bits."""
    whole = total + 2 * terms
    share, rest = np.divmod(counts + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        share = share * 1000 + digit
    return share + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Trees:
    """Segment trees of equal width over one store of nodes, per level: a leaf is a count, an inner node a pair of nodes."""

    def __init__(self, counts: np.ndarray):
        """``counts``: a row per tree, with as many columns as there are terms, padded to a power of two by -1."""
        width = 1 << max(counts.shape[1] - 1, 0).bit_length()
        padded = np.full((counts.shape[0], width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        #: Children of each node, from the level above the leaves up to the roots.
        self.children: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            pairs, inverse = np.unique(nodes.reshape(-1, 2), axis=0, return_inverse=True)
            self.children.append(pairs)
            nodes = inverse.reshape(nodes.shape[0], -1)
        self.roots = nodes[:, 0]

    def compare(self, one: int, other: int, totals: tuple[int, int], terms: int) -> int:
        """Sum of the prices of all leaves of two trees with these totals."""
        pairs, ways = np.array([[self.roots[one], self.roots[other]]]), []
        for children in reversed(self.children):
            below = np.concatenate([np.stack([children[pairs[:, 0], side], children[pairs[:, 1], side]], axis=1) for side in (0, 1)])
            numbers, way = np.unique(below[:, 0] * (1 << 32) + below[:, 1], return_inverse=True)
            pairs = np.stack([numbers >> 32, numbers & 0xFFFFFFFF], axis=1)
            ways.append(way)
        left, right = self.leaves[pairs[:, 0]], self.leaves[pairs[:, 1]]
        value = np.zeros(len(pairs), np.int64)
        real = left >= 0
        value[real] = price(shares(left[real], totals[0], terms), shares(right[real], totals[1], terms))
        for way in reversed(ways):
            half = len(way) // 2
            value = value[way[:half]] + value[way[half:]]
        return int(value[0])

    def places(self, one: int) -> np.ndarray:
        """Places of the tree's leaves with a count over 0, going down only where there are any."""
        some = self.leaves > 0
        levels = [some]
        for children in self.children:
            some = some[children].any(axis=1)
            levels.append(some)
        nodes, places = np.array([self.roots[one]]), np.zeros(1, np.int64)
        for level in range(len(self.children), 0, -1):
            both = self.children[level - 1][nodes]
            nodes, places = both.reshape(-1), (places[:, None] * 2 + np.arange(2)).reshape(-1)
            keep = levels[level - 1][nodes]
            nodes, places = nodes[keep], places[keep]
        return places[levels[0][nodes]]


def _compare_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial distances of the sources of two tiles over one block, and the best terms of each source of a tile."""
    table = pa.Table.from_batches(list(batches))
    rows = sorted(table.to_pylist(), key=lambda r: (r["role"], r["source"] or ""))
    width = rows[0]["width"]
    counts = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        if row["places"]:
            counts[i, row["places"]] = row["counts"]
    lang, terms = rows[0]["lang"], rows[0]["v"]
    first = [i for i, r in enumerate(rows) if r["role"] == 0]
    second = [i for i, r in enumerate(rows) if r["role"] == 1]
    alone = rows[0]["one"] == rows[0]["two"]
    whole = next((i for i, r in enumerate(rows) if r["role"] == 2), None)
    out: list[tuple] = []
    trees = Trees(counts) if width else None
    for k, i in enumerate(first):
        for j in first[k + 1 :] if alone else second:
            value = trees.compare(i, j, (rows[i]["total"], rows[j]["total"]), terms) if trees else 0
            out.append((lang, "pair", rows[i]["source"], rows[j]["source"], value))
        if trees and whole is not None:
            places = trees.places(i)
            p = shares(counts[i, places], rows[i]["total"], terms)
            q = shares(counts[whole, places], rows[whole]["total"], terms)
            value = price(p, q)
            more = np.flatnonzero(p > q)
            if len(more) > TOP_TERMS:
                least = np.partition(value[more], len(more) - TOP_TERMS)[len(more) - TOP_TERMS]
                more = more[value[more] >= least]
            names = rows[whole]["terms"]
            best = sorted(((-int(value[x]), names[places[x]].encode(), names[places[x]]) for x in more))[:TOP_TERMS]
            out.extend((lang, "term", rows[i]["source"], term, -value) for value, _, term in best)
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "part", "source", "item", "value"])


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of a source to the others of its language, and the terms that set it apart."""
    empty_if_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty_if_null(lang_col).alias("lang"), empty_if_null(source_col).alias("source"), empty_if_null(text_col).alias("text"))
    counts = checkpointed(
        rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    kept = (
        counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
        .agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    dealt = kept.join(langs, "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.ceil(F.col("v") / block))).cast("int")
    )
    in_block = Window.partitionBy("lang", "block")
    terms = checkpointed(dealt.select(
        "lang", "term", "block", "in_lang",
        (F.row_number().over(in_block.orderBy(F.desc("in_lang"), "term")) - 1).alias("place"), F.count("*").over(in_block).cast("int").alias("width"),
    ))

    cells = counts.filter(F.col("term").isNotNull()).join(terms.select("lang", "term", "block", "place"), ["lang", "term"])
    vectors = cells.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("place", "n")).alias("cells"), F.sum("n").alias("sum"))
    totals = vectors.groupBy("lang", "source").agg(F.sum("sum").alias("total"))
    # A source takes part in every block of its language, and so does the language; one without kept terms has one block of none.
    sizes = counts.filter(F.col("term").isNull()).groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sources = (
        counts.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang")
        .join(langs, "lang", "left").select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "tiles",
            F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"),
        )
    )
    blocks = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int") - 1))
    tile_pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(F.col("tile"), t).alias("one"), F.greatest(F.col("tile"), t).alias("two"), (F.col("tile") > t).cast("int").alias("role"))))
    widths = terms.groupBy("lang", "block").agg(
        F.first("width").alias("width"),
        F.sort_array(F.collect_list(F.struct("place", F.col("in_lang").alias("n"), "term"))).alias("cells"),
    )
    members = (
        sources.withColumn("block", blocks).join(widths.select("lang", "block", "width"), ["lang", "block"], "left")
        .join(vectors.drop("sum"), ["lang", "source", "block"], "left").withColumn("pair", tile_pairs)
        .select(
            "lang", "block", "pair.one", "pair.two", "pair.role", "source", "total", "v", F.coalesce("width", F.lit(0)).alias("width"),
            F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"), F.lit(None).cast("array<string>").alias("terms"),
        )
    )
    whole = (
        widths.join(langs, "lang").join(sizes, "lang").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "lang", "block", F.col("tile").alias("one"), F.col("tile").alias("two"), F.lit(2).alias("role"), F.lit(None).cast("string").alias("source"),
            F.col("lang_total").alias("total"), "v", "width", F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"), F.col("cells.term").alias("terms"),
        )
    )
    parts = members.unionByName(whole).groupBy("lang", "block", "one", "two").applyInArrow(
        _compare_block, "lang string, part string, source string, item string, value long"
    )
    found = checkpointed(parts)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("p")).select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    tops = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(ranks))
    return ranked(pairs).unionByName(ranked(tops).filter(F.col("rank") <= TOP_TERMS))
