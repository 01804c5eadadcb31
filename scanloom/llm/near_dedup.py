"""Near duplicates: b-bit MinHash proposes links between documents, their whole shingle sets confirm them.

A document's set holds the distinct runs of ``shingle`` words, ASCII letters in lower case; a text with fewer words has
the whole sequence as its one element, and one without words has none and links with nothing. Documents are linked when
100 * intersection >= percent * union of their sets, and components of linked documents are near duplicates.

1. Documents with the same set form a class and from here on one row; a third of all rows being copies is one row.
2. Each class gets 256 minima, cut into 42 bands of six. Two sets of similarity 0.8 share no band once in 350,000.
3. In a bucket of classes that share a band, each is paired with the least of them only. Pairs whose packed signatures of
   two bits per minimum, corrected for chance, or whose sizes are too far apart go; whole sets confirm the others.
4. In buckets that still hold several components, what does not belong to the largest is paired with one more of its
   members, another for each bucket. What still doesn't belong is compared with everything of other components in such
   buckets, by the rare elements that linked sets must share: no link is left out, and a large bucket of near copies,
   nearly one component by now, isn't paired out.
5. Components are found by spreading least labels along links and jumping along labels, with a checkpoint per round.

Sets are made of 64-bit hashes and compared exactly. No list of links, components or documents comes to the driver.

Defined results: a null text is an empty one; a null id is never the name of a component that has another; rows that
repeat are in one component, and ``keep_one`` keeps rows that repeat both id and text together (exact duplicates come
first); extra columns are carried by ``keep_one`` and ignored by ``components``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import release, text_of
from scanloom.llm.wordhash import M1, WordHashes, mixed, windows, words_of
from scanloom.sources.checkpoint import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS, MINIMA = 42, 6, 256
#: Bits kept of each minimum, and minima in one word of a signature.
BITS = 2
PER_WORD = 64 // BITS
#: Estimates spread by 0.03 around the similarity. What they rule out is looked at again, by elements.
MARGIN = 0.03
#: Rounds in which large buckets are joined up before all that is left is compared.
TURNS = 1
#: Shingles whose minima are taken at once.
BLOCK = 4096

_random = np.random.default_rng(20_240_607)
FACTORS = (_random.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1))[:, None]
OFFSETS = _random.integers(0, 1 << 32, MINIMA, np.uint32)[:, None]
del _random


# ---- in tasks -------------------------------------------------------------------------------------------

def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes.of([w.lower() for w in words]), min(size, len(words))) + np.uint64(min(size, len(words))))


def minima(elements: np.ndarray) -> np.ndarray:
    found = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    values = (mixed(elements) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(values), BLOCK):
        found = np.minimum(found, (FACTORS * values[None, i : i + BLOCK] + OFFSETS).min(axis=1))
    return found


def signature(found: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed."""
    low = (found & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, PER_WORD)
    return (low << (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    parts = found[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = mixed(np.arange(BANDS, dtype=np.uint64) + M1)
    for j in range(ROWS):
        key = mixed(key * M1 + parts[:, j])
    return key


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, classes, signatures, keys = [], [], [], []
            for value in batch.column(2):
                elements = shingle_set(words_of(value.as_py()), size, hashes)
                found = minima(elements)
                sizes.append(len(elements))
                classes.append(hashlib.md5(elements.tobytes()).digest() if len(elements) else None)
                signatures.append(signature(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                 _lists(signatures), _lists(keys)],
                ["doc_id", "text_key", "n_shingles", "class", "signature", "bands"],
            )

    return sign


def _setter(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(words_of(t.as_py()), size, hashes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["class", "elements"])

    return sets


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def arrays(column: pa.Array) -> list[np.ndarray]:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    for batch in batches:
        n = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(arrays(batch.column(2)), arrays(batch.column(3)), strict=True)]
        sizes = [pa.compute.list_value_length(batch.column(i)).cast(pa.int64()) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *sizes], ["a", "b", "common", "n_a", "n_b"])


# ---- plans ----------------------------------------------------------------------------------------------

def signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text_of(text_col))).alias("text_key"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _signer(size),
        f"doc_id {kind}, text_key binary, n_shingles long, class binary, signature array<long>, bands array<long>",
    )


def similar_enough(a: Column, b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether signatures and sizes make it likely that the sets are linked."""
    matches = F.lit(MINIMA)
    every = F.lit(int.from_bytes(bytes([0x55] * 8), "big"))
    for i in range(MINIMA // PER_WORD):
        differ = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        matches = matches - F.bit_count((differ.bitwiseOR(F.shiftrightunsigned(differ, 1))).bitwiseAND(every))
    chance = 1.0 / (1 << BITS)
    estimate = (matches / MINIMA - chance) / (1.0 - chance)
    return (estimate >= percent / 100 - MARGIN) & (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))


def components_of(links: DataFrame) -> DataFrame:
    """``node, label``: the least node that each node of the links ``a, b`` is connected with."""
    both = checkpointed(
        links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    )
    labels = checkpointed(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
        spread = near.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        spread = spread.join(jump, "label").select("node", F.least("label", "further").alias("label"))
        spread = checkpointed(spread)
        if spread.join(labels, ["node", "label"], "left_anti").isEmpty():
            return spread
        labels = spread


def _shared_bands(classes: DataFrame) -> DataFrame:
    """``band, class, center``: classes in buckets of two and more, with the least class of their bucket."""
    placed = classes.select("class", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("class").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return checkpointed(placed.join(buckets.select("band", "center"), "band"))


def _sets(docs: DataFrame, classes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """The whole shingle sets of ``classes``, from the text of each one's first document."""
    wanted = classes.select("class", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key"))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_of(text_col))).alias("key"), F.col(text_col).alias("text"))
    same = [wanted["key"] == texts["key"], wanted["id"].eqNullSafe(texts["id"])]
    texts = texts.join(wanted, same).select("class", "text")
    return checkpointed(texts.mapInArrow(_setter(size), "class binary, elements array<long>").dropDuplicates(["class"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``a, b`` whose whole sets are similar enough."""
    likely = pairs.join(sets.select(F.col("class").alias("a"), F.col("elements").alias("x")), "a")
    likely = likely.join(sets.select(F.col("class").alias("b"), F.col("elements").alias("y")), "b")
    counted = likely.select("a", "b", "x", "y").mapInArrow(_common, "a binary, b binary, common long, n_a long, n_b long")
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return checkpointed(counted.filter(100 * F.col("common") >= percent * union).select("a", "b"))


def _likely(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes in one bucket that signatures and sizes allow; both sides have ``band, class, n, signature``."""
    x = one.select("band", *[F.col(c).alias(f"{c}_a") for c in one.columns if c != "band"])
    y = two.select("band", *[F.col(c).alias(f"{c}_b") for c in two.columns if c != "band"])
    fit = similar_enough(F.col("signature_a"), F.col("signature_b"), F.col("n_a"), F.col("n_b"), percent)
    fit = fit & (F.col("class_a") != F.col("class_b"))
    pairs = x.join(y, "band").filter(fit)
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their own component and the bucket's largest."""
    labelled = members.join(labels.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "class"))
    by_label = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    several = by_label.groupBy("band").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
    return labelled.join(several.filter("labels > 1").select("band", F.col("most.label").alias("main")), "band")


def _rest(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of what doesn't belong to its bucket's largest component with all it may be linked to elsewhere.

    Linked sets have need = percent/(100+percent) * (n_a + n_b) elements in common. In one order of all elements, what
    they have in common begins at places i and j with n_a - i >= need and n_b - j >= need, so only the front of a set is
    looked up: places with n - i >= percent/100 n, and of the smaller of two with n - i >= 2 percent/(100+percent) n.
    With rare elements first, what sets a near copy apart comes first, so a copy that is too different from the others of
    a large group meets almost none of them. No link is left out.
    """
    lone = F.max(F.col("label") != F.col("main")).alias("lone")
    whole = checkpointed(inside.groupBy("class").agg(lone, F.first("label").alias("label"), F.first("n").alias("n")))
    elements = sets.join(whole.select("class", "n"), "class").select("class", "n", F.explode("elements").alias("element"))
    often = elements.groupBy("element").agg(F.count(F.lit(1)).alias("k"))
    placed = elements.join(often, "element").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("k", "element"))).alias("all"))
    front = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    starts = placed.select("class", F.posexplode(F.transform(front, lambda x: x.getField("element"))).alias("place", "element"))
    starts = checkpointed(starts.join(whole, "class").withColumn("left", F.col("n") - F.col("place")).drop("place"))

    x = starts.filter("lone").select("element", *[F.col(c).alias(f"{c}_a") for c in ("class", "n", "left", "label")])
    y = starts.select("element", *[F.col(c).alias(f"{c}_b") for c in ("class", "n", "left", "label", "lone")])
    least_left = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    fit = least_left & sizes & (F.col("label_a") != F.col("label_b"))
    smaller = F.struct("n_a", "class_a") < F.struct("n_b", "class_b")
    # Two lone ones meet once only, where the smaller of them is a.
    up = x.filter((100 + percent) * F.col("left_a") >= 2 * percent * F.col("n_a")).join(y, "element").filter(fit & smaller)
    short = y.filter(~F.col("lone_b") & ((100 + percent) * F.col("left_b") >= 2 * percent * F.col("n_b")))
    down = x.join(short, "element").filter(fit & ~smaller)
    pairs = up.select("class_a", "class_b").union(down.select("class_a", "class_b"))
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def linked_classes(docs: DataFrame, rows: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``class, label``: the component of each class that is linked with another. ``rows``: what ``signed`` made of ``docs``."""
    spark = docs.sparkSession
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(
        first, F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    classes = checkpointed(classes)
    shared = _shared_bands(classes)
    brief = checkpointed(classes.select("class", "first", "n", "signature").join(shared.select("class").distinct(), "class"))
    sets = _sets(docs, brief, size, id_col, text_col)
    members = shared.join(brief.select("class", "n", "signature"), "class")
    release(spark)

    # What estimates rule out in the first two rounds is looked at again in the last, without estimates.
    centers = members.filter(F.col("class") == F.col("center")).select("band", "class", "n", "signature")
    stars = _likely(members.select("band", "class", "n", "signature"), centers, percent)
    links = _confirmed(stars, sets, percent)
    labels = components_of(links)
    for turn in range(TURNS):
        inside = _mixed_buckets(members, labels)
        main = F.col("label") == F.col("main")
        # Another member of the largest component for each bucket, so that near copies of near copies meet several.
        order = F.struct(F.xxhash64("class", "band", F.lit(turn)).alias("order"), "class", "n", "signature")
        pivots = inside.filter(main).groupBy("band").agg(F.min(order).alias("p")).select("band", "p.class", "p.n", "p.signature")
        more = _confirmed(_likely(inside.filter(~main).select("band", "class", "n", "signature"), pivots, percent), sets, percent)
        release(spark)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components_of(links)

    more = _confirmed(_rest(checkpointed(_mixed_buckets(members, labels)), sets, percent), sets, percent)
    release(spark)
    if not more.isEmpty():
        labels = components_of(links.union(more))
    return labels.withColumnRenamed("node", "class")


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """What ``signed`` made, and the first row of each component by class."""
    rows = checkpointed(signed(docs, size, id_col, text_col))
    labels = linked_classes(docs, rows, size, percent, id_col, text_col)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(key).alias("first"))
    classes = classes.join(labels, "class", "left").select("class", "first", F.coalesce("label", "class").alias("label"))
    firsts = classes.groupBy("label").agg(F.min("first").alias("of_all"))
    return rows, classes.join(firsts, "label").select("class", "of_all")


def components(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    rows, firsts = _grouped(docs, shingle, percent, id_col, text_col)
    found = rows.select("doc_id", "n_shingles", "class").join(firsts, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("of_all.doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component."""
    rows, firsts = _grouped(docs, shingle, percent, id_col, text_col)
    row = rows.select("doc_id", "text_key", "class").join(firsts, "class")
    first = F.col("doc_id").eqNullSafe(F.col("of_all.doc_id")) & (F.col("text_key") == F.col("of_all.text_key"))
    gone = row.filter(~first).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    whole = docs.withColumn("__own", F.unhex(F.md5(text_of(text_col))))
    return whole.join(
        gone, (whole["__own"] == gone["__key"]) & whole[id_col].eqNullSafe(gone["__id"]), "left_anti"
    ).drop("__own")
