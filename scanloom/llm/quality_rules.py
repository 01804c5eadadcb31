"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Statistics of each document are turned into a vector (``VECTOR``). For each group of language and source, the minimum
covariance determinant is approached by concentration steps: from medians and quartile ranges on, the three quarters of
the documents that are nearest give the next mean and covariance. A document whose squared Mahalanobis distance lies
beyond ``CUTOFF`` is rejected, and so is one that fails the base rules. Distances are counted in cells, so a step is one
grouping with partial sums: no group is ever sorted or collected, and no text is shuffled.

Only DataFrame functions are used. Defined results: a null or empty text has no words and fails the base rules; null
languages and sources are values of their own; rows that repeat, and so ties, are judged each by itself, alike; a group with fewer
than ``MIN_GROUP`` documents that pass the base rules is judged by the estimate of its whole language, and where that has
fewer, too, by that of all documents, whatever their number (``pools``); a very long text is read whole, by one task;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import SPACE, bound, broadcast_if_small, group_key, text_of
from scanloom.sources.checkpoint import checkpointed

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: Documents that a group, or else its language, must have for a covariance of its own to be trusted.
MIN_GROUP = 40
#: Share of a group that the estimate rests on, and the chi-squared quantile of that share for five dimensions.
CORE_SHARE, CORE_QUANTILE = 0.75, 6.6257
#: Squared distance beyond which a document is rejected: the 0.999 quantile of chi-squared for five dimensions.
CUTOFF = 20.515
STEPS = 4
#: Distances are told apart by cells of this relative width; so are the values of each dimension at the start.
DISTANCE_CELLS, VALUE_CELLS = 16, 100

#: The vector: its parts, and the least spread of each, so that a group of like documents rejects nothing close to them.
#: Counts are shrunk towards usual values by pseudo-counts, as rates of short texts vary much. Many groups have no symbols or
#: repeats at all, so some least spread is needed; the README has what half, a fifth and less of these would reject.
VECTOR = {
    "log_words": ("ln(1 + n_words)", 1.0),
    "word_length": ("(word_chars + 100) / (n_words + 20)", 0.4),
    "symbol_rate": ("ln(1 + 10 * n_symbols / (n_words + 20))", 0.25),
    "dup_line_rate": ("n_dup_lines / (n_lines + 5)", 0.1),
    "repeat_rate": ("n_repeat_words / (n_words + 20)", 0.05),
}
DIM = len(VECTOR)
NAMES = list(VECTOR)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words which the text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_windows(windows: Column) -> Column:
        def covered(starts: Column) -> Column:
            steps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.get(starts, k + 1) - s))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        def starts_of(order: Column) -> Column:
            same = lambda k, e: F.coalesce(F.get(order, k).getField("w") == e.getField("w"), F.lit(False))
            found = F.filter(order, lambda e, k: same(k - 1, e) | same(k + 1, e))
            return F.sort_array(F.transform(found, lambda e: e.getField("i")))

        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows), bound(bound(placed, starts_of), covered)
        ).otherwise(0)

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))
        return bound(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))), of_windows)

    return F.when(F.size(words) > WINDOW, bound(hashes, of_hashes)).otherwise(0)


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = text_of("text")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        group_key(lang_col).alias("lang"), F.concat_ws("/", group_key(lang_col), group_key(source_col)).alias("group"),
    )

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated_words(words).cast("long").alias("n_repeat_words"))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).alias("n_dup_lines"))

    words = F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")
    with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    rows = rows.select(
        "doc_id", "lang", "group", bound(words, counts).alias("w"), bound(with_word, lines).alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "group", "w.n_words", "word_chars", "n_symbols", F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        "w.n_repeat_words", "l.n_lines",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), *[F.expr(e).cast("double").alias(n) for n, (e, _) in VECTOR.items()])


def _start(passed: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group and dimension, from counts per cell."""
    dims = F.posexplode(F.array(*[F.round(F.col(n) * VALUE_CELLS).cast("long") for n in NAMES])).alias("dim", "cell")
    cells = passed.select("group", dims).groupBy("group", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("group", "dim").orderBy("cell")
    whole = Window.partitionBy("group", "dim")
    cells = cells.select("*", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("cell"))) / VALUE_CELLS
    spread = cells.groupBy("group", "dim").agg(
        F.max("all").alias("rows"), at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd")
    )
    by = spread.groupBy("group").agg(
        F.max("rows").alias("rows"),
        *[F.max(F.when(F.col("dim") == i, F.col("mid"))).alias(f"m{i}") for i in range(DIM)],
        *[F.max(F.when(F.col("dim") == i, F.col("sd"))).alias(f"sd{i}") for i in range(DIM)],
    )
    zero = F.lit(0.0)
    covariance = {(i, j): F.col(f"sd{i}") * F.col(f"sd{i}") if i == j else zero for i in range(DIM) for j in range(i + 1)}
    return _with_factor(by.select("group", "rows", *[f"m{i}" for i in range(DIM)], *_named(covariance)))


def _named(covariance: dict) -> list[Column]:
    return [c.alias(f"c{i}{j}") for (i, j), c in covariance.items()]


def _with_factor(groups: DataFrame) -> DataFrame:
    """The Cholesky factor of each group's covariance, to which the least spreads were added."""
    for i, name in enumerate(NAMES):
        groups = groups.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + VECTOR[name][1] ** 2)
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"f{i}{k}") * F.col(f"f{j}{k}")
            groups = groups.withColumn(f"f{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"f{j}{j}"))
    kept = [f"f{i}{j}" for i in range(DIM) for j in range(i + 1)]
    return groups.select("group", "rows", *[f"m{i}" for i in range(DIM)], *kept)


def _with_distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``distance``, the squared Mahalanobis distance, by forward substitution; null without an estimate."""
    rows = rows.join(broadcast_if_small(groups), "group", "left")
    total = F.lit(0.0)
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"f{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"f{i}{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn("distance", total)


def _concentrated(passed: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean and covariance of the nearest documents of each group, widened to hold for normal data."""
    rows = _with_distance(passed, groups)
    cell = F.floor(F.ln(1 + F.col("distance")) * DISTANCE_CELLS)
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i in range(DIM) for j in range(i + 1)]
    cells = rows.groupBy("group", cell.alias("cell")).agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("n"), *sums, *products)
    before = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    core = cells.filter(F.col("before") < CORE_SHARE * F.col("rows"))
    added = [f"s{i}" for i in range(DIM)] + [f"p{i}{j}" for i in range(DIM) for j in range(i + 1)]
    core = core.groupBy("group").agg(
        F.max("rows").alias("rows"), F.sum("n").alias("n"), F.max("cell").alias("cell"), *[F.sum(c).alias(c) for c in added]
    )
    mean = {i: F.col(f"s{i}") / F.col("n") for i in range(DIM)}
    widen = F.greatest(F.lit(1.0), (F.exp((F.col("cell") + 1) / DISTANCE_CELLS) - 1) / CORE_QUANTILE)
    covariance = {
        (i, j): (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) * widen for i in range(DIM) for j in range(i + 1)
    }
    means = [m.alias(f"m{i}") for i, m in mean.items()]
    return _with_factor(core.select("group", "rows", *means, *_named(covariance)))


def pools(passed: DataFrame) -> DataFrame:
    """For each group ``pool``, whose estimate it is judged by, and ``feeds``, the pools that its documents count in.

    A group that is large enough is a pool of its own, and counts in its language's and the common one where a smaller
    group of that language, or of any, needs it.
    """
    groups = passed.groupBy("lang", "group").agg(F.count(F.lit(1)).alias("n"))
    by_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.bool_or(F.col("n") < MIN_GROUP).alias("lang_needed"))
    few = F.col("lang_n") < MIN_GROUP
    own, of_lang, common = F.concat(F.lit("group "), "group"), F.concat(F.lit("lang "), "lang"), F.lit("all")
    rows = checkpointed(groups.join(by_lang, "lang").select(
        "group", F.when(F.col("n") >= MIN_GROUP, own).when(few, common).otherwise(of_lang).alias("pool"), own.alias("own"),
        F.when(F.col("lang_needed") & ~few, of_lang).alias("of_lang"),
    ))
    common_needed = bool(rows.filter(F.col("pool") == common).limit(1).count())
    fed = F.array(F.when(F.col("pool") == F.col("own"), F.col("own")), F.col("of_lang"), F.when(F.lit(common_needed), common))
    return rows.select("group", "pool", F.array_compact(fed).alias("feeds"))


def estimate(stats: DataFrame, pooled: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of each pool."""
    passed = stats.filter(~F.col("base_failed")).join(broadcast_if_small(pooled.select("group", "feeds")), "group")
    passed = passed.select(F.explode("feeds").alias("group"), *NAMES)
    groups = checkpointed(_start(passed))
    for _ in range(STEPS):
        groups = checkpointed(_concentrated(passed, groups))
    return groups


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per document: its id, six statistics, ``base_failed``, ``kept`` and ``distance`` (null: all of its group fail the base rules)."""
    stats = checkpointed(statistics(docs, id_col, text_col, lang_col, source_col))
    pooled = pools(stats.filter(~F.col("base_failed")))
    rows = stats.join(broadcast_if_small(pooled.select("group", "pool")), "group", "left").drop("group").withColumnRenamed("pool", "group")
    rows = _with_distance(rows, estimate(stats, pooled))
    outlier = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"), "distance",
    )
