"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests tells from language.

Base kinds are assignments to secret names, access keys and long hexadecimal runs; they are always reported. Further
tokens (runs of 20 or more characters of encodings) are tested:

* The encoding is inferred from the characters: base 16, 32, 36 or 64. A run that fits none as a whole, such as NAME=VALUE
  or a path, is cut at inner ``=`` and at characters foreign to each encoding (and to letters and digits), and every part
  of 20 or more characters is tested at its own place; of accepted parts that overlap the least like language is reported.
* Under uniform characters of that encoding: chi-squared of the counts, runs above and below the middle of the alphabet,
  serial correlation at lag one. A token that one of them rejects (after Bonferroni) isn't random.
* Under language: how unlikely so few coinciding characters, and so many changes between capitals, small letters and
  digits, are in words of that length; both in one p-value by Fisher's method.
* False discoveries are held at ``FALSE_DISCOVERIES`` by the step-up rule of Benjamini and Hochberg over all tokens of the
  corpus of the same encoding and length band, as short tokens hold less evidence. P-values are counted in cells, so the
  rule needs one grouping; its limits, one number per encoding and band, are all that comes to the driver.

Only DataFrame functions are used and texts are not shuffled. Offsets count code points, ends are exclusive. Defined
results: a null or empty text has no spans; rows that repeat are scanned each by itself and count in the rule each; other
columns are ignored; an empty table gives an empty result. A text of any length is scanned whole, in time that grows with
its length and matches. Of accepted parts that overlap and are equally unlike language the longer one is reported, then
the earlier one; spans that start at one place are listed by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import bound, text_of
from scanloom.sources.checkpoint import checkpointed

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Small-letter texts one of which an assignment holds.
NAMES = ("password", "passwd", "secret", "token", "api")
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order in which they are tried: name, characters, padding allowed, alphabet in its order.
ENCODINGS = (
    ("decimal", "[0-9]+", None),
    ("hex", "[0-9A-Fa-f]+", DIGITS + "abcdef"),
    ("base32", "[A-Z2-7]+=*", UPPER + "234567"),
    ("base36", "[a-z0-9]+|[A-Z0-9]+", DIGITS + LOWER),
    ("base64", "[A-Za-z0-9+/]+={0,2}", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+={0,2}", UPPER + LOWER + DIGITS + "-_"),
)
#: Any encoding, and the parts of runs that fit none. Only ``=`` at the end of a run can be padding, not one before a value.
WHOLE = "^(?:" + "|".join(pattern for _, pattern, _ in ENCODINGS) + ")$"
LEAST = 20
PADDED = "(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
PARTS = (
    "[0-9A-Fa-f]{20,}", "[A-Z2-7]{14,}(?:=+(?![A-Za-z0-9+/_-]))?", "[a-z0-9]{20,}", "[A-Z0-9]{20,}",
    "[A-Za-z0-9]{18,}" + PADDED, "[A-Za-z0-9+/]{18,}" + PADDED, "[A-Za-z0-9_-]{18,}" + PADDED,
)
#: Lengths at which a band begins.
BANDS = (20, 28, 40, 64, 128)
RANDOM_LEVEL, FALSE_DISCOVERIES = 0.001, 0.001
#: Chance that two letters of a text, or three, are the same, and that neighbours differ in kind; usual for Western languages.
SAME_TWO, SAME_THREE, CHANGE = 0.066, 0.0055, 0.08
#: Cells of p-values for each power of ten, and the power beyond which they count alike.
CELLS, LAST_POWER = 20, 300

SPANS = "array<struct<start:int,kind:int,end:int>>"
TOKENS = "array<struct<start:int,end:int,token:string>>"
#: Values of a block of running sums.
BLOCK = 256


def _running(values: Column, add=lambda x, y: x + y) -> Column:
    """Running sums of an array, or what else ``add`` makes of its values.

    A fold that appends copies its array at each step, so it goes over blocks, and over what comes out of each: the time
    grows with the array, and not with its square.
    """

    def fold(array: Column) -> Column:
        def step(state: Column, v: Column) -> Column:
            last = F.when(state.getField("last").isNull(), v).otherwise(add(state.getField("last"), v))
            return F.struct(last.alias("last"), F.array_append(state.getField("all"), last).alias("all"))

        start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(array, start, step, lambda state: state.getField("all"))

    def of_values(array: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(array), F.lit(BLOCK))
        return bound(F.transform(firsts, lambda first: fold(F.slice(array, first, BLOCK))), of_blocks)

    def of_blocks(blocks: Column) -> Column:
        def shifted(ends: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda block, i: F.transform(
                block, lambda v: F.when(i == 0, v).otherwise(add(F.get(ends, i - 1), v)))))

        return bound(fold(F.transform(blocks, lambda block: F.element_at(block, -1))), shifted)

    return F.when(F.size(values) > 0, bound(values, of_values)).otherwise(F.array().cast("array<int>"))


def _located(text: Column, pattern: str, kind: int | None, keep=None) -> Column:
    """Spans of all matches, from the lengths of what lies between them. ``keep(i)``: whether the i-th match counts.
    Without a kind, the spans have the text of the match (``token``) instead."""

    def from_matches(matches: Column) -> Column:
        def from_parts(parts: Column) -> Column:
            # What lies before a match and the match in turn, each ending where the lengths up to it add up to.
            lengths = F.flatten(F.transform(matches, lambda m, i: F.array(F.length(F.get(parts, i)), F.length(m))))
            return bound(_running(lengths), from_ends)

        def from_ends(ends: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start, end = F.get(ends, i * 2).alias("start"), F.get(ends, i * 2 + 1).alias("end")
                return F.struct(start, end, m.alias("token")) if kind is None else F.struct(start, F.lit(kind).alias("kind"), end)

            spans = F.transform(matches, span)
            return spans if keep is None else F.filter(spans, lambda _, i: keep(i))

        return bound(F.split(text, pattern, -1), from_parts)

    none = F.array().cast(TOKENS if kind is None else SPANS)
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, from_matches(m)).otherwise(none))


def _overlapped(base: Column, reach: Column):
    """Whether any of ``base``, sorted by start, overlaps a span. ``reach``: the largest end up to each. By bisection."""

    def test(t: Column) -> Column:
        start, end = t.getField("start"), t.getField("end")

        def halve(state: Column, _: Column) -> Column:
            low, high = state.getField("low"), state.getField("high")
            middle = F.floor((low + high) / 2).cast("int")
            before = F.get(base, middle).getField("start") < end
            done = low >= high
            return F.struct(
                F.when(~done & before, middle + 1).otherwise(low).alias("low"),
                F.when(done | before, high).otherwise(middle).alias("high"),
            )

        whole = F.struct(F.lit(0).alias("low"), F.size(base).alias("high"))
        count = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(base)))), whole, halve, lambda state: state.getField("low"))
        return bound(count, lambda n: (n > 0) & F.coalesce(F.get(reach, n - 1) > start, F.lit(False)))

    return test


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    none = F.array().cast(SPANS)
    small = F.lower(text)
    named = small.contains(NAMES[0])
    for name in NAMES[1:]:
        named = named | small.contains(name)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = bound(values, lambda v: _located(text, ASSIGN, 0, lambda i: F.length(F.get(v, i)) >= MIN_ASSIGNED))
    return F.sort_array(F.concat(
        F.when(named, assigned).otherwise(none),
        F.when(text.contains("AKIA"), _located(text, ACCESS, 1)).otherwise(none),
        _located(text, HEX, 2),
    ))


# ---- tests of one token ---------------------------------------------------------------------------------

def _upper_tail(z: Column) -> Column:
    """Chance that a normal variable exceeds z: the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1.0 / (1.0 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _inferred(token: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern, alphabet in reversed(ENCODINGS):
        found = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(name if alphabet else None).cast("string")).otherwise(found)
    return found


def _alphabet(encoding: Column) -> Column:
    found = F.lit("")
    for name, _, alphabet in ENCODINGS:
        found = F.when(encoding == name, F.lit(alphabet or "")).otherwise(found)
    return found


def tested(tokens: DataFrame) -> DataFrame:
    """``tokens`` (with ``token``) plus ``encoding, n, p_random, p_language``; null where no encoding fits."""
    rows = tokens.withColumn("encoding", _inferred(F.col("token")))
    one_case = F.when(F.col("encoding").isin("hex", "base36"), F.lower("token")).otherwise(F.col("token"))
    rows = rows.withColumn("plain", F.regexp_replace(one_case, "=+$", ""))
    rows = rows.withColumn("alphabet", _alphabet(F.col("encoding"))).withColumn("n", F.length("plain"))
    rows = rows.withColumn("size", F.length("alphabet")).withColumn("chars", F.split("plain", ""))
    rows = rows.withColumn("values", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c) - 1.0))
    counts = F.transform(F.array_distinct("chars"), lambda c: F.length("plain") - F.length(F.replace(F.col("plain"), c, F.lit(""))))
    rows = rows.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c.cast("double")))
    n, size = F.col("n").cast("double"), F.col("size").cast("double")

    chi = size / n * F.col("squares") - n
    p_uniform = 2 * _upper_tail(F.abs((chi - (size - 1)) / F.sqrt(2 * (size - 1))))
    rows = rows.withColumn("high", F.transform("values", lambda v: v >= (F.col("size") / 2)))
    changes = lambda column: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(column) - 1)), F.lit(0.0),
        lambda a, i: a + F.when(F.get(F.col(column), i) != F.get(F.col(column), i - 1), 1.0).otherwise(0.0),
    )
    rows = rows.withColumn("runs", changes("high") + 1).withColumn(
        "ups", F.aggregate("high", F.lit(0.0), lambda a, h: a + h.cast("int"))
    )
    ups, downs = F.col("ups"), n - F.col("ups")
    runs_mean = 2 * ups * downs / n + 1
    runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
    p_runs = F.when(runs_var > 0, 2 * _upper_tail(F.abs(F.col("runs") - runs_mean) / F.sqrt(runs_var))).otherwise(0.0)
    rows = rows.withColumn("mean", F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / n)
    around = lambda i: F.get(F.col("values"), i) - F.col("mean")
    spread = F.aggregate("values", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    lagged = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), F.lit(0.0), lambda a, i: a + around(i) * around(i - 1))
    rows = rows.withColumn("spread", spread).withColumn("lagged", lagged)
    p_serial = F.when(F.col("spread") > 0, 2 * _upper_tail(F.abs(F.col("lagged") / F.col("spread")) * F.sqrt(n))).otherwise(0.0)
    rows = rows.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least(p_uniform, p_runs, p_serial)))

    same = (F.col("squares") - n) / (n * (n - 1))
    same_var = 2 * SAME_TWO * (1 - SAME_TWO) / (n * (n - 1)) + 4 * (n - 2) * (SAME_THREE - SAME_TWO**2) / (n * (n - 1))
    p_same = _upper_tail((SAME_TWO - same) / F.sqrt(same_var))
    rows = rows.withColumn("kinds", F.transform(F.split("token", ""), lambda c: (
        F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).when(c.between("0", "9"), 3).otherwise(4)
    )))
    share = changes("kinds") / (F.size("kinds") - 1)
    rows = rows.withColumn("share", share)
    share = F.col("share")
    apart = share * F.ln(F.greatest(share, F.lit(1e-9)) / CHANGE) + (1 - share) * F.ln(F.greatest(1 - share, F.lit(1e-9)) / (1 - CHANGE))
    p_changes = F.when(share > CHANGE, F.exp(-(F.size("kinds") - 1) * apart)).otherwise(1.0)
    # In base 16 no two characters are as rare together as in language; there digits among letters have to tell.
    p_same = F.when(F.col("encoding") == "hex", F.lit(1.0)).otherwise(p_same)
    rows = rows.withColumn("both", F.greatest(p_same * p_changes, F.lit(1e-300)))
    p_language = F.col("both") * (1 - F.ln("both"))
    found = F.col("encoding").isNotNull()
    return rows.select(
        *tokens.columns, "encoding", "n",
        F.when(found, F.col("p_random")).alias("p_random"), F.when(found, F.least(F.lit(1.0), p_language)).alias("p_language"),
    )


def _band(n: Column) -> Column:
    found = F.lit(0)
    for start in BANDS:
        found = found + (n >= start).cast("int")
    return found


def limits(tokens: DataFrame) -> dict[tuple[str, int], int]:
    """The least cell of p-values that the rule accepts, by encoding and length band, where it accepts any."""
    cells = tokens.groupBy("encoding", "band", "cell").agg(F.count(F.lit(1)).alias("k"))
    group = Window.partitionBy("encoding", "band")
    least = group.orderBy(F.desc("cell"))
    cells = cells.select("*", F.sum("k").over(least).alias("upto"), F.sum("k").over(group).alias("m"))
    passed = F.pow(F.lit(10.0), -F.col("cell") / CELLS) <= FALSE_DISCOVERIES * F.col("upto") / F.col("m")
    rows = cells.filter(passed).groupBy("encoding", "band").agg(F.min("cell").alias("cell")).collect()
    return {(r.encoding, r.band): r.cell for r in rows}


def _parts(run: Column) -> Column:
    """The run if an encoding fits it, or else its parts: ``start, end`` in the text, ``run`` (where it starts) and ``token``."""
    start, end, token = (run.getField(f) for f in ("start", "end", "token"))

    def placed(p: Column) -> Column:
        a, b = p.getField("start"), p.getField("end")
        return F.struct((start + a).alias("start"), (start + b).alias("end"), start.alias("run"), p.getField("token").alias("token"))

    def once(parts: Column) -> Column:
        return F.filter(parts, lambda p, i: (i == 0) | (p != F.get(parts, i - 1)))

    cut = F.filter(F.concat(*[_located(token, pattern, None) for pattern in PARTS]), lambda p: p.getField("end") - p.getField("start") >= LEAST)
    whole = F.array(F.struct(start.alias("start"), end.alias("end"), start.alias("run"), token.alias("token")))
    return F.when(token.rlike(WHOLE), whole).otherwise(F.transform(bound(F.sort_array(cut), once), placed))


def _apart(parts: Column) -> Column:
    """Of ``parts``, structs that begin with what orders them, those that no better one overlaps, as spans."""

    def add(kept: Column, p: Column) -> Column:
        start, end = p.getField("start"), p.getField("end")
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index("random")).alias("kind"), end.alias("end")))
        over = F.exists(kept, lambda k: (k.getField("start") < end) & (start < k.getField("end")))
        return F.when(over, kept).otherwise(F.concat(kept, span))

    return F.aggregate(F.sort_array(parts), F.array().cast(SPANS), add)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    ``found`` is the spans as an array of kind, start and end.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", base_spans(F.col("text")).alias("base"), _located(F.col("text"), TOKEN, None).alias("tokens"))

    def free(base: Column) -> Column:
        reach = _running(F.transform(base, lambda b: b.getField("end")), F.greatest)
        return bound(reach, lambda r: F.filter(parts, lambda t: ~_overlapped(base, r)(t)))

    parts = F.flatten(F.transform("tokens", _parts))
    tokens = F.when(F.size("base") > 0, free(F.col("base"))).otherwise(parts)
    rows = rows.select("doc_id", "base", tokens.alias("tokens")).withColumn("row", F.monotonically_increasing_id())
    rows = checkpointed(rows)  # which also fixes the row numbers

    likely = tested(rows.select("row", F.explode("tokens").alias("t")).select("row", "t.*")).filter(F.col("encoding").isNotNull())
    cell = F.least(F.floor(-F.log10("p_language") * CELLS), F.lit(LAST_POWER * CELLS)).cast("int")
    likely = checkpointed(likely.select(
        "row", "run", "start", "end", "encoding", _band(F.col("n")).alias("band"), cell.alias("cell"), "p_random"
    ))
    accepted = F.lit(False)
    for (encoding, band), least in limits(likely).items():
        accepted = accepted | ((F.col("encoding") == encoding) & (F.col("band") == band) & (F.col("cell") >= least))
    part = F.struct((-F.col("cell")).alias("first"), (F.col("start") - F.col("end")).alias("then"), "start", "end")
    likely = likely.filter(accepted & (F.col("p_random") >= RANDOM_LEVEL))
    # Parts of a run that overlap, also by way of others, are chosen from together; the rest of a run is not looked at.
    earlier = Window.partitionBy("row", "run").orderBy("start", "end")
    first = F.coalesce(F.col("start") >= F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    likely = likely.withColumn("first", first)
    likely = likely.withColumn("cluster", F.sum(F.col("first").cast("int")).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    added = likely.groupBy("row", "run", "cluster").agg(F.collect_list(part).alias("parts"))
    added = added.groupBy("row").agg(F.flatten(F.collect_list(_apart(F.col("parts")))).alias("added"))

    rows = rows.select("row", "doc_id", "base").join(added, "row", "left")
    rows = rows.withColumn("all", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))))
    kinds = F.array(*map(F.lit, KINDS))

    def joined(column: str) -> Column:
        parts = F.transform(column, lambda x: F.concat_ws(":", F.get(kinds, x.getField("kind")), x.getField("start"), x.getField("end")))
        return F.array_join(parts, ",")

    count = lambda k: F.size(F.filter("base", lambda b: b.getField("kind") == k)).cast("long")
    found = F.transform("all", lambda x: F.struct(
        F.get(kinds, x.getField("kind")).alias("kind"), x.getField("start").alias("start"), x.getField("end").alias("end")
    ))
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"), found.alias("found"),
    )
