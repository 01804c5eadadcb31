"""Rule matching: files in, findings out, in one pass and without a shuffle.

Each file is joined (broadcast) to the rules of its language, all its matches are computed as one array inside its
row, and that array is exploded once: neither the text nor its lines are copied per line or per rule. A regex only
runs on a file, and then on a line, that holds the plain text every match of it must contain.

Rules reach the files in chunks of a measured size (``CHUNK_BYTES``), each a broadcast of its own. A pack that needs one
chunk is a single pass. A larger one goes over the files chunk by chunk, a checkpoint in between, so that no stage holds
more than one chunk; the hits of a file add up in its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.fixed_values import LANGUAGE_KEYS
from scanloom.functions.dialect import SPACE, choose_gates
from scanloom.functions.language import UNKNOWN
from scanloom.functions.reuse import built_once
from scanloom.functions.text import fold_case, lines_of
from scanloom.rules import Pattern, Rule, language_rules, patterns_df
from scanloom.sources.checkpoint import checkpointed
from scanloom.sources.local import local_table

SAST_SINGLE, SAST_MULTI, SECRET, DEPENDENCY = range(4)  # order of the passes in a report

HIT = ("struct<pass_ord:int,rule_ord:int,pattern_idx:int,match_idx:int,"
       "line_number:int,line_end:int,code_snippet:string>")
CANDIDATES = "array<struct<start:int,rule_ord:int,pattern_idx:int,match_idx:int,end:int>>"
PATTERN = "struct<pass_ord:int,rule_ord:int,idx:int,java:string,folded:boolean,gate:array<string>,needs:array<array<string>>"
BUNDLE_SCHEMA = (
    f"language string, gate_texts array<string>, single_rules array<array<{PATTERN}>>>, "
    f"multi_rules array<array<{PATTERN},twins:array<struct<rule_ord:int,idx:int>>>>>"
)

# Marks around multi-line matches; noncharacters, and taken out of the text first should it hold them.
OPEN, CLOSE, STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2"

DEDUPE_GAP = 3

#: Most bytes of the rules that are broadcast at once, over all languages; a lone rule, or the rules of one id if some have
#: multi-line patterns, are not parted. What findings repeat from their rules is broadcast up to the same size.
CHUNK_BYTES = 16 << 20
#: What a pattern takes beside its texts, for headers and offsets of the arrays it is kept in.
PATTERN_OVERHEAD = 256


# ---- rules as data --------------------------------------------------------------------------------------

def _row(pass_ord: int, rule: Rule, p: Pattern) -> dict:
    return {"pass_ord": pass_ord, "rule_ord": rule.ord, "idx": p.idx, "java": p.java, "folded": p.folded,
            "needs": [list(n) for n in p.required]}


def _multi_group(rules: list[Rule]) -> list[dict]:
    """Multi-line patterns of the rules that share one id, each with the single-line patterns of the same text."""
    same_text: dict[str, list[dict]] = {}
    for s in rules:
        for q in s.single:
            same_text.setdefault(q.text, []).append({"rule_ord": s.ord, "idx": q.idx})
    return [_row(SAST_MULTI, r, p) | {"twins": same_text.get(p.text, [])} for r in rules for p in r.multi]


def _bytes_of(rule: Rule, everywhere: bool = False) -> int:
    """What a rule takes in the bundles of its languages; a text it requires may be listed as a gate, too."""
    keys = set(rule.languages)
    languages = len(LANGUAGE_KEYS) + 1 if everywhere else sum(1 for names in LANGUAGE_KEYS.values() if keys.intersection(names))
    size = sum(
        PATTERN_OVERHEAD + len(p.java.encode()) + 3 * sum(len(t.encode()) + 8 for texts in p.required for t in texts)
        for p in (*rule.single, *rule.multi))
    return size * languages


def rule_chunks(rules: Sequence[Rule], secrets: Sequence[Rule], chunk_bytes: int = CHUNK_BYTES) -> list[tuple[list[Rule], list[Rule]]]:
    """Rules and secret rules dealt into chunks of at most so many bytes, each rule into one; at least one chunk.

    Rules of one id stay together if any of them has multi-line patterns, as their matches are thinned out together.
    """
    by_id: dict[str, list[Rule]] = {}
    for rule in rules:
        by_id.setdefault(rule.id, []).append(rule)
    units: list[tuple[list[Rule], list[Rule]]] = []
    for group in by_id.values():
        units += [(group, [])] if any(r.multi for r in group) else [([r], []) for r in group]
    units += [([], [r]) for r in secrets]
    chunks: list[tuple[list[Rule], list[Rule]]] = [([], [])]
    filled = 0
    for some_rules, some_secrets in units:
        size = sum(map(_bytes_of, some_rules)) + sum(_bytes_of(r, everywhere=True) for r in some_secrets)
        if filled and filled + size > chunk_bytes:
            chunks.append(([], []))
            filled = 0
        chunks[-1][0].extend(some_rules)
        chunks[-1][1].extend(some_secrets)
        filled += size
    return chunks


def rule_bundles(spark: SparkSession, rules: Sequence[Rule], secrets: Sequence[Rule], multi_line: bool = True) -> DataFrame:
    """For every language the rules that apply to it; secret rules apply to all, also where the language is unknown."""
    rows = []
    for language in [*LANGUAGE_KEYS, UNKNOWN]:
        chosen = language_rules(rules, language)
        single = [[_row(SAST_SINGLE, r, p) for p in r.single] for r in chosen]
        single += [[_row(SECRET, r, p) for p in r.single] for r in secrets]
        same_id: dict[str, list[Rule]] = {}
        for r in chosen if multi_line else ():
            same_id.setdefault(r.id, []).append(r)
        multi = [_multi_group(group) for group in same_id.values()]
        patterns = [p for group in single + multi for p in group]
        for p, gate in zip(patterns, choose_gates([p["needs"] for p in patterns])):
            p["gate"] = list(gate)
        rows.append({
            "language": language,
            "gate_texts": sorted({t for p in patterns for t in p["gate"]}),
            "single_rules": [s for s in single if s],
            "multi_rules": [m for m in multi if m],
        })
    return local_table(spark, rows, BUNDLE_SCHEMA)


# ---- matching -------------------------------------------------------------------------------------------

def _may_match(folded: Column, pattern: Column) -> Column:
    """False only where the pattern cannot match."""
    return F.forall(pattern["needs"], lambda need: F.exists(need, lambda text: F.contains(folded, text)))


@built_once
def _possible(kinds: tuple[str, ...]) -> Column:
    """The rules of each kind, cut down to the patterns that may match somewhere in the file."""

    def cut_down(rules: str, present: Column) -> Column:
        kept = F.transform(rules, lambda ps: F.filter(ps, lambda p: (
            ((F.size(p["gate"]) == 0) | F.arrays_overlap(p["gate"], present)) & _may_match(F.col("_folded"), p))))
        return F.filter(kept, lambda ps: F.size(ps) > 0)

    # The one-element array gives the texts found a name, so each is looked for once, not once per pattern.
    present = F.filter("gate_texts", lambda t: F.contains(F.col("_folded"), t))
    return F.transform(F.array(present), lambda found: F.struct(
        *[cut_down(kind, found).alias(kind) for kind in kinds]))[0]


def _line(n: Column) -> Column:
    """Line ``n``, counted from 0; null outside the file."""
    return F.get(F.col("_lines"), n)


def _single_hits(rules: Column, snippets: bool) -> Column:
    """One hit per line and rule: the first pattern of the rule that matches the line."""

    def of_rule(patterns: Column) -> Column:
        def first_match(line: Column, i: Column) -> Column:
            folded = F.get(F.col("_folded_lines"), i)
            return F.aggregate(patterns, F.lit(None).cast("int"), lambda found, p: F.coalesce(
                found, F.when(
                    _may_match(folded, p) & F.rlike(F.when(p["folded"], folded).otherwise(line), p["java"]), p["idx"])))

        def hit(idx: Column, i: Column) -> Column:
            around = F.concat_ws("\n", *[_line(i + d) for d in range(-2, 3)]) if snippets else F.lit("")
            return F.when(idx.isNotNull(), F.struct(
                patterns[0]["pass_ord"].alias("pass_ord"), patterns[0]["rule_ord"].alias("rule_ord"),
                idx.alias("pattern_idx"), F.lit(0).alias("match_idx"),
                (i + 1).alias("line_number"), F.lit(None).cast("int").alias("line_end"),
                around.alias("code_snippet")))

        return F.filter(F.transform(F.transform("_lines", first_match), hit), lambda h: h.isNotNull())

    return F.flatten(F.transform(rules, of_rule))


def _spans(pattern: Column) -> Column:
    """Start and end line of every non-blank match of the pattern in the whole text, in order."""
    content = F.when(pattern["folded"], F.col("_folded")).otherwise(F.col("content"))
    holds_marks = F.contains(content, F.lit(OPEN)) | F.contains(content, F.lit(CLOSE))
    content = F.when(holds_marks, F.translate(content, OPEN + CLOSE, STAND_IN * 2)).otherwise(content)
    marked = F.regexp_replace(content, pattern["java"], F.lit(f"{OPEN}$0{CLOSE}"))

    def lines_with(mark: str, lines: Column) -> Column:
        def times(line: Column) -> Column:
            without = F.replace(line, F.lit(mark), F.lit(""))
            return F.when(F.contains(line, F.lit(mark)), F.length(line) - F.length(without)).otherwise(0)
        return F.flatten(F.transform(lines, lambda line, i: F.array_repeat(i + 1, times(line))))

    def of_lines(lines: Column) -> Column:
        return F.arrays_zip(lines_with(OPEN, lines).alias("start"), lines_with(CLOSE, lines).alias("end"))

    def of_text(text: Column) -> Column:
        without_blank = F.regexp_replace(text, f"{OPEN}([{SPACE}]*){CLOSE}", "$1")
        # One-element arrays give the marked text and its lines a name, so neither is computed for each mark.
        spans = F.transform(F.array(lines_of(without_blank)), of_lines)[0]
        return F.when(F.contains(text, F.lit(OPEN)), spans)

    return F.coalesce(F.transform(F.array(marked), of_text)[0], F.array().cast("array<struct<start:int,end:int>>"))


def thin_out(candidates: Column) -> Column:
    """Walk candidates by start line, keeping those that begin more than DEDUPE_GAP lines after the last one kept."""
    start = F.struct(F.lit(None).cast("int").alias("last_end"), F.array().cast(CANDIDATES).alias("kept"))

    def step(state: Column, c: Column) -> Column:
        near = state["last_end"].isNotNull() & (c["start"] - state["last_end"] <= DEDUPE_GAP)
        return F.when(near, state).otherwise(F.struct(
            c["end"].alias("last_end"), F.array_append(state["kept"], c).alias("kept")))

    return F.aggregate(F.array_sort(candidates), start, step, lambda s: s["kept"])


def _multi_hits(rules: Column, single_hits: Column, snippets: bool) -> Column:
    """Multi-line hits per rule id, thinned out, less those that the last single-line hit of the same text covers."""

    def of_group(patterns: Column) -> Column:
        found = F.flatten(F.transform(patterns, lambda p: F.transform(_spans(p), lambda s, i: F.struct(
            s["start"].alias("start"), p["rule_ord"].alias("rule_ord"), p["idx"].alias("pattern_idx"),
            i.alias("match_idx"), s["end"].alias("end")))))

        def covered(c: Column) -> Column:
            def by_twin(p: Column) -> Column:
                twin_hits = F.filter(single_hits, lambda h: (h["pass_ord"] == SAST_SINGLE) & F.exists(
                    p["twins"], lambda t: (t["rule_ord"] == h["rule_ord"]) & (t["idx"] == h["pattern_idx"])))
                last_line = F.array_max(F.transform(twin_hits, lambda h: h["line_number"]))
                return F.coalesce(last_line == c["start"], F.lit(False))
            return F.exists(patterns, lambda p: (F.size(p["twins"]) > 0) & (p["rule_ord"] == c["rule_ord"])
                            & (p["idx"] == c["pattern_idx"]) & by_twin(p))

        def hit(c: Column) -> Column:
            numbers = F.sequence(F.greatest(c["start"] - 2, F.lit(0)),
                                 F.least(c["end"], F.size("_lines") - 1))
            around = F.array_join(F.transform(numbers, _line), "\n") if snippets else F.lit("")
            return F.struct(
                F.lit(SAST_MULTI).alias("pass_ord"), c["rule_ord"].alias("rule_ord"),
                c["pattern_idx"].alias("pattern_idx"), c["match_idx"].alias("match_idx"),
                c["start"].alias("line_number"), c["end"].alias("line_end"), around.alias("code_snippet"))

        return F.transform(F.filter(thin_out(found), lambda c: ~covered(c)), hit)

    return F.flatten(F.transform(rules, of_group))


@built_once
def _single_column(snippets: bool) -> Column:
    return _single_hits(F.col("_possible.single_rules"), snippets).cast(f"array<{HIT}>")


@built_once
def _all_hits_column(snippets: bool) -> Column:
    single = F.col("_single")
    multi = _multi_hits(F.col("_possible.multi_rules"), single, snippets).cast(f"array<{HIT}>")
    return F.concat(single, multi).alias("_hits")


def explode_hits(files: DataFrame, bundles: Sequence[DataFrame], keep: list[str], multi_line: bool = True,
                 snippets: bool = True, keep_clean: bool = False, once: list[str] = ()) -> DataFrame:
    """One row per hit, the text left behind; ``keep_clean`` adds one row without a rule for each clean file.

    ``bundles`` are those of each chunk of the rules. ``once`` names columns that stay with the first row of their file only and are null in the others.
    ``files`` has content and language. Where it has a boolean ``in_scan``, files without it get secret rules only.
    """
    known = F.col("language").isin([*LANGUAGE_KEYS])
    if "in_scan" in files.columns:
        known = known & F.col("in_scan")
    kinds = ("single_rules", "multi_rules") if multi_line else ("single_rules",)
    rows = files.select(*keep, *once, "content", F.when(known, F.col("language")).otherwise(UNKNOWN).alias("_key"))
    for i, chunk in enumerate(bundles):
        if i and not rows.isStreaming:
            rows = checkpointed(rows)
        prepared = (
            rows.withColumn("_folded", fold_case(F.col("content")))
            .withColumns({"_lines": lines_of(F.col("content")), "_folded_lines": lines_of(F.col("_folded"))})
            .join(F.broadcast(chunk.withColumnRenamed("language", "_key")), "_key")
            .withColumn("_possible", _possible(kinds))
        )
        found = prepared.withColumn("_single", _single_column(snippets))
        column = _all_hits_column(snippets) if multi_line else F.col("_single")
        more = ["content", "_key"] if i + 1 < len(bundles) else []
        rows = found.select(*keep, *once, *more, (F.concat("_hits", column) if i else column).alias("_hits"))
    hits = rows
    # An inner explode makes Spark filter on "array not empty" first, which would compute the array twice.
    if once:
        exploded = hits.select(*keep, *once, F.posexplode_outer("_hits").alias("_at", "h"))
        first = F.coalesce(F.col("_at"), F.lit(0)) == 0
        exploded = exploded.select(*keep, *[F.when(first, F.col(c)).alias(c) for c in once], "h.*")
    else:
        exploded = hits.select(*keep, F.explode_outer("_hits").alias("h")).select(*keep, "h.*")
    return exploded if keep_clean else exploded.filter(F.col("rule_ord").isNotNull())


def with_rule(hits: DataFrame, passes: list[tuple[int, str, Sequence[Rule]]], keep_clean: bool = False) -> DataFrame:
    """Attach what findings repeat from their rule; broadcast if the rules are found small."""
    dim = patterns_df(hits.sparkSession, passes)
    size = sum(
        sum(len(t.encode()) for t in (r.id, r.name, r.category, r.severity, r.description, r.remediation, p.text)) + PATTERN_OVERHEAD
        for _, kind, rules in passes for r in rules for p in getattr(r, kind))
    return hits.join(F.broadcast(dim) if size <= CHUNK_BYTES else dim, ["pass_ord", "rule_ord", "pattern_idx"], "left" if keep_clean else "inner")
