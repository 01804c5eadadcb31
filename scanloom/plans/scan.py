"""End-to-end scans: a table of files in, a table of findings out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.language import detect_language
from scanloom.operators.match import (
    CHUNK_BYTES, SAST_MULTI, SAST_SINGLE, SECRET, explode_hits, rule_bundles, rule_chunks, with_rule,
)
from scanloom.rules import Rule, builtin_rules, secret_rules

FINDING_COLUMNS = [
    "rule_id", "rule_name", "category", "severity", "file_path", "line_number", "line_end", "code_snippet",
    "description", "remediation", "matched_pattern", "match_type", "cwe", "owasp",
]
ORDER_COLUMNS = ["pass_ord", "rule_ord", "pattern_idx", "match_idx"]


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", detect_language(F.col("path"), F.col("content")))


def scan_code(files: DataFrame, rules: Sequence[Rule] | None = None, secrets: Sequence[Rule] | None = None,
              keep: Sequence[str] = (), multi_line: bool = True, snippets: bool = True,
              keep_clean: bool = False, once: Sequence[str] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Language rules and secret rules over the same files, the text being read once.

    ``files`` has path, content, language and the ``keep`` columns. Where it also has a boolean ``in_scan``,
    language rules only run on files that have it set. ``keep_clean`` adds one row with a null rule_id for every
    file without findings, so that totals need no join back to the files. Columns named in ``once`` come with the
    first row of each file. A pack of more than ``chunk_bytes`` is broadcast in chunks, one after the other.
    """
    rules = builtin_rules() if rules is None else rules
    secrets = secret_rules() if secrets is None else secrets
    keep = [*keep, "path", "language"]
    bundles = [rule_bundles(files.sparkSession, *chunk, multi_line) for chunk in rule_chunks(rules, secrets, chunk_bytes)]
    passes = [(SAST_SINGLE, "single", rules), (SECRET, "single", secrets)]
    passes += [(SAST_MULTI, "multi", rules)] if multi_line else []
    hits = explode_hits(files, bundles, keep, multi_line, snippets, keep_clean, list(once))
    found = with_rule(hits, passes, keep_clean).withColumnRenamed("path", "file_path")
    pattern = F.when(F.col("pass_ord") == SECRET, F.lit("")).otherwise(F.col("matched_pattern"))
    found = found.withColumns({"matched_pattern": pattern, "cwe": F.lit(""), "owasp": F.lit("")})
    return found.select(*keep[:-2], "language", *FINDING_COLUMNS, *ORDER_COLUMNS, *once)


def scan_sast(files: DataFrame, rules: Sequence[Rule] | None = None, **options) -> DataFrame:
    """Findings of the language rules alone."""
    return scan_code(files, rules, [], **options)


def scan_secrets(files: DataFrame, secrets: Sequence[Rule] | None = None, **options) -> DataFrame:
    """Findings of the secret rules alone."""
    return scan_code(files, [], secrets, multi_line=False, **options)
