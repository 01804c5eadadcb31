"""Whole scans of what lies on shared storage: trees of repositories, archives, tables of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.functions.language import resolve_language
from scanloom.operators import dependencies as dep
from scanloom.operators import metrics as met
from scanloom.operators.findings import union_findings
from scanloom.plans.scan import scan_code, with_language
from scanloom.rules import Rule
from scanloom.sources.checkpoint import checkpointed
from scanloom.sources.files import (
    MAX_FILE_BYTES, dealt, decode_strict, decode_text, expand_archives, list_tree, read_tree, unread_files, with_selection,
)
from scanloom.sources.history import append_history, read_history
from scanloom.streaming.incremental import append_findings


def _dependencies(manifests: DataFrame, by: str, advisories: Sequence[dict] | None) -> DataFrame:
    """Findings in manifests (``by``, inner_path, raw)."""
    strict = manifests.withColumns({"path": F.col("inner_path"), "content": decode_strict(F.col("raw"))})
    return dep.dependency_findings(dep.dependency_issues(strict, [by], advisories), [by])


def _texts(files: DataFrame, extensions: Sequence[str] | None) -> DataFrame:
    """Files as texts with language and selection. Paths are those inside the repository or archive."""
    named = with_selection(files, extensions=extensions).withColumns(
        {"path": F.col("inner_path"), "content": decode_text(F.col("raw"))})
    return with_language(named.drop("raw"))


def scan_trees(spark: SparkSession, root: str, repo_depth: int = 1, rules: Sequence[Rule] | None = None,
               multi_line: bool = True, extensions: Sequence[str] | None = None,
               advisories: Sequence[dict] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Findings in all repositories below ``root``: language rules on selected files, secret rules on all, advisories
    on manifests.

    A file that could not be read has one row without a rule, whose ``error`` says why. Findings are checkpointed,
    since which files were read is known only from the scan itself.
    """
    files = _texts(read_tree(spark, root, repo_depth, max_bytes=max_bytes), extensions)
    scanned = checkpointed(scan_code(files, rules, keep=["repo"], multi_line=multi_line, keep_clean=True))
    seen = scanned.select("repo", F.col("file_path").alias("inner_path"))
    unread = unread_files(list_tree(spark, root, repo_depth), seen, max_bytes).withColumnRenamed("inner_path", "file_path")
    manifests = read_tree(spark, root, repo_depth, only=dep.is_manifest, max_bytes=max_bytes)
    return union_findings(scanned.filter(F.col("rule_id").isNotNull()), _dependencies(manifests, "repo", advisories), unread)


def scan_arriving_files(spark: SparkSession, root: str, output: str, checkpoint: str, repo_depth: int = 1,
                        rules: Sequence[Rule] | None = None, multi_line: bool = True,
                        extensions: Sequence[str] | None = None, advisories: Sequence[dict] | None = None) -> StreamingQuery:
    """All three passes over files as they arrive below ``root``; each file is scanned once, manifests included."""
    arriving = read_tree(spark, root, repo_depth, stream=True)
    code = scan_code(_texts(arriving, extensions), rules, keep=["repo"], multi_line=multi_line)
    issues = _dependencies(arriving.filter(dep.is_manifest(F.col("inner_path"))), "repo", advisories)
    return append_findings(union_findings(code, issues), output, checkpoint)


def tree_files_scanned(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Files per repository after pruning; only names are read."""
    return met.files_scanned(with_selection(list_tree(spark, root, repo_depth)), ["repo"])


def read_archives(spark: SparkSession, paths: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("path").alias("archive"), F.col("content").alias("raw"))


def scan_archive_files(spark: SparkSession, paths: str, rules: Sequence[Rule] | None = None, multi_line: bool = True,
                       extensions: Sequence[str] | None = None, advisories: Sequence[dict] | None = None, partitions: int = 0) -> DataFrame:
    """Findings in all archives that ``paths`` (a folder or glob) names, dealt to so many ``partitions`` if not 0.

    An archive that cannot be read has one row without a rule, whose ``error`` says why.
    """
    # One pass: each archive is decompressed once, and the bytes of a manifest stay with the first row of its file.
    members = expand_archives(dealt(read_archives(spark, paths), partitions))
    manifest = F.when(dep.is_manifest(F.col("inner_path")), F.col("raw"))
    files = _texts(members.withColumn("manifest", manifest), extensions)
    rows = checkpointed(scan_code(files, rules, keep=["archive"], multi_line=multi_line, keep_clean=True, once=["manifest", "error"]).filter(
        F.col("rule_id").isNotNull() | F.col("manifest").isNotNull() | F.col("error").isNotNull()))
    manifests = rows.filter(F.col("manifest").isNotNull()).select(
        "archive", F.col("file_path").alias("inner_path"), F.col("manifest").alias("raw"))
    found = rows.filter(F.col("rule_id").isNotNull() | F.col("error").isNotNull()).drop("manifest")
    return union_findings(found, _dependencies(manifests, "archive", advisories))


def scan_texts(texts: DataFrame, keep: Sequence[str], rules: Sequence[Rule] | None = None,
               multi_line: bool = True, partitions: int = 0) -> DataFrame:
    """Findings in texts (content, declared_language) as they were pasted; they are not recorded in a history.

    ``partitions`` deals texts that come from few row groups to so many tasks."""
    named = dealt(texts, partitions).withColumns({
        "path": F.lit("input"), "language": resolve_language(F.col("declared_language"), F.col("content"))})
    return scan_code(named, rules, keep=keep, multi_line=multi_line)


def record_scans(findings: DataFrame, by: str, scan_type: str, at: Column, findings_path: str, history_path: str,
                 scanned: DataFrame | None = None) -> DataFrame:
    """Write findings with the id and time of their scan, add one history entry per scan, and return the entries.

    ``at`` is evaluated once; a job that may be tried again passes a fixed time. A scan is stored under its id (the time
    and ``by``): findings replace those stored under the same id before, and the history entry comes last and only once,
    so a job that is tried again, wherever it broke off, leaves what one run leaves. Scans named in ``scanned`` (``by``, files_scanned) are recorded even where nothing was found.
    """
    micros = findings.sparkSession.range(1).select(F.unix_micros(at.cast("timestamp"))).first()[0]
    at = F.timestamp_micros(F.lit(micros))
    scan_id = F.concat_ws("-", F.date_format(at, "yyyyMMddHHmmss"), by)
    findings = checkpointed(findings)
    stored = findings.withColumns({"scan_id": scan_id, "scan_ts": at}).write.partitionBy("scan_id")
    stored.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(findings_path)
    if scanned is not None:
        findings = findings.unionByName(scanned.select(by), allowMissingColumns=True)
    entries = met.scan_summary(findings, [by], scanned).withColumns({
        "id": scan_id, "scan_type": F.lit(scan_type),
        "source": F.col(by), "ts": at})
    recorded = read_history(findings.sparkSession, history_path).select("id")
    append_history(entries.join(recorded, "id", "left_anti"), history_path)
    return entries
