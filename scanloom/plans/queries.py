"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.fixed_values import LANGUAGE_KEYS, TOP_LANGUAGES
from scanloom.functions.language import detect_language, resolve_language
from scanloom.functions.text import lines_of
from scanloom.operators import dependencies as dep
from scanloom.operators import findings as fnd
from scanloom.operators import history as hist
from scanloom.operators import metrics as met
from scanloom.plans.scan import scan_code, scan_sast, scan_secrets, with_language
from scanloom.rules import builtin_rules, catalog_df, load_rules, merge_rules, parse_rule_packs
from scanloom.sources import derived
from scanloom.sources import history as history_store
from scanloom.sources import reports
from scanloom.sources.checkpoint import checkpointed, fresh_dir
from scanloom.sources.files import decode_text, expand_archives, relative_path, with_selection
from scanloom.sources.local import local_table
from scanloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPOSITORY, SINGLE_FILE = "repository", "single_file"
AS_OF = "2024-02-01 12:00:00"
GENERATED_AT = "2024-02-01T12:00:00"
SEARCH_TEXT = "INJECTION"
HISTORY_SEARCH = "USER1"


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_query")] = f
    return f


# ---- shared inputs --------------------------------------------------------------------------------------

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """All files of the derived repositories, with language and selection."""
    files = derived.corpus_files(spark, sf).withColumn("inner_path", relative_path(F.col("path"), F.col("repo")))
    return with_language(with_selection(files))


def corpus_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without its texts: languages by name alone."""
    files = derived.corpus_of(derived.table(spark, sf, "documents").select("doc_id", F.lit("").alias("text")))
    files = files.drop("content").withColumn("inner_path", relative_path(F.col("path"), F.col("repo")))
    return with_selection(files)


def selected(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).filter("in_scan")


def corpus_findings(spark: SparkSession, sf: str, **options) -> DataFrame:
    return scan_sast(selected(spark, sf), keep=["repo"], **options)


def repo_results(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all files, those without any included, for totals by repository."""
    return scan_sast(selected(spark, sf), keep=["repo"], snippets=False, keep_clean=True)


def multiline(spark: SparkSession, sf: str) -> DataFrame:
    return with_language(derived.multiline_files(spark, sf))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    repo = F.concat(F.lit("repo"), (F.col("manifest_id") % 10).cast("string"))
    return derived.manifests(spark, sf).withColumn("repo", repo)


def everything(spark: SparkSession, sf: str, snippets: bool = False) -> DataFrame:
    """Rules on the selected files, secrets in all files, and all manifests."""
    code = scan_code(corpus(spark, sf), keep=["repo"], snippets=snippets)
    issues = dep.dependency_issues(manifests(spark, sf), keep=["repo"])
    return fnd.union_findings(code, dep.dependency_findings(issues, keep=["repo"]))


def builtin(spark: SparkSession) -> DataFrame:
    return catalog_df(spark, builtin_rules())


SHORT = ["rule_id", "severity", "file_path", "line_number", "line_end", "match_type"]


# ---- sources --------------------------------------------------------------------------------------------

@query
def scan_corpus_files(spark, sf):
    return corpus_findings(spark, sf, snippets=False).select(*SHORT, "matched_pattern")


@query
def scan_text_rows(spark, sf):
    rows = derived.text_rows(spark, sf)
    rows = rows.withColumns({
        "language": resolve_language(F.col("declared_language"), F.col("content")), "path": F.lit("input")})
    return scan_sast(rows, keep=["id"], snippets=False).select("id", "language", *SHORT)


@query
def scan_pages(spark, sf):
    return scan_sast(with_language(derived.page_rows(spark, sf)), keep=["page_id"], snippets=False).select("page_id", "language", *SHORT)


def _archives(spark: SparkSession, sf: str) -> DataFrame:
    """Each corpus file packed with a note, as zip or tar.gz; and beside every fiftieth one, bytes that are no archive."""

    def pack(doc_id: int, name: str, data: bytes) -> bytes:
        out = io.BytesIO()
        members = [(name, data), ("NOTE", b"packed\r\n")]
        if doc_id % 2:
            with tarfile.open(fileobj=out, mode="w:gz") as tf:
                for n, d in members:
                    info = tarfile.TarInfo(n)
                    info.size = len(d)
                    tf.addfile(info, io.BytesIO(d))
        else:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
                for n, d in members:
                    zf.writestr(n, d)
        return out.getvalue()

    def pack_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"a{d}", pack(d, n, c.encode())) for d, n, c in zip(b["doc_id"], b["inner_path"], b["content"])]
            rows += [(f"b{d}", b"no archive") for d in b["doc_id"] if d % 50 == 7]
            yield pd.DataFrame(rows, columns=["archive", "raw"])

    files = derived.corpus_files(spark, sf)
    files = files.select("doc_id", relative_path(F.col("path"), F.col("repo")).alias("inner_path"), "content")
    return files.mapInPandas(pack_all, "archive string, raw binary")


def _archive_members(spark: SparkSession, sf: str) -> DataFrame:
    return expand_archives(_archives(spark, sf)).withColumn("content", decode_text(F.col("raw"))).drop("raw")


@query
def expand_archives_query(spark, sf):
    members = _archive_members(spark, sf)
    return members.select("archive", "inner_path", F.md5(F.encode("content", "UTF-8")).alias("content_md5"),
                          F.col("error").isNotNull().alias("failed"))


@query
def scan_archives(spark, sf):
    members = with_selection(_archive_members(spark, sf).filter(F.col("error").isNull())).filter("in_scan")
    files = with_language(members.withColumn("path", F.col("inner_path")))
    return scan_sast(files, keep=["archive"]).select("archive", *SHORT)


@query
def scan_by_repo(spark, sf):
    files = selected(spark, sf).withColumn("path", F.col("inner_path"))
    found = scan_sast(files, keep=["repo"], snippets=False)
    return found.groupBy("repo", "file_path").agg(F.count("*").alias("findings"))


@query
def files_scanned_by_repo(spark, sf):
    return met.files_scanned(corpus_paths(spark, sf), ["repo"])


@query
def rule_catalog(spark, sf):
    found = repo_results(spark, sf).groupBy("rule_id").agg(F.count("rule_id").alias("findings"))
    return builtin(spark).join(found, F.col("id") == F.col("rule_id"), "left").select(
        "rule_ord", "id", "name", "category", "severity", F.array_join("languages", ",").alias("languages"),
        F.size("patterns").alias("patterns"), F.size("multi_line_patterns").alias("multi_line_patterns"),
        F.coalesce("findings", F.lit(0)).alias("findings"))


def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_rule_packs(derived.custom_rule_packs(spark, sf))
    return parsed.withColumn("position", F.col("pack")).drop("pack")


@query
def custom_rules_load(spark, sf):
    return custom_rules(spark, sf).select(
        "position", "id", "name", "category", "severity", "description", "remediation",
        *[F.array_join(c, ",").alias(c) for c in ("languages", "patterns", "multi_line_patterns")])


def merged_rules(spark: SparkSession, sf: str) -> DataFrame:
    return merge_rules(builtin(spark), custom_rules(spark, sf))


@query
def merge_rules_query(spark, sf):
    return merged_rules(spark, sf).select(
        "rule_ord", "block", "position", "id", "name", "category", "severity",
        F.array_join("languages", ",").alias("languages"))


@query
def advisory_by_severity(spark, sf):
    found = dep.with_advisory(dep.packages(manifests(spark, sf)))
    return found.filter(F.col("severity").isNotNull()).groupBy("ecosystem", "severity").agg(
        F.count("*").alias("uses"), F.count_distinct("name").alias("packages"))


@query
def manifest_files(spark, sf):
    """Of the corpus and the manifests, the files that are taken for manifests."""
    paths = corpus_paths(spark, sf).select("path").unionByName(derived.manifests(spark, sf).select("path"))
    return paths.filter(dep.is_manifest(F.col("path")))


@query
def findings_from_json(spark, sf):
    """Findings sent back as JSON, every other one without its optional fields."""
    found = fnd.wire(corpus_findings(spark, sf))
    optional = ("match_type", "cwe", "owasp")
    short = [F.when(F.col("line_number") % 2 == 0, F.col(c)).alias(c) for c in optional]
    sent = found.select(*[c for c in fnd.WIRE_COLUMNS if c not in optional], *short)
    rows = fnd.from_wire(sent.select(F.to_json(F.struct("*")).alias("json")))
    return rows.select(*SHORT, "rule_name", "category", "code_snippet", "cwe", "owasp", "matched_pattern")


@query
def report_json(spark, sf):
    """Reports written as JSON and read back."""
    found = checkpointed(scan_sast(selected(spark, sf), keep=["repo"], keep_clean=True))
    header = reports.report_header(met.scan_summary(found, ["repo"]), met.by_category(found, ["repo"]), "repo",
                                   F.lit(GENERATED_AT))
    path = fresh_dir(spark, "report")
    reports.write_json(found.filter(F.col("rule_id").isNotNull()), header, "repo", path)
    written = spark.read.schema(
        "repo string, metadata struct<generated_at:string,total_vulnerabilities:bigint,security_score:double,"
        "security_grade:string>, statistics struct<by_severity:map<string,bigint>,by_category:map<string,bigint>,"
        "by_match_type:map<string,bigint>>").json(f"{path}/header")
    rows = reports.read_json_findings(spark, path, "repo").groupBy("repo").agg(F.count("*").alias("rows"))
    return written.join(rows, "repo", "left").select(
        "repo", "metadata.generated_at", "metadata.total_vulnerabilities", "metadata.security_score",
        "metadata.security_grade", F.col("statistics.by_severity")["Critical"].alias("critical"),
        F.coalesce(F.try_element_at("statistics.by_category", F.lit("A03")), F.lit(0)).alias("a03"),
        F.col("statistics.by_match_type")["single-line"].alias("single_line"),
        F.coalesce("rows", F.lit(0)).alias("rows"))


@query
def report_csv_rows(spark, sf):
    """A report written as CSV and read back."""
    path = fresh_dir(spark, "report")
    reports.write_csv(corpus_findings(spark, sf, snippets=False), path)
    return reports.read_csv_findings(spark, path).select(
        *[F.col(c) if c.startswith("line_") else F.coalesce(c, F.lit("")).alias(c) for c in fnd.CSV_COLUMNS])


def _history_written(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "history")
    scans = derived.scan_history(spark, sf)
    history_store.append_history(scans.filter("scan_type in ('zip', 'repository')"), path)
    history_store.append_history(scans.filter("scan_type not in ('zip', 'repository')"), path)
    return history_store.read_history(spark, path)


def _ts_text(column: str = "ts") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query
def history_read(spark, sf):
    return _history_written(spark, sf).select(
        "id", "scan_type", "source", _ts_text(), "total", "critical", "high", "medium", "low", "score", "grade")


@query
def history_top50(spark, sf):
    return hist.newest(_history_written(spark, sf)).select("id", "source", _ts_text(), "total", "score", "grade")


# ---- projections, filters, predicates -------------------------------------------------------------------

@query
def detect_language_query(spark, sf):
    named = corpus(spark, sf).select("path", "language")
    pages = derived.page_rows(spark, sf)
    by_content = pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"),
                              detect_language(F.lit("input"), F.col("content")).alias("language"))
    return named.unionByName(by_content)


@query
def resolve_language_alias(spark, sf):
    return derived.text_rows(spark, sf).select(
        "id", "declared_language", resolve_language(F.col("declared_language"), F.col("content")).alias("language"))


def rule_languages(spark: SparkSession) -> DataFrame:
    """Which rule applies to which language: language, rule_ord, rule_id."""
    keys = local_table(spark, [{"language": lang, "key": key} for lang, names in LANGUAGE_KEYS.items() for key in names],
                       "language string, key string")
    rules = builtin(spark).select("rule_ord", F.col("id").alias("rule_id"), F.explode("languages").alias("key"))
    return keys.join(F.broadcast(rules), "key").select("language", "rule_ord", "rule_id").distinct()


def files_with_language(spark: SparkSession, sf: str) -> DataFrame:
    """Selected files by path; their names settle the language, so no text is read."""
    paths = corpus_paths(spark, sf).filter("in_scan")
    return paths.select("repo", "path", detect_language(F.col("path"), F.lit("")).alias("language"))


@query
def applicable_rules(spark, sf):
    used = files_with_language(spark, sf).groupBy("language").agg(F.count("*").alias("files"))
    return rule_languages(spark).join(used, "language").select("language", "rule_id", "files")


@query
def files_x_rules(spark, sf):
    return files_with_language(spark, sf).join(F.broadcast(rule_languages(spark)), "language").select(
        "path", "language", "rule_id")


@query
def rules_by_language(spark, sf):
    """Rules filed under the declared names themselves, aliases not expanded."""
    declared = derived.text_rows(spark, sf).groupBy("declared_language").agg(F.count("*").alias("texts"))
    rules = builtin(spark).select(F.col("id").alias("rule_id"), F.explode("languages").alias("key"))
    return declared.join(F.broadcast(rules), F.lower("declared_language") == F.col("key")).select(
        "declared_language", "texts", "rule_id")


@query
def rules_by_category(spark, sf):
    found = met.by_category(repo_results(spark, sf), ["rule_id"])
    rules = builtin(spark).filter(F.col("category") == "A03").select(F.col("id").alias("rule_id"), "name")
    return rules.join(found.select("rule_id", "findings"), "rule_id", "left").select(
        "rule_id", "name", F.coalesce("findings", F.lit(0)).alias("findings"))


@query
def explode_lines(spark, sf):
    return derived.corpus_files(spark, sf).select(
        "path", F.posexplode(lines_of(F.col("content"))).alias("n", "line")).select(
        "path", (F.col("n") + 1).alias("line_number"), "line")


@query
def single_line_findings(spark, sf):
    return corpus_findings(spark, sf, multi_line=False).select(
        "file_path", "rule_id", "line_number", "pattern_idx", "matched_pattern")


@query
def multi_line_findings(spark, sf):
    found = scan_sast(multiline(spark, sf)).filter(F.col("match_type") == "multi-line")
    return found.select("file_path", "rule_id", "line_number", "line_end", "pattern_idx", "code_snippet")


@query
def finding_snippets(spark, sf):
    return corpus_findings(spark, sf).select("file_path", "rule_id", "line_number", "match_type", "code_snippet")


@query
def single_line_only(spark, sf):
    files = with_language(derived.heredoc_files(spark, sf))
    return scan_sast(files, multi_line=False).select(*SHORT)


@query
def findings_wire(spark, sf):
    return fnd.wire(corpus_findings(spark, sf))


@query
def filter_findings(spark, sf):
    return fnd.filter_findings(corpus_findings(spark, sf), severity="High", category="A05").select(*SHORT)


@query
def search_findings(spark, sf):
    return fnd.search_findings(corpus_findings(spark, sf), SEARCH_TEXT).select(*SHORT)


@query
def search_history(spark, sf):
    return hist.search_history(derived.scan_history(spark, sf), HISTORY_SEARCH).select("id", "source", "scan_type")


@query
def scan_risk_status(spark, sf):
    return hist.with_risk(derived.scan_history(spark, sf)).select(
        "id", "project_status", "report_risk", "scan_type_label")


@query
def scan_age_bucket(spark, sf):
    return hist.with_age(derived.scan_history(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")),
                         F.lit(AS_OF).cast("timestamp")).select("id", "age")


@query
def quality_gate(spark, sf):
    return met.quality_gate(repo_results(spark, sf), ["repo"], minimum="High", fail_on_high=True)


# ---- joins ----------------------------------------------------------------------------------------------

def _package_advisories(spark: SparkSession, sf: str, ecosystem: str) -> DataFrame:
    found = dep.with_advisory(dep.packages(manifests(spark, sf)).filter(F.col("ecosystem") == ecosystem))
    return found.filter(F.col("severity").isNotNull()).select("path", "line_number", "package", "version", "severity")


@query
def npm_advisories(spark, sf):
    return _package_advisories(spark, sf, "npm")


@query
def pypi_advisories(spark, sf):
    return _package_advisories(spark, sf, "pypi")


@query
def go_advisories(spark, sf):
    return _package_advisories(spark, sf, "go").drop("version")


@query
def cargo_advisories(spark, sf):
    return _package_advisories(spark, sf, "cargo").drop("version")


@query
def suppress_covered(spark, sf):
    return scan_sast(with_language(derived.heredoc_files(spark, sf))).select(*SHORT)


# ---- aggregations ---------------------------------------------------------------------------------------

@query
def finding_totals(spark, sf):
    return met.finding_totals(repo_results(spark, sf), ["repo"])


@query
def by_severity(spark, sf):
    return met.by_severity(repo_results(spark, sf), ["repo"])


@query
def by_category(spark, sf):
    return met.by_category(repo_results(spark, sf))


@query
def by_file(spark, sf):
    return met.by_file(repo_results(spark, sf))


@query
def by_match_type(spark, sf):
    return met.by_match_type(everything(spark, sf))


@query
def security_score(spark, sf):
    return met.security_score(repo_results(spark, sf), ["repo", "file_path"])


@query
def security_grade(spark, sf):
    return met.security_grade(repo_results(spark, sf), ["repo", "file_path"])


@query
def repo_security(spark, sf):
    """Score and grade of each repository."""
    return met.security_grade(repo_results(spark, sf), ["repo"])


@query
def history_kpis(spark, sf):
    return hist.kpis(derived.scan_history(spark, sf))


@query
def rules_per_language(spark, sf):
    named = merged_rules(spark, sf).select(F.explode("languages").alias("language"))
    return named.groupBy("language").agg(F.count("*").alias("rules")).orderBy(
        F.col("rules").desc(), "language").limit(TOP_LANGUAGES)


@query
def rules_info(spark, sf):
    listed = merged_rules(spark, sf).select(
        "position", "id", "name", "category", "severity",
        (F.size("multi_line_patterns") > 0).alias("has_multi_line_patterns"))
    return listed


@query
def scan_summary(spark, sf):
    scanned = met.files_scanned(corpus_paths(spark, sf), ["repo"])
    return met.scan_summary(everything(spark, sf), ["repo"], extra=scanned)


@query
def languages_detected(spark, sf):
    return met.languages_detected(files_with_language(spark, sf), ["repo"])


@query
def executive_summary(spark, sf):
    return met.executive_summary(met.scan_summary(repo_results(spark, sf), ["repo"]), ["repo"])


@query
def distinct_categories(spark, sf):
    return met.distinct_categories(everything(spark, sf))


# ---- order ----------------------------------------------------------------------------------------------

@query
def dedupe_multi_line(spark, sf):
    """What is left of the multi-line matches per file and rule."""
    found = scan_sast(multiline(spark, sf), snippets=False).filter(F.col("match_type") == "multi-line")
    return found.groupBy("file_path", "rule_id").agg(
        F.count("*").alias("kept"), F.min("line_number").alias("first_line"), F.max("line_end").alias("last_line"))


@query
def number_findings(spark, sf):
    found = everything(spark, sf, snippets=True)
    return fnd.number_findings(found, "repo", REPOSITORY).select(
        "repo", "file_path", "rule_id", "line_number", "code_snippet", "finding_number", "findings_in_group")


@query
def first_20(spark, sf):
    found = everything(spark, sf)
    return fnd.first_findings(found, "repo", scan_type=REPOSITORY).select(
        "repo", "finding_number", "file_path", "rule_id", "line_number", "remaining")


@query
def order_by_severity(spark, sf):
    return fnd.order_by_severity(corpus_findings(spark, sf, snippets=False)).select(*SHORT)


@query
def canonical_order(spark, sf):
    return fnd.canonical_order(everything(spark, sf), ["repo"], REPOSITORY).select("repo", *SHORT)


@query
def number_findings_of_files(spark, sf):
    """The same findings as a scan of single files reports them: file by file."""
    return fnd.number_findings(everything(spark, sf), "repo", SINGLE_FILE).select(
        "repo", "file_path", "rule_id", "line_number", "finding_number")


@query
def scan_trend(spark, sf):
    return hist.trend(derived.scan_history(spark, sf))


# ---- unions, manifests, secrets -------------------------------------------------------------------------

@query
def all_findings(spark, sf):
    return everything(spark, sf).select("repo", "language", *SHORT, "rule_name", "category", "matched_pattern")


@query
def npm_all_deps(spark, sf):
    """Development dependencies win: each manifest is given two of its dependencies again, in other versions."""
    lists = manifests(spark, sf).filter(dep.ecosystem_of(F.col("path")) == "npm")
    again = F.regexp_replace("content", r'"devDependencies": \{', '"devDependencies": {"lodash": "9.9.9", "ws": "^9", ')
    again = F.regexp_replace(again, r", \}\}$", "}}")
    return dep.packages(lists.withColumn("content", again)).select("path", "package", "version")


@query
def npm_packages(spark, sf):
    return dep.packages(manifests(spark, sf)).filter("ecosystem = 'npm'").select(
        "path", "package", "version", "line_number")


@query
def npm_unpinned(spark, sf):
    found = dep.packages(manifests(spark, sf)).filter("ecosystem = 'npm'")
    return found.filter(dep.npm_is_unpinned(F.col("version"))).select("path", "package", "version")


@query
def npm_clean_version(spark, sf):
    found = dep.packages(manifests(spark, sf)).filter("ecosystem = 'npm'")
    return found.select("path", "package", dep.clean_version(F.col("version")).alias("clean"))


@query
def pypi_requirements(spark, sf):
    return dep.packages(manifests(spark, sf)).filter("ecosystem = 'pypi'").select(
        "path", "line_number", "package", "operator", "version")


@query
def pypi_unpinned(spark, sf):
    found = dep.packages(manifests(spark, sf)).filter("ecosystem = 'pypi'")
    return found.filter(dep.is_unpinned(F.lit("pypi"), F.col("operator"), F.col("version"))).select(
        "path", "line_number", "package")


@query
def manifest_dispatch(spark, sf):
    return manifests(spark, sf).select("path", dep.ecosystem_of(F.col("path")).alias("ecosystem"))


@query
def dependency_rule_ids(spark, sf):
    issues = dep.dependency_issues(manifests(spark, sf))
    return issues.groupBy("ecosystem", "rule_id", "issue_type", "severity").agg(F.count("*").alias("issues"))


@query
def dependency_findings(spark, sf):
    issues = dep.dependency_issues(manifests(spark, sf))
    return dep.dependency_findings(issues).select(
        "rule_id", "rule_name", "category", "severity", "file_path", "line_number", "code_snippet", "description",
        "remediation", "match_type", "cwe", "owasp")


@query
def secret_findings(spark, sf):
    """Secrets in all files, folders and kinds of file regardless."""
    return scan_secrets(corpus(spark, sf), keep=["repo"]).select("repo", *SHORT, "code_snippet")


@query
def catalogue_findings(spark, sf):
    """Files of all languages, in which every live rule with single-line patterns has something to find."""
    files = with_language(derived.catalogue_files(spark, sf))
    return scan_sast(files, multi_line=False).select("file_path", "rule_id", "line_number", "matched_pattern")


@query
def catalogue_secrets(spark, sf):
    """Every kind of secret, in files of all languages."""
    return scan_secrets(with_language(derived.catalogue_files(spark, sf))).select(*SHORT, "code_snippet")


@query
def custom_pack_findings(spark, sf):
    """A pack that is written, loaded from its folder, merged with the built-in rules and scanned with."""
    folder = fresh_dir(spark, "pack")
    derived.brand_pack(spark, sf).coalesce(1).write.text(folder)
    files = with_language(derived.brand_files(spark, sf))
    return scan_sast(files, load_rules(spark, folder)).select(*SHORT, "rule_name")


# ---- streams --------------------------------------------------------------------------------------------

@query
def stream_scan(spark, sf):
    """The corpus scan as a stream of documents; its result must equal the batch scan."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet").select("doc_id", "text")
    files = derived.corpus_of(documents)
    files = files.withColumn("inner_path", relative_path(F.col("path"), F.col("repo")))
    files = with_language(with_selection(files)).filter("in_scan")
    output, state = fresh_dir(spark, "stream-out"), fresh_dir(spark, "stream-state")
    incremental.run_to_end(lambda: incremental.scan_stream(files, output, state, secrets=[], keep=["repo"]))
    return spark.read.parquet(output).select("repo", *SHORT)


@query
def stream_all_findings(spark, sf):
    """Documents as code and manifests, each arriving as a stream, in one query with all three passes."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet").select("doc_id", "text")
    files = derived.corpus_of(documents).withColumn("inner_path", relative_path(F.col("path"), F.col("repo")))
    arriving = fresh_dir(spark, "stream-manifests")
    manifests(spark, sf).write.parquet(arriving)
    lists = spark.readStream.schema(spark.read.parquet(arriving).schema).parquet(arriving)
    output, state = fresh_dir(spark, "stream-out"), fresh_dir(spark, "stream-state")
    incremental.run_to_end(lambda: incremental.scan_stream(
        with_language(with_selection(files)), output, state, manifests=lists, keep=["repo"]))
    return spark.read.parquet(output).select("repo", "language", *SHORT, "rule_name", "category", "matched_pattern")


@query
def stream_daily_kpis(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    severity = F.coalesce(*[F.when(F.col("event_type") == e, s) for e, s in (
        ("error", "Critical"), ("signup", "High"), ("purchase", "Medium"), ("view", "Low"))])
    scans = events.select(F.col("ts").cast("timestamp").alias("ts"), severity.alias("severity"))
    output, state = fresh_dir(spark, "stream-out"), fresh_dir(spark, "stream-state")
    incremental.run_to_end(lambda: incremental.count_daily(scans, output, state))
    return incremental.read_daily(spark, output)
