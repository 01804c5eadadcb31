"""Dependency manifests: packages out of manifest texts, advisories for them, findings.

Every manifest is read once: its packages are computed as one array inside the row, exploded, and joined to the
advisories. Go and Rust manifests are searched for listed names. A name is not tried on every line: short texts are cut
from the line and joined with those that the names are filed under, and only the names met that way are compared.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.fixed_values import (
    DEPENDENCY_CWE, DEPENDENCY_OWASP, ECOSYSTEM_RULE_PREFIX, MANIFEST_ECOSYSTEM, MANIFEST_FILES, UNPINNED_VERSIONS,
)
from scanloom.functions.dialect import java_body
from scanloom.functions.text import base_name, lines_of, literal_map, one_json_value, strip
from scanloom.operators.match import DEPENDENCY
from scanloom.rules import read_pack
from scanloom.sources.local import local_table

ADVISORY_SCHEMA = "ecosystem string, package string, severity string, reason string, safe_version string"
PACKAGE = "struct<package:string,name:string,operator:string,version:string,line_number:int,filed_under:string,line:string>"
#: Names of Go modules are filed under so many of their characters, the rarest; shorter ones under all.
GRAM = 8

# The shape of a requirement line, and the wording of dependency findings.
REQUIREMENT = r"^([A-Za-z0-9_\-\.]+)\s*([><=!~]{0,2})\s*([A-Za-z0-9\._\-\*]*)"
KNOWN_TEXT = {
    "npm": ("Package '{package}' has known security issues: {reason}",
            "Update to safe version: {safe_version}. Run 'npm audit fix'."),
    "pypi": ("Package '{package}' has known security issues: {reason}",
             "Update to safe version: {safe_version}. Run 'pip install --upgrade {package}'."),
    "go": ("Go dependency '{package}' has known security issues: {reason}",
           "Update or replace '{package}'. Run 'go get -u {package}'."),
    "cargo": ("Rust dependency '{package}': {reason}",
              "Run 'cargo audit' for full vulnerability report. Update '{package}' to latest."),
}
UNPINNED_TEXT = {
    "npm": ("Package '{package}' has unpinned version '{version}'. Unpinned deps may pull in vulnerable versions.",
            "Pin '{package}' to a specific version in package.json and use package-lock.json."),
    "pypi": ("Package '{package}' has no version pin in requirements.txt.",
             "Pin exact versions (e.g., requests==2.31.0) and use pip freeze for reproducible installs."),
}


def load_advisories(extra: Sequence[dict] = ()) -> list[dict]:
    """Packaged advisories; those of ``extra`` win over packaged ones for the same package."""
    listed = {(a["ecosystem"], a["package"]): a for a in [*read_pack("advisories.json")["advisories"], *extra]}
    return list(listed.values())


def read_advisories(path: str, spark: SparkSession | None = None) -> list[dict]:
    """Packaged advisories and those of a JSON file, read from wherever Spark can read."""
    spark = spark or SparkSession.active()
    texts = spark.read.text(path, wholetext=True).collect()
    if len(texts) != 1:
        raise ValueError(f"{path} must be one JSON file")
    return load_advisories(json.loads(texts[0][0])["advisories"])


def advisories_df(spark: SparkSession, advisories: Sequence[dict] | None = None) -> DataFrame:
    return local_table(spark, load_advisories() if advisories is None else list(advisories), ADVISORY_SCHEMA)


def is_manifest(path: Column) -> Column:
    return F.lower(base_name(path)).isin(MANIFEST_FILES)


def ecosystem_of(path: Column) -> Column:
    """Ecosystem whose scan reads the manifest; null where none does."""
    return F.try_element_at(literal_map(MANIFEST_ECOSYSTEM), F.lower(base_name(path)))


# ---- packages of a manifest, as an array ----------------------------------------------------------------

def _package(package: Column, name: Column, line_number: Column, operator: Column | None = None,
             version: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        package.alias("package"), name.alias("name"), (nothing if operator is None else operator).alias("operator"),
        (nothing if version is None else version).alias("version"), line_number.cast("int").alias("line_number"),
        name.alias("filed_under"), nothing.alias("line"))


def npm_entries(content: Column) -> Column:
    """Dependencies of a package.json, in which a development dependency wins over one of the same name."""
    parsed = one_json_value(content, "dependencies map<string,string>, devDependencies map<string,string>")
    entries = F.concat(*[
        F.coalesce(F.map_entries(parsed[c]), F.array().cast("array<struct<key:string,value:string>>"))
        for c in ("dependencies", "devDependencies")
    ])

    def last_of_each(all_entries: Column) -> Column:
        return F.filter(all_entries, lambda e, i: ~F.exists(
            F.slice(all_entries, i + 2, F.size(all_entries)), lambda later: later["key"] == e["key"]))

    distinct = F.transform(F.array(entries), last_of_each)[0]
    return F.transform(distinct, lambda e: _package(
        e["key"], F.lower(e["key"]), F.lit(1), version=F.coalesce(e["value"], F.lit("None"))))


def _numbered_lines(content: Column) -> Column:
    return F.transform(lines_of(content), lambda line, i: F.struct(
        strip(line).alias("line"), (i + 1).alias("line_number")))


def pypi_entries(content: Column) -> Column:
    """Requirement lines: package, operator and version."""
    regex = java_body(REQUIREMENT)

    def is_requirement(row: Column) -> Column:
        line = row["line"]
        return ((line != "") & ~F.startswith(line, F.lit("#")) & ~F.startswith(line, F.lit("-"))
                & F.rlike(line, F.lit(regex)))

    def parsed(row: Column) -> Column:
        package, operator, version = [F.regexp_extract(row["line"], regex, g) for g in (1, 2, 3)]
        return _package(package, pypi_name(package), row["line_number"], operator, version)

    return F.transform(F.filter(_numbered_lines(content), is_requirement), parsed)


def pypi_name(package: Column) -> Column:
    return F.replace(F.lower(package), F.lit("-"), F.lit("_"))


def _looked_up(rows: Column, cut) -> Column:
    """For each line the texts that ``cut`` takes from it, to look names up by."""
    nothing = F.lit(None).cast("string")
    return F.flatten(F.transform(rows, lambda row: F.transform(F.array_distinct(cut(row["line"])), lambda text: F.struct(
        nothing.alias("package"), nothing.alias("name"), nothing.alias("operator"), nothing.alias("version"),
        row["line_number"].cast("int").alias("line_number"), text.alias("filed_under"), row["line"].alias("line")))))


def filed_names(names: Sequence[str]) -> list[tuple[str, str]]:
    """Each name of a Go module with the part of it that it is filed under: the one that fewest names have."""
    parts = {name: [name[i:i + GRAM] for i in range(max(len(name) - GRAM, 0) + 1)] for name in names}
    held_by = Counter(part for of in parts.values() for part in set(of))
    return [(min(of, key=lambda part: (held_by[part], part)), name) for name, of in parts.items()]


def go_entries(content: Column, lengths: Sequence[int], block_aware: bool = False) -> Column:
    """What ``require …`` lines, or lines with a tab inside, hold of the given lengths, to look modules up by.

    Lines are stripped first, so entries of a ``require (`` block do not count unless ``block_aware``.
    """

    def looked_at(row: Column) -> Column:
        line = row["line"]
        wanted = F.startswith(line, F.lit("require")) | F.contains(line, F.lit("\t"))
        if block_aware:
            wanted = wanted | F.rlike(line, F.lit(r"^\S+\s+v\d"))
        return (line != "") & ~F.startswith(line, F.lit("//")) & wanted

    def cut(line: Column) -> Column:
        def of_length(n: int) -> Column:
            starts = F.when(F.length(line) >= n, F.sequence(F.lit(1), F.length(line) - n + 1))
            return F.coalesce(F.transform(starts, lambda i: F.substr(line, i, F.lit(n))), F.array().cast("array<string>"))
        return F.concat(F.array().cast("array<string>"), *[of_length(n) for n in lengths])

    return _looked_up(F.filter(_numbered_lines(content), looked_at), cut)


def cargo_entries(content: Column, lengths: Sequence[int]) -> Column:
    """The beginnings of lines, of any section, that are as long as some crate's name."""

    def cut(line: Column) -> Column:
        fit = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(line))
        return F.transform(fit, lambda n: F.left(line, n))

    return _looked_up(_numbered_lines(content), cut)


def packages(manifests: DataFrame, keep: Sequence[str] = (), advisories: Sequence[dict] | None = None,
             block_aware: bool = False) -> DataFrame:
    """One row per package found in a manifest (path, content): for npm and PyPI all, for Go and Rust the listed."""
    advisories = load_advisories() if advisories is None else advisories
    names = {eco: list(dict.fromkeys(a["package"] for a in advisories if a["ecosystem"] == eco)) for eco in ("go", "cargo")}
    filed = [("go", *x) for x in filed_names(names["go"])] + [("cargo", name, name) for name in names["cargo"]]
    go_lengths = sorted({len(part) for eco, part, _ in filed if eco == "go"})
    eco, content = F.col("ecosystem"), F.col("content")
    entries = (
        F.when(eco == "npm", npm_entries(content))
        .when(eco == "pypi", pypi_entries(content))
        .when(eco == "go", go_entries(content, go_lengths, block_aware))
        .when(eco == "cargo", cargo_entries(content, sorted({len(n) for n in names["cargo"]})))
    )
    keep = [*keep, "path"]
    scanned = manifests.select(*keep, ecosystem_of(F.col("path")).alias("ecosystem"), "content").filter(eco.isNotNull())
    # explode_outer, as in rule matching: no filter that would compute the array twice.
    rows = scanned.select(*keep, "ecosystem", F.explode_outer(entries.cast(f"array<{PACKAGE}>")).alias("p"))
    listed = local_table(manifests.sparkSession, [{"ecosystem": e, "filed_under": part, "listed": n} for e, part, n in filed],
                         "ecosystem string, filed_under string, listed string")
    rows = rows.select(*keep, "ecosystem", "p.*").join(listed, ["ecosystem", "filed_under"], "left")
    # The part that a module is filed under may stand in a line without the rest of the name.
    met = F.when(F.contains("line", "listed"), F.col("listed"))
    rows = rows.withColumns({"package": F.coalesce("package", met), "name": F.coalesce("name", met)})
    return rows.filter(F.col("package").isNotNull()).select(*keep, "ecosystem", "package", "name", "operator", "version", "line_number")


# ---- issues and findings --------------------------------------------------------------------------------

def npm_is_unpinned(version: Column) -> Column:
    v = strip(version)
    return v.isin(UNPINNED_VERSIONS) | F.startswith(v, F.lit("^")) | F.startswith(v, F.lit("~"))


def is_unpinned(ecosystem: Column, operator: Column, version: Column) -> Column:
    return (F.when(ecosystem == "npm", npm_is_unpinned(version))
            .when(ecosystem == "pypi", (operator == "") | (version == ""))
            .otherwise(False))


def clean_version(version: Column) -> Column:
    return F.when(version != "", F.regexp_replace(strip(version), r"^[\^~>=<!]+", ""))


def _per_ecosystem(table: dict, of) -> Column:
    return F.coalesce(*[F.when(F.col("ecosystem") == eco, of(value)) for eco, value in table.items()])


def _text(template: str) -> Column:
    """``template`` with every {column} replaced by its value."""
    pieces = template.replace("}", "{").split("{")
    return F.concat(*[F.coalesce(F.col(p), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def dependency_rule_id(ecosystem: Column, name: Column) -> Column:
    short = F.when(ecosystem == "go", F.element_at(F.split(name, "/"), -1)).otherwise(name)
    return F.concat(_per_ecosystem(ECOSYSTEM_RULE_PREFIX, F.lit), F.left(F.upper(short), F.lit(8)))


def with_advisory(found: DataFrame, advisories: Sequence[dict] | None = None) -> DataFrame:
    """Left join on the looked-up name; versions are not compared."""
    listed = advisories_df(found.sparkSession, advisories).withColumnRenamed("package", "name")
    return found.join(listed, ["ecosystem", "name"], "left")


def dependency_issues(manifests: DataFrame, keep: Sequence[str] = (), advisories: Sequence[dict] | None = None,
                      block_aware: bool = False) -> DataFrame:
    """Unpinned and known-vulnerable packages of manifests, one row per issue."""
    found = with_advisory(packages(manifests, keep, advisories, block_aware), advisories)
    eco, version = F.col("ecosystem"), F.col("version")
    unpinned = F.struct(
        F.lit("unpinned").alias("issue_type"),
        _per_ecosystem(ECOSYSTEM_RULE_PREFIX, lambda prefix: F.lit(prefix + "UNPIN")).alias("rule_id"),
        F.lit("Low").alias("severity"),
        F.when(eco == "npm", version).alias("current_version"),
        _per_ecosystem(UNPINNED_TEXT, lambda t: _text(t[0])).alias("description"),
        _per_ecosystem(UNPINNED_TEXT, lambda t: _text(t[1])).alias("remediation"),
    )
    known = F.struct(
        F.lit("known_vulnerable").alias("issue_type"),
        dependency_rule_id(eco, F.col("name")).alias("rule_id"),
        F.col("severity"),
        F.when(eco == "npm", clean_version(version)).when(version != "", version).alias("current_version"),
        _per_ecosystem(KNOWN_TEXT, lambda t: _text(t[0])).alias("description"),
        _per_ecosystem(KNOWN_TEXT, lambda t: _text(t[1])).alias("remediation"),
    )
    issues = F.array(F.when(is_unpinned(eco, F.col("operator"), version), unpinned),
                     F.when(F.col("severity").isNotNull(), known))
    rows = found.select(*keep, "path", "ecosystem", F.col("package").alias("package_name"), "line_number",
                        F.explode_outer(issues).alias("i"))
    return rows.filter(F.col("i").isNotNull()).select(
        *keep, "path", "ecosystem", "package_name", "line_number", "i.*",
        F.lit(DEPENDENCY_CWE).alias("cwe"), F.lit(DEPENDENCY_OWASP).alias("owasp"))


def dependency_findings(issues: DataFrame, keep: Sequence[str] = (), parity: bool = False) -> DataFrame:
    """Issues in the shape of all other findings. With ``parity`` cwe and owasp are blanked."""
    title = F.initcap(F.replace(F.col("issue_type"), F.lit("_"), F.lit(" ")))
    version = F.when(F.col("current_version") != "", F.col("current_version"))
    return issues.select(
        *keep,
        F.lit(None).cast("string").alias("language"),
        "rule_id",
        F.concat(F.lit("Dependency: "), F.col("package_name"), F.lit(" ("), title, F.lit(")")).alias("rule_name"),
        F.lit("Dependency Analysis").alias("category"),
        "severity",
        F.col("path").alias("file_path"),
        "line_number",
        F.lit(None).cast("int").alias("line_end"),
        F.concat(F.lit("Package: "), F.col("package_name"), F.lit("  Version: "),
                 F.coalesce(version, F.lit("unspecified"))).alias("code_snippet"),
        "description", "remediation",
        F.lit("").alias("matched_pattern"),
        F.lit("dependency").alias("match_type"),
        *[(F.lit("") if parity else F.col(c)).alias(c) for c in ("cwe", "owasp")],
        F.lit(DEPENDENCY).alias("pass_ord"),
        *[F.lit(0).alias(c) for c in ("rule_ord", "pattern_idx", "match_idx")],
    )
