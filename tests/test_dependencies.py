import random

import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import dependencies as dep


def manifest(spark, path, content):
    return spark.createDataFrame([(path, content)], "path string, content string")


def packages(spark, path, content, **options):
    rows = dep.packages(manifest(spark, path, content), **options).collect()
    return [(r.package, r.operator, r.version, r.line_number) for r in rows]


def issues(spark, path, content, **options):
    rows = dep.dependency_issues(manifest(spark, path, content), **options).collect()
    return [(r.rule_id, r.package_name, r.current_version, r.severity, r.line_number) for r in rows]


def test_npm(spark):
    text = json.dumps({"dependencies": {"Lodash": "^1.0", "react": "1.2.3", "a": None, "n": 3},
                       "devDependencies": {"react": "*", "ws": ""}})
    got = {p[0]: p[2] for p in packages(spark, "x/package.json", text)}
    assert got == {"Lodash": "^1.0", "react": "*", "a": "None", "n": "3", "ws": ""}
    assert set(issues(spark, "x/PACKAGE.json", text)) == {
        ("DEP-NPM-UNPIN", "Lodash", "^1.0", "Low", 1), ("DEP-NPM-LODASH", "Lodash", "1.0", "High", 1),
        ("DEP-NPM-UNPIN", "react", "*", "Low", 1), ("DEP-NPM-UNPIN", "ws", "", "Low", 1),
        ("DEP-NPM-WS", "ws", None, "High", 1)}


def test_npm_duplicate_keys_last_wins(spark):
    assert packages(spark, "package.json", '{"dependencies": {"a": "1", "b": "2", "a": "3"}}') == [
        ("b", None, "2", 1), ("a", None, "3", 1)]


@pytest.mark.parametrize("text", [
    "", "not json", "[]", "{}", '{"dependencies": null}', None, "{'dependencies': {'a': '1'}}", '{"dependencies": {"a": "1"}} x',
    '{"dependencies": {"a": "1"}},{}', '{"dependencies": {"a": "1"},}', '\ufeff{"dependencies": {"a": "1"}}',
])
def test_npm_unreadable(spark, text):
    assert packages(spark, "package.json", text) == []


@pytest.mark.parametrize("version, unpinned", [
    ("", True), ("*", True), ("latest", True), ("next", True), ("canary", True), ("x", True), (" ^1", True), ("~1", True),
    ("1.0", False), (">=1", False), ("X", False), ("1.x", False), ("  ", True),
])
def test_npm_unpinned(spark, version, unpinned):
    df = spark.createDataFrame([(version,)], "v string")
    assert df.select(dep.npm_is_unpinned(F.col("v")).alias("u")).first().u == unpinned


@pytest.mark.parametrize("version, clean", [("^1.2", "1.2"), (" >=<!~1 ", "1"), ("", None), ("^", ""), ("1^2", "1^2"),
                                            ("= 1", " 1")])
def test_clean_version(spark, version, clean):
    df = spark.createDataFrame([(version,)], "v string")
    assert df.select(dep.clean_version(F.col("v")).alias("c")).first().c == clean


def test_requirements(spark):
    text = "\n".join(["# c", "-r x", "", "  requests==2.0  ", "flask", "x===1", "git+https://a/b", "Jinja2 >= 2", "a[b]==1",
                      "(bad)", "six~=1 # c", "a-b.c_d>1"])
    assert packages(spark, "requirements.txt", text) == [
        ("requests", "==", "2.0", 4), ("flask", "", "", 5), ("x", "==", "", 6), ("git", "", "", 7),
        ("Jinja2", ">=", "2", 8), ("a", "", "", 9), ("six", "~=", "1", 11), ("a-b.c_d", ">", "1", 12)]
    got = issues(spark, "requirements-test.txt", text)
    assert ("DEP-PY-UNPIN", "x", None, "Low", 6) in got and ("DEP-PY-UNPIN", "a", None, "Low", 9) in got
    assert ("DEP-PY-REQUESTS", "requests", "2.0", "Medium", 4) in got
    assert ("DEP-PY-JINJA2", "Jinja2", "2", "High", 8) in got
    assert ("DEP-PY-FLASK", "flask", None, "Medium", 5) in got


def test_go(spark):
    text = "\n".join(["module x", "require golang.org/x/net v0.1", "require (", "\tgolang.org/x/crypto v1", ")",
                      "// golang.org/x/net\ty", "replace golang.org/x/net\t=> golang.org/x/crypto"])
    assert sorted((p[3], p[0]) for p in packages(spark, "go.mod", text)) == [
        (2, "golang.org/x/net"), (7, "golang.org/x/crypto"), (7, "golang.org/x/net")]
    assert ("golang.org/x/crypto", 4) in [(p[0], p[3]) for p in packages(spark, "go.mod", text, block_aware=True)]
    assert issues(spark, "go.mod", "require github.com/dgrijalva/jwt-go v1") == [
        ("DEP-GO-JWT-GO", "github.com/dgrijalva/jwt-go", None, "Critical", 1)]


def test_cargo(spark):
    text = 'openssl = "1"\n  openssl-sys = "1"\nserde = "1"\nactix-web = "4"'
    assert issues(spark, "Cargo.toml", text) == [
        ("DEP-RUST-OPENSSL", "openssl", None, "Medium", 1), ("DEP-RUST-OPENSSL", "openssl", None, "Medium", 2),
        ("DEP-RUST-ACTIX-WE", "actix-web", None, "Low", 4)]


def test_dispatch(spark):
    paths = ["package.json", "requirements-test.txt", "composer.json", "x/GO.MOD", "cargo.toml", "pom.xml", "a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(dep.is_manifest(F.col("p")).alias("m"), dep.ecosystem_of(F.col("p")).alias("e")).collect()
    assert [r.m for r in got] == [True, False, True, True, True, True, False]
    assert [r.e for r in got] == ["npm", "pypi", None, "go", "cargo", None, None]


def test_findings_form(spark):
    got = dep.dependency_findings(dep.dependency_issues(manifest(spark, "m/package.json", '{"dependencies": {"vm2": "1"}}')))
    row = got.first()
    assert (row.rule_id, row.rule_name, row.category, row.severity, row.match_type) == (
        "DEP-NPM-VM2", "Dependency: vm2 (Known Vulnerable)", "Dependency Analysis", "Critical", "dependency")
    assert row.code_snippet == "Package: vm2  Version: 1" and row.line_end is None and row.matched_pattern == ""
    assert row.remediation == "Update to safe version: ABANDON. Run 'npm audit fix'." and row.cwe == "CWE-1104"
    assert dep.dependency_findings(dep.dependency_issues(
        manifest(spark, "requirements.txt", "pickle")), parity=True).select("cwe", "owasp").distinct().collect() == [("", "")]
    unpinned = dep.dependency_findings(dep.dependency_issues(manifest(spark, "requirements.txt", "six"))).first()
    assert unpinned.code_snippet == "Package: six  Version: unspecified"
    assert unpinned.rule_name == "Dependency: six (Unpinned)"


def test_extra_advisories(spark):
    extra = dep.load_advisories([{"ecosystem": "go", "package": "example.org/m", "severity": "High", "reason": "r"}])
    assert issues(spark, "go.mod", "require example.org/m v1", advisories=extra) == [
        ("DEP-GO-M", "example.org/m", None, "High", 1)]


def test_fifty_thousand_names_are_looked_up(spark):
    """Every listed module in a line, and every crate that a line begins with, as a plain search finds them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    go = sorted({f"github.com/{word()}/{word()}" for _ in range(50_000)} | {"x/y", "a", "github.com/", "é漢/mod"})
    cargo = sorted({word() for _ in range(3_000)})
    listed = [{"ecosystem": eco, "package": n, "severity": "High", "reason": "r"} for eco, names in (("go", go), ("cargo", cargo)) for n in names]
    mod = [f"require {n}{rng.choice(['', '/v2', 'x'])} v1" for n in rng.sample(go, 30)] + ["require nothing", "é漢/mod\tx", "// github.com/a/b\tc", ""]
    toml = [f'{rng.choice(["", "  "])}{rng.choice(cargo)}{word()} = "1"' for _ in range(30)] + ["", "#", "[x]"]
    files = [("m/go.mod", "\n".join(mod)), ("m/Cargo.toml", "\n".join(toml))]
    got = dep.packages(spark.createDataFrame(files, "path string, content string"), advisories=listed)
    want = []
    for i, line in enumerate(mod, 1):
        line = line.strip()
        if not line.startswith("//") and (line.startswith("require") or "\t" in line):
            want += [("m/go.mod", n, i) for n in go if n in line]
    for i, line in enumerate(toml, 1):
        want += [("m/Cargo.toml", n, i) for n in cargo if line.strip().startswith(n)]
    assert sorted(map(tuple, got.select("path", "name", "line_number").collect())) == sorted(want) and len(want) > 60


def test_names_are_filed_under_their_rarest_part():
    filed = {name: part for part, name in dep.filed_names(["github.com/a/b", "github.com/a/cdefghij", "x/y"])}
    assert filed["x/y"] == "x/y" and not filed["github.com/a/cdefghij"].startswith("github")
    assert all(part in name for name, part in filed.items())
