import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from scanloom.plans.scan import scan_sast, with_language
from scanloom.sources import checkpoint
from scanloom.sources.files import (
    decode_strict, decode_text, expand_archives, is_selected, in_skipped_dir, in_tree_scan, read_tree, relative_path, with_selection,
)


@pytest.mark.parametrize("raw", [
    b"plain", "é ü 漢 😀".encode(), b"a\xffb", b"\xc3", b"a\xe2\x82b", b"\xf0\x9f\x98", b"ok\xed\xa0\x80x", b"a\r\nb\rc\n\r",
    "genuine � stays".encode(), b"\xc0\xaf", b"", b"\xef\xbb\xbfbom", b"\xf8\x88\x80\x80\x80z", b"a\x00b",
])
def test_decode_is_pythons(spark, raw):
    expected = io.TextIOWrapper(io.BytesIO(raw), encoding="utf-8", errors="ignore").read()
    df = spark.createDataFrame([(bytearray(raw),)], "r binary")
    row = df.select(decode_text(F.col("r")).alias("t"), decode_strict(F.col("r")).alias("s")).first()
    assert row.t == expected
    try:
        strict = io.TextIOWrapper(io.BytesIO(raw), encoding="utf-8").read()
    except UnicodeDecodeError:
        strict = None
    assert row.s == strict


@pytest.mark.parametrize("path, skipped, selected", [
    ("a.py", False, True), ("src/a.py", False, True), ("node_modules/a.py", True, True), ("x/Build/a.py", True, True),
    ("x/.GIT/a", True, False), ("build", False, False), ("x/dist", False, False), ("a/Dockerfile.dev", False, True),
    ("rebuild/a.py", False, True), ("a/notes", False, False),
])
def test_selection(spark, path, skipped, selected):
    df = spark.createDataFrame([(path,)], "p string")
    row = df.select(in_skipped_dir(F.col("p")).alias("k"), is_selected(F.col("p")).alias("s")).first()
    assert (row.k, row.s) == (skipped, selected)


def test_extension_list(spark):
    df = spark.createDataFrame([("a.py",), ("a.js",), ("Dockerfile",)], "inner_path string")
    got = with_selection(df, extensions=[".js"]).filter("in_scan").select("inner_path").collect()
    assert [r[0] for r in got] == ["a.js", "Dockerfile"]


def test_relative_path(spark):
    df = spark.createDataFrame([("/r/a/b", "/r"), ("r/a", "r"), ("x/a", "r")], "p string, r string")
    assert [x[0] for x in df.select(relative_path(F.col("p"), F.col("r"))).collect()] == ["a/b", "a", "x/a"]


@pytest.fixture
def tree(tmp_path):
    files = {
        "repo1/a.py": b"except:\r\n", "repo1/sub dir/b+c%20.JS": b"eval(x)", "repo1/node_modules/m.js": b"eval(x)",
        "repo1/Dockerfile": b"USER root", "repo2/notes": b"import os", "repo2/x/é.php": b"\xff<?= md5($x)",
        "repo2/vendor/v.php": b"md5(1)",
    }
    for name, data in files.items():
        path = tmp_path / "trees" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "trees")


def test_tree_scan(spark, tree):
    files = read_tree(spark, tree, only=in_tree_scan).withColumn("content", decode_text(F.col("raw")))
    found = scan_sast(with_language(files), keep=["repo"]).select("repo", "file_path", "rule_id", "line_number").collect()
    assert sorted(map(tuple, found)) == [
        ("repo1", "repo1/Dockerfile", "DOCKER-001", 1), ("repo1", "repo1/a.py", "BP-PY-001", 1),
        ("repo1", "repo1/sub dir/b+c%20.JS", "A03-JS-002", 1), ("repo1", "repo1/sub dir/b+c%20.JS", "A08-JS-001", 1),
        ("repo2", "repo2/x/é.php", "A02-PHP-001", 1)]


def test_tree_is_pruned_while_listed(spark, tree):
    """Files left out must not be read: they are gone from the scan itself, not filtered after it."""
    pruned = read_tree(spark, tree, only=in_tree_scan)
    scan = [line for line in pruned._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert len(scan) == 1
    node = pruned._jdf.queryExecution().executedPlan()
    pruned.collect()
    while node.children().size():
        node = node.children().apply(0)
    assert node.metrics().apply("numFiles").value() == 4
    assert read_tree(spark, tree).count() == 7


def test_root_itself_may_be_a_skipped_name(spark, tmp_path):
    path = tmp_path / "build" / "r" / "a.py"
    path.parent.mkdir(parents=True)
    path.write_text("except:")
    assert read_tree(spark, str(tmp_path / "build"), only=in_tree_scan).count() == 1
    assert read_tree(spark, str(tmp_path / "build" / "r"), repo_depth=0).select("repo", "inner_path").collect() == [("", "a.py")]


def archive(kind, members):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("folder/", b"")
            for n, d in members.items():
                z.writestr(n, d)
    else:
        with tarfile.open(fileobj=out, mode=kind) as t:
            for n, d in members.items():
                info = tarfile.TarInfo(n)
                info.size = len(d)
                t.addfile(info, io.BytesIO(d))
    return out.getvalue()


@pytest.mark.parametrize("kind", ["zip", "w", "w:gz", "w:bz2", "w:xz"])
def test_archives(spark, kind):
    members = {"./a/x.py": b"except:", "b.bin": bytes(range(256))}
    rows = [("one", bytearray(archive(kind, members))), ("bad", bytearray(b"nothing"))]
    got = expand_archives(spark.createDataFrame(rows, "archive string, raw binary")).collect()
    found = {r.inner_path: bytes(r.raw) for r in got if r.archive == "one"}
    assert found == {k.removeprefix("./"): v for k, v in members.items()}
    assert [(r.inner_path, r.error) for r in got if r.archive == "bad"] == [
        (None, "Unsupported archive format. Use ZIP or TAR.")]


@pytest.mark.parametrize("kind", ["zip", "w", "w:gz"])
@pytest.mark.parametrize("only", [None, ["package.json"]])
def test_archives_broken_halfway_have_no_members(spark, kind, only):
    import random
    noise = random.Random(1).randbytes
    raw = bytearray(archive(kind, {"package.json": b"{}", "a": noise(50_000), "b": noise(50_000)}))
    if kind == "zip":
        raw[60_000] ^= 0xFF
    else:
        del raw[70_000:]
    got = expand_archives(spark.createDataFrame([("x", raw)], "archive string, raw binary"), only).collect()
    assert [(r.inner_path, r.error is not None) for r in got] == [(None, True)]


def test_only_some_members(spark):
    raw = archive("w:gz", {"a/Package.JSON": b"{}", "b.py": b"x"})
    got = expand_archives(spark.createDataFrame([("a", bytearray(raw))], "archive string, raw binary"), ["package.json"])
    assert [r.inner_path for r in got.collect()] == ["a/Package.JSON"]


def test_checkpoint_dir_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint.shared_dir(spark) == named
    df = checkpoint.checkpointed(spark.range(10))
    assert df.count() == 10
    assert named in spark.sparkContext.getCheckpointDir()
