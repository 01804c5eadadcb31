import os
import re

import pytest
from pyspark.sql import functions as F

from scanloom.fixed_values import EXTENSION_LANGUAGE
from scanloom.functions.language import detect_language, resolve_language
from scanloom.functions.text import base_name, extension

PATHS = ["a.js", "A.JSX", "x/y.Php5", "b.tar.gz", ".bashrc", "..x", "...", "a.", "noext", "dir.py/noext", "x/.git", "a..py",
         ".a.py", "Dockerfile", "x/DOCKERFILE.dev", "containerfile", "dockerfile.prod", "dockerfile.js", "a b.tf", "n\nl.go"]


def test_names_and_suffixes_are_pythons(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = df.select(base_name(F.col("p")).alias("b"), extension(F.col("p")).alias("e")).collect()
    assert [r.b for r in got] == [os.path.basename(p) for p in PATHS]
    assert [r.e for r in got] == [os.path.splitext(p)[1].lower() for p in PATHS]


@pytest.mark.parametrize("path, content, language", [
    ("a.js", "", "javascript"), ("Dockerfile", "", "dockerfile"), ("dockerfile.js", "", "javascript"),
    ("x", "<?PHP", "php"), ("x", "a\nFROM b", "dockerfile"), ("x", "a FROM b", "unknown"), ("x", "from b", "python"),
    ("x", "import os", "python"), ("x", "def  f", "python"), ("x", "class A:", "python"), ("x", "class A", "unknown"),
    ("x", "export", "javascript"), ("x", "letter", "javascript"), ("x", "LET", "unknown"), ("x", "", "unknown"),
    ("x", None, "unknown"), ("x.unknownext", "var x", "javascript"), ("x", "<?php\nFROM a", "php"), ("x", "FROM\ta", "dockerfile"),
])
def test_detection(spark, path, content, language):
    df = spark.createDataFrame([(path, content)], "p string, c string")
    assert df.select(detect_language(F.col("p"), F.col("c")).alias("l")).first().l == language


def test_every_extension(spark):
    df = spark.createDataFrame([("f" + e.upper(), lang) for e, lang in EXTENSION_LANGUAGE.items()], "p string, want string")
    assert df.filter(detect_language(F.col("p"), F.lit("")) != F.col("want")).count() == 0
    assert len(EXTENSION_LANGUAGE) == 42


@pytest.mark.parametrize("declared, content, language", [
    ("JS", "", "javascript"), ("ts", "", "typescript"), ("TypeScript", "", "typescript"), ("c++", "", "cpp"),
    ("C#", "", "csharp"), ("golang", "", "go"), ("shell", "", "bash"), ("ps1", "", "powershell"), ("py", "", "python"),
    ("rs", "", "rust"), ("klingon", "import os", "python"), ("klingon", "x", "unknown"), ("", "var", "javascript"),
    ("h", "", "c"), ("tar.gz", "", "unknown"),
])
def test_declared_names(spark, declared, content, language):
    df = spark.createDataFrame([(declared, content)], "d string, c string")
    assert df.select(resolve_language(F.col("d"), F.col("c")).alias("l")).first().l == language


def test_multiline_from_is_pythons(spark):
    texts = ["a\rFROM b", "a FROM b", "FROM\nb", "\nFROM b", "xFROM b"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r.l == "dockerfile" for r in df.select(detect_language(F.lit("x"), F.col("c")).alias("l")).collect()]
    assert got == [bool(re.search(r"^FROM\s+\S+", t, re.MULTILINE)) for t in texts]
