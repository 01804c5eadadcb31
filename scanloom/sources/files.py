"""Source files as DataFrames: directory trees, archives and decoded text."""

from __future__ import annotations

import io
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.fixed_values import DOCKERFILE_NAMES, EXTENSION_LANGUAGE, SKIP_DIRS
from scanloom.functions.reuse import built_once
from scanloom.functions.text import base_name, extension, newline_normalized

REPLACEMENT, STAND_IN = "\ufffd", "\ufddf"

ARCHIVE_BATCH_BYTES = 16 * 1024 * 1024
#: The largest value that a column holds.
MAX_FILE_BYTES = (1 << 31) - 1


def dealt(rows: DataFrame, partitions: int = 0) -> DataFrame:
    """``rows`` in so many partitions; 0 leaves them as they were read. A file of one row group, such as a small table,
    is read by a single task, whatever the number of cores; large inputs split by themselves and need no dealing."""
    return rows.repartition(partitions) if partitions > 0 else rows


def decode_text(raw: Column) -> Column:
    """Bytes as UTF-8 text: bad bytes are dropped, and every line break becomes a newline."""
    text = F.replace(raw.cast("string"), F.lit(REPLACEMENT), F.lit(STAND_IN))
    dropped = F.replace(F.make_valid_utf8(text), F.lit(REPLACEMENT), F.lit(""))
    return newline_normalized(F.replace(dropped, F.lit(STAND_IN), F.lit(REPLACEMENT)))


def decode_strict(raw: Column) -> Column:
    """Bytes as UTF-8 text, or null where they are not."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), newline_normalized(text))


def relative_path(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, root), F.ltrim(F.substr(path, F.length(root) + 1), F.lit("/"))).otherwise(path)


def in_skipped_dir(inner_path: Column) -> Column:
    """Whether a folder on the way to the file, below the root of the tree, is one of those not looked into."""
    dirs = F.split(F.lower(inner_path), "/")
    return F.arrays_overlap(F.slice(dirs, 1, F.size(dirs) - 1), _skip_dirs())


@built_once
def _skip_dirs() -> Column:
    return F.array(*[F.lit(d) for d in SKIP_DIRS])


def is_selected(path: Column, extensions: Sequence[str] | None = None) -> Column:
    """Whether a tree scan takes the file: a listed extension, or a Dockerfile by name."""
    wanted = list(EXTENSION_LANGUAGE) if extensions is None else list(extensions)
    return extension(path).isin(wanted) | F.lower(base_name(path)).isin(DOCKERFILE_NAMES)


def in_tree_scan(inner_path: Column, extensions: Sequence[str] | None = None) -> Column:
    return ~in_skipped_dir(inner_path) & is_selected(inner_path, extensions)


def with_selection(files: DataFrame, inner_path: str = "inner_path",
                   extensions: Sequence[str] | None = None) -> DataFrame:
    """Add ``listed`` (not below a skipped folder) and ``in_scan`` (listed and of a wanted kind)."""
    inner = F.col(inner_path)
    return files.withColumns({"listed": ~in_skipped_dir(inner), "in_scan": in_tree_scan(inner, extensions)})


TREE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _inside_tree(spark: SparkSession, files: DataFrame, root: str, repo_depth: int) -> tuple[Column, Column, Column]:
    """Repository, path below ``root`` and path inside the repository of each file."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    url = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_extract(url, r"(?s)^[a-z0-9+.-]+:(?://[^/]*)?\Q" + base + r"\E/(.*)\z", 1)
    inner = F.regexp_extract(path, r"(?s)^(?:[^/]*/){%d}(.*)\z" % repo_depth, 1)
    repo = F.regexp_extract(path, r"(?s)^((?:[^/]*/){%d})" % repo_depth, 1)
    return F.rtrim(repo, F.lit("/")), path, inner


def read_tree(spark: SparkSession, root: str, repo_depth: int = 1, only: Callable[[Column], Column] | None = None,
              stream: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """All files below ``root``, or as a stream those that arrive there: repo, path, inner_path, raw.

    The first ``repo_depth`` folders name the repository. ``only`` is a condition on the path inside it; it is put
    on file metadata, so files it leaves out are dropped while files are listed and never read. Files that cannot be
    read, or are larger than one value may be, are left out; ``unread_files`` names them.
    """
    reader = spark.readStream.schema(TREE_SCHEMA) if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    files = files.filter(F.col("length") <= max_bytes)
    repo, path, inner = _inside_tree(spark, files, root, repo_depth)
    if only is not None:
        files = files.filter(only(inner))
    return files.select(repo.alias("repo"), path.alias("path"), inner.alias("inner_path"), F.col("content").alias("raw"))


def list_tree(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """All files below ``root`` by metadata alone, none being opened: repo, path, inner_path, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    repo, path, inner = _inside_tree(spark, files, root, repo_depth)
    return files.select(repo.alias("repo"), path.alias("path"), inner.alias("inner_path"), "length")


def unread_files(listed: DataFrame, seen: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Of the listed files those that a scan has not ``seen`` (repo, inner_path), each with the reason as ``error``.

    ``seen`` must come from what was read, not from another listing. Only names are shuffled.
    """
    missed = listed.join(seen.select("repo", "inner_path").distinct(), ["repo", "inner_path"], "left_anti")
    reason = F.when(F.col("length") > max_bytes, F.concat(F.lit("larger than "), F.lit(str(max_bytes)), F.lit(" bytes")))
    return missed.select("repo", "inner_path", F.coalesce(reason, F.lit("could not be read")).alias("error"))


def _expander(names: frozenset[str] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What runs on executors. Its parts are nested so that they travel with it: executors need not have this package."""

    def wanted(path: str) -> bool:
        return names is None or path.rpartition("/")[2].lower() in names

    def members(raw: bytes, wanted: Callable[[str], bool]) -> Iterator[tuple[str, bytes]]:
        data = io.BytesIO(raw)
        if zipfile.is_zipfile(data):
            with zipfile.ZipFile(data) as zf:
                for info in zf.infolist():
                    if not info.is_dir() and wanted(info.filename):
                        yield info.filename, zf.read(info)
            return
        data.seek(0)
        try:
            tf = tarfile.open(fileobj=data, mode="r:*")
        except tarfile.TarError as e:
            raise ValueError("Unsupported archive format. Use ZIP or TAR.") from e
        with tf:
            for member in tf:
                if member.isfile() and wanted(member.name):
                    yield member.name, tf.extractfile(member).read()

    def spooled(raw: bytes, kept) -> list[tuple[str, int]]:
        """Reads the archive through once, its wanted members one after another into ``kept``: their names and sizes."""
        listed = []
        for inner, data in members(raw, lambda path: True):
            if wanted(inner):
                kept.write(data)
                listed.append((inner.removeprefix("./"), len(data)))
        kept.seek(0)
        return listed

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "inner_path", "raw", "error"]
        rows, held = [], 0
        for batch in batches:
            for archive, raw in zip(batch["archive"], batch["raw"]):
                # An archive broken anywhere has no members at all, so they wait until it has been read to its end:
                # small ones in memory, others in a file of this task, which goes with it.
                with tempfile.SpooledTemporaryFile(max_size=ARCHIVE_BATCH_BYTES) as kept:
                    try:
                        listed = spooled(raw, kept)
                    except Exception as e:  # one broken archive must not stop the others
                        rows.append((archive, None, None, str(e)))
                        continue
                    for inner, size in listed:
                        rows.append((archive, inner, kept.read(size), None))
                        held += size
                        if held > ARCHIVE_BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return expand


def expand_archives(archives: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Members of zip and tar archives (archive STRING, raw BINARY) as archive, inner_path, raw, error.

    Each archive is decompressed once. Members leave in batches of bounded size. An archive that cannot be read gives one row with its error.
    ``only`` restricts members to these base names (lower case).
    """
    names = None if only is None else frozenset(only)
    return archives.select("archive", "raw").mapInPandas(
        _expander(names), "archive string, inner_path string, raw binary, error string")
