"""Small groups are judged by what their language, or all documents, look like."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def text(rng, n):
    return " ".join("abcdefghijklmnop"[: rng.randint(2, 9)] + str(rng.randrange(999)) for _ in range(n))


def broken(rng):
    return " ".join(w + "***$$$" for w in text(rng, 150).split())


@pytest.mark.parametrize("langs", [["en"], ["en", "de", "fr", None]])
def test_small_groups_reject_outliers(spark, langs):
    rng = random.Random(5)
    # Thirty documents a source: too few for an estimate of its own; with four languages too few in each of those, too.
    sources = 8 if len(langs) == 1 else 1
    rows = [(text(rng, rng.randint(60, 300)), lang, f"s{s}" if s else None) for lang in langs for s in range(sources) for _ in range(30)]
    good = len(rows)
    rows += [(broken(rng), lang, "s0" if sources > 1 else None) for lang in langs] + [(None, "xx", "only bad"), ("", "xx", "only bad")]
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(table).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept for i in range(good)) >= 0.98 * good
    assert not any(got[i].kept for i in range(good, len(rows)))
    assert all(got[i].distance is not None for i in range(good + len(langs)))


def test_pools_of_groups(spark):
    counts = {("en", "big"): 50, ("en", "small"): 3, ("de", "a"): 30, ("de", "b"): 30, ("fr", "x"): 2, ("it", "y"): 60}
    rows = [(lang, f"{lang}/{source}") for (lang, source), n in counts.items() for _ in range(n)]
    got = {r.group: (r.pool, set(r.feeds)) for r in quality_rules.pools(spark.createDataFrame(rows, "lang string, group string")).collect()}
    assert got == {
        "en/big": ("group en/big", {"group en/big", "lang en", "all"}), "en/small": ("lang en", {"lang en", "all"}),
        "de/a": ("lang de", {"lang de", "all"}), "de/b": ("lang de", {"lang de", "all"}), "fr/x": ("all", {"all"}),
        "it/y": ("group it/y", {"group it/y", "all"}),
    }


def test_distances_against_a_second_version_of_the_estimate(spark):
    """The same steps in numpy, on exact order statistics: the cells of the distributed version move little."""
    import numpy as np

    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(60, 300)), "en", "s") for i in range(400)] + [(400 + i, broken(rng), "en", "s") for i in range(8)]
    table = spark.createDataFrame(rows, SCHEMA)
    stats = quality_rules.statistics(table, "doc_id", "text", "lang", "source").orderBy("doc_id").select(*quality_rules.NAMES).collect()
    x = np.array([list(r) for r in stats])
    floor = np.diag([sd**2 for _, sd in quality_rules.VECTOR.values()])
    mid = np.median(x, axis=0)
    cov = np.diag(((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349) ** 2) + floor

    def distances():
        d = x - mid
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    for _ in range(quality_rules.STEPS):
        d = distances()
        core = np.argsort(d, kind="stable")[: int(np.ceil(quality_rules.CORE_SHARE * len(x)))]
        mid = x[core].mean(axis=0)
        cov = np.cov(x[core].T, bias=True) * max(1.0, d[core].max() / quality_rules.CORE_QUANTILE) + floor
    got = {r.doc_id: r.distance for r in quality_rules.judge(table).select("doc_id", F.col("distance")).collect()}
    want = distances()
    assert all(abs(got[i] - want[i]) <= 0.15 * want[i] + 0.05 for i in range(len(x)))
    assert [got[i] > quality_rules.CUTOFF for i in range(len(x))] == list(want > quality_rules.CUTOFF)
