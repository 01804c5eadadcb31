"""Secrets in one long text: exact spans, in time that grows with the text."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from scanloom.llm import secret_scan

DRAW = random.Random(5)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def token(n, letters=LETTERS):
    return "".join(DRAW.choice(letters) for _ in range(n))


def test_many_matches_in_one_text(spark):
    texts = [
        " ".join(token(24, "0123456789abcdef") for _ in range(40_000)),
        " ".join("token=" + token(30) for _ in range(30_000)),
        "=".join(token(24) for _ in range(20_000)),
        "a" * 3_000_000,
    ]
    begun = time.time()
    rows = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - begun < 120
    assert (rows[0].n_hex, rows[1].n_assign, rows[3].n_hex) == (40_000, 30_000, 1)
    for i, (kind, pattern, group) in enumerate([("hex", "[0-9a-f]{24,}", 0), ("assign", "token=[A-Za-z0-9]+", 0)]):
        spans = ",".join(f"{kind}:{m.start(group)}:{m.end(group)}" for m in re.finditer(pattern, texts[i]))
        assert rows[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    # Parts of one run: nearly all are found, apart from each other, and each where its characters are.
    found = [tuple(map(int, s.split(":")[1:])) for s in rows[2].spans.split(",")]
    assert len(found) > 19_000 and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert all("=" not in texts[2][a:b] for a, b in found)


def test_running_values_and_overlaps_against_plain_python(spark):
    rows = []
    for i in range(60):
        values = [DRAW.randrange(-50, 50) for _ in range(DRAW.choice([0, 1, 2, 255, 256, 257, 700]))]
        base = sorted((a, 0, a + DRAW.randrange(1, 30)) for a in (DRAW.randrange(300) for _ in range(DRAW.randrange(12))))
        rows.append((i, values, base, [(a, a + DRAW.randrange(1, 9)) for a in range(0, 330, 7)]))
    df = spark.createDataFrame(
        rows, "i int, values array<int>, base array<struct<start:int,kind:int,end:int>>, spans array<struct<start:int,end:int>>")
    reach = secret_scan._running(F.transform("base", lambda b: b.getField("end")), F.greatest)
    df = df.withColumns({"sums": secret_scan._running(F.col("values")), "reach": reach})
    df = df.withColumn("over", F.transform("spans", secret_scan._overlapped(F.col("base"), F.col("reach"))))
    for r in df.collect():
        assert r["sums"] == [sum(r["values"][:k + 1]) for k in range(len(r["values"]))]
        assert r.over == [any(b.start < s.end and s.start < b.end for b in r.base) for s in r.spans]
