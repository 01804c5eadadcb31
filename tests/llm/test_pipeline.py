"""The pipeline's stages, and the queries' SQL twins."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from scanloom.llm import mixing, queries
from scanloom.llm.common import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    first = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert all(first[r.doc_id] == r.text for r in docs.collect())
        if k < 3:
            assert 0 < docs.count() <= before.count()
        if k == 1:
            assert docs.count() == len({" ".join((t or "").split()) for t in first.values()})
    # Every row of the mix is packed, from its first token on.
    assert docs.filter("start = 0").count() == before.count()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_keep_the_right_documents(spark, tmp_path):
    """The ids that each stage keeps against plain Python; the copies of the mix against op2_mixing, which has a SQL twin."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    base, texts = text(150).split(), [text(rng.randint(20, 80)) for _ in range(40)]
    for changes in (1, 2, 3, 3, 4, 4, 6, 9):  # five words: three changes are near, four are not, unless they lie close
        near = list(base)
        for k in rng.sample(range(150), changes):
            near[k] = f"changed{rng.randrange(9**6)}"
        texts.append(" ".join(near))
    texts += [texts[3], texts[4].replace(" ", "\n"), texts[5].upper(), "one two three", "One two three", "four words are few", None, "", " \t\n"]
    order = rng.sample(range(1000), len(texts))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in zip(order, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    identified = {i: t for i, t, *_ in rows if words(t)}
    firsts = {}
    for i in sorted(identified, reverse=True):
        firsts[tuple(words(identified[i]))] = i
    sets = {}
    for i in firsts.values():
        w = [x.lower() for x in words(identified[i])]
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    want = [set(identified), set(firsts.values()), {i for i in sets if label[i] == i}]
    assert len(want[2]) < len(want[1]) < len(want[0]) < len(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = Counter(r.doc_id for r in docs.collect())
        if k < 3:
            assert got == Counter(want[k]), corpus_pipeline.STAGES[k][0]
        else:
            assert got == Counter({r.doc_id: r.taken // r.size for r in mixing.mix(before).collect() if r.taken})


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    normal = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr) and got
