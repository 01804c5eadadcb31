"""Source divergence, byte-level BPE and hard negatives against brute force and the tiktoken library."""

import base64
import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
import tiktoken

from scanloom.llm import byte_bpe, divergence, hard_negatives, personal_data, substring_dedup
from scanloom.llm.common import RANKS, split_pattern

SCHEMA = "doc_id long, text string, lang string, source string, n long, item string, ids string, decoded string, term string"


def rows_of(*rows):
    return [(*r, 9, "item", "ids", "decoded", "term") for r in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "ÉCOLE", "école", "x1x", "don't", "日本", "gamma", "delta", "eps", "\x00zeta", "eta-theta"] + [f"{c}{d}" for c in "klm" for d in "abcdefgh"]
    found = []
    for i in range(120):
        lang = ["en", "fr", None, "de"][i % 4]
        source = [f"s{rng.randrange(5)}", None, "", "host"][min(i % 7, 3)]
        found.append((i, " ".join(rng.choice(vocabulary[: 12 + i % 20]) for _ in range(rng.randrange(0, 60))), lang, source))
    found += [(200, None, "en", "silent"), (201, "", "xx", "only"), (202, " 12 34 ", "xx", "other"), (203, "rare word", "yy", "a"), (5, found[5][1], "de", "s1")]
    found += [(204, "alpha " * 30_000, "en", "long"), (None, "beta gamma", None, None)]
    return rows_of(*found)


def brute_divergence(rows, least):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))) for r in rows]
    df, lang_n, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        df[lang].update(set(terms))
        lang_n[lang].update(terms)
        n[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(n[lang, s]) for s in sources}
        q = share(lang_n[lang])
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(values, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, tile", [(4096, 64), (5, 2)])
def test_source_divergence(spark, rows, block, tile):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.audit(docs, least_docs=4, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, 4)


def test_source_divergence_without_rows_or_terms(spark, rows):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    got = divergence.audit(docs, least_docs=1000).collect()
    assert sorted(tuple(r) for r in got) == brute_divergence(rows, 1000) and {r.value for r in got} == {0}


def test_equal_subtrees_are_one_node():
    trees = divergence.Trees(np.array([[0, 0, 0, 0, 1, 2, 0, 0], [0, 0, 0, 0, 1, 2, 1, 2], [0, 0, 0, 0, 1, 2, 0, 0]]))
    assert trees.roots[0] == trees.roots[2] != trees.roots[1]
    assert len(trees.children[0]) == 2 and len(trees.children[1]) == 3 and len(trees.children[2]) == 2
    assert trees.places(1).tolist() == [4, 5, 6, 7]


def test_shares_are_exact():
    rng = random.Random(1)
    counts = [rng.randrange(10**14) for _ in range(200)] + [0, 1]
    total, terms = 9 * 10**14, 10**9
    got = divergence.shares(np.array(counts), total, terms)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encode():
    return byte_bpe.encoder(byte_bpe.read_ranks(RANKS), split_pattern())


def test_ids_as_the_tiktoken_library(encode, reference):
    rng = random.Random(5)
    pool = [*"ab '1 !\n\t\r\xa0\x85éß日", "'s", "'ll", "  ", "ſ", "<|endoftext|>", "😀", *[chr(c) for x in byte_bpe.LATER_LETTERS for c in x]]
    pool += [chr(c) for c in (rng.randrange(0x110000) for _ in range(500)) if not 0xD800 <= c < 0xE000]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        assert encode(text) == reference.encode_ordinary(text), text
    for text in ("a" * 3001, "".join(rng.choice("abcdeé") for _ in range(4000)), " " * 999, "!" * 777):
        assert encode(text) == reference.encode_ordinary(text)


def test_every_code_point_is_cut_alike(encode, reference):
    for start in range(0, 0x40000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert encode(text) == reference.encode_ordinary(text), hex(start)


def test_long_run_is_not_quadratic(encode):
    start, rng = time.monotonic(), random.Random(2)
    run = "".join(rng.choice("abcdefgh") for _ in range(400_000))
    ids = encode(run)
    assert time.monotonic() - start < 40 and len(ids) > 100_000


def test_digests_and_round_trip(spark, rows, reference):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert sorted((tuple(r) for r in byte_bpe.digests(docs, RANKS, split_pattern()).collect()), key=repr) == sorted(want, key=repr)
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, split_pattern()), RANKS)
    assert both.columns == ["doc_id", "text", "lang", "source", "n", "item", "term", "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert byte_bpe.digests(spark.createDataFrame([], SCHEMA), RANKS, split_pattern()).count() == 0
    odd = spark.createDataFrame([(None,), ([None, 99, 10**6],), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd, RANKS).collect()].count(b"") == 2


def brute_negatives(rows):
    kept = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or x != x or abs(x) == float("inf") for x in vec):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        if i not in kept or (label, vec) < kept[i]:
            kept[i] = (label, vec)
    scaled = {i: (label, [floor(256 * x) for x in vec]) for i, (label, vec) in kept.items()}
    out = []
    for a, (label, v) in scaled.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in scaled.items()}
        first = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in first([i for i in scaled if i != a and scaled[i][0] == label], 5):
            fits = [i for i in scaled if scaled[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(first(fits, 3), 1)]
    return sorted(out)


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.randrange(4)) for i in range(n)]


EMBEDDINGS = "vec_id long, embedding array<double>, label int, vec string, score long, block int, is_anchor boolean"


@pytest.mark.parametrize("block, tile", [(4096, 8192), (60, 3)])
def test_hard_negatives(spark, block, tile):
    rows = vectors(700, 6, 1)
    rows += [(700 + i, [1.0, 0.5, -0.25, 0.0, 0.0, 0.0], i % 3) for i in range(200)]  # ties
    rows += [(1000, None, 1), (1050, [float("nan")] * 6, 1), (1100, [None] * 6, 1), (1150, [1.0] * 6, None), (1200, [float("inf")] * 6, 2)]
    rows += [(None, [1.0] * 6, 1), (1250, [0.0] * 6, 1), (1300, [], 2), (1350, [3.0, 1.0], 3), (1400, [-2.0] * 6, 77), rows[3], (4, [9.0] * 6, 3)]
    df = spark.createDataFrame([(*r, "x", 1, 2, True) for r in rows], EMBEDDINGS).repartition(3)
    got = hard_negatives.mine(df, block=block, tile=tile)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_hard_negatives_of_large_components(spark):
    rows = vectors(120, 3, 2, 1e6)
    got = hard_negatives.mine(spark.createDataFrame([(*r, "x", 1, 2, True) for r in rows], EMBEDDINGS))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    far = [(i, [s * 1e30 * (i + 1)], i % 2) for i, s in zip(range(60), [1, -1] * 30, strict=True)]
    assert hard_negatives.mine(spark.createDataFrame([(*r, "x", 1, 2, True) for r in far], EMBEDDINGS)).count() >= 0
    assert hard_negatives.mine(spark.createDataFrame([], EMBEDDINGS)).count() == 0


def test_reading_stops_early():
    rng = np.random.default_rng(4)
    matrix = rng.integers(-9, 9, (4000, 3))
    matrix[7] = [500, 500, 500]
    lists, seen = hard_negatives.Lists(matrix), 0
    for rows, scores, most in lists.read(np.array([2, 1, 1])):
        seen += len(rows)
        if most is not None and most < scores.max():
            break
    assert seen < 100


def test_mail_and_network_addresses_as_the_patterns_find_them():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(8)
    for pool in ("ab.@-+é ", "019.x ", "a1.@"):
        for _ in range(6000):
            text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
            found = personal_data.spans_of(text)
            assert [s[1:3] for s in found if s[0] == "email"] == [m.span() for m in email.finditer(text)], text
            assert [s[1:3] for s in found if s[0] == "ip"] == [m.span() for m in ip.finditer(text) if personal_data._ip_ok(m[0])], text


@pytest.mark.parametrize("text", [
    "x" * 3_000_000 + " @", "x" * 3_000_000 + "@", "1" * 3_000_000 + ".", "1." * 1_000_000, "a@" * 1_000_000, "+49 30 1234567, " * 60_000,
    "call 555-123-4567 " * 60_000,
], ids=["letters", "at the end", "digits", "dots", "ats", "phones", "local phones"])
def test_personal_data_in_one_long_text_takes_linear_time(text):
    start = time.monotonic()
    personal_data.spans_of(text)
    assert time.monotonic() - start < 45


def test_added_spans_overlap_none():
    rng = random.Random(9)
    for _ in range(300):
        spans = [(s, s + rng.randrange(1, 12)) for s in (rng.randrange(100) for _ in range(6))]
        taken, held = personal_data.Taken(spans), list(spans)
        for _ in range(20):
            start = rng.randrange(100)
            end = start + rng.randrange(1, 9)
            free = not any(s < end and start < e for s, e in held)
            assert taken.add(start, end) == free
            held += [(start, end)] * free


def test_places_beyond_a_text_are_left_out():
    assert substring_dedup.candidates(np.array([500]), 100, 35).tolist() == []
    assert substring_dedup.candidates(np.array([24, 500]), 100, 35).tolist() == substring_dedup.candidates(np.array([24]), 100, 35).tolist()


def test_texts_that_share_the_short_key(spark, monkeypatch):
    """All texts under one short key: each gets the places of all, and the result is that of each by itself."""
    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(50)]
    texts = [" ".join([*[word() for _ in range(n)], *passage, word()]) for n in (0, 7, 400)] + [" ".join(word() for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    conv = substring_dedup.F.conv
    monkeypatch.setattr(substring_dedup.F, "conv", lambda *a: substring_dedup.F.lit("7"))
    forced = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup.F, "conv", conv)
    assert forced == plain and [r[2] for r in plain] == [50, 50, 50, 0]


def test_hashes_of_runs():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    both = np.concatenate([hashes, hashes[100:180], hashes[:7]])
    runs = substring_dedup.Runs(substring_dedup.M1)
    found = runs.of(both, np.arange(len(both) - 34), 35)
    assert (found[300:346] == found[100:146]).all() and len(set(found.tolist())) == len(found) - 46
    assert (runs.of(both[60:], np.arange(200), 35) == found[60:260]).all()


def test_words_and_their_hashes_in_stretches(monkeypatch):
    rng = random.Random(11)
    hashes = substring_dedup.WordHashes()
    for stretch in (1 << 20, 12):
        monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
        seen = {}
        for _ in range(300):
            text = "".join(rng.choice("ab é\t\n\x0b\x1c") for _ in range(rng.randrange(0, 60))).encode()
            words, found = text.split(), hashes.of(text).tolist()
            assert len(words) == len(found)
            for word, x in zip(words, found, strict=True):
                assert seen.setdefault(word, x) == x
        assert len(set(seen.values())) == len(seen) > 200
