"""LM scores, periodic runs and collocations against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lattice, phrases, runs
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_tokens string, start string, rank string"


def _row(i, text, lang="en"):
    return (i, text, lang, "a", "b", "c")


EDGE = [
    _row(None, None, None), _row(None, "no id but words"), _row(1, None), _row(2, ""), _row(3, " \t\n "), _row(4, "ONE one", None),
    _row(5, "x" * 3000 + " é ß ▁ \0", "und"), _row(6, "ab cd " * 60), _row(7, "ab cd " * 60), _row(7, "ab cd " * 60),
    _row(8, "a. b, a b; a b! a b? " * 30, "de"), _row(9, "the cat\tsat\vthe cat sat\r" * 40, "de"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edge = spark.createDataFrame(EDGE, SCHEMA)
    return {"sf": docs, "edge": edge, "empty": edge.where("false")}


def _words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


# ------------------------------------------------------------------- op 11

PIECES = [b" ", b" a", b"a", b"ab", b"abc", b"b", b"bc", b"c", b"abcabcabcabc", "é".encode(), b"\xc3", b"\xa9"]


def _ways(w, pieces=PIECES):
    """All segmentations of a word with its opening space, as lists of piece numbers."""
    if not w:
        return [[]]
    return [[i, *rest] for i, p in enumerate(pieces) if w.startswith(p) for rest in _ways(w[len(p):], pieces)]


def test_forward_sum_and_expected_counts():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(len(PIECES)))
    lat = lattice.Lattice(PIECES, np.log(p))
    words = [b"a", b"ab", b"abc", b"abcabcabcabc", b"", "abéc".encode(), b"cab", b"c" * 9, b"bcabcabcabcabca"]
    ways = {w: [math.prod(p[i] for i in x) for x in _ways(b" " + w)] for w in words}
    assert np.allclose(lat.log_probability(words), [math.log(sum(ways[w])) for w in words])
    count = np.arange(1, len(words) + 1)
    want = np.zeros(len(PIECES))
    for w, n in zip(words, count):
        for x, q in zip(_ways(b" " + w), ways[w]):
            for i in x:
                want[i] += n * q / sum(ways[w])
    assert np.allclose(lat.expected(words, count), want)
    # words past the length of the vectorised recursion
    long = [b"abc" * 40, b"ab" * 33, b"c" * 64, b"c" * 63, b"c" * 62]
    got, one = lat.expected(long, np.ones(5)), np.zeros(len(PIECES))
    for w in long:
        lat._expected_long(b" " + w, 1.0, one)
    assert np.allclose(got, one)
    assert np.allclose(lat.log_probability(long), [lat._forward(b" " + w)[-1] for w in long])


def test_vocabulary_is_a_distribution():
    pieces, prior = lattice.load_vocabulary(Q.VOCABULARY)
    assert abs(prior.sum() - 1) < 1e-9 and len(pieces) == len(set(pieces))
    assert all(p == p.lower() and b" " not in p[1:] for p in pieces)
    assert {bytes([b]) for b in range(256)} - set(pieces) == {bytes([b]) for b in [*range(9, 14), *range(65, 91)]}


@pytest.mark.parametrize("name", ["sf", "edge", "empty"])
def test_lm_scores(tables, name):
    docs = tables[name].withColumn("held_out", lattice.held_out(F.col("doc_id")))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(_words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")))
            c[b""] += 1
    total, distinct = sum(c.values()), len(c)
    model = lattice.train(docs.where("not held_out").select("text"), Q.VOCABULARY)
    assert (model.tokens, model.distinct) == (total, distinct)
    assert abs(np.exp(model.log_p).sum() + math.exp(model.log_end) - 1) < 1e-9
    lat = lattice.Lattice(model.pieces, model.log_p)
    want = []
    for i, t in rows:
        w = [x.lower() for x in _words(t)]
        base = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in [*w, b""])
        score = (sum(lat._forward(b" " + x)[-1] for x in w) + model.log_end) / math.log(10)
        want.append((i, held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, b""]), total, round(base, 6), round(score, 6)))
    for common in (100_000, 3):
        out = lattice.score_documents(docs, model, common=common)
        assert set(out.columns) == {*docs.columns, "n_known", "train_tokens", "base_score", "score", "n_tokens"} - {"text"}
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_training_fits_the_corpus(spark, tables):
    """Held-out texts are likelier under the trained model than under the vocabulary's prior."""
    docs = tables["sf"].withColumn("held_out", lattice.held_out(F.col("doc_id")))
    train = docs.where("not held_out").select("text")
    means = [lattice.score_documents(docs.where("held_out"), lattice.train(train, Q.VOCABULARY, rounds=r)).agg(F.avg("score")).first()[0]
             for r in (0, 1, 2)]
    assert means[0] < means[1] < means[2]


def test_op11_columns(spark):
    out = Q.op11_lattice(spark, SF)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert out.where("score is null or score > 0 or base_score is null").count() == 0


# ------------------------------------------------------------------- op 12


def brute_runs(w, least=24, periods=3):
    out = {}
    for q in range(1, len(w) // periods + 1):
        x = 0
        while x < len(w) - q:
            s = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            if x - s + q >= max(least, periods * q) and x > s:
                out.setdefault((s, x + q), q)
            x += 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def _random_words(rng):
    n, a, kind = rng.randint(0, 300), rng.choice([1, 2, 3, 5]), rng.randrange(4)
    w = [] if kind else [rng.randrange(a) for _ in range(n)]
    while kind and len(w) < n:
        if kind == 1:
            w += [rng.randrange(a) for _ in range(rng.randint(1, 40))] * rng.randint(1, 7)
        elif kind == 2:  # long stretches of one word, parted by others
            w += [0] * rng.choice([5, 30, 31, 60]) + [rng.choice([1, 1, 2, 0])]
        else:
            w = [y for x in (w or [0]) for y in ((0, 1) if x == 0 else (0,))]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = [_random_words(rng) for _ in range(60)]
    for least, periods, piece in ((24, 3, 1 << 18), (24, 3, 16), (24, 3, 1), (5, 4, 33), (100, 3, 64)):
        assert runs.runs_of_texts(texts, least, periods, piece) == [brute_runs(w, least, periods) for w in texts]


def test_catchers_word_by_word():
    w = ([0] * 40 + [1]) * 5 + [2, 3, 4] * 20
    c = runs.Catchers()
    for i, x in enumerate(w):
        c.append(np.array([x]))
        if i % 37 == 0:
            assert [(s, e - s, q) for s, e, q in c.runs()] == brute_runs(w[:i + 1])
    assert [(s, e - s, q) for s, e, q in c.runs()] == brute_runs(w)


def test_long_stretches_take_linear_time():
    import time

    def took(n):
        t = time.time()
        assert len(runs.runs_of_texts([([0] * (n // 11) + [1]) * 11])[0]) == 12
        return time.time() - t

    took(20_000)
    small = took(50_000)
    assert took(400_000) < 40 * max(small, 0.05)


def test_strongest_by_exact_ratio():
    assert runs.strongest([(0, 30, 10), (5, 24, 8), (7, 31, 10)]) == (7, 31, 10)
    assert runs.strongest([(3, 24, 8), (0, 30, 10)]) == (0, 30, 10)
    assert runs.strongest([]) is None


def _looped(w, i):
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]


@pytest.mark.parametrize("name", ["sf", "edge", "empty"])
def test_find_runs(tables, name):
    docs = tables[name]
    out = runs.find_runs(docs, plant=runs.planted(F.col("doc_id")))
    assert {"runs", "collapsed_text", "start", *docs.columns} - {"text"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    want = []
    for r in docs.select("doc_id", "text").collect():
        w = _looped(_words(r.text), r.doc_id)
        found = brute_runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        want.append((r.doc_id, len(w), len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], found,
                     b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    got = [(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed_text)
           for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op12_digests(spark, tables):
    want = {}
    for r in tables["sf"].select("doc_id", "text").collect():
        found = brute_runs(_looped(_words(r.text), r.doc_id))
        want[r.doc_id] = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    out = Q.op12_runs(spark, SF).collect()
    assert {r.doc_id: r.runs_sha256 for r in out} == want
    assert sum(r.n_runs > 0 for r in out) > 5


# ------------------------------------------------------------------- op 13


@pytest.mark.parametrize("bits,words", [(3, 2), (20, 2), (20, 3), (20, 4), (21, 5), (1, 5), (12, 5)])
def test_filter_is_lossless(bits, words):
    rng = np.random.default_rng(bits * words)
    grams = rng.integers(0, 1 << bits, (4000, words))
    grams[::3] = grams[0]
    first, second = phrases.permuted(grams, bits)
    assert (phrases.restored(first, second, words, bits) == grams).all()
    parts = [phrases.QuotientFilter(first[a::3], None if second is None else second[a::3], np.ones(len(first[a::3]), np.int64)) for a in range(3)]
    for shard_bits in (0, 6):
        shards: dict = {}
        for f in parts:
            for s, data in f.shards(shard_bits):
                shards.setdefault(s, []).append(phrases.QuotientFilter.unpacked(data, s, shard_bits, second is not None))
        got = {}
        for fs in shards.values():
            m = phrases.QuotientFilter.merged(fs)
            got.update(zip(map(tuple, phrases.restored(m.first, m.second, words, bits).tolist()), m.count.tolist()))
        assert got == Counter(map(tuple, grams.tolist()))


def brute_phrases(rows, longest=5, least=100, cover=100, first=2000):
    f, n = {}, Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    key = lang, tuple(w[i:i + k])
                    f[key] = f.get(key, 0) + 1
    often = {k: a for k, a in f.items() if a >= least}
    out = []
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        held = any(lang == g and len(v) > len(w) and 100 * b >= cover * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                   for (g, v), b in often.items())
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not held:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked = [(r[0], i, *r[1:]) for _, g in itertools.groupby(out, key=lambda r: r[0]) for i, r in enumerate(g, 1)]
    return [r for r in ranked if first is None or r[1] <= first]


@pytest.mark.parametrize("name,least,cover,first", [("sf", 20, 100, 2000), ("sf", 12, 90, 7), ("edge", 5, 100, None), ("empty", 5, 100, 10)])
def test_collocations(tables, name, least, cover, first):
    docs = tables[name]
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = brute_phrases(rows, 5, least, cover, first)
    assert bool(want) == (name != "empty")
    # all frequent words numbered, and only the three most frequent ones
    for numbers in (1 << 20, 3):
        out = phrases.collocations(docs, least=least, cover=cover, first=first, numbers=numbers)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == sorted(want)


def test_products_beyond_64_bits(spark):
    """1000 a n of a language with 3e9 words passes 2^63; decimals stay exact."""
    a, n, l, r = 3_000_000_007, 3_999_999_989, 3_000_000_019, 3_100_000_037
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(F.expr(
        "(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_full_counters_give_out_rare_words(spark, tables, monkeypatch):
    """Counts stay whole when a task's counter overflows many times."""
    from tidemark.llm import common

    c = Counter({"a": 5, "b": 1, "c": 1})
    assert common.evicted(c) == {"b": 1, "c": 1} and c == {"a": 5}
    assert common.evicted(c) == {"a": 5} and not c
    docs = tables["sf"]
    want = Counter(w.lower() for r in docs.select("text").collect() for w in _words(r.text))
    monkeypatch.setattr(lattice, "_COUNTED", 50)
    got = {r.word.encode(): r.c for r in lattice.word_counts(docs).collect()}
    assert got.pop(b"") == docs.count() and got == want
    monkeypatch.setattr(phrases, "_COUNTED", 50)
    got = phrases.word_counts(docs.select("lang", "text"), "text", "lang").agg(F.sum("c")).first()[0]
    assert got == sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", r.text or "")) for r in docs.select("text").collect())


def test_least_count_bounds_what_is_collected(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([1] * 50 + [2] * 20 + [7] * 5 + [100, 101, 5000])], "w long, c long")
    from tidemark.llm.common import least_count

    assert [least_count(df, "c", m) for m in (0, 2, 3, 8, 27, 28, 78, 1000)] == [1 << 62, 5000, 100, 7, 7, 2, 1, 1]
    assert least_count(df.where("false"), "c", 10) == 1 << 62
