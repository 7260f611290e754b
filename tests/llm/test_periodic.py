import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.llm import periodic
from signalframe.llm.common import text_of, words_of


def brute(w, exponent=4, least=6):
    """Every stretch of every period by direct comparison; the smallest period names it."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                s = i
                while i + q < n and w[i] == w[i + q]:
                    i += 1
                length = i + q - s
                if length >= max(least, exponent * q):
                    out.setdefault((s, length), q)
            else:
                i += 1
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_runs_of_many_documents(exponent, least):
    rng = random.Random(exponent)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 8]), rng.choice([0, 1, 5, 6, 20, 60])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n > 8:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        got = [[] for _ in docs]
        for d, *r in zip(*(v.tolist() for v in periodic.runs_of(np.array(sum(docs, []), dtype=np.int64), np.array([len(d) for d in docs]), exponent, least))):
            got[d].append(tuple(r))
        assert got == [brute(d, exponent, least) for d in docs]


def test_suffix_and_lcp_arrays():
    rng = random.Random(3)
    docs = [[rng.randrange(2) for _ in range(n)] for n in (40, 0, 1, 90)] + [[7] * 50, [7] * 50]
    words, sizes = np.array(sum(docs, []), dtype=np.int64), np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), sizes)
    end = np.cumsum(sizes)[doc]
    sa, rank = periodic.suffix_array(words, end)
    suffix = lambda i: (int(doc[i]), words[i : end[i]].tolist())
    assert sa.tolist() == sorted(range(len(words)), key=suffix) and (rank[sa] == np.arange(len(words))).all()
    lcp = periodic.lcp_array(words, end, sa, rank)
    for k in range(1, len(words)):
        (d, a), (e, b) = suffix(sa[k - 1]), suffix(sa[k])
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if d == e else 0)


@pytest.mark.parametrize("words", [[0] * 60_000, [0, 1] * 30_000, list(range(300)) * 100])
def test_long_runs_take_no_quadratic_time(words):
    got = [v.tolist() for v in periodic.runs_of(np.array(words), np.array([len(words)]))]
    assert got == [[0], [0], [len(words)], [len(set(words))]]


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in runs)]
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(kept)))


def test_query_matches_a_plain_search(spark):
    from signalframe.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(plain(r.doc_id, r.text) for r in docs)
    assert sorted(tuple(r[c] for c in names) for r in got) == want
    assert sum(w[1] > 0 for w in want) >= 10


def test_odd_rows(spark, odd, empty):
    words = words_of(text_of())
    got = sorted((str(r.doc_id), r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(odd, words).collect())
    want = []
    for r in odd.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = brute(w) if len(w) < 1000 else brute(w[:60])
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        want.append((str(r.doc_id), len(w), tuple(runs), " ".join(kept)))
    assert got == sorted(want)
    assert periodic.find_runs(empty, words).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, w array<string>")
    assert [tuple(r) for r in periodic.find_runs(nothing, F.col("w")).orderBy("doc_id").collect()] == [(1, 0, [], ""), (2, 0, [], "")]


def test_a_text_of_a_million_words(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit("ha"), 1_000_000).alias("w"))
    r = periodic.find_runs(df, F.col("w")).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (1_000_000, [(0, 1_000_000, 1)], "ha")
