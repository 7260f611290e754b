import math
import zlib
from collections import Counter

import numpy as np
import pytest

from signalframe.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check(docs, rows):
    texts = docs.collect()
    c = Counter(t for r in texts if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = {}
    for r in texts:
        t = tokens(r.text)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want.setdefault(r.doc_id, []).append((held(r.doc_id), len(t), sum(c[x] > 0 for x in t), n, round(base, 5)))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(lm, "FREQUENT", 5000)
    rows = lm.score(docs).collect()
    check(docs, rows)
    out = [r for r in rows if r.held_out]
    per = lambda f: sum(f(r) for r in out) / sum(r.n_tokens for r in out)
    # Held-out text is likelier under the pairs than under single words.
    assert per(lambda r: r.score) > per(lambda r: r.base_score)
    assert all(r.score < 0 for r in rows)


def test_odd_rows(odd, empty):
    rows = lm.score(odd).collect()
    assert len(rows) == odd.count()
    check(odd, rows)
    assert lm.score(empty).collect() == []


def test_filter_counts(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63, 60000)
    counts = np.minimum((1 / rng.random(60000)).astype(np.int64), 10**6)
    table = spark.createDataFrame([(1 + i % 2, int(h), int(c)) for i, (h, c) in enumerate(zip(hashes, counts))], "kind int, hash long, count long")
    bits, lines, least = lm.build_filter(table)
    assert least == 1 and len(bits) <= lm.FILTER_BYTES
    for kind in (1, 2):
        own = np.arange(60000) % 2 == kind - 1
        got = lm.probe(bits, lines, hashes[own].view(np.uint64), kind)
        # Never below the step of the true count; above it only by false positives.
        assert (got >= counts[own] / lm.BASE).all()
        assert (got > counts[own] * lm.BASE).mean() < 0.06
    other = rng.integers(-(2**63), 2**63, 40000).view(np.uint64)
    assert (lm.probe(bits, lines, other, 1) > 0).mean() < 0.06


def test_filter_stays_within_its_size(spark):
    table = spark.range(200000).selectExpr("1 kind", "xxhash64(id) hash", "1 + id % 7 count")
    bits, lines, least = lm.build_filter(table, filter_bytes=1 << 18)
    assert len(bits) <= (1 << 18) + lm.SEGMENT and least > 1


def test_conditional_distribution_sums_to_at_most_one():
    """With exact counts, one context's shares over the vocabulary and the rest add up to one."""
    seen = np.array([50.0, 30.0, 20.0])
    floor = 100 + 0.5 * 4
    uni = np.r_[(seen + 0.5) / floor, 0.5 / floor]
    pairs = np.array([10.0, 25.0, 15.0, 0.0])
    p = (pairs + lm.PRIOR * uni) / (50 + lm.PRIOR)
    assert p.sum() == pytest.approx(1.0)


def test_a_small_filter_loses_no_count(spark):
    """What does not enter the filter is looked up: scores agree with those of a filter that holds everything."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = lambda rows: {r.doc_id: (r.score, r.n_tokens) for r in rows.collect()}
    whole, small = scores(lm.score(docs)), scores(lm.score(docs, filter_bytes=1 << 16))
    assert whole.keys() == small.keys()
    # A few n-grams are false positives of either filter.
    assert sum(abs(whole[k][0] - small[k][0]) for k in whole) < 0.02 * sum(n for _, n in whole.values())


def test_pairs_seen_once_count(spark):
    """A pair that one training text has is known to a held-out text with it, and to its own text."""
    ids = [i for i in range(200)]
    inside, outside = [i for i in ids if not held(i)], [i for i in ids if held(i)]
    rows = [(inside[0], "salt pepper"), (inside[1], "pepper salt"), (inside[2], "salt"), (inside[3], "pepper"), (outside[0], "salt pepper"), (outside[1], "salt salt pepper pepper")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert got == pytest.approx({r.doc_id: r.score for r in lm.score(docs, filter_bytes=0).collect()})
    n, words = 10, {"salt": 3, "pepper": 3, None: 4}
    middle = lambda c: 1.0 if c == 1 else lm.BASE ** (int(lm._levels(np.array([c]))[0]) - 0.5)
    seen = Counter((a, b) for i, t in rows if not held(i) for a, b in zip([None, *t.split()], [*t.split(), None]))

    def score(text):
        total = 0.0
        for a, b in zip([None, *text.split()], [*text.split(), None]):
            pair = middle(seen[a, b]) if seen[a, b] else 0.0
            uni = (middle(words[b]) + 0.5) / (n + 0.5 * 4)
            total += math.log10((min(pair, middle(words[a])) + lm.PRIOR * uni) / (middle(words[a]) + lm.PRIOR))
        return total

    assert got == pytest.approx({i: score(t) for i, t in rows})


def test_words_are_found_and_hashed_on_bytes():
    """Places, counts and hashes of words, found on all texts' bytes at once."""
    from signalframe.llm.common import Words, distinct

    long = b"x" * 255
    texts = [b" The\x0bcat\x1cB\x85 \t", b"", b" \n ", "Éé日 abcdefgh abcdefghi".encode(), b"\x00 \x00\x00 a a\x00", long + b" " + long + b"y " + long + b"yz " + b"z" * 70_000, b"the cat\x1cb\x85"]
    want = [t.lower().split() for t in texts]
    words = Words(texts, lower=True)
    got = [words.data[a : a + n].tobytes() for a, n in zip(words.start, words.size)]
    assert got == [w for t in want for w in t] and words.counts.tolist() == [len(t) for t in want]
    hashes = words.hashes()
    assert len({*hashes.tolist()}) == len({*got}) == len({*zip(got, hashes.tolist())})
    assert Words([]).hashes().tolist() == Words([b""]).hashes().tolist() == []
    alone = [h for t in texts for h in Words([t], lower=True).hashes().tolist()]
    assert alone == hashes.tolist()
    values = np.array([3, 1, 3, 2**63], np.uint64)
    assert distinct(values).tolist() == [1, 3, 2**63] and distinct(values[:0]).tolist() == []
