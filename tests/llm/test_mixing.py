import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from signalframe.llm import mixing

SF = "/root/testdata/sf0.01"


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, rows):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += n_words(r.text)
    want = expected_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r.doc_id, r.source, n_words(r.text)) for r in docs)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return taken, want


def test_targets_and_balance_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs).collect()
    taken, want = check(docs.collect(), out)
    # Landing decides at most two documents of a source (which has 50 here).
    assert np.mean([abs(taken[s] - want[s]) / want[s] for s in want]) < 0.03
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_odd_rows_and_levels(spark, odd, empty, monkeypatch):
    check(odd.collect(), mixing.mix(odd).collect())
    monkeypatch.setattr(mixing, "CHUNK", 4)
    monkeypatch.setattr(mixing, "FAN", 2)
    mixed = mixing.mix(odd)
    rows = mixed.collect()
    check(odd.collect(), rows)
    out = mixing.repeat(odd, mixed)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == +Counter({k: sum(r.copies for r in rows if r.doc_id == k) for k in {r.doc_id for r in rows}})
    assert mixing.mix(empty).collect() == []


def test_equal_rows_are_dealt_to_many_chunks(spark):
    from pyspark.sql import functions as F

    units = spark.createDataFrame([(1, 77, "s", 10, 20000), (2, 78, "s", 5, 1)], "doc_id long, row long, source string, size long, same long")
    known = spark.createDataFrame([("s", 1.5, 40)], "s string, rate double, chunks long")
    counts = [r["count"] for r in mixing._dealt(units, known, 11).groupBy("chunk").count().collect()]
    assert sum(counts) == 20001 and len(counts) == 40 and max(counts) < 650


def test_flight_keeps_both_totals_in_expectation():
    size = np.array([5, 9, 1, 7, 3, 8, 2, 6, 4, 10, 11, 12], float)
    p = np.full(12, 0.3)
    hits, words = np.zeros(12), []
    for seed in range(4000):
        x = mixing._flight(p, size, np.random.default_rng(seed), True)
        hits += x
        words.append(x @ size)
    assert np.abs(hits / 4000 - 0.3).max() < 0.035
    assert np.std(words) < 0.6 * np.sqrt(0.21 * (size**2).sum())
