"""Two-level ordering against plain Python, with one key holding most rows."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from signalframe.functions import hashing as H
from signalframe.operators import order, rank, windowing


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(50), rng.random()) for i in range(2000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, id long, a int, v double")


def test_ordinal_equals_row_number(skewed):
    rows, df = skewed
    got = {r.id: r.ordinal for r in order.ordinal(df, ["k"], ["a", "id"], F.col("a")).collect()}
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        for i, r in enumerate(sorted(group, key=lambda r: (r[2], r[1]))):
            assert got[r[1]] == i


def test_prefix_sum_equals_running_total(skewed):
    rows, df = skewed
    out = order.prefix_sum(df, ["k"], ["v"], order.monotone_bucket(F.col("v"), 5), {"s": F.col("a").cast("long")})
    got = {r.id: r.s for r in out.collect()}
    for k in {r[0] for r in rows}:
        acc = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[3]):
            acc += r[2]
            assert got[r[1]] == acc


def test_monotone_bucket_never_decreases(spark):
    vals = sorted([-1e9, -3.5, -1.0, -1e-6, 0.0, 1e-6, 0.3, 2.0, 7e8])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    b = [r.b for r in df.withColumn("b", order.monotone_bucket(F.col("v"))).orderBy("i").collect()]
    assert b == sorted(b)


@pytest.mark.parametrize("quota", [0, 1, 5, 700, 5000])
def test_hash_head_is_exact(skewed, quota):
    rows, df = skewed
    got = {(r.k, r.id) for r in order.hash_head(df, ["k"], H.digest(1, "id"), "id", F.lit(quota)).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        ids = sorted((hashlib.sha256(f"1::{r[1]}".encode()).hexdigest(), r[1]) for r in rows if r[0] == k)
        want |= {(k, i) for _, i in ids[:quota]}
    assert got == want


def _runs(values):
    out, start = [], 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            out.append((start, i))
            start = i
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 64, 10000])
def test_segments_any_block_size(spark, block):
    rng = random.Random(block)
    rec = {"a": [rng.randrange(2) for _ in range(301)], "b": [1] * 40, "c": [0], "d": list(range(12))}
    rows = [(k, t, v) for k, vs in rec.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "recording_id string, t long, state int")
    got = {}
    for r in windowing.segments(df, ["state"], block=block).collect():
        got.setdefault(r.recording_id, []).append((r.segment, r.start, r.stop))
    for k, vs in rec.items():
        assert sorted(got[k]) == [(i, a, b) for i, (a, b) in enumerate(_runs(vs))]


def test_previous_any_block_size(spark):
    df = spark.createDataFrame([("a", t, t * t) for t in range(100)], "k string, t long, v long")
    for block in (1, 3, 100):
        got = {r.t: r.p for r in order.previous(df, ["k"], "t", {"p": "v"}, block).collect()}
        assert got == {t: (t - 1) ** 2 if t else None for t in range(100)}


def test_best_epoch_is_the_greedy_choice(spark):
    rng = random.Random(0)
    hist = [(f"r{r}", e, rng.random() if rng.random() > 0.1 else float("nan")) for r in range(5) for e in range(200)]
    df = spark.createDataFrame(hist, "run_id string, epoch long, m double")
    got = {r.run_id: r.best_epoch for r in rank.best_epoch(df, "m", 0.05).collect()}
    for r in range(5):
        best, at = float("-inf"), -1
        for _, e, m in (h for h in hist if h[0] == f"r{r}"):
            if m == m and m > best + 0.05:
                best, at = m, e
        assert got[f"r{r}"] == at


def test_pareto_front_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.randrange(30), rng.randrange(30)) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, p int, c int")
    for maximize in (True, False):
        sign = 1 if maximize else -1
        want = {i for i, p, c in pts if not any(sign * q >= sign * p and d <= c and (sign * q > sign * p or d < c) for _, q, d in pts)}
        assert {r.id for r in rank.pareto_front(df, "p", "c", maximize).collect()} == want


def test_buckets_are_even_wherever_values_crowd(spark):
    ids = spark.range(50000).select(F.format_string("sub-%06d", "id").alias("k"))
    scores = spark.range(1000).select((0.99 + F.col("id") / 1e5).alias("k"))
    tiny = spark.range(1000).select((F.col("id") * 1e-12).alias("k"))
    for df, n in ((ids, 50000), (scores, 1000), (tiny, 1000)):
        placed = order.spread(df, "k")
        assert placed.groupBy("__spread").count().agg(F.max("count")).first()[0] < max(0.03 * n, 20)
        rows = [r["__spread"] for r in placed.orderBy("k").collect()]
        assert rows == sorted(rows) and 0 <= rows[0] and rows[-1] <= 255
    got = order.ordinal(order.spread(ids, "k"), [], ["k"], F.col("__spread"), "n")
    assert got.filter(F.format_string("sub-%06d", F.col("n")) != F.col("k")).count() == 0


def test_buckets_of_few_and_odd_values(spark):
    odd = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (float("-inf"),), (float("inf"),)], "k double")
    rows = [r["__spread"] for r in order.spread(odd, "k").orderBy("k").collect()]
    assert rows == sorted(rows)
    assert order.spread(odd.limit(0), "k").count() == 0


def test_labels_of_any_number_are_ranked_in_buckets(spark):
    from signalframe.operators import labels

    df = spark.range(3000).select(F.format_string("c%05d", F.col("id") * 7 % 3000).alias("label"))
    out = labels.contiguous_labels(df)
    assert out.filter(F.format_string("c%05d", "class_id") != F.col("label")).count() == 0 and out.count() == 3000
