import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalframe.operators import layout, normalize, windowing


def starts_of(n, w, s, tail):
    full = list(range(0, n - w + 1, s)) if n >= w else []
    after = full[-1] + s if full else 0
    if tail == "floor" and n % s:
        return sorted(set(full) | {n // s * s})
    if tail == "all":
        return list(range(0, n, s))
    if tail == "keep":
        return full + ([after] if (not full) or (full[-1] + w < n and after < n) else [])
    if tail == "next":
        return full + ([after] if after < n else [])
    return full


@pytest.mark.parametrize("tail,want", [
    ("drop", [0, 1024, 2048]), ("floor", [0, 1024, 2048, 4096]), ("all", [0, 1024, 2048, 3072, 4096]),
    ("keep", [0, 1024, 2048, 3072]), ("next", [0, 1024, 2048, 3072]),
])
def test_worked_values(tail, want):
    assert starts_of(5000, 2048, 1024, tail) == want


@pytest.mark.parametrize("w,s,frame", [(8, 4, 4), (8, 4, 12), (6, 6, 6), (5, 2, 8), (4, 7, 14)])
@pytest.mark.parametrize("tail", windowing.TAILS)
def test_frames_do_not_change_windows(spark, w, s, frame, tail):
    lengths = {f"r{n}": n for n in (1, 3, 4, 5, 8, 12, 13, 16, 24, 29, 48)}
    rows = [(r, t, float(t + 1)) for r, n in lengths.items() for t in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "recording_id string, t long, v double").withColumn("channel", F.lit("c"))
    got = {}
    for r in windowing.cut(df, w, s, tail, frame=frame).collect():
        got.setdefault(r.recording_id, []).append((r.start, r.x, r.n_pad))
    for rec, n in lengths.items():
        want = []
        for a in starts_of(n, w, s, tail):
            x = [float(t + 1) for t in range(a, min(a + w, n))]
            want.append((a, x + [0.0] * (w - len(x)), w - len(x)))
        assert sorted(got.get(rec, [])) == want


def test_layout_round_trip(spark):
    rows = [(r, t, float(t), -float(t)) for r in "ab" for t in range(37)]
    df = spark.createDataFrame(rows, "recording_id string, t long, p double, q double")
    back = layout.to_samples(layout.to_signals(df, 10, 25, channels=["p", "q"]))
    assert back.count() == 2 * 2 * 37
    assert back.filter((F.col("channel") == "q") & (F.col("v") != -F.col("t"))).count() == 0


def test_bad_frame_is_an_error(spark):
    df = spark.createDataFrame([("a", t, 1.0, "c") for t in range(9)], "recording_id string, t long, v double, channel string")
    with pytest.raises(PySparkException):
        windowing.windows(layout.to_signals(df, 5, 4), 8, 4).collect()


def test_patchify_rejects_a_remainder(spark):
    df = spark.createDataFrame([([1.0] * 10,)], "x array<double>")
    with pytest.raises(PySparkException):
        windowing.patchify(df, 4).collect()
    with pytest.raises(ValueError):
        windowing.patchify(df, 6, 2)


def test_segment_windows_never_cross_splits(spark):
    """Sample values are sample indices, so overlap between splits would show."""
    state = [(i // 130) % 6 for i in range(2000)]
    rows = [("r", t, float(t), v) for t, v in enumerate(state)]
    df = spark.createDataFrame(rows, "recording_id string, t long, v double, rep int").withColumn("channel", F.lit("emg"))
    segs = windowing.segments(df, ["rep"], block=256)
    split = F.when(F.col("rep").isin(1, 3), "train").when(F.col("rep") == 2, "val").when(F.col("rep") == 5, "test")
    cut = windowing.segment_windows(df, segs.withColumn("split", split).filter("split is not null").select("recording_id", "split", "start", "stop"), 40, 10)
    seen = {r.split: set(r.s) for r in cut.groupBy("split").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("s")).collect()}
    assert set(seen) == {"train", "val", "test"}
    assert not (seen["train"] & seen["val"] or seen["train"] & seen["test"] or seen["val"] & seen["test"])


def test_normalisations_on_constant_rows(spark):
    df = spark.createDataFrame([([3.0] * 4,)], "x array<double>")
    for fn in (lambda d: normalize.zscore(d, "add"), lambda d: normalize.zscore(d, "one"), lambda d: normalize.minmax(d, "zero")):
        assert fn(df).first().x == [0.0] * 4
    assert normalize.minmax(df, "floor").first().x == [-1.0] * 4
    zero = spark.createDataFrame([([0.0] * 4,)], "x array<double>")
    assert normalize.maxabs(zero, "one").first().x == [0.0] * 4


def test_crop_keeps_sleep_and_margin(spark):
    ann = [("r", float(t * 600), 600.0, "W" if t < 10 or t > 20 else "N2") for t in range(40)]
    df = spark.createDataFrame(ann, "recording_id string, onset double, duration double, code string")
    got = sorted(r.onset for r in windowing.crop_wake(df, 30).collect())
    assert got[0] == 10 * 600 - 1800 and got[-1] == 21 * 600 + 1200
