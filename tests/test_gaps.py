"""Windows hold the samples of their indices: late starts, gaps and whole missing frames."""

import pytest
from pyspark.sql import functions as F

from signalframe.operators import layout, windowing


def signal(spark, ts, wide=False):
    """Sample values are sample indices."""
    if wide:
        return spark.createDataFrame([("r", t, float(t), -float(t)) for t in ts], "recording_id string, t long, a double, b double")
    return spark.createDataFrame([("r", "c", t, float(t)) for t in ts], "recording_id string, channel string, t long, v double")


def without(n, *missing):
    return [t for t in range(n) if t not in missing]


def whole(rows):
    return all(r.x == [float(r.start + i) for i in range(len(r.x) - r.n_pad)] + [0.0] * r.n_pad for r in rows)


GAPS = [
    without(24, 0), without(24, 0, 1, 2), without(24, 7), without(24, 8), without(24, 9), without(24, 15), without(24, 16), without(24, 6, 7, 8),
    without(24, *range(8, 16)), without(40, *range(8, 24)), list(range(8, 24)), list(range(3, 16)), without(24, 12), [0, *range(16, 24)], [5], [-1, 0, 1],
]


@pytest.mark.parametrize("ts", GAPS, ids=lambda ts: f"{ts[0]}-{len(ts)}")
def test_a_gap_anywhere_is_an_error(spark, ts):
    for step in (2, 4):
        with pytest.raises(Exception, match="no sample between|missing or repeated|negative"):
            windowing.cut(signal(spark, ts), 4, step, "keep", frame=8).collect()


def test_a_repeated_index_is_an_error(spark):
    with pytest.raises(Exception, match="missing or repeated"):
        windowing.cut(signal(spark, [0, 1, 1, 2, 3]), 2, 2).collect()


def test_gap_at_the_default_frame(spark):
    with pytest.raises(Exception, match="no sample between|missing or repeated"):
        layout.to_signals(signal(spark, without(3000, *range(1024, 1034))), 1024).collect()
    assert layout.to_signals(signal(spark, range(2048)), 1024).count() == 2


@pytest.mark.parametrize("step,frame", [(2, 2), (2, 8), (4, 4), (4, 100), (1, 1), (5, 5)])
def test_edges_do_not_change_whole_recordings(spark, step, frame):
    df = None
    for n in (16, 17, 8, 3):
        one = signal(spark, range(n)).withColumn("recording_id", F.lit(f"r{n}"))
        df = one if df is None else df.unionByName(one)
    for tail in ("keep", "all"):
        plain = windowing.cut(df, 4, step, tail, frame=800).collect()
        got = windowing.cut(df, 4, step, tail, frame=frame).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and whole(got)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("first", [0, 3, 8, 21])
def test_windows_counted_from_the_first_sample(spark, first, wide):
    df = signal(spark, range(first, first + 13), wide)
    got = windowing.cut(df, 4, 2, "keep", channels=["a", "b"] if wide else None, frame=8, start="first")
    got = got.filter("channel in ('c', 'a')").orderBy("start").collect()
    assert [r.start for r in got] == [first + s for s in (0, 2, 4, 6, 8, 10)] and whole(got)


@pytest.mark.parametrize("block", [1, 5, 100])
def test_filled_gaps(spark, block):
    cases = {f"r{i}": ts for i, ts in enumerate(GAPS) if ts[0] >= 0}
    df = None
    for name, ts in cases.items():
        one = signal(spark, ts).withColumn("recording_id", F.lit(name))
        df = one if df is None else df.unionByName(one)
    got, inner = {}, {}
    for r in layout.fill_gaps(df, fill=-5.0, block=block).collect():
        got.setdefault(r.recording_id, []).append((r.t, r.v))
    for r in layout.fill_gaps(df, start=None, block=block).collect():
        inner.setdefault(r.recording_id, []).append(r.t)
    for name, ts in cases.items():
        assert sorted(got[name]) == [(t, float(t) if t in ts else -5.0) for t in range(max(ts) + 1)]
        assert sorted(inner[name]) == list(range(min(ts), max(ts) + 1))


def test_cut_fills(spark):
    ts = without(24, 0, 7, 8, *range(12, 20))
    got = windowing.cut(signal(spark, ts), 4, 4, "drop", frame=8, fill=-1.0).orderBy("start").collect()
    assert [r.x for r in got] == [[float(t) if t in ts else -1.0 for t in range(s, s + 4)] for s in range(0, 24, 4)]
    later = windowing.cut(signal(spark, [t for t in ts if t > 2]), 4, 4, "drop", frame=8, fill=-1.0, start="first").orderBy("start").collect()
    assert [(r.start, r.x) for r in later] == [(s, [float(t) if t in ts else -1.0 for t in range(s, s + 4)]) for s in range(3, 21, 4)]


@pytest.mark.parametrize("first", [0, 3, 1020, 1024, 1027, 2050])
def test_epochs_and_segments_of_a_late_start(spark, first):
    df = signal(spark, range(first, first + 1300))
    events = spark.createDataFrame([("r", first + k, 1) for k in (0, 1, 3, 500, 1022, 1297, 1299)], "recording_id string, event_t long, code int")
    got = {r.event_t - first: r.x for r in windowing.epochs(df, events, -1, 2, 1.0).collect()}
    assert got == {k: [float(first + k + i) for i in (-1, 0, 1, 2)] for k in (1, 3, 500, 1022, 1297)}
    segs = spark.createDataFrame([("r", first, first + 9), ("r", first + 1000, first + 1300)], "recording_id string, start long, stop long")
    got = sorted((r.start, r.x) for r in windowing.segment_windows(df, segs, 4, 3).collect())
    starts = [*range(first, first + 6, 3), *range(first + 1000, first + 1297, 3)]
    assert got == [(s, [float(s + i) for i in range(4)]) for s in starts]
    beyond = spark.createDataFrame([("r", first + 1290, first + 1310)], "recording_id string, start long, stop long")
    with pytest.raises(Exception, match="beyond"):
        windowing.segment_windows(df, beyond, 16, 1).collect()


@pytest.mark.parametrize("missing", [(1023,), (1024,), (1022, 1023, 1024), tuple(range(1000, 2100))])
def test_epochs_over_a_gap_are_an_error(spark, missing):
    df = signal(spark, without(3000, *missing))
    events = spark.createDataFrame([("r", k, 1) for k in (500, 1025, 2200)], "recording_id string, event_t long, code int")
    with pytest.raises(Exception, match="no sample between|missing or repeated"):
        windowing.epochs(df, events, -1, 2, 1.0).collect()


def test_rebase_keeps_channels_aligned(spark):
    df = signal(spark, range(5, 9), wide=True).unionByName(signal(spark, range(2), wide=True).withColumn("recording_id", F.lit("s")))
    got = sorted((r.recording_id, r.t, r.a) for r in layout.rebase(df).collect())
    assert got == [("r", t, float(t + 5)) for t in range(4)] + [("s", 0, 0.0), ("s", 1, 1.0)]
