"""Cases where block length, gaps, special numbers or nulls must not change a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import channels, order, pairs, rank, splits, windowing

INF = float("inf")


@pytest.mark.parametrize("block", [1, 2, 4, 5, 100])
def test_segments_and_previous_do_not_depend_on_blocks(spark, block):
    gaps = [(), (4,), (3, 4), (5,), (0, 1), (3, 4, 5, 6, 7, 8)]
    rows = [(f"r{n}", t, "a" if t < 9 else "b") for n, gap in enumerate(gaps) for t in range(12) if t not in gap]
    df = spark.createDataFrame(rows, "recording_id string, t long, s string")
    got = sorted((r.recording_id, r.segment, r.start, r.stop, r.s) for r in windowing.segments(df, ["s"], block=block).collect())
    first = {n: min(t for r, t, _ in rows if r == n) for n, _, _ in rows}
    assert got == [x for n, t in sorted(first.items()) for x in ((n, 0, t, 9, "a"), (n, 1, 9, 12, "b"))]
    before = {(r.recording_id, r.t): r.p for r in order.previous(df.withColumn("v", F.col("t")), ["recording_id"], "t", {"p": "v"}, block).collect()}
    for n in first:
        ts = [t for r, t, _ in rows if r == n]
        assert [before[n, t] for t in ts] == [None, *ts[:-1]]


def test_buckets_follow_the_order_and_spread(spark):
    rng = np.random.default_rng(1)
    values = sorted([-INF, *(-(10 ** rng.uniform(-9, 300, 300))), -0.0, 0.0, *(10 ** rng.uniform(-9, 300, 300)), 2.0**52, 2.0**52 + 1, INF]) + [float("nan")]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    b = [r.b for r in df.select("i", order.monotone_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert b == sorted(b) and b[0] < b[1] and b[-3] < b[-2] < b[-1]
    many = spark.range(20000).select((1e5 + F.rand(1) * 1e10).alias("v"))
    top = many.groupBy(order.monotone_bucket(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert top < 0.03 * 20000


def test_numbers_that_are_none_come_last(spark):
    df = spark.createDataFrame([("a", "0.7"), ("b", "nan"), ("c", "0.9"), ("d", "oops"), ("e", "inf"), ("f", "-inf")], "id string, m string")
    assert [r.id for r in rank.rank_runs(df, "m").collect()][:4] == ["e", "c", "a", "f"]
    place = {r.id: r.place for r in rank.place_runs(df, "m", "id").collect()}
    assert place == {"e": 1, "c": 2, "a": 3, "f": 4, "b": 5, "d": 6}


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1, 0.5, 1.0), (2, 0.6, 2.0), (3, 0.9, INF)], [1, 2, 3]),
        ([(1, 0.5, 1.0), (2, 0.6, 2.0), (4, float("nan"), 0.5)], [1, 2]),
        ([(1, 0.5, 1e12), (2, 0.6, 1e5), (3, 0.7, 1e12)], [2, 3]),
        ([(1, -INF, 1.0), (2, -INF, 2.0)], [1]),
    ],
)
def test_pareto_front_with_special_numbers(spark, rows, want):
    df = spark.createDataFrame(rows, "id long, p double, c double")
    assert sorted(r.id for r in rank.pareto_front(df, "p", "c").collect()) == want


def test_unknown_is_no_pass(spark):
    df = spark.createDataFrame([("x", "semg", None), ("y", "semg", "limb")], "dataset_id string, modality string, emg_region string")
    assert [r.dataset_id for r in channels.non_limb(df).collect()] == ["x"]
    w = spark.createDataFrame([("w", "eeg", None, None, 2, None, 2, 2)], "window_id string, modality string, emg_region string, sampling_rate double, n_channels int, n_names int, n_xyz int, n_mask int")
    r = channels.validate_windows(w).first()
    assert r.bad_rate and r.bad_names and not (r.bad_xyz or r.bad_mask or r.bad_modality or r.bad_region)
    folds = spark.createDataFrame([(1,), (9,), (10,), (None,)], "f int")
    assert [r.split for r in splits.fold_split(folds, "f").collect()] == ["train", "val", "test", None]


def test_pair_statistics_stay_small(monkeypatch):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(2, 9, 40)) + 1j * rng.normal(size=(2, 9, 40))
    whole = [pairs._phase_lag_index(z, 0.1, True), pairs._imaginary_part(z, 0.1), pairs._coherence_of(z)]
    monkeypatch.setattr(pairs, "_AT_ONCE", 100)
    parts = [pairs._phase_lag_index(z, 0.1, True), pairs._imaginary_part(z, 0.1), pairs._coherence_of(z)]
    for a, b in zip(whole, parts):
        assert np.allclose(a, b)
    cross = np.abs((z[0, 1] * z[0, 4].conj()).mean()) / np.sqrt((np.abs(z[0, 1]) ** 2).mean() * (np.abs(z[0, 4]) ** 2).mean())
    assert whole[2][0, 1, 4] == pytest.approx(cross)


def test_packing_follows_the_montage(spark):
    from signalframe.operators import layout, spatial

    rows = [(1, "Fp1", 0, [1.0, 2.0]), (1, "Cz", 1, [3.0, 4.0]), (1, "Az", 2, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "window_id int, channel string, pos int, x array<double>")
    packed = layout.pack_channels(df, ["window_id"], order="pos")
    assert packed.first().channels == ["Fp1", "Cz", "Az"]
    # Output 2 has no entry: it is zero, not absent.
    op = spark.createDataFrame([(7, 0, 0, 1.0), (7, 0, 1, -1.0), (7, 1, 2, 2.0)], "operator_id int, out_ch int, in_ch int, w double")
    out = spatial.apply_operator(packed.withColumn("operator_id", F.lit(7)), op).first().x
    assert [list(r) for r in out] == [[-2.0, -2.0], [10.0, 12.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="0..C-1"):
        layout.pack_channels(df.filter("pos <> 1"), ["window_id"], order="pos").collect()


def test_missing_samples_are_reported(spark):
    from signalframe.operators import layout

    df = spark.createDataFrame([("r", "c", t, float(t)) for t in (0, 1, 2, 4)], "recording_id string, channel string, t long, v double")
    with pytest.raises(Exception, match="missing or repeated"):
        layout.to_signals(df, 8).collect()


def test_derivation_is_part_of_the_montage(spark):
    from signalframe.operators import spatial

    rows = [(m, f"c{i}", i, float(i), 1.0, 0.5, True, d) for m, d in (("a", "monopolar"), ("b", "bipolar_tcp")) for i in range(4)]
    df = spark.createDataFrame(rows, "montage_id string, channel string, pos int, x double, y double, z double, good boolean, derivation_type string")
    assert spatial.montage_hash(df).select("montage_hash").distinct().count() == 2


def test_rewriting_windows_leaves_their_number(spark, tmp_path):
    from signalframe.sources import manifest, windows

    rows = [(d, s, "r", i) for d in ("a", "b") for s in ("train", "val") for i in range(3)]
    df = spark.createDataFrame(rows, "dataset_id string, split string, recording_id string, start long")
    path = str(tmp_path / "w")
    for _ in range(2):
        windows.write_windows(df, path, splits=("train", "val"))
    windows.write_windows(df.filter("dataset_id = 'a'"), path)
    assert spark.read.parquet(path).count() == len(rows)
    with pytest.raises(ValueError, match="test"):
        windows.write_windows(df, path, splits=("train", "test"))
    entries = spark.createDataFrame([], manifest.SCHEMA)
    manifest.write_manifest(entries, str(tmp_path / "m"))
    assert manifest.read_manifest(spark, str(tmp_path / "m")).count() == 0
    spark.createDataFrame([(manifest.VERSION, 5)], "version int, count long").write.mode("overwrite").json(str(tmp_path / "m/header"))
    with pytest.raises(ValueError, match="5"):
        manifest.read_manifest(spark, str(tmp_path / "m"))
