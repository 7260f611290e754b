"""Wavelet, filter, spatial and phase invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import dsp, electrodes
from signalframe.functions import wavelets as V
from signalframe.operators import augment, channels, filters, metrics, pairs, spatial, wavelet


@pytest.mark.parametrize("name", ["haar", "db2", "db4", "db6", "sym4", "sym5", "coif3"])
def test_orthogonal_taps(name):
    lo, hi = map(np.array, V.filters(name))
    assert np.isclose(lo.sum(), 2**0.5) and np.isclose((lo**2).sum(), 1.0) and np.isclose(hi.sum(), 0.0, atol=1e-9)
    for k in range(2, len(lo), 2):
        assert abs(lo[k:] @ lo[:-k]) < 1e-8


def test_db4_matches_published_taps():
    want = [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
            -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965]
    assert np.allclose(V.filters("db4")[0], want, atol=1e-10)


@pytest.mark.parametrize("mode", V.MODES)
@pytest.mark.parametrize("patch,level", [(32, 1), (64, 3), (128, 2)])
def test_dwt_is_critically_sampled_and_invertible(mode, patch, level):
    a = V.analysis_matrix(patch, "bior4.4", level, mode)
    assert a.shape == (patch, patch) and sum(V.band_lengths(patch, level)) == patch
    assert np.abs(V.synthesis_matrix(patch, "bior4.4", level, mode) @ a - np.eye(patch)).max() < 1e-9


def test_condition_numbers():
    cond = lambda w, j, m: np.linalg.cond(V.analysis_matrix(64, w, j, m))
    assert np.allclose([cond("bior4.4", j, "reflect") for j in (1, 2, 3)], [3.16, 10.73, 41.8], rtol=0.01)
    assert np.allclose([cond("bior4.4", j, "periodization") for j in (1, 2, 3)], [1.32, 1.41, 1.45], rtol=0.01)
    assert np.isclose(cond("db4", 3, "periodization"), 1.0)


def test_orthogonal_falls_back_to_periodization():
    assert V.resolve_mode("db4", "reflect") == "periodization" and V.resolve_mode("bior4.4", "reflect") == "reflect"
    with pytest.raises(ValueError):
        V.resolve_mode("db4", "mirror")


def test_long_filter_does_not_fit_the_kernel(spark):
    df = spark.createDataFrame([([0.0] * 32,)], "x array<double>")
    with pytest.raises(ValueError):
        wavelet.dwt_stack(df, 32, "coif3", 1, 16)


def test_dense_map_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(20, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    got = np.array([r.coeffs for r in wavelet.dwt(df, 64).orderBy("i").collect()])
    assert np.allclose(got, x @ V.analysis_matrix(64, "bior4.4", 3).T)


# -- filters ---------------------------------------------------------------------

def _samples(spark, x):
    rows = [("r", t, float(v)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, t long, v double").withColumn("channel", F.lit("c"))


def test_frames_equal_whole_signal(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=6000)) + 40
    cfg = filters.Preprocess(notch=20.0, bandpass=(5.0, 30.0), target_rate=64.0, normalise="none")
    whole = x[None]
    for f in cfg.filters(128.0):
        whole = f.zero_phase(whole)
    whole = dsp.resample_rows(whole, 1, 2, 0, 0, 3000)[0]
    got = filters.preprocess(_samples(spark, x), 128.0, cfg, frame=1024).orderBy("t").toPandas()
    assert list(got["t"]) == list(range(3000))
    assert np.abs(got["v"].to_numpy() - whole).max() < 1e-8


def test_chain_removes_offset_and_mains(spark):
    t = np.arange(2000) / 500
    x = np.sin(2 * np.pi * 10 * t) + 5 + 0.5 * np.sin(2 * np.pi * 50 * t)
    cfg = filters.Preprocess(notch=50.0, bandpass=(1.0, 40.0), target_rate=250.0, normalise="zscore")
    y = filters.preprocess(_samples(spark, x), 500.0, cfg).orderBy("t").toPandas()["v"].to_numpy()
    assert len(y) == 1000 and abs(y.mean()) < 1e-9 and abs(y.std() - 1) < 1e-9
    power, freq = np.abs(np.fft.rfft(y)), np.fft.rfftfreq(1000, 1 / 250)
    assert power[np.argmin(abs(freq - 50))] < 0.02 * power[np.argmin(abs(freq - 10))]


def test_invalid_steps_are_skipped():
    cfg = filters.Preprocess(notch=60.0, bandpass=(70.0, 200.0))
    assert cfg.filters(100.0) == []
    assert cfg.key() == filters.Preprocess(notch=60.0, bandpass=(70.0, 200.0)).key() != filters.Preprocess().key()


def test_resample_identity_and_sine():
    assert filters.Preprocess(target_rate=100.0).ratio(100.0) == (1, 1)
    t = np.arange(2048) / 2048
    y = dsp.resample_rows(np.sin(2 * np.pi * 12 * t)[None], *dsp.rates(2048, 256), 0, 0, 256)[0]
    assert np.abs(y - np.sin(2 * np.pi * 12 * np.arange(256) / 256))[20:-20].max() < 0.01


# -- spatial ----------------------------------------------------------------------

def _montage(spark, names, bad=(), derivation="monopolar", mid="m"):
    rows = [(mid, n, i, *map(float, electrodes.POSITIONS[n]), n not in bad, derivation) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "montage_id string, channel string, pos int, x double, y double, z double, good boolean, derivation_type string")


def _dense(op, n):
    m = np.zeros((n, n))
    for r in op.filter("w is not null").collect():
        m[r.out_ch, r.in_ch] = r.w
    return m


def test_template_lies_on_the_sphere():
    assert len(electrodes.POSITIONS) == 67
    assert all(abs(sum(v * v for v in p) - 1) < 1e-12 for p in electrodes.POSITIONS.values())
    assert electrodes.POSITIONS["T8"][0] > 0 > electrodes.POSITIONS["T7"][0]


def test_surface_laplacian_annihilates_constants(spark):
    names = electrodes.STANDARD_61
    op = spatial.surface_laplacian(_montage(spark, names, bad=("Cz", "P3")))
    assert spatial.reference_invariance(op).first().invariant
    m = _dense(op, len(names))
    assert not m[:, [names.index("Cz"), names.index("P3")]].any()


def test_surface_laplacian_skips(spark):
    few = _montage(spark, electrodes.STANDARD_19[:10])
    assert "usable electrodes" in spatial.surface_laplacian(few).first().skipped
    bip = _montage(spark, electrodes.STANDARD_19, derivation="bipolar_tcp")
    assert spatial.surface_laplacian(bip).first().skipped == "bipolar montage"


def test_interpolation_of_a_smooth_field(spark):
    names = electrodes.STANDARD_61
    xyz = np.array([electrodes.POSITIONS[n] for n in names])
    field = 0.5 * xyz[:, 0] + xyz[:, 1] * xyz[:, 2]
    m = _dense(spatial.interpolate_bad(_montage(spark, names, bad=("Cz",))), len(names))
    k = names.index("Cz")
    assert abs(m[k] @ field - field[k]) < 0.1
    assert np.allclose(np.delete(m @ field, k), np.delete(field, k))


def test_references(spark):
    names = ["Cz", "O1", "M1", "M2"]
    refs = spatial.reference_channels(_montage(spark, names), car_min=4)
    ops = spatial.reference_operator(refs)
    car = _dense(ops.filter("view = 'common_average'"), 4)
    assert np.allclose(car, np.eye(4) - 0.25)
    link = _dense(ops.filter("view = 'linked_mastoids'"), 4)
    assert np.allclose(link, np.eye(4) - np.array([0, 0, 0.5, 0.5]))
    skipped = {r.view: r.skipped for r in refs.collect()}
    assert skipped["left_ear"] and not skipped["left_mastoid"]
    tight = spatial.reference_channels(_montage(spark, names), car_min=32)
    assert "4 good channels < 32" in {r.skipped for r in tight.collect()}
    tiers = {r.view: r.tier for r in refs.collect()}
    assert tiers["common_average"] == "standard" and tiers["random_channel"] == "hard"


def test_view_probability_limits(spark):
    df = spark.range(300).withColumnRenamed("id", "window_id")
    assert spatial.sample_views(df, hard_prob=0.0).filter(F.col("view").isin(*spatial.HARD_VIEWS)).count() == 0
    assert spatial.sample_views(df, hard_prob=1.0).filter(F.col("view").isin(*spatial.STANDARD_VIEWS)).count() == 0


def _pair(spark, lag):
    rng = np.random.default_rng(2)
    n, fs = 2048, 256.0
    spec = np.fft.rfft(rng.normal(size=n + 64))
    freq = np.fft.rfftfreq(n + 64, 1 / fs)
    src = np.fft.irfft(np.where((freq >= 8) & (freq < 13), spec, 0), n + 64)
    src = src / src.std()
    shift = int(round(lag * fs))
    x = np.stack([src[32:32 + n], src[32 - shift:32 - shift + n]]) + 0.1 * rng.normal(size=(2, n))
    return spark.createDataFrame([("w", ["a", "b"], x.tolist())], "window_id string, channels array<string>, x array<array<double>>")


def _value(edges, band="alpha"):
    return edges.filter((F.col("band") == band) & (F.col("ch_i") != F.col("ch_j"))).first().value


def test_phase_lag_separates_volume_conduction(spark):
    zero, lagged = _pair(spark, 0.0), _pair(spark, 0.025)
    assert _value(pairs.wpli(zero, ["window_id"], 256.0)) < 0.1
    assert _value(pairs.wpli(lagged, ["window_id"], 256.0)) > 0.5
    assert _value(pairs.imag_coherence(zero, ["window_id"], 256.0)) < 0.1
    assert _value(pairs.coherence(zero, ["window_id"], 256.0)) > 0.9


def test_band_graphs_follow_the_band(spark):
    t = np.arange(1024) / 128
    x = np.random.default_rng(4).normal(size=(8, 1024)) * 0.2
    x[:4] += np.sin(2 * np.pi * 10 * t)
    x[4:] += np.sin(2 * np.pi * 25 * t)
    df = spark.createDataFrame([("w", [f"c{i}" for i in range(8)], x.tolist())], "window_id string, channels array<string>, x array<array<double>>")
    cov = pairs.channel_covariance(df, ["window_id"], 128.0, {"alpha": (8, 13), "beta": (13, 30)})
    v = {(r.band, r.ch_i, r.ch_j): r.value for r in cov.collect()}
    assert v["alpha", "c0", "c1"] > 0.8 and v["alpha", "c4", "c5"] < 0.5 and v["beta", "c4", "c5"] > 0.8


def test_shrinkage_improves_conditioning(spark):
    x = np.random.default_rng(5).normal(size=(6, 1)) @ np.ones((1, 6))
    x = (x @ np.random.default_rng(6).normal(size=(6, 8))).tolist()
    df = spark.createDataFrame([("w", [f"c{i}" for i in range(6)], x)], "window_id string, channels array<string>, x array<array<double>>")
    cond = lambda s: pairs.condition_number(pairs.channel_covariance(df, ["window_id"], shrinkage=s, coef=0.1)).first().condition_number
    assert cond("fixed") < cond("none") and cond("ledoit_wolf") < cond("none")


# -- corruption, metrics, names ------------------------------------------------------

def test_corruption_limits(spark):
    x = np.random.default_rng(7).normal(size=(30, 4, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "window_id int, x array<array<double>>")
    same = augment.corrupt(df, prob=-1.0).collect()
    assert all(r.kind == "none" and r.level == 0.0 and np.allclose(r.x, x[r.window_id]) for r in same)
    for kind in augment.KINDS:
        for r in augment.corrupt(df, prob=1.0, kinds=[kind]).collect():
            assert r.kind == kind and 0.0 <= r.level <= 1.0
            y = np.array(r.x)
            if kind == "noise" and r.level > 0.5:
                assert np.abs(y - x[r.window_id]).max() > 0.1
            if kind == "bad_channel":
                assert (np.abs(y).max(axis=1) < 0.01).sum() == round(4 * 0.5 * r.level)
            if kind == "dropout":
                assert (y == 0).all(axis=0).sum() == max(1, round(64 * 0.5 * r.level))


def test_kl_is_zero_on_equal_inputs(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5],)], "a array<double>").withColumn("b", F.col("a"))
    assert abs(metrics.symmetric_kl(df).first().symmetric_kl) < 1e-12


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 300), rng.integers(-20, 20, 300) / 3.0
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert np.isclose(metrics.auroc(df).first().auroc, ((diff > 0) + 0.5 * (diff == 0)).mean())


def test_names(spark):
    cases = {"EEG FP1-REF": "Fp1", "t3": "T7", " T6-LE": "P8", "cz": "Cz", "ch00": "ch00", "EEG X9-REF": "X9"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.c for r in df.withColumn("c", electrodes.canonical_name(F.col("raw"))).collect()}
    assert got == cases
    import zlib

    slots = {r.raw: r.s for r in df.withColumn("s", electrodes.name_slot(F.col("raw"))).collect()}
    assert slots["ch00"] == 68 + zlib.crc32(b"ch00") % (512 - 68) and 1 <= slots["cz"] <= 67


def test_channel_ids_and_strictness(spark):
    df = spark.createDataFrame([("r", "Fpz-Cz"), ("r", "Cz"), ("r", "nope")], "rec string, channel string")
    got = {r.channel: r.channel_id for r in channels.channel_id(df).collect()}
    assert got["Fpz-Cz"] == 2 and got["nope"] == 1 and got["Cz"] != got["Fpz-Cz"]
    with pytest.raises(ValueError):
        channels.strict_channel_id(df, ["rec"])
    with pytest.raises(ValueError):
        channels.strict_channel_id(df.filter("channel = 'Cz'").unionByName(df.filter("channel = 'Cz'")), ["rec"])


def test_swapping_endpoints_negates_direction(spark):
    el = electrodes.electrode_table(spark)
    ch = spark.createDataFrame([("a", "Fpz", "Cz"), ("b", "Cz", "Fpz"), ("c", "Cz", "Cz")], "channel string, positive string, negative string")
    g = {r.channel: r for r in channels.derivation_geometry(ch, el).collect()}
    assert np.isclose(g["a"].direction_y, -g["b"].direction_y) and np.isclose(g["a"].center_y, g["b"].center_y)
    assert not g["c"].bipolar and g["c"].direction_x == g["c"].direction_y == g["c"].direction_z == 0.0


def test_registry_gates(spark):
    from signalframe.functions import tables

    d = tables.datasets(spark)
    channels.assert_limb(d)
    with pytest.raises(ValueError):
        channels.assert_limb(d.withColumn("emg_region", F.lit("unknown")))
    ok = {r.dataset_id for r in d.filter(channels.uses_surface_laplacian()).collect()}
    assert "tueg" in ok and "ptbxl" not in ok


def _naive_zero_phase(sections, pad, x):
    """Sample-by-sample cascade, forward and backward, over the odd extension."""

    def once(v):
        for b, a in sections:
            # Steady state of this section for a constant input of v[0].
            gain = b.sum() / a.sum()
            s1 = b[2] - a[2] * gain
            s0 = b[1] - a[1] * gain + s1
            s0, s1 = s0 * v[0], s1 * v[0]
            out = np.empty_like(v)
            for i, u in enumerate(v):
                y = b[0] * u + s0
                s0, s1 = b[1] * u - a[1] * y + s1, b[2] * u - a[2] * y
                out[i] = y
            v = out
        return v

    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    return once(once(ext)[::-1])[::-1][pad:pad + len(x)]


@pytest.mark.parametrize("edges", [(1.0, 40.0), (None, 30.0)])
def test_block_filter_equals_sample_loop(edges):
    fs, (lo, hi) = 100.0, edges
    hi = min(hi, 40.0)
    x = np.cumsum(np.random.default_rng(9).normal(size=900)) + 7
    f = dsp.bandpass(fs, lo, hi) if lo else dsp.lowpass(fs, hi)
    sections = dsp._sections(*dsp.butter_zpk(4, lo / 50 if lo else None, hi / 50))
    assert np.abs(f.zero_phase(x[None])[0] - _naive_zero_phase(sections, f.pad, x)).max() < 1e-7


def test_butterworth_edges_are_half_power():
    z, p, g = dsp.butter_zpk(4, 0.1, 0.4)
    at = lambda w: abs(g * np.prod(np.exp(1j * np.pi * w) - z) / np.prod(np.exp(1j * np.pi * w) - p))
    assert np.allclose([at(0.1), at(0.4)], 0.5**0.5) and at(0.2) > 0.99 and at(0.01) < 1e-3


def _whole(x, fs, cfg):
    """The chain over one array: what block-wise filtering must give."""
    for f in cfg.filters(fs):
        x = f.zero_phase(x)
    up, down = cfg.ratio(fs)
    return x if (up, down) == (1, 1) else dsp.resample_rows(x, up, down, 0, 0, -(-x.shape[1] * up // down))


def test_blocks_keep_a_memory_longer_than_themselves():
    """0.1 Hz at 2048 Hz in blocks of 16 384: states carry what no halo could."""
    cfg = filters.Preprocess(notch=50.0, bandpass=(0.1, 40.0), normalise="none")
    steps, frame = cfg.filters(2048.0), 16384
    x = np.cumsum(np.random.default_rng(2).normal(size=(2, 5 * frame + 777)), axis=1) + 300
    cuts = [x[:, a:a + frame] for a in range(0, x.shape[1], frame)]
    n = dsp.width(steps)
    ends = lambda k: (k == 0, k == len(cuts) - 1)
    sent = np.stack([dsp.cascade(steps, b, np.zeros((2, n)), *ends(k))[1] for k, b in enumerate(cuts)])
    own = {k: dsp.response(steps, cuts[k].shape[1], *ends(k)) for k in (0, len(cuts) - 1)}
    states = dsp.incoming(steps, dsp.response(steps, frame, False, False), sent, own)
    got = np.concatenate([dsp.cascade(steps, b, states[k], *ends(k))[0] for k, b in enumerate(cuts)], axis=1)
    want = _whole(x, 2048.0, cfg)
    assert np.abs(got - want).max() < 1e-9 * np.abs(x).max()


def test_filtered_blocks_of_many_recordings(spark):
    """Recordings of one block, a short rest that joins the block before, and exact multiples."""
    rng = np.random.default_rng(3)
    lengths = {f"r{n}": n for n in (1, 2, 40, 127, 128, 129, 155, 156, 157, 300, 512, 1000)}
    x = {r: np.cumsum(rng.normal(size=(2, n)), axis=1) for r, n in lengths.items()}
    rows = [(r, t, float(v[0, t]), float(v[1, t])) for r, v in x.items() for t in range(v.shape[1])]
    df = spark.createDataFrame(rows, "recording_id string, t long, a double, b double")
    cfg = filters.Preprocess(notch=20.0, bandpass=(1.0, 30.0), target_rate=96.0, normalise="none")
    got = filters.preprocess(df, 128.0, cfg, frame=128, channels=["a", "b"]).toPandas()
    for r, v in x.items():
        want = _whole(v, 128.0, cfg)
        for k, c in enumerate("ab"):
            mine = got[(got.recording_id == r) & (got.channel == c)].sort_values("t")
            assert list(mine["t"]) == list(range(want.shape[1]))
            assert np.abs(mine["v"].to_numpy() - want[k]).max() < 1e-8


@pytest.mark.parametrize("fs,cfg", [
    (4.0, filters.Preprocess(target_rate=3.0, normalise="none")),
    (4.0, filters.Preprocess(target_rate=7.0, normalise="none")),
    (512.0, filters.Preprocess(notch=50.0, target_rate=64.0, normalise="none")),
])
def test_resampled_rest_shorter_than_the_reach(spark, fs, cfg):
    """A recording's last block may hold fewer samples than a resampler looks ahead."""
    frame, edge, reach = filters._layout(cfg, fs, 128)
    rng = np.random.default_rng(4)
    rests = sorted({0, 1, *range(edge, reach + 2, 1 if reach < 40 else 9)})
    x = {f"r{n}": np.cumsum(rng.normal(size=(4, n)), axis=1) for rest in rests for n in (frame + rest, 2 * frame + rest)}
    rows = [(r, t, *v[:, t].tolist()) for r, v in x.items() for t in range(v.shape[1])]
    df = spark.createDataFrame(rows, "recording_id string, t long, a double, b double, c double, d double")
    got = filters.preprocess(df, fs, cfg, frame=128, channels=["a", "b", "c", "d"]).toPandas()
    parts = {k: g.sort_values("t") for k, g in got.groupby(["recording_id", "channel"])}
    for r, v in x.items():
        for c, want in zip("abcd", _whole(v, fs, cfg)):
            assert list(parts[r, c]["t"]) == list(range(len(want)))
            assert np.abs(parts[r, c]["v"].to_numpy() - want).max() < 1e-8


def test_samples_are_shuffled_once(spark):
    """Only states, edges and moments meet the blocks: the arrays themselves do not move again."""
    import re

    df = spark.createDataFrame([("r", t, 1.0 * t, 2.0) for t in range(50)], "recording_id string, t long, a double, b double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cfg = filters.Preprocess(notch=20.0, bandpass=(1.0, 30.0), target_rate=96.0, normalise="zscore")
        done = filters.preprocess(df, 128.0, cfg, channels=["a", "b"])
        plan = spark._jvm.PythonSQLUtils.explainString(done._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    names = [{re.sub(r"#\d+L?", "", c) for c in line.split(", ")} for line in moved]
    assert any({"sent", "response"} <= n for n in names) and any("states" in n for n in names)
    assert not any(n & {"x", "samples", "own"} for n in names)


@pytest.mark.parametrize("limit", [0, 64])
def test_one_null_rule_for_linear_maps(spark, monkeypatch, limit):
    from signalframe.functions import linear

    monkeypatch.setattr(linear, "UNROLL_LIMIT", limit)
    inf, nan = float("inf"), float("nan")
    rows = [[1.0, None, 3.0], [1.0, 2.0, 3.0], [None, nan, 0.0], [inf, 1.0, 1.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>")
    m = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 2], [0, 0, 0]])
    got = [list(r.y) for r in df.select("i", linear.apply_matrix(F.col("x"), m).alias("y")).orderBy("i").collect()]
    same = lambda a, b: a == b or (a is not None and b is not None and np.isnan(a) and np.isnan(b))
    want = [[1.0, None, 3.0, 7.0, 0.0], [1.0, 2.0, 3.0, 7.0, 0.0], [None, nan, 0.0, None, 0.0], [inf, 1.0, 1.0, inf, 0.0]]
    assert all(same(a, b) for g, w in zip(got, want) for a, b in zip(g, w))
    with pytest.raises(Exception, match="array length"):
        spark.createDataFrame([([1.0],)], "x array<double>").select(linear.apply_matrix(F.col("x"), m)).collect()


def test_filters_take_bounded_pieces_of_a_batch():
    """However many recordings a batch holds, few numbers are worked on at once, each row once."""
    import pyarrow as pa

    sizes = [1200] * 2000 + [800] * 500
    x = pa.array([np.full(n, float(i)) for i, n in enumerate(sizes)]).slice(3)
    seen = []
    for at, rows, places, (last,) in filters._alike(x, 4, [i % 2 for i in range(len(x))]):
        assert rows.size <= filters._NUMBERS and rows.shape[0] == 4 * len(at)
        assert (rows[::4, 0] == at + 3).all() and (x.values.to_numpy()[places[:, 0]] == at + 3).all()
        assert (at % 2 == last).all()
        seen += at.tolist()
    assert sorted(seen) == list(range(len(x)))


def test_windows_of_one_montage_are_dealt_to_many_groups(spark):
    """A montage that all windows share must not bring them into one task."""
    from signalframe.operators import spatial

    montage = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "montage_id int, pos int, channel string")
    geo = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 0.5), (1, 1, 0, 0.5), (1, 1, 1, 1.0)], "montage_id int, ch_i int, ch_j int, value double")
    windows = spark.range(300).selectExpr("id recording_id", "0 start", "1 montage_id")
    dyn = windows.selectExpr("recording_id", "start", "explode(array(struct('a' ch_i, 'a' ch_j, 1.0D value), struct('a' ch_i, 'b' ch_j, 0.25D value), struct('b' ch_i, 'b' ch_j, 2.0D value))) e").select("recording_id", "start", "e.*")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = spatial.total_affinity(geo, dyn, montage, windows, 0.5, 2.0, ("recording_id", "start"))
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        rows = {(r.recording_id, r.ch_i, r.ch_j): r.value for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    import re

    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert any("__share" in d for d in dealt) and not any("montage_id" in d and "__share" not in d for d in dealt)
    assert rows == {(k, *e): v for k in range(300) for e, v in {(0, 0): 2.5, (0, 1): 0.75, (1, 0): 0.75, (1, 1): 4.5}.items()}
