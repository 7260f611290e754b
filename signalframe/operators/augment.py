"""Augmentation and corruption of known severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H

KINDS = ("noise", "drift", "saturation", "bad_channel", "dropout")


def augment(df: DataFrame, seed=0, keys=("window_id",), prob: float = 0.5, noise_std: float = 0.01,
            scale_range=(0.8, 1.2), noise_keys=None) -> DataFrame:
    """With probability ``prob``: add Gaussian noise, then scale the amplitude.

    ``noise_keys`` (default ``keys``) separates the noise of a window's channels.
    """
    keys = list(keys)
    per_row = list(noise_keys or keys)
    on = H.uniform(f"{seed}:on", *keys) <= prob
    lo, hi = scale_range
    gain = lo + (hi - lo) * H.uniform(f"{seed}:scale", *keys)
    draws = H.normals(f"{seed}:noise", *per_row, count=F.size("x"))
    noisy = F.zip_with("x", draws, lambda v, z: v + noise_std * z) if noise_std > 0 else F.col("x")
    changed = A.let(gain, lambda g: F.transform(noisy, lambda v: v * g))
    return df.withColumn("x", F.when(on, changed).otherwise(F.col("x")))


def time_stretch(df: DataFrame, factor) -> DataFrame:
    """Linear interpolation to ``int(T * factor)`` samples (pixel centres), then a
    centre crop or right padding back to T."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    x, size = F.col("x"), F.size("x")

    def stretched(n):
        def at(i):
            p = F.greatest((i + 0.5) * size / n - 0.5, F.lit(0.0))
            lo = F.least(F.floor(p).cast("int"), size - 1)
            hi = F.least(lo + 1, size - 1)
            w = p - F.floor(p)
            return F.get(x, lo) * (1.0 - w) + F.get(x, hi) * w

        start = F.floor(F.greatest(n - size, F.lit(0)) / 2).cast("int")
        return A.pad_to(F.slice(F.transform(F.sequence(F.lit(0), n - 1), at), start + 1, size), size)

    return df.withColumn("x", A.let(F.floor(size * f).cast("int"), stretched))


def random_time_stretch(df: DataFrame, seed=0, keys=("window_id",), stretch_range=(0.8, 1.2)) -> DataFrame:
    lo, hi = stretch_range
    return time_stretch(df, lo + (hi - lo) * H.uniform(f"{seed}:stretch", *keys))


def corrupt(packed: DataFrame, seed=0, keys=("window_id",), prob: float = 0.5, kinds=KINDS, max_level: float = 1.0,
            snr_db=(20.0, -5.0), drift_amp=(0.1, 3.0), quantile=(0.999, 0.5), bad_fraction=(0.0, 0.5), drop_fraction=(0.0, 0.5)) -> DataFrame:
    """One corruption per window of known severity.

    ``packed(keys, x ARRAY<ARRAY<DOUBLE>>)`` is channel-major; adds ``kind`` and
    ``level`` (0 = untouched). All draws are hashes of (seed, key[, channel, sample]).
    """
    keys = list(keys)
    kinds = list(kinds)
    u = lambda tag, *more: H.uniform(f"{seed}:{tag}", *keys, *more)
    picked = F.element_at(F.array(*[F.lit(k) for k in kinds]), H.choice(u("kind"), len(kinds)) + 1)
    out = packed.withColumn("kind", F.when(u("on") > prob, "none").otherwise(picked))
    out = out.withColumn("level", F.when(F.col("kind") == "none", 0.0).otherwise(u("level") * max_level))
    level = F.col("level")
    mix = lambda r: r[0] + (r[1] - r[0]) * level
    flat = F.flatten("x")
    n_t, n_c = F.size(F.get("x", F.lit(0))), F.size("x")
    noise = lambda tag, c: H.normals(f"{seed}:{tag}", *keys, c, count=n_t)

    power = F.greatest(A.mean(F.transform(flat, lambda v: v * v)), F.lit(1e-12))
    drop_n = F.greatest(F.lit(1), F.bround(n_t * mix(drop_fraction))).cast("int")
    free = F.greatest(n_t - drop_n, F.lit(1))
    kind = F.col("kind")
    params = F.struct(
        F.when(kind == "noise", F.sqrt(power / F.pow(F.lit(10.0), mix(snr_db) / 10.0))).alias("sigma"),
        F.when(kind == "drift", mix(drift_amp) * F.greatest(A.spread(flat, 1), F.lit(1e-6))).alias("amp"),
        F.when(kind == "saturation", A.quantile(F.transform(flat, F.abs), F.greatest(F.least(mix(quantile), F.lit(0.9999)), F.lit(0.01)))).alias("thr"),
        F.when(kind == "bad_channel", _chosen(keys, seed, n_c, F.bround(n_c * mix(bad_fraction)).cast("int"))).alias("bad"),
        drop_n.alias("n"),
        H.choice(u("start"), free).alias("start"),
    )
    two_pi = 6.283

    def rows(per_sample):
        return F.transform("x", lambda row, c: F.transform(row, lambda v, t: per_sample(v, t, c)))

    def drifted(p):
        def row(r, c):
            wave = F.struct((u("phase", c) * two_pi).alias("phase"), (0.5 + 2.0 * u("freq", c)).alias("freq"))
            step = 1.0 / F.greatest(n_t - 1, F.lit(1))
            return A.let(wave, lambda w: F.transform(r, lambda v, t: v + p["amp"] * F.sin(two_pi * w["freq"] * t * step + w["phase"])))

        return F.transform("x", row)

    def changed(p):
        inside = lambda t: (t >= p["start"]) & (t < p["start"] + p["n"])
        return (
            F.when(kind == "noise", F.transform("x", lambda row, c: F.zip_with(row, noise("noise", c), lambda v, z: v + z * p["sigma"])))
            .when(kind == "drift", drifted(p))
            .when(kind == "saturation", rows(lambda v, t, c: F.greatest(F.least(v, p["thr"]), -p["thr"])))
            .when(kind == "bad_channel", F.transform("x", lambda row, c: F.when(F.array_contains(p["bad"], c), F.transform(noise("bad", c), lambda z: z * 1e-3)).otherwise(row)))
            .when(kind == "dropout", rows(lambda v, t, c: F.when(inside(t), 0.0).otherwise(v)))
            .otherwise(F.col("x"))
        )

    return out.withColumn("x", A.let(params, changed))


def _chosen(keys, seed, n_channels, n_bad):
    """Indices of the ``n_bad`` channels with the smallest hash."""
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), n_channels - 1), lambda c: F.struct(H.digest(f"{seed}:bad", *keys, c).alias("d"), c.alias("c"))))
    return F.transform(F.slice(ranked, 1, F.greatest(n_bad, F.lit(0))), lambda s: s["c"])


def reliability_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.greatest(F.least(1.0 - F.col("level"), F.lit(1.0)), F.lit(0.0)))
