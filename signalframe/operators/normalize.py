"""Normalisation: statistic, zero-spread convention and scope are all explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A

EPS = 1e-8


def zscore(df: DataFrame, eps_mode: str = "add") -> DataFrame:
    """Per-row z-score. Zero-spread conventions:

    ``add`` sd + 1e-8, ``floor`` max(sd, 1e-8), ``one`` sd 0 becomes 1,
    ``sample`` sample sd + 1e-12.
    """
    return df.withColumn("x", _zscored(F.col("x"), eps_mode))


def zscore_rows(df: DataFrame, eps_mode: str = "add") -> DataFrame:
    """``zscore`` of every channel of channel-major windows ``x[C][T]``."""
    return df.withColumn("x", F.transform("x", lambda row: _zscored(row, eps_mode)))


def _zscored(x: Column, eps_mode: str) -> Column:
    sd = _guard(A.spread(x, 1 if eps_mode == "sample" else 0), eps_mode)
    stats = F.struct(A.mean(x).alias("m"), sd.alias("s"))
    return A.let(stats, lambda p: F.transform(x, lambda v: (v - p["m"]) / p["s"]))


def minmax(df: DataFrame, eps_mode: str = "zero") -> DataFrame:
    """Scale to [-1, 1]. ``zero``: a constant row becomes 0; ``floor``: range at least 1e-8."""
    if eps_mode not in ("zero", "floor"):
        raise ValueError(f"unknown eps_mode {eps_mode!r}")
    x = F.col("x")
    stats = F.struct(F.array_min(x).alias("lo"), (F.array_max(x) - F.array_min(x)).alias("r"))

    def scaled(p):
        if eps_mode == "floor":
            return F.transform(x, lambda v: 2.0 * (v - p["lo"]) / F.greatest(p["r"], F.lit(EPS)) - 1.0)
        return F.transform(x, lambda v: F.when(p["r"] == 0, 0.0).otherwise(2.0 * (v - p["lo"]) / F.nullif(p["r"], F.lit(0.0)) - 1.0))

    return df.withColumn("x", A.let(stats, scaled))


def maxabs(df: DataFrame, eps_mode: str = "one") -> DataFrame:
    """Divide by the largest magnitude. ``one``: zero peak becomes 1; ``floor``: at least 1e-8."""
    peak = F.array_max(F.transform("x", F.abs))
    guarded = {
        "one": F.when(peak == 0, F.lit(1.0)).otherwise(peak),
        "floor": F.greatest(peak, F.lit(EPS)),
    }[eps_mode]
    return df.withColumn("x", A.let(guarded, lambda p: F.transform("x", lambda v: v / p)))


def scale(df: DataFrame, k: float) -> DataFrame:
    return df.withColumn("x", F.transform("x", lambda v: v * F.lit(float(k))))


def clip(df: DataFrame, s: float) -> DataFrame:
    return df.withColumn("x", F.transform("x", lambda v: F.greatest(F.least(v, F.lit(float(s))), F.lit(-float(s)))))


def with_scope(signals: DataFrame, keys, by_channel: bool = False) -> DataFrame:
    """Framed arrays with ``scope: struct<n, mean, m2, lo, hi>`` over all frames of (keys, channel).

    Count, mean, squares about the mean, least and greatest value of every frame are
    merged per key; only these numbers are shuffled. They come back to their frames
    by (keys, t0), on which framed arrays are partitioned already
    (``by_channel`` for arrays from long samples, which have the channel there too),
    so the arrays stay where they are. Halo samples do not count.
    """
    keys, row = list(keys), [*keys, "t0"]
    own = F.slice("x", 1, F.col("frame")) if "frame" in signals.columns else F.col("x")
    narrow = signals.select(*row, "channel", A.moments(own).alias("__f"))
    every = W.partitionBy(*keys, "channel")
    n = F.sum("__f.n").over(every)
    mean = F.sum(F.col("__f.n") * F.col("__f.mean")).over(every) / n
    narrow = narrow.select("*", n.alias("n"), mean.alias("mean"), F.min("__f.lo").over(every).alias("lo"), F.max("__f.hi").over(every).alias("hi"))
    apart = F.col("__f.mean") - F.col("mean")
    narrow = narrow.withColumn("m2", F.sum(F.col("__f.m2") + F.col("__f.n") * apart * apart).over(every))
    scope = F.struct("n", "mean", "m2", "lo", "hi")
    if by_channel:
        return signals.join(narrow.select(*row, "channel", scope.alias("scope")), [*row, "channel"])
    each = narrow.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("channel", scope.alias("scope")))).alias("__s"))
    return signals.join(each, row).withColumn("scope", F.col("__s")[F.col("channel")]).drop("__s")


def scoped_zscore(signals: DataFrame, keys=("recording_id",), eps_mode: str = "floor", by_channel: bool = False) -> DataFrame:
    """Z-score of framed arrays at any scope (recording, run, session, ...) and per channel."""
    out = with_scope(signals, keys, by_channel)
    n = F.col("scope.n") - (1.0 if eps_mode == "sample" else 0.0)
    sd = _guard(F.sqrt(F.col("scope.m2") / F.nullif(n, F.lit(0.0))), eps_mode)
    stats = F.struct(F.col("scope.mean").alias("m"), sd.alias("s"))
    return out.withColumn("x", A.let(stats, lambda p: F.transform("x", lambda v: (v - p["m"]) / p["s"]))).drop("scope")


def scoped_normalise(signals: DataFrame, keys, mode: str, clip_sigma: float | None = None, by_channel: bool = False) -> DataFrame:
    """The normalise step of the preprocessing chain over whole recordings (floored denominators)."""
    if mode == "none":
        return signals
    if mode == "zscore":
        out = scoped_zscore(signals, keys, "floor", by_channel)
    elif mode in ("minmax", "maxabs"):
        lo, hi = F.col("scope.lo"), F.col("scope.hi")
        if mode == "minmax":
            p = F.struct(lo.alias("m"), F.greatest(hi - lo, F.lit(EPS)).alias("s"))
            change = lambda p: F.transform("x", lambda v: 2.0 * (v - p["m"]) / p["s"] - 1.0)
        else:
            p = F.greatest(F.abs(lo), F.abs(hi), F.lit(EPS))
            change = lambda p: F.transform("x", lambda v: v / p)
        out = with_scope(signals, keys, by_channel).withColumn("x", A.let(p, change)).drop("scope")
    else:
        raise ValueError(f"unknown normalisation {mode!r}")
    return clip(out, clip_sigma) if clip_sigma else out


def normalise(df: DataFrame, mode: str, clip_sigma: float | None = None) -> DataFrame:
    """The normalise step of the preprocessing chain (floored denominators)."""
    step = {
        "none": lambda d: d,
        "zscore": lambda d: zscore(d, "floor"),
        "minmax": lambda d: minmax(d, "floor"),
        "maxabs": lambda d: maxabs(d, "floor"),
    }
    if mode not in step:
        raise ValueError(f"unknown normalisation {mode!r}")
    out = step[mode](df)
    return clip(out, clip_sigma) if clip_sigma and mode != "none" else out


def _guard(sd: Column, eps_mode: str) -> Column:
    rules = {
        "add": sd + EPS,
        "floor": F.greatest(sd, F.lit(EPS)),
        "one": F.when(sd == 0, F.lit(1.0)).otherwise(sd),
        "sample": sd + 1e-12,
    }
    if eps_mode not in rules:
        raise ValueError(f"unknown eps_mode {eps_mode!r}")
    return rules[eps_mode]
