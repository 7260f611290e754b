"""Channel selection, vocabulary, geometry and window constraints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import electrodes, tables
from .labels import literal_map


def filter_recordings(df: DataFrame, n_channels: int, min_len: int) -> DataFrame:
    """Add ``skip_reason`` (null = keep) from ``n_channels`` and ``n_samples``."""
    reason = (
        F.when(F.col("n_channels") != n_channels, "channels")
        .when(F.col("n_samples") < min_len, "short")
    )
    return df.withColumn("skip_reason", reason)


def skip_counts(df: DataFrame) -> DataFrame:
    """How many recordings each rule removed; kept ones count as ``valid``."""
    return df.groupBy(F.coalesce("skip_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def align_montage(channels: DataFrame, names: list[str], min_fraction: float = 1.0, keys=("recording_id",)) -> DataFrame:
    """Raw labels to template order.

    ``channels(keys, idx, raw_name, ...)``: the lowest ``idx`` wins when two
    labels share a canonical name. A recording missing more than
    ``(1 - min_fraction)`` of the template is dropped.
    """
    keys = list(keys)
    place = F.try_element_at(literal_map({n: i for i, n in enumerate(names)}), F.col("channel"))
    named = channels.withColumn("channel", electrodes.canonical_name(F.col("raw_name"))).withColumn("pos", place)
    first = W.partitionBy(*keys, "channel").orderBy("idx")
    one = named.filter(F.col("pos").isNotNull()).withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")
    need = len(names) - len(names) * (1.0 - min_fraction)
    whole = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= need).select(*keys)
    return one.join(whole, keys, "left_semi")


def require_channels(channels: DataFrame, names: list[str], fs: float, keys=("recording_id",)) -> DataFrame:
    """Violations only: required channels absent or duplicated, or a wrong rate."""
    keys = list(keys)
    wanted = F.array(*[F.lit(n) for n in names])
    hits = channels.groupBy(*keys, "fs").pivot("channel", names).agg(F.count(F.lit(1)))
    counts = hits.select(
        *keys, "fs",
        F.explode(F.arrays_zip(wanted.alias("name"), F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names]).alias("n"))).alias("__c"),
    ).select(*keys, "fs", F.col("__c.name").alias("channel"), F.col("__c.n").alias("n"))
    problem = F.when(F.col("fs") != fs, "rate").when(F.col("n") == 0, "absent").when(F.col("n") > 1, "duplicate")
    return counts.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def live_channels(samples: DataFrame, tol: float = 1e-12, path: str = "path") -> DataFrame:
    """Per file and channel: does it carry signal here, is it in the kept set?

    The kept set is the union of live channels over all files. Returns ``(path, channel, live, kept, flag)`` with flag ``flat``
    for a kept channel without signal and ``extra`` for a live one outside.
    """
    spread = samples.groupBy(path, "channel").agg((F.stddev_pop("v") > tol).alias("live"))
    kept = spread.filter("live").select("channel").distinct().withColumn("kept", F.lit(True))
    out = spread.join(kept, "channel", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    flag = F.when(F.col("kept") & ~F.col("live"), "flat").when(~F.col("kept") & F.col("live"), "extra").otherwise("ok")
    return out.withColumn("flag", flag)


def select_channels(df: DataFrame, drop=(), keep: int | None = None, index: str = "idx") -> DataFrame:
    """Drop channels by index, keep the first ``keep`` of the rest, renumber from 0."""
    gone = sorted(set(drop))
    out = df.filter(~F.col(index).isin(gone)) if gone else df
    below = sum((F.when(F.col(index) > g, 1).otherwise(0) for g in gone), F.lit(0))
    out = out.withColumn(index, (F.col(index) - below).cast("int"))
    return out if keep is None else out.filter(F.col(index) < keep)


def channel_id(df: DataFrame, col: str = "channel", out: str = "channel_id") -> DataFrame:
    ids = literal_map({n: i for i, n in enumerate(tables.CHANNEL_VOCABULARY)})
    return df.withColumn(out, F.coalesce(F.try_element_at(ids, F.col(col)), F.lit(tables.UNK_ID)))


def strict_channel_id(df: DataFrame, keys, col: str = "channel") -> DataFrame:
    """Ids with unknown or repeated names per key as an error."""
    ids = channel_id(df, col)
    bad = ids.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"), F.min("channel_id").alias("id")).filter(
        (F.col("n") > 1) | (F.col("id") == tables.UNK_ID)
    )
    found = bad.limit(10).collect()
    if found:
        raise ValueError(f"unknown or duplicate channels: {sorted({r[col] for r in found})}")
    return ids


def positions(df: DataFrame, col: str = "raw_name") -> DataFrame:
    """Template coordinates; unknown names sit at the origin with known=false."""
    pos = F.create_map(*[v for n, (x, y, z) in electrodes.POSITIONS.items() for v in (F.lit(n), F.array(F.lit(x), F.lit(y), F.lit(z)))])
    out = df.withColumn("channel", electrodes.canonical_name(F.col(col))).withColumn("__p", F.try_element_at(pos, F.col("channel")))
    at = lambda i: F.coalesce(F.get("__p", F.lit(i)), F.lit(0.0))
    return out.select(*df.columns, *([] if "channel" in df.columns else ["channel"]),
                      at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("__p").isNotNull().alias("known"))


def derivation_geometry(channels: DataFrame, electrodes_df: DataFrame) -> DataFrame:
    """Endpoints to unit-sphere midpoint and signed direction.

    ``channels(channel, positive, negative)``; a monopolar channel has equal
    endpoints and therefore direction zero.
    """
    def unit(df, prefix, key):
        r = F.greatest(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.lit(1e-8))
        return df.select(F.col("channel").alias(key), *[(F.col(a) / r).alias(prefix + a) for a in "xyz"])

    both = channels.join(unit(electrodes_df, "p", "positive"), "positive").join(unit(electrodes_df, "n", "negative"), "negative")
    mid = {a: 0.5 * (F.col("p" + a) + F.col("n" + a)) for a in "xyz"}
    r = F.greatest(F.sqrt(sum((mid[a] ** 2 for a in "xyz"), F.lit(0.0))), F.lit(1e-8))
    return both.select(
        *channels.columns,
        *[(mid[a] / r).alias("center_" + a) for a in "xyz"],
        *[(F.col("p" + a) - F.col("n" + a)).alias("direction_" + a) for a in "xyz"],
        (F.col("positive") != F.col("negative")).alias("bipolar"),
    )


def metadata_hash(df: DataFrame, keys, name: str = "name", value: str = "value") -> DataFrame:
    """Digest over sorted ``name=value`` pairs of each key (a handful per recording set-up)."""
    pair = F.concat_ws("=", name, value)
    return df.groupBy(*keys).agg(F.substring(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(pair))), 256), 1, 32).alias("metadata_hash"))


def spherical_basis(df: DataFrame) -> DataFrame:
    """``basis`` = [x, y, z, xy, xz, yz, x^2-y^2, 3z^2-1] of the projected position."""
    r = F.greatest(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.lit(1e-8))
    u = df.withColumn("__x", F.col("x") / r).withColumn("__y", F.col("y") / r).withColumn("__z", F.col("z") / r)
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    return u.withColumn("basis", F.array(x, y, z, x * y, x * z, y * z, x * x - y * y, 3.0 * z * z - 1.0)).drop("__x", "__y", "__z")


def fourier_features(df: DataFrame, bands: int = 8, scale: float = 2.0) -> DataFrame:
    """``features`` = [xyz, sin(2^k pi s xyz), cos(2^k pi s xyz)], axis-major."""
    axes = [F.col(a) for a in "xyz"]
    freq = [scale * 2.0**k * math.pi for k in range(bands)]
    sines = [F.sin(a * f) for a in axes for f in freq]
    cosines = [F.cos(a * f) for a in axes for f in freq]
    return df.withColumn("features", F.array(*axes, *sines, *cosines))


def validate_windows(windows: DataFrame) -> DataFrame:
    """Constraint flags per window; all false means valid, a null field is a violation.

    ``windows(window_id, modality, emg_region, sampling_rate, n_channels,
    n_names, n_xyz, n_mask)``.
    """
    flag = lambda bad: F.coalesce(bad, F.lit(True))
    return windows.select(
        "window_id",
        flag(~F.col("modality").isin(*tables.MODALITIES)).alias("bad_modality"),
        flag(F.col("n_names") != F.col("n_channels")).alias("bad_names"),
        flag(F.col("n_xyz") != F.col("n_channels")).alias("bad_xyz"),
        flag(F.col("n_mask") != F.col("n_channels")).alias("bad_mask"),
        flag(F.col("sampling_rate") <= 0).alias("bad_rate"),
        ((F.coalesce("modality", F.lit("")) == "semg") & flag(~F.col("emg_region").isin(*tables.EMG_REGIONS))).alias("bad_region"),
    )


def mixed_batches(windows: DataFrame, key: str) -> DataFrame:
    """Batch keys whose windows do not share one channel count."""
    return windows.groupBy(key).agg(F.min("n_channels").alias("lo"), F.max("n_channels").alias("hi")).filter("lo <> hi")


def uses_surface_laplacian() -> Column:
    """EEG with coordinates and no bipolar derivation."""
    return (F.col("modality") == "eeg") & F.col("has_coordinates") & ~F.lower("derivation_type").startswith("bipolar")


def non_limb(datasets: DataFrame) -> DataFrame:
    return datasets.filter((F.col("modality") == "semg") & ~F.col("emg_region").eqNullSafe(F.lit("limb")))


def assert_limb(datasets: DataFrame) -> None:
    bad = [r.dataset_id for r in non_limb(datasets).select("dataset_id").limit(20).collect()]
    if bad:
        raise ValueError(f"non-limb sEMG datasets: {sorted(bad)}")
