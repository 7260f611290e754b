"""Long samples <-> channel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_signals(
    samples: DataFrame,
    frame: int,
    halo: int = 0,
    keys=("recording_id",),
    channels=None,
) -> DataFrame:
    """Samples to framed channel arrays ``(keys, channel, t0, x, frame, halo)``.

    Frame ``k`` holds samples ``k*frame .. (k+1)*frame + halo - 1``. Arrays are
    therefore bounded whatever the recording's length, and a window that starts
    inside a frame and is at most ``halo`` longer than the step needs no other
    row. ``channels`` names the value columns of a wide table; without it the
    table is long with columns ``channel`` and ``v``.

    A recording must start at 0 and lack no index (``frames``); ``rebase`` moves a
    later start to 0, ``fill_gaps`` puts samples where some are missing.
    """
    group, values, packed = frames(samples, frame, halo, keys, channels)
    meta = [F.lit(frame).alias("frame"), F.lit(halo).alias("halo")]
    if channels is None:
        return packed.select(*group, "t0", *meta, _field("samples", "v").alias("x"))
    return packed.select(*group, "t0", *meta, F.explode(channel_rows("samples", values)).alias("__c")).select(
        *group, "__c.channel", "t0", "frame", "halo", "__c.x"
    )


def frames(samples: DataFrame, frame: int, halo: int, keys, channels=None, start: str = "zero"):
    """Samples packed per ``(keys, t0)`` as ``samples ARRAY<STRUCT<t, values>>``.

    Returns the grouping columns, the value columns and the table, which is hash
    partitioned on the grouping columns and ``t0``, the index at which a frame begins:
    what joins it on exactly these columns does not move the arrays.

    Arrays have no place for gaps, so an index that is negative, missing or
    repeated is an error, wherever it falls: the last sample of a frame is also
    sent to the next one, which thus sees whether the two touch and whether whole
    frames are absent. ``start="zero"`` demands that a recording begins at index 0;
    ``start="first"`` lets it begin anywhere (one narrow aggregate finds where), and
    the first frame's array then begins at the first sample.
    """
    group = list(keys) + (["channel"] if channels is None else [])
    values = ["v"] if channels is None else list(channels)
    t = F.when(F.col("t") >= 0, F.col("t")).otherwise(F.raise_error(F.lit("a sample's index is null or negative")).cast("long"))
    first = F.greatest(F.floor((t - halo) / frame).cast("long"), F.lit(0).cast("long"))
    last = F.floor((F.col("t") + 1) / frame).cast("long")
    framed = samples.select(*group, "t", *values, F.explode(F.sequence(first * frame, last * frame, F.lit(frame).cast("long"))).alias("t0"))
    packed = framed.groupBy(*group, "t0").agg(
        F.sort_array(F.collect_list(F.struct("t", *values))).alias("samples")
    )
    begin = F.col("t0")
    low, high = F.get("samples", F.lit(0))["t"], F.get("samples", F.size("samples") - 1)["t"]
    packed = packed.filter(high >= begin)
    if start == "first":
        # Only the frames that hold a recording's first sample need to know of it; joining
        # on the frame as well leaves the arrays where they are.
        near = F.sequence(F.greatest(F.floor((F.col("first") - halo) / frame).cast("long"), F.lit(0).cast("long")), F.floor(F.col("first") / frame).cast("long"))
        begins = origins(samples, group).withColumn("t0", F.explode(F.transform(near, lambda k: k * frame)))
        packed = packed.join(begins, [*group, "t0"], "left")
        expected = F.coalesce(F.greatest(begin - 1, F.col("first")), begin - 1)
    elif start == "zero":
        expected = F.greatest(begin - 1, F.lit(0))
    else:
        raise ValueError(f"unknown start {start!r}")
    text = lambda c: c.cast("string")
    late = F.raise_error(F.concat(F.lit("no sample between "), text(expected), F.lit(" and "), text(low), F.lit(": rebase the recording or fill its gaps")))
    gap = F.raise_error(F.concat(F.lit("samples missing or repeated between "), text(low), F.lit(" and "), text(high)))
    own = F.when(low < begin, F.slice("samples", 2, F.size("samples"))).otherwise(F.col("samples"))
    packed = packed.withColumn("samples", F.when(high - low + 1 != F.size("samples"), gap).when(low != expected, late).otherwise(own))
    return group, values, packed.select(*group, "t0", "samples")


def origins(samples: DataFrame, keys=("recording_id",)) -> DataFrame:
    """``(keys, first)``: the index at which each recording starts."""
    return samples.groupBy(*keys).agg(F.min("t").alias("first"))


def rebase(samples: DataFrame, keys=("recording_id",)) -> DataFrame:
    """The same samples on a clock that starts at 0 with the recording's first sample.

    All channels of a recording move by the same number, so they stay aligned.
    """
    keys = list(keys)
    moved = samples.join(origins(samples, keys), keys).withColumn("t", F.col("t") - F.col("first"))
    return moved.select(*samples.columns)


def fill_gaps(samples: DataFrame, keys=("recording_id", "channel"), values=("v",), fill: float | None = 0.0, start: int | None = 0, block: int = 65536) -> DataFrame:
    """Samples plus one row with ``fill`` in ``values`` for every missing index.

    ``start`` is the index from which a recording is filled, None leaves what lies
    before its first sample alone. Rows are compared with the one before inside
    blocks of indices (``order.previous``), so no task sees a whole recording; a
    null in ``fill`` gives nulls. Columns beyond keys, ``t`` and values are null in
    the rows that are added.
    """
    from .order import previous

    keys, values = list(keys), list(values)
    before = previous(samples.select(*keys, "t"), keys, "t", {"__before": "t"}, block)
    least = F.coalesce("__before", F.col("t") - 1 if start is None else F.least(F.lit(start - 1).cast("long"), F.col("t") - 1))
    holes = before.withColumn("__before", least).filter(F.col("t") - F.col("__before") > 1)
    added = holes.select(*keys, F.explode(F.sequence(F.col("__before") + 1, F.col("t") - 1)).alias("t"))
    kinds = {f.name: f.dataType for f in samples.schema}
    added = added.select(*keys, F.col("t").cast(kinds["t"]).alias("t"), *[F.lit(fill).cast(kinds[v]).alias(v) for v in values])
    return samples.unionByName(added, allowMissingColumns=True)


def channel_rows(source: str, values) -> Column:
    """Array of ``(channel, x)`` from an array of sample structs."""
    return F.array(*[F.struct(F.lit(c).alias("channel"), _field(source, c).alias("x")) for c in values])


def to_samples(signals: DataFrame, keys=("recording_id", "channel")) -> DataFrame:
    """Framed arrays back to one row per sample; halo copies are dropped."""
    own = F.expr("slice(x, 1, frame)")
    return signals.select(*keys, "t0", F.posexplode(own).alias("__i", "v")).select(
        *keys, (F.col("t0") + F.col("__i")).alias("t"), "v"
    )


def unpivot(samples: DataFrame, channels, keys=("recording_id", "t")) -> DataFrame:
    """Wide samples to ``(keys, channel, v)`` without a shuffle."""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels])
    return samples.select(*keys, F.explode(rows).alias("__c")).select(*keys, "__c.channel", "__c.v")


def pack_channels(windows: DataFrame, keys, value: str = "x", order: str | None = None) -> DataFrame:
    """One row per window with its channels side by side.

    ``order`` names the column with each channel's montage position; positions
    must be 0..C-1. Operators address channels by that position, so named channels
    need it; without it channels are ordered by ``channel`` itself. Bounded by the
    montage (at most a few hundred channels of one window).
    """
    keys = list(keys)
    place = [] if order is None else [F.col(order).cast("long").alias("__pos")]
    packed = windows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*place, "channel", value))).alias("__p"))
    if order is not None:
        found = F.transform("__p", lambda s: s["__pos"])
        dense = F.coalesce(found == F.sequence(F.lit(0).cast("long"), F.size("__p").cast("long") - 1), F.lit(False))
        wrong = F.raise_error(F.concat(F.lit("channel positions are not 0..C-1: "), found.cast("string")))
        packed = packed.withColumn("__p", F.when(dense, F.col("__p")).otherwise(wrong))
    return packed.select(
        *keys,
        F.transform("__p", lambda s: s["channel"]).alias("channels"),
        F.transform("__p", lambda s: s[value]).alias("x"),
    )


def nan_to_zero(df: DataFrame, value: str = "x") -> DataFrame:
    return df.withColumn(value, F.transform(value, lambda v: F.nanvl(v, F.lit(0.0))))


def split_row(df: DataFrame, value: str, channels: int, length: int, names=None) -> DataFrame:
    """A flat array of ``channels * length`` numbers to one row per channel."""
    label = (lambda k: F.lit(names[k])) if names else (lambda k: F.lit(k))
    rows = F.array(*[
        F.struct(label(k).alias("channel"), F.slice(F.col(value), k * length + 1, length).cast("array<double>").alias("x"))
        for k in range(channels)
    ])
    rest = [c for c in df.columns if c != value]
    return df.select(*rest, F.explode(rows).alias("__c")).select(*rest, "__c.channel", "__c.x")


def _field(source: str, name: str) -> Column:
    return F.transform(source, lambda s: s[name].cast("double"))
