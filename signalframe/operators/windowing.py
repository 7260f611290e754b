"""Window cutting: tail policies, length fitting, patches, segments, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from .layout import channel_rows, fill_gaps, frames, origins, rebase, to_signals

TAILS = ("drop", "floor", "all", "keep", "next")


def windows(signals: DataFrame, window: int, step: int, tail: str = "drop") -> DataFrame:
    """Cut framed channel arrays into windows of ``window`` samples every ``step``.

    No shuffle: each window starts inside exactly one frame and lies inside that
    frame's array. A frame shorter than ``frame + halo`` ends the recording, so
    its own size gives the recording's length for the tail rules:

    * ``drop``  complete windows only
    * ``floor`` plus one padded window at ``floor(L/step)*step`` when that leaves a rest
    * ``all``   every start below L, short ones padded
    * ``keep``  plus one padded window after the last complete one if samples remain uncovered
    * ``next``  plus one padded window at the next start if it is below L
    """
    if tail not in TAILS:
        raise ValueError(f"unknown tail policy {tail!r}; expected one of {TAILS}")
    fits = (F.pmod(F.col("frame"), F.lit(step)) == 0) & (F.col("halo") >= max(window - step, 0))
    guard = F.when(fits, F.col("t0")).otherwise(
        F.raise_error(F.lit("frame must be a multiple of step and halo at least window - step"))
    )
    n_here = F.size("x")
    end = F.col("t0") + n_here
    has_full = end >= window
    last_full = F.floor((end - window) / step).cast("long") * step
    facts = F.struct(
        end.alias("end"),
        (n_here < F.col("frame") + F.col("halo")).alias("ends_here"),
        has_full.alias("has_full"),
        last_full.alias("last_full"),
        F.when(has_full, last_full + step).otherwise(F.lit(0)).alias("after"),
        F.when(
            n_here > 0,
            F.sequence(guard, F.least(F.col("t0") + F.col("frame"), end) - 1, F.lit(step).cast("long")),
        ).otherwise(F.array().cast("array<bigint>")).alias("starts"),
    )
    rule = {
        "drop": lambda p, s: F.lit(False),
        "floor": lambda p, s: (F.pmod(p["end"], F.lit(step)) != 0) & (s == F.floor(p["end"] / step) * step),
        "all": lambda p, s: F.lit(True),
        "keep": lambda p, s: (s == p["after"]) & (~p["has_full"] | (p["last_full"] + window < p["end"])),
        "next": lambda p, s: s == p["after"],
    }[tail]
    kept = A.let(facts, lambda p: F.filter(p["starts"], lambda s: (s + window <= p["end"]) | (p["ends_here"] & rule(p, s))))
    rest = [c for c in signals.columns if c not in ("x", "t0", "frame", "halo")]
    cut = signals.select(*rest, "t0", "x", F.explode(kept).alias("start"))
    piece = F.slice(F.col("x"), (F.col("start") - F.col("t0") + 1).cast("int"), window)
    return cut.select(
        *rest,
        "start",
        A.pad_to(piece, window).alias("x"),
        (F.lit(window) - F.size(piece)).alias("n_pad"),
    )


def packed(samples: DataFrame, window: int, step: int, channels, keys=("recording_id",), frame: int | None = None) -> DataFrame:
    """Complete windows ``(keys, start, channels, x[C][T])`` of a wide table, channels by name.

    A frame holds all channels of its samples, so windows are packed where they are
    cut: no channel row is made and none is brought together again.
    """
    if frame is None:
        frame = step * max(1, -(-256 // step))
    if frame % step:
        raise ValueError("frame must be a multiple of step")
    keys, names = list(keys), sorted(channels)
    _, _, framed = frames(samples, frame, max(window - step, 0), keys, channels)
    end = F.col("t0") + F.size("samples")
    starts = F.sequence(F.col("t0"), F.least(F.col("t0") + frame, end) - 1, F.lit(step).cast("long"))
    placed = framed.select(*keys, "t0", "samples", F.explode(F.filter(starts, lambda s: s + window <= end)).alias("start"))
    placed = placed.withColumn("samples", F.slice("samples", (F.col("start") - F.col("t0") + 1).cast("int"), window))
    rows = F.transform(channel_rows("samples", names), lambda c: c["x"])
    return placed.select(*keys, "start", F.array(*[F.lit(c) for c in names]).alias("channels"), rows.alias("x"))


def cut(samples: DataFrame, window: int, step: int, tail: str = "drop", keys=("recording_id",),
        channels=None, frame: int | None = None, start: str = "zero", fill: float | None = None) -> DataFrame:
    """Samples straight to windows: one shuffle on (recording, frame).

    A missing, repeated or negative index is an error, and so is a recording that
    does not begin at index 0. ``start="first"`` counts windows from each recording's
    first sample instead; ``start`` of a window stays on the recording's own clock.
    ``fill`` puts that value wherever an index is missing.
    """
    if start not in ("zero", "first"):
        raise ValueError(f"unknown start {start!r}")
    halo = max(window - step, 0)
    if frame is None:
        frame = step * max(1, -(-4 * window // step))
    keys = list(keys)
    if fill is not None:
        own = keys if channels else [*keys, "channel"]
        samples = fill_gaps(samples, own, channels or ("v",), fill, 0 if start == "zero" else None)
    if start == "zero":
        return windows(to_signals(samples, frame, halo, keys, channels), window, step, tail)
    out = windows(to_signals(rebase(samples, keys), frame, halo, keys, channels), window, step, tail)
    return out.join(origins(samples, keys), keys).withColumn("start", F.col("start") + F.col("first")).select(*out.columns)


def adjust_length(df: DataFrame, n: int) -> DataFrame:
    """Truncate or right-pad with zeros."""
    return df.withColumn("x", A.pad_to(F.slice("x", 1, n), n))


def fit_length(df: DataFrame, n: int, mode: str = "center", seed: int = 0, key=("window_id",)) -> DataFrame:
    """Crop (centre or hash-random start) when longer, right-pad when shorter."""
    extra = F.greatest(F.size("x") - n, F.lit(0))
    if mode == "center":
        start = F.floor(extra / 2).cast("int")
    elif mode == "random":
        start = H.choice(H.uniform(seed, *key), extra + 1)
    else:
        raise ValueError(f"unknown crop mode {mode!r}")
    return df.withColumn("x", A.pad_to(F.slice(F.col("x"), start + 1, n), n))


def patchify(df: DataFrame, patch: int, levels: int = 0) -> DataFrame:
    """Non-overlapping patches; a length that does not divide is an error."""
    if patch % (2**levels):
        raise ValueError(f"patch length {patch} is not divisible by 2**{levels}")
    size = F.size("x")
    count = F.when(
        (size > 0) & (F.pmod(size, F.lit(patch)) == 0), F.floor(size / patch).cast("int")
    ).otherwise(F.raise_error(F.concat(F.lit("window length "), size.cast("string"), F.lit(f" is not a multiple of patch {patch}"))))
    rest = [c for c in df.columns if c != "x"]
    return df.select(*rest, "x", F.explode(F.sequence(F.lit(0), count - 1)).alias("patch")).select(
        *rest, "patch", F.slice(F.col("x"), F.col("patch") * patch + 1, patch).alias("x")
    )


def segments(samples: DataFrame, cols, keys=("recording_id",), block: int = 65536) -> DataFrame:
    """Maximal runs over which all of ``cols`` stay constant.

    Returns ``(keys, segment, start, stop, cols)`` with ``stop`` exclusive: the next
    run's start, or one past the last sample. A missing index does not end a run.
    Samples are shuffled once, into blocks of ``block`` indices; the last state of
    the block before decides whether a block's first sample goes on with a run, so
    the result does not depend on ``block`` and no task sees a whole recording.
    """
    keys, cols = list(keys), list(cols)
    t = F.col("t")
    data = samples.select(*keys, "t", F.struct(*cols).alias("__state"), F.floor(t / block).cast("long").alias("__blk"))
    in_block = W.partitionBy(*keys, "__blk").orderBy("t")
    along = W.partitionBy(*keys).orderBy("__blk")
    edges = data.groupBy(*keys, "__blk").agg(F.max("t").alias("__last_t"), F.max_by("__state", "t").alias("__last"))
    edges = edges.select(
        *keys, "__blk", F.lag("__last").over(along).alias("__before"), F.when(F.lead("__blk").over(along).isNull(), F.col("__last_t")).alias("__end")
    )
    seen = data.withColumn("__prev", F.lag("__state").over(in_block)).join(edges.hint("merge"), [*keys, "__blk"])
    prev = F.coalesce("__prev", "__before")
    changes = prev.isNull() | ~prev.eqNullSafe(F.col("__state"))
    closes = F.coalesce(t == F.col("__end"), F.lit(False))
    start = F.struct(t.alias("at"), F.lit(True).alias("run"))
    stop = F.struct((t + 1).alias("at"), F.lit(False).alias("run"))
    # Boundaries: the start of every run and the end of the recording.
    found = F.when(changes & closes, F.array(start, stop)).when(changes, F.array(start)).when(closes, F.array(stop))
    marks = seen.select(*keys, "__blk", "__state", F.explode(found).alias("__m")).select(
        *keys, "__blk", "__state", F.col("__m.at").alias("start"), F.col("__m.run").alias("__run")
    )
    ordered = W.partitionBy(*keys, "__blk").orderBy("start")
    local = marks.withColumn("__n", F.row_number().over(ordered) - 1).withColumn("__stop", F.lead("start").over(ordered))
    per_block = marks.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__c"), F.min("start").alias("__first"))
    joined = per_block.select(
        *keys, "__blk",
        F.coalesce(F.sum("__c").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.lead("__first").over(along).alias("__following"),
    )
    out = local.filter("__run").join(joined.hint("merge"), [*keys, "__blk"])
    return out.select(
        *keys, (F.col("__n") + F.col("__off")).alias("segment"), "start", F.coalesce("__stop", "__following").alias("stop"), *[F.col(f"__state.{c}").alias(c) for c in cols]
    )


def segment_windows(samples: DataFrame, segs: DataFrame, window: int, step: int,
                    keys=("recording_id",), channels=None) -> DataFrame:
    """Complete windows cut inside each segment, so none crosses a boundary.

    ``segs`` carries whatever was decided per segment (label, split); filter it
    first.
    """
    keys = list(keys)
    carried = [c for c in segs.columns if c not in (*keys, "start", "stop")]
    starts = segs.filter(F.col("stop") - F.col("start") >= window).select(
        *keys, *carried,
        F.explode(F.sequence(F.col("start"), F.col("stop") - window, F.lit(step).cast("long"))).alias("start"),
    )
    got = _gather(samples, starts, window, keys, carried, channels)
    short = F.raise_error(F.concat(F.lit("a segment goes beyond its recording at "), F.col("start").cast("string")))
    return got.withColumn("x", F.when(F.size("x") == window, F.col("x")).otherwise(short.cast("array<double>")))


def _gather(samples, starts, window, keys, carried, channels):
    """Cut ``window`` samples at each start, wherever the recording begins.

    Samples are packed into frames that overlap by ``window - 1``, so they are
    shuffled once and each start meets one frame; positions count from the frame's
    first sample. A window over the recording's end is short, one that begins
    before its first sample is left out.
    """
    frame = max(1024, 4 * window)
    group, values, packed = frames(samples, frame, window - 1, keys, channels, start="first")
    wanted = starts.withColumn("t0", F.floor(F.col("start") / frame).cast("long") * frame)
    at = (F.col("start") - F.get("samples", F.lit(0))["t"] + 1).cast("int")
    cut = packed.join(wanted, [*keys, "t0"]).filter(at >= 1)
    cut = cut.select(*group, *carried, "start", F.slice("samples", at, window).alias("samples"))
    if channels is None:
        return cut.select(*group, *carried, "start", F.transform("samples", lambda s: s["v"]).alias("x"))
    return cut.select(*group, *carried, "start", F.explode(channel_rows("samples", values)).alias("__c")).select(
        *group, *carried, "start", "__c.channel", "__c.x"
    )


def interval_label(points: DataFrame, intervals: DataFrame, at: str = "t", bin_width: float = 30.0,
                   keys=("recording_id",)) -> DataFrame:
    """Points inside ``[onset, onset + duration)`` of the same recording.

    Both sides carry ``floor(time / bin_width)``; an interval is repeated once per
    bin it touches, so the join is an equi join and each pair is met exactly once.
    """
    keys = list(keys)
    stop = F.col("onset") + F.col("duration")
    lo = F.floor(F.col("onset") / bin_width).cast("long")
    hi = F.greatest(lo, F.ceil(stop / bin_width).cast("long") - 1)
    spread = intervals.withColumn("__bin", F.explode(F.sequence(lo, hi)))
    binned = points.withColumn("__bin", F.floor(F.col(at) / bin_width).cast("long"))
    return binned.join(spread, [*keys, "__bin"]).filter(
        (F.col(at) >= F.col("onset")) & (F.col(at) < stop)
    ).drop("__bin")


def epochs(samples: DataFrame, events: DataFrame, tmin: float, tmax: float, fs: float,
           n: int | None = None, keys=("recording_id",), channels=None) -> DataFrame:
    """Samples with ``tmin <= (t - event) / fs <= tmax`` around each event sample.

    Duplicate events at one sample are reduced to the first by code. ``n`` crops
    to the first n samples and rejects shorter epochs.
    """
    keys = list(keys)
    first = int(round(tmin * fs))
    length = int(round(tmax * fs)) - first + 1
    once = events.groupBy(*keys, "event_t").agg(F.min("code").alias("code"))
    starts = once.withColumn("start", F.col("event_t") + first)
    got = _gather(samples, starts, length, keys, ["event_t", "code"], channels)
    full = got.filter(F.size("x") == length)
    if n is None:
        return full
    if n > length:
        raise ValueError(f"epoch of {length} samples is shorter than {n}")
    return full.withColumn("x", F.slice("x", 1, n))


def annotation_windows(ann: DataFrame, window: float, last: str = "overlap") -> DataFrame:
    """Non-overlapping window starts inside each annotation interval.

    ``overlap`` adds one window that ends at the interval's end when a rest is
    left over; ``drop`` omits it. Intervals shorter than the window give none.
    """
    n = F.floor(F.col("duration") / window).cast("int")
    regular = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("onset") + k * window)
    rest = F.col("duration") - n * window
    if last == "overlap":
        tail = F.when(rest > 0, F.array(F.col("onset") + F.col("duration") - window)).otherwise(
            F.array().cast("array<double>")
        )
        starts = F.concat(regular, tail)
    elif last == "drop":
        starts = regular
    else:
        raise ValueError(f"unknown last-window rule {last!r}")
    return ann.filter(F.col("duration") >= window).withColumn("start", F.explode(starts))


def crop_wake(ann: DataFrame, minutes: float = 30.0, wake: str = "W", keys=("recording_id",)) -> DataFrame:
    """Keep what lies within ``minutes`` of the first and last non-wake interval."""
    keys = list(keys)
    asleep = F.col("code") != wake
    span = ann.groupBy(*keys).agg(
        F.min(F.when(asleep, F.col("onset"))).alias("__lo"),
        F.max(F.when(asleep, F.col("onset") + F.col("duration"))).alias("__hi"),
    )
    pad = minutes * 60.0
    near = (F.col("onset") + F.col("duration") > F.col("__lo") - pad) & (F.col("onset") < F.col("__hi") + pad)
    out = ann.join(span, keys).filter(near)
    start = F.greatest(F.col("onset"), F.col("__lo") - pad)
    stop = F.least(F.col("onset") + F.col("duration"), F.col("__hi") + pad)
    return out.withColumn("duration", stop - start).withColumn("onset", start).drop("__lo", "__hi")


def limit_per_recording(df: DataFrame, n: int, keys=("recording_id",), order=("start",)) -> DataFrame:
    """First ``n`` windows per recording; the limit is applied before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
