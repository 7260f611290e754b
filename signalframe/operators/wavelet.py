"""Wavelet analysis of patches and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import wavelets as V
from ..functions.linear import apply_matrix


def dwt(patches: DataFrame, patch: int, wavelet: str = "bior4.4", levels: int = 3, mode: str = "reflect", value: str = "x", out: str = "coeffs") -> DataFrame:
    """Critically sampled transform: ``coeffs`` has exactly as many numbers as ``x``."""
    return patches.withColumn(out, apply_matrix(F.col(value), V.analysis_matrix(patch, wavelet, levels, mode)))


def idwt(coeffs: DataFrame, patch: int, wavelet: str = "bior4.4", levels: int = 3, mode: str = "reflect", value: str = "coeffs", out: str = "x") -> DataFrame:
    return coeffs.withColumn(out, apply_matrix(F.col(value), V.synthesis_matrix(patch, wavelet, levels, mode)))


def split_bands(coeffs: DataFrame, patch: int, levels: int, value: str = "coeffs", out: str = "c") -> DataFrame:
    """One row per sub-band with its coefficients."""
    rows, at = [], 1
    for name, n in zip(V.band_names(levels), V.band_lengths(patch, levels)):
        rows.append(F.struct(F.lit(name).alias("band"), F.slice(F.col(value), at, n).alias(out)))
        at += n
    rest = [c for c in coeffs.columns if c not in (value, "x")]
    return coeffs.select(*rest, F.explode(F.array(*rows)).alias("__b")).select(*rest, "__b.band", f"__b.{out}")


def band_energy(bands: DataFrame, value: str = "c") -> DataFrame:
    """Mean squared coefficient of each sub-band row."""
    total = F.aggregate(value, F.lit(0.0), lambda a, v: a + v * v)
    return bands.withColumn("energy", total / F.size(value)).drop(value)


def pooled_energy(bands: DataFrame, slots: int, value: str = "c") -> DataFrame:
    """Energy of whole-window bands pooled onto ``slots`` patch positions.

    Slot i averages coefficients ``floor(i*n/S) .. ceil((i+1)*n/S) - 1``.
    """
    n = F.size(value)
    slot = F.col("patch")
    lo = F.floor(slot * n / slots).cast("int")
    hi = F.ceil((slot + 1) * n / slots).cast("int")
    part = F.slice(F.col(value), lo + 1, hi - lo)
    total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v)
    spread = bands.withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return spread.withColumn("energy", total / (hi - lo)).drop(value)


def dwt_stack(windows: DataFrame, length: int, wavelet: str = "db6", levels: int = 3, kernel: int = 16) -> DataFrame:
    """Non-critical decomposition: every band is upsampled back to the window length.

    Filters are centred in ``kernel`` taps, applied with zero padding, decimated by
    two and repeated by nearest neighbour. Rows: ``band`` = D1..DJ then A.
    """
    lo, hi = V.filters(wavelet)
    if len(lo) > kernel:
        raise ValueError(f"{wavelet} has {len(lo)} taps, more than kernel {kernel}")
    off = (kernel - len(lo)) // 2 - kernel // 2
    kept = (length + 2 * (kernel // 2) - kernel) // 2 + 1

    edge = max(kernel, -2 * off)
    zeros = F.array_repeat(F.lit(0.0), edge)

    def level(x, taps):
        used = [(k, float(w)) for k, w in enumerate(taps) if w]

        def coefficient(padded):
            def at(n):
                parts = [F.get(padded, n * 2 + (k + off + edge)) * w for k, w in used]
                return sum(parts[1:], parts[0])

            return F.transform(F.sequence(F.lit(0), F.lit(kept - 1)), at)

        def upsample(half):
            return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(half, F.floor(i * kept / F.lit(length)).cast("int")))

        return A.let(F.concat(zeros, x, zeros), lambda padded: A.let(coefficient(padded), upsample))

    out = windows.withColumn("__a", F.col("x"))
    names = []
    for j in range(1, levels + 1):
        out = out.withColumn(f"__d{j}", level(F.col("__a"), hi)).withColumn("__a", level(F.col("__a"), lo))
        names.append((f"D{j}", f"__d{j}"))
    names.append(("A", "__a"))
    rest = [c for c in windows.columns if c != "x"]
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(c).alias("x")) for b, c in names])
    return out.select(*rest, F.explode(rows).alias("__b")).select(*rest, "__b.band", "__b.x")


def block_stats(bands: DataFrame, block: int, eps: float = 1e-6, value: str = "x") -> DataFrame:
    """log-RMS, normalised entropy and log1p kurtosis per block of a band row.

    The last block is completed by repeating the final sample.
    """
    size = F.size(value)
    blocks = F.ceil(size / block).cast("int")
    filled = F.concat(F.col(value), F.array_repeat(F.get(F.col(value), size - 1), blocks * block - size))
    rest = [c for c in bands.columns if c != value]
    cut = bands.select(*rest, filled.alias("__x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).select(
        *rest, "block", F.slice(F.col("__x"), F.col("block") * block + 1, block).alias("__x")
    )
    x = F.col("__x")
    total = lambda f: F.aggregate(F.transform(x, f), F.lit(0.0), lambda a, v: a + v)
    moments = F.struct((total(lambda v: v) / block).alias("m"), total(lambda v: v * v).alias("p"))

    def stats(q):
        power = lambda: F.greatest(q["p"], F.lit(eps))
        share = lambda v: v * v / power()
        var = F.greatest(total(lambda v: (v - q["m"]) * (v - q["m"])) / block, F.lit(eps))
        fourth = total(lambda v: F.pow(v - q["m"], 4)) / block
        entropy = -total(lambda v: share(v) * F.log(F.greatest(share(v), F.lit(eps)))) / math.log(block)
        return F.struct(
            F.log(F.sqrt(F.greatest(q["p"] / block, F.lit(eps)))).alias("log_rms"),
            entropy.alias("entropy"),
            F.log1p(F.greatest(fourth / (var * var), F.lit(0.0))).alias("kurtosis"),
        )

    return cut.select(*rest, "block", A.let(moments, stats).alias("__q")).select(*rest, "block", "__q.*")
