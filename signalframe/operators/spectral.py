"""FFT operators: each row is one bounded window, batched through Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.tables import BANDS


def _by_shape(col: pd.Series):
    """Row positions and stacked arrays, one group per array length."""
    lengths = col.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([np.asarray(col.iloc[i], dtype=float) for i in at])


def _map(df: DataFrame, keys, fields, work) -> DataFrame:
    """Run ``work(stack) -> list of per-row lists of output tuples`` over batches."""
    keep = [df.schema[k] for k in keys]
    schema = T.StructType(keep + list(fields))
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, stack in _by_shape(pdf["x"]):
                part = work(stack)
                reps = len(next(iter(part.values()))) // len(at)
                head = pdf.iloc[np.repeat(at, reps)][list(keys)].reset_index(drop=True)
                yield pd.concat([head, pd.DataFrame({n: part[n] for n in names})], axis=1)

    return df.select(*keys, "x").mapInPandas(run, schema)


def band_filter(windows: DataFrame, keys, fs: float, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """Band-limited signal per band: positive bins with lo <= f < hi, doubled."""
    edges = dict(bands)

    def work(stack):
        n = stack.shape[1]
        spectrum = np.fft.fft(stack, axis=1)
        freq = np.fft.fftfreq(n, 1.0 / fs)
        parts = [np.fft.ifft(spectrum * np.where((freq >= lo) & (freq < hi), 2.0, 0.0), axis=1).real for lo, hi in edges.values()]
        out = np.stack(parts, axis=1).reshape(-1, n)
        return {"band": list(edges) * stack.shape[0], "x": list(out)}

    return _map(windows, keys, [T.StructField("band", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))], work)


def segment_plan(n: int, segments: int) -> tuple[int, int]:
    count = max(1, min(segments, n // 32))
    size = n // count
    return (1, n) if size < 8 else (count, size)


def band_bins(size: int, fs: float, lo: float, hi: float) -> np.ndarray:
    freq = np.fft.rfftfreq(size, 1.0 / fs)
    hit = np.flatnonzero((freq >= lo) & (freq < hi))
    return hit if len(hit) else np.array([min(1, len(freq) - 1)])


def segment_spectra(stack: np.ndarray, segments: int) -> tuple[np.ndarray, int]:
    """Hann-windowed spectra of the last axis cut into segments."""
    count, size = segment_plan(stack.shape[-1], segments)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    cut = stack[..., : count * size].reshape(*stack.shape[:-1], count, size)
    return np.fft.rfft(cut * hann, axis=-1), size


def band_coefficients(windows: DataFrame, keys, fs: float, bands=BANDS, segments: int = 4) -> DataFrame:
    """Complex coefficients ``re``/``im`` per band, segment-major."""
    edges = dict(bands)

    def work(stack):
        spectra, size = segment_spectra(stack, segments)
        names, re, im = [], [], []
        picks = {b: band_bins(size, fs, *e) for b, e in edges.items()}
        for row in spectra:
            for b, bins in picks.items():
                z = row[:, bins].reshape(-1)
                names.append(b)
                re.append(z.real)
                im.append(z.imag)
        return {"band": names, "re": re, "im": im}

    arr = T.ArrayType(T.DoubleType())
    return _map(windows, keys, [T.StructField("band", T.StringType()), T.StructField("re", arr), T.StructField("im", arr)], work)


def token_spectrum_scores(tokens: DataFrame, keys) -> DataFrame:
    """Older patch importance: FFT magnitude over the token axis summed over
    features, linearly stretched (end points aligned) to the token count.

    ``tokens(keys, x ARRAY<ARRAY<DOUBLE>>)`` token-major; returns one row per token.
    """
    keep = [tokens.schema[k] for k in keys]
    schema = T.StructType(keep + [T.StructField("patch", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            out = []
            for i, x in enumerate(pdf["x"]):
                m = np.stack([np.asarray(r, dtype=float) for r in x])
                n = m.shape[0]
                mag = np.abs(np.fft.rfft(m, axis=0)).sum(axis=1)
                at = np.linspace(0, len(mag) - 1, n) if n > 1 else np.zeros(1)
                out.append(np.interp(at, np.arange(len(mag)), mag))
            if out:
                reps = [len(o) for o in out]
                head = pdf.loc[pdf.index.repeat(reps), list(keys)].reset_index(drop=True)
                head["patch"] = np.concatenate([np.arange(r) for r in reps]).astype("int32")
                head["score"] = np.concatenate(out)
                yield head

    return tokens.select(*keys, "x").mapInPandas(run, schema)
