"""Wavelet filters and small dense analysis matrices.

A matrix has the size of one patch (tens to a few hundred), is built once on the
driver and travels inside the plan; data never passes through here.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, sqrt

import numpy as np

MODES = ("reflect", "symmetric", "periodization", "zero", "constant")

# Low-pass analysis taps of families without a short rule.
TAPS = {
    "sym4": [-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161,
             0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427],
    "sym5": [0.027333068345077982, 0.029519490925774643, -0.039134249302383094, 0.1993975339773936, 0.7234076904024206,
             0.6339789634582119, 0.01660210576452232, -0.17532808990845047, -0.021101834024758855, 0.019538882735286728],
    "coif3": [-3.459977283621256e-05, -7.098330313814114e-05, 0.0004662169601128863, 0.0011175187708906016,
              -0.0025745176887502236, -0.00900797613666158, 0.015880544863615904, 0.03455502757306163,
              -0.08230192710688598, -0.07179982161931202, 0.42848347637761874, 0.7937772226256206,
              0.4051769024096169, -0.06112339000267287, -0.0657719112818555, 0.023452696141836267,
              0.007782596427325418, -0.003793512864491014],
}
BIOR44_LO = [0.0, 0.03782845550726404, -0.023849465019556843, -0.11062440441843718, 0.37740285561283066,
             0.8526986790088938, 0.37740285561283066, -0.11062440441843718, -0.023849465019556843, 0.03782845550726404]
BIOR44_HI = [0.0, -0.06453888262869706, 0.04068941760916406, 0.41809227322161724, -0.7884856164055829,
             0.41809227322161724, 0.04068941760916406, -0.06453888262869706, 0.0, 0.0]


def _daubechies(n: int) -> list[float]:
    """Minimum-phase Daubechies taps by spectral factorisation, analysis order."""
    y_poly = [comb(n - 1 + k, k) for k in range(n)]
    taps = np.array([1.0])
    for _ in range(n):
        taps = np.convolve(taps, [1.0, 1.0])
    for y in np.roots(y_poly[::-1]) if n > 1 else []:
        pair = np.roots([1.0, 4.0 * y - 2.0, 1.0])
        inside = pair[np.argmin(np.abs(pair))]
        taps = np.convolve(taps, [1.0, -inside])
    taps = np.real(taps)
    return list((taps * sqrt(2.0) / taps.sum())[::-1])


@lru_cache(maxsize=None)
def filters(name: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(low, high) analysis taps of haar, dbN, sym4, sym5, coif3 or bior4.4."""
    key = name.lower()
    if key == "bior4.4":
        return tuple(BIOR44_LO), tuple(BIOR44_HI)
    if key == "haar":
        lo = [1.0 / sqrt(2.0)] * 2
    elif key in TAPS:
        lo = TAPS[key]
    elif key.startswith("db") and key[2:].isdigit() and 1 <= int(key[2:]) <= 12:
        lo = _daubechies(int(key[2:]))
    else:
        raise ValueError(f"unknown wavelet {name!r}")
    n = len(lo)
    return tuple(lo), tuple((-1.0) ** (i + 1) * lo[n - 1 - i] for i in range(n))


def resolve_mode(wavelet: str, mode: str) -> str:
    """Orthogonal filters are singular under anything but periodization."""
    if mode not in MODES:
        raise ValueError(f"unknown boundary mode {mode!r}; expected {MODES}")
    return mode if wavelet.lower().startswith(("bior", "rbio")) else "periodization"


def band_names(levels: int) -> list[str]:
    return [f"A{levels}"] + [f"D{j}" for j in range(levels, 0, -1)]


def band_lengths(patch: int, levels: int) -> list[int]:
    if patch % (2**levels):
        raise ValueError(f"patch length {patch} is not divisible by {2**levels}")
    return [patch >> levels] + [patch >> j for j in range(levels, 0, -1)]


def _extension(patch: int, mode: str) -> np.ndarray:
    eye = np.eye(patch)
    second = {
        "reflect": eye[::-1], "symmetric": eye[::-1], "periodization": eye,
        "zero": np.zeros((patch, patch)), "constant": np.repeat(eye[-1:], patch, axis=0),
    }[mode]
    return np.vstack([eye, second])


def _level(size: int, taps) -> np.ndarray:
    """One periodic analysis level: c[n] = sum_k w[k] x[(2(n+off)+k-(L-2)) mod size]."""
    n_taps = len(taps)
    shift = ((n_taps - 2) // 2) // 2
    m = np.zeros((size // 2, size))
    n = np.arange(size // 2)
    for k, w in enumerate(taps):
        np.add.at(m, (n, (2 * (n + shift) + k - (n_taps - 2)) % size), w)
    return m


@lru_cache(maxsize=64)
def analysis_matrix(patch: int, wavelet: str, levels: int, mode: str = "reflect") -> np.ndarray:
    """P x P map from a patch to [cA_J, cD_J, ..., cD_1]."""
    band_lengths(patch, levels)
    lo, hi = filters(wavelet)
    state = _extension(patch, resolve_mode(wavelet, mode))
    details = []
    for _ in range(levels):
        size = state.shape[0]
        details.append(_level(size, hi) @ state)
        state = _level(size, lo) @ state
    bands = [state, *details[::-1]]
    return np.vstack([b[: b.shape[0] // 2] for b in bands])


@lru_cache(maxsize=64)
def synthesis_matrix(patch: int, wavelet: str, levels: int, mode: str = "reflect") -> np.ndarray:
    return np.linalg.inv(analysis_matrix(patch, wavelet, levels, mode))
