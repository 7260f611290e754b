"""Filter design and block filtering of stacked rows, numpy only."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_BLOCK = 128


def butter_zpk(order: int, low: float | None, high: float | None):
    """Digital Butterworth zeros, poles and gain; edges are fractions of Nyquist.

    ``low`` and ``high`` give a band-pass, ``high`` alone a low-pass.
    """
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda w: 4.0 * np.tan(np.pi * w / 2.0)
    if low is None:
        wc = warp(high)
        zeros, poles, gain = np.zeros(0), proto * wc, wc**order
    else:
        w1, w2 = warp(low), warp(high)
        bw, w0 = w2 - w1, math.sqrt(w1 * w2)
        half = proto * bw / 2.0
        root = np.sqrt(half**2 - w0**2 + 0j)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), bw**order
    gain = gain * np.real(np.prod(4.0 - zeros) / np.prod(4.0 - poles))
    zd = np.concatenate([(4.0 + zeros) / (4.0 - zeros), -np.ones(len(poles) - len(zeros))])
    return zd, (4.0 + poles) / (4.0 - poles), gain


def _sections(zeros, poles, gain):
    """Second-order sections (b, a), poles farthest from the unit circle first."""
    upper = sorted([p for p in poles if p.imag > 1e-12], key=abs)
    real = sorted([p.real for p in poles if abs(p.imag) <= 1e-12], key=abs)
    dens = [np.real(np.poly([p, np.conj(p)])) for p in upper]
    for i in range(0, len(real), 2):
        dens.append(np.real(np.poly(real[i:i + 2] if i + 1 < len(real) else [real[i], 0.0])))
    zs = sorted(np.real(zeros))
    # One zero from each end of the axis per section keeps band-pass sections balanced.
    nums = []
    while len(zs) > 1:
        nums.append(np.real(np.poly([zs.pop(0), zs.pop(-1)])))
    if zs:
        nums.append(np.array([1.0, -zs[0], 0.0]))
    nums += [np.array([1.0, 0.0, 0.0])] * (len(dens) - len(nums))
    nums[0] = nums[0] * gain
    return list(zip(nums, dens))


def _coupled(a, b, c):
    """The same second-order section with its complex poles as a scaled rotation.

    Near z = 1 (a low cut at a high rate) direct-form states grow and cancel; in this
    form rounding does not grow with a filter's memory.
    """
    poles, vectors = np.linalg.eig(a)
    if abs(poles[0].imag) < 1e-14:
        return a, b, c
    t = np.stack([vectors[:, 0].real, vectors[:, 0].imag], axis=1)
    back = np.linalg.inv(t)
    a, b, c = back @ a @ t, back @ b, c @ t
    size = math.sqrt(np.linalg.norm(c) / max(np.linalg.norm(b), 1e-300))
    return a, b * size, c / size


def _state_space(sections):
    """Cascade of second-order sections as one (A, B, C, D)."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for num, den in sections:
        sa = np.array([[-den[1], 1.0], [-den[2], 0.0]])
        sb = np.array([num[1] - den[1] * num[0], num[2] - den[2] * num[0]])
        sa, sb, sc = _coupled(sa, sb, np.array([1.0, 0.0]))
        sd, n = num[0], len(b)
        a = np.block([[a, np.zeros((n, 2))], [np.outer(sb, c), sa]])
        b = np.concatenate([b, sb * d])
        c = np.concatenate([sd * c, sc])
        d = sd * d
    return a, b, c, d


class Iir:
    """A stable recursive filter applied to rows in blocks of matrix products."""

    def __init__(self, sections, pad: int):
        self.a, self.b, self.c, self.d = _state_space(sections)
        self.pad = pad
        n = len(self.b)
        self.steady = np.linalg.solve(np.eye(n) - self.a, self.b)
        powers = [np.eye(n)]
        for _ in range(_BLOCK):
            powers.append(powers[-1] @ self.a)
        self._powers = powers
        impulse = np.array([self.d] + [self.c @ p @ self.b for p in powers[: _BLOCK - 1]])
        lag = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
        self._toeplitz = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self._observe = np.array([self.c @ p for p in powers[:_BLOCK]])
        self._drive = np.array([p @ self.b for p in powers[:_BLOCK]])

    def run(self, x: np.ndarray, state: np.ndarray):
        """Output and state after the last sample, for rows that begin in ``state``."""
        out = np.empty_like(x)
        for at in range(0, x.shape[1], _BLOCK):
            part = x[:, at:at + _BLOCK]
            m = part.shape[1]
            out[:, at:at + m] = part @ self._toeplitz[:m, :m].T + state @ self._observe[:m].T
            state = state @ self._powers[m].T + part @ self._drive[:m][::-1]
        return out, state

    def zero_phase(self, x: np.ndarray) -> np.ndarray:
        """Forward and backward pass over whole rows."""
        return self.block(x, 0.0, 0.0, True, True)[0]

    def block(self, x: np.ndarray, before, after, first: bool, last: bool):
        """Forward and backward pass over one block of a recording.

        ``before`` is the forward pass' state at the block's beginning, ``after`` the
        backward pass' state at its end; at the recording's own ends rows are extended
        oddly and start from the steady state. Returns the block's output and the
        states that its neighbours need: after it and before it.
        """
        pad = min(self.pad, x.shape[1] - 1)
        left = 2 * x[:, :1] - x[:, pad:0:-1] if first else x[:, :0]
        right = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1] if last and pad else x[:, :0]
        ext = np.concatenate([left, x, right], axis=1)
        fwd, after_it = self.run(ext, ext[:, :1] * self.steady if first else np.broadcast_to(before, (len(x), len(self.b))))
        back = np.ascontiguousarray(fwd[:, ::-1])
        both, before_it = self.run(back, back[:, :1] * self.steady if last else np.broadcast_to(after, (len(x), len(self.b))))
        at = left.shape[1]
        return both[:, ::-1][:, at:at + x.shape[1]], after_it, before_it


def cascade(steps, x: np.ndarray, states: np.ndarray, first: bool, last: bool):
    """One block through all filters. ``states`` holds, for each filter, the forward
    state at its beginning and the backward state at its end, side by side; the
    states for the neighbours come back in the same places.
    """
    out, at = np.zeros((len(x), states.shape[1])), 0
    for f in steps:
        n = len(f.b)
        x, out[:, at:at + n], out[:, at + n:at + 2 * n] = f.block(x, states[:, at:at + n], states[:, at + n:at + 2 * n], first, last)
        at += 2 * n
    return x, out


def width(steps) -> int:
    return sum(2 * len(f.b) for f in steps)


def response(steps, length: int, first: bool, last: bool) -> np.ndarray:
    """What each incoming state of a silent block adds to the outgoing ones: a block is linear in both."""
    n = width(steps)
    return cascade(steps, np.zeros((n, length)), np.eye(n), first, last)[1]


def incoming(steps, inside: np.ndarray, outgoing: np.ndarray, ends: dict[int, np.ndarray]) -> np.ndarray:
    """True incoming states ``[block, row, state]`` of all blocks in order.

    ``outgoing`` are the states each block sends out when it gets zeros; ``inside`` is
    the response of every block but those in ``ends``. A state depends on earlier
    filters and on the same pass only, so each pass is one running product along
    the blocks, forward and then backward.
    """
    got, at = np.zeros_like(outgoing), 0
    for f in steps:
        n = len(f.b)
        for lo, order, ahead in ((at, range(len(got) - 1), 1), (at + n, range(len(got) - 1, 0, -1), -1)):
            part = slice(lo, lo + n)
            for k in order:
                got[k + ahead][:, part] = outgoing[k][:, part] + got[k] @ ends.get(k, inside)[:, part]
        at += 2 * n
    return got


@lru_cache(maxsize=32)
def bandpass(fs: float, lo: float, hi: float, order: int = 4) -> Iir | None:
    """None when the band is invalid at this rate (the step is then skipped)."""
    a, b = max(lo / (fs / 2), 1e-6), min(hi / (fs / 2), 0.999)
    if a >= b:
        return None
    sections = _sections(*butter_zpk(order, a, b))
    return Iir(sections, 3 * (2 * len(sections) + 1))


@lru_cache(maxsize=32)
def lowpass(fs: float, cutoff: float, order: int = 4) -> Iir | None:
    if cutoff >= fs / 2:
        return None
    sections = _sections(*butter_zpk(order, None, cutoff / (fs / 2)))
    return Iir(sections, 3 * (2 * len(sections) + 1))


@lru_cache(maxsize=32)
def notch(fs: float, freq: float, q: float = 30.0) -> Iir | None:
    if freq >= fs / 2:
        return None
    w = 2 * math.pi * freq / fs
    g = 1.0 / (1.0 + math.tan(w / q / 2.0))
    num = g * np.array([1.0, -2.0 * math.cos(w), 1.0])
    den = np.array([1.0, -2.0 * g * math.cos(w), 2.0 * g - 1.0])
    return Iir([(num, den)], 9)


def rates(fs: float, target: float) -> tuple[int, int]:
    up, down = int(round(target)), int(round(fs))
    g = math.gcd(up, down)
    return up // g, down // g


@lru_cache(maxsize=32)
def resample_taps(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed (beta 5) sinc of half length ``10 * max(up, down)``, unit DC gain times ``up``."""
    top = max(up, down)
    half = 10 * top
    n = np.arange(-half, half + 1)
    h = np.sinc(n / top) / top * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def resample_rows(x: np.ndarray, up: int, down: int, first_in: int, first_out: int, n_out: int) -> np.ndarray:
    """Outputs ``first_out ..`` from rows whose first sample has index ``first_in``;
    samples outside the rows count as zero."""
    h = resample_taps(up, down)
    half = (len(h) - 1) // 2
    reach = half // up + 1
    m = np.arange(first_out, first_out + n_out)
    centre = (m * down) // up
    offsets = np.arange(-reach, reach + 1)
    at = m[:, None] * down - (centre[:, None] + offsets[None, :]) * up + half
    taps = np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0)
    src = centre[:, None] + offsets[None, :] - first_in
    ok = (src >= 0) & (src < x.shape[1])
    weights = np.where(ok, taps, 0.0)
    out = np.empty((x.shape[0], n_out))
    for i in range(x.shape[0]):
        out[i] = np.einsum("mk,mk->m", x[i][np.clip(src, 0, x.shape[1] - 1)], weights)
    return out
