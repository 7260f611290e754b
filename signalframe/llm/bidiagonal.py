"""Singular values and right singular vectors of a small triangular matrix by qd arrays.

Householder reflections turn R into an upper bidiagonal B, ``R = U B P'``. With
``q`` the squared diagonal and ``e`` the squared superdiagonal of B, ``B'B`` has the
factor arrays ``(q, e)``: shifted dqds sweeps give its eigenvalues to high relative
accuracy, twisted factorisations of ``B'B - s`` their vectors. The matrices here have
one row per dimension, whatever the number of rows they were reduced from.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def _reflector(x: np.ndarray):
    """``v, beta, alpha`` with ``(1 - beta v v') x = alpha e_0``."""
    top = np.abs(x).max() if len(x) else 0.0
    if top == 0.0 or not np.any(x[1:]):
        return None, 0.0, x[0] if len(x) else 0.0
    v = x / top
    norm = np.sqrt(v @ v)
    alpha = -np.copysign(norm, v[0])
    v[0] -= alpha
    return v, 2.0 / (v @ v), alpha * top


def bidiagonal(r: np.ndarray):
    """``diagonal, superdiagonal, P``: the square ``r`` is ``U B P'``."""
    a = np.array(r, dtype=float)
    d = len(a)
    p = np.eye(d)
    for k in range(d):
        v, beta, _ = _reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, beta, _ = _reflector(a[k, k + 1 :].copy())
            if v is not None:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= beta * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _sweep(q, e, shift):
    """One dqds step: the arrays of ``B'B - shift``; None if that is not positive."""
    n = len(q)
    q2, e2 = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None
        q2[i] = d + e[i]
        if q2[i] == 0.0:
            e2[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / q2[i]
            e2[i], d = e[i] * t, d * t - shift
    if d < 0.0:
        return None
    q2[-1] = d
    return q2, e2


def _guess(q, e):
    """Smaller eigenvalue of the trailing 2 x 2 block, a little less: a shift that is tried first."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2.0
    root = np.hypot(half, np.sqrt(c))
    least = b - c / (half + root) if half >= 0 and half + root > 0 else (a + b) / 2.0 - root
    return max(0.0, least * (1.0 - 4.0 * EPS))


def dqds(q, e) -> np.ndarray:
    """Eigenvalues of ``B'B`` for the squared entries of B, falling."""
    out, blocks = [], [(list(map(float, q)), list(map(float, e)), 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        shift = 0.0
        while q:
            for i in range(len(e) - 1, -1, -1):
                if e[i] <= EPS * EPS * (total + q[i + 1]):
                    blocks.append((q[: i + 1], e[:i], total))
                    q, e = q[i + 1 :], e[i + 1 :]
                    break
            if len(q) == 1:
                out.append(total + q[0])
                break
            # A shift above the least eigenvalue shows as a negative entry; less is tried then.
            while (step := _sweep(q, e, shift)) is None:
                shift = shift / 8.0 if shift > EPS * total else 0.0
            q, e = step
            # Reversing a graded block lets the small end come last.
            if q[0] < q[-1] / 1.5 and shift == 0.0 and total == 0.0:
                q, e = _flip(q, e)
            total += shift
            shift = _guess(q, e)
    return np.sort(np.array(out))[::-1]


def _flip(q, e):
    """Factor arrays of the same matrix with rows and columns reversed (BB' keeps the values)."""
    return q[::-1], e[::-1]


def _twisted(q, e, value):
    """Multipliers from both ends of ``B'B - value`` and the pivot of each twist."""
    n = len(q)
    tiny = np.finfo(float).tiny
    up, s = np.zeros(n - 1), np.zeros(n)
    low, p = np.zeros(n - 1), np.zeros(n)
    off = np.sqrt(q[:-1] * e)
    # From the top: L+ D+ L+' with l+ = off / d+; s is what is left of the shift.
    s[0] = -value
    for i in range(n - 1):
        d = q[i] + s[i]
        d = d if d != 0.0 else -tiny - EPS * EPS * max(abs(value), q[i])
        up[i] = off[i] / d
        s[i + 1] = e[i] * s[i] / d - value
    # From the bottom: U- D- U-'.
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        d = e[i] + p[i + 1]
        d = d if d != 0.0 else -tiny - EPS * EPS * max(abs(value), q[i])
        low[i] = off[i] / d
        p[i] = q[i] * (p[i + 1] / d if e[i] else 1.0) - value
    return up, low, s + p + value


def _solve(up, low, r, n):
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
        if abs(z[i]) > 1e150:
            z /= abs(z[i])
    for i in range(r, n - 1):
        z[i + 1] = -low[i] * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= abs(z[i + 1])
    return z / np.sqrt(z @ z)


def vectors(q, e, values) -> np.ndarray:
    """Unit eigenvectors of ``B'B`` in columns, one per value of the falling list ``values``.

    Each comes from the twist with the smallest pivot. Vectors of values so close
    that they are not told apart are made orthogonal; if nothing is left of one,
    the next smallest pivot is taken.
    """
    q, e = np.asarray(q, float), np.asarray(e, float)
    n = len(q)
    found: list[np.ndarray] = []
    for k, value in enumerate(values):
        if n == 1:
            return np.ones((1, len(values)))
        up, low, pivots = _twisted(q, e, value)
        near = [z for z, v in zip(found, values[:k]) if v - value <= 1e-3 * abs(values[0])]
        for r in np.argsort(np.abs(pivots), kind="stable"):
            z = _solve(up, low, r, n)
            for _ in range(2):
                for other in near:
                    z = z - (other @ z) * other
            norm = np.sqrt(z @ z)
            if norm > 0.05:
                break
        found.append(z / norm)
    return np.stack(found, axis=1) if found else np.zeros((n, 0))


def right_singular(r: np.ndarray, count: int):
    """Squared singular values of ``r`` (falling, all) and the first ``count`` right singular vectors."""
    # Scaled by a power of two, so that squares neither overflow nor vanish.
    top = np.abs(r).max() if r.size else 0.0
    scale = 2.0 ** np.floor(np.log2(top)) if top > 0 else 1.0
    diagonal, above, p = bidiagonal(r / scale)
    q, e = diagonal**2, above**2
    values = dqds(q, e)
    z = vectors(q, e, values[:count])
    # sqrt(q e) lost the signs of B; a diagonal of signs brings them back.
    signs = np.cumprod(np.r_[1.0, np.where(diagonal[:-1] * above < 0, -1.0, 1.0)])
    v = p @ (signs[:, None] * z)
    return values * scale * scale, v / np.sqrt((v * v).sum(axis=0))
