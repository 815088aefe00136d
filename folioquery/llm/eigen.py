"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, bisection by
Sturm counts, inverse iteration with reorthogonalisation inside clusters."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-3  # eigenvalues nearer than this share of the norm are kept orthogonal by hand
ROUNDS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a matrix similar to a symmetric one."""
    a = np.array(matrix, float)
    reflectors = []
    for j in range(len(a) - 2):
        v = a[j + 1 :, j].copy()
        length = np.linalg.norm(v)
        alpha = -length if v[0] >= 0 else length
        v[0] -= alpha
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        sub = a[j + 1 :, j + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1, j] = alpha
        reflectors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the given places."""
    tiny = EPS * max(1e-300, np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0))
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, to the last bits of a double."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(count, (diagonal - reach).min()), np.full(count, (diagonal + reach).max())
    wanted = len(diagonal) - np.arange(count)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        enough = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) z = right by elimination with row exchanges."""
    n = len(diagonal)
    d, up, up2 = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    low, z = off.tolist(), right.tolist()
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            d[k], up[k], up2[k], d[k + 1], up[k + 1], low[k] = low[k], d[k + 1], up[k + 1], up[k], 0.0, d[k]
            z[k], z[k + 1] = z[k + 1], z[k]
        factor = low[k] / (d[k] if abs(d[k]) > tiny else tiny)
        d[k + 1] -= factor * up[k]
        up[k + 1] -= factor * up2[k]
        z[k + 1] -= factor * z[k]
    for k in reversed(range(n)):
        rest = z[k] - (up[k] * z[k + 1] if k + 1 < n else 0.0) - (up2[k] * z[k + 2] if k + 2 < n else 0.0)
        z[k] = rest / (d[k] if abs(d[k]) > tiny else tiny)
    return np.array(z)


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of the ``count`` largest eigenvalues, falling. The
    largest entry of each vector is positive."""
    scale = np.abs(matrix).max(initial=0)
    n = len(matrix)
    count = min(count, n)
    if scale == 0:
        return np.zeros(count), np.eye(n)[:count]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    norm = (np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max()
    rng = np.random.default_rng(n)
    vectors, first = np.zeros((count, n)), 0
    for m, value in enumerate(values):
        if m and values[m - 1] - value > CLUSTER * norm:
            first = m
        z = rng.normal(size=n)
        for _ in range(ROUNDS):
            z = z / np.linalg.norm(z)
            z = _solve(diagonal, off, value, EPS * norm, z)
            z /= np.abs(z).max()  # so that squares cannot overflow
            for _ in range(2):
                z = z - vectors[first:m].T @ (vectors[first:m] @ z)
        vectors[m] = z / np.linalg.norm(z)
    for j in reversed(range(len(reflectors))):
        v = reflectors[j]
        vectors[:, j + 1 :] -= 2 * np.outer(vectors[:, j + 1 :] @ v, v)
    vectors *= np.where(vectors[np.arange(count), np.abs(vectors).argmax(axis=1)] < 0, -1, 1)[:, None]
    return values * scale, vectors
