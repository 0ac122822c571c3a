"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation,
Sturm-count bisection and inverse iteration, in numpy."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: eigenvalues nearer than this part of the norm are one cluster
CLUSTER = 1e-3
#: rounds of inverse iteration
ROUNDS = 5


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(diagonal, off-diagonal, reflectors)`` of a matrix with entries up to 1.

    The reflector j acts on rows j + 1 and on; it is zero where the column is."""
    a = np.array(a, float)
    n, reflectors, off = len(a), [], np.zeros(max(len(a) - 1, 0))
    for j in range(n - 1):
        x = a[j + 1:, j].copy()
        norm = float(np.linalg.norm(x))
        v = np.zeros(len(x))
        if j == n - 2:
            off[j] = x[0]
            break
        if norm > EPS * EPS:  # what is smaller is rounding, and its squares would underflow
            v = x / norm
            v[0] += np.copysign(1.0, v[0])
            v /= np.linalg.norm(v)
            off[j] = -np.copysign(norm, x[0])
            p = a[j + 1:, j + 1:] @ v
            w = 2 * (p - (v @ p) * v)
            a[j + 1:, j + 1:] -= np.column_stack([v, w]) @ np.vstack([w, v])
        reflectors.append(v)
    return np.diag(a).copy(), off, reflectors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x the number of eigenvalues of the tridiagonal matrix below it."""
    tiny = np.finfo(float).tiny / EPS
    q = d[0] - x
    below = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, all bisected at the same time."""
    n = len(d)
    around = np.zeros(n)
    around[:-1] += np.abs(e)
    around[1:] += np.abs(e)
    low, high = float((d - around).min()), float((d + around).max())
    slack = EPS * max(abs(low), abs(high)) * n + np.finfo(float).tiny
    a, b = np.full(k, low - slack), np.full(k, high + slack)
    place = n - np.arange(k)  # the eigenvalue sought is the place-th smallest
    for _ in range(200):
        mid = (a + b) / 2
        if np.all((mid <= a) | (mid >= b) | (b - a <= 2 * EPS * np.maximum(np.abs(a), np.abs(b)))):
            break
        above = sturm_count(d, e, mid) >= place
        a, b = np.where(above, a, mid), np.where(above, mid, b)
    return (a + b) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """``(T - shift_j) x_j = b_j`` for all columns j: elimination with row exchanges."""
    n, k = b.shape
    least = EPS * scale
    up0, up1, up2 = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    x = b.copy()
    pivot, nxt = d[0] - shift, np.full(k, e[0] if n > 1 else 0.0)
    for i in range(n - 1):
        under, diag, right = np.full(k, e[i]), d[i + 1] - shift, np.full(k, e[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(under) > np.abs(pivot)
        r0, r1, r2 = np.where(swap, under, pivot), np.where(swap, diag, nxt), np.where(swap, right, 0.0)
        s0, s1, s2 = np.where(swap, pivot, under), np.where(swap, nxt, diag), np.where(swap, 0.0, right)
        r0 = np.where(np.abs(r0) < least, least, r0)
        up0[i], up1[i], up2[i] = r0, r1, r2
        top, low = np.where(swap, x[i + 1], x[i]), np.where(swap, x[i], x[i + 1])
        by = s0 / r0
        x[i], x[i + 1] = top, low - by * top
        pivot, nxt = s1 - by * r1, s2 - by * r2
    up0[n - 1] = np.where(np.abs(pivot) < least, least, pivot)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= up0[i]
        big = np.abs(x).max(axis=0)  # a nearly singular matrix gives huge solutions; only directions matter
        over = big > 1e200
        if over.any():
            x[:, over] /= big[over]
    return x


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling ``values`` as columns; those of a cluster are made orthogonal each round."""
    n, k = len(d), len(values)
    scale = max(float(np.abs(d).max(initial=0)) + 2 * float(np.abs(e).max(initial=0)), np.finfo(float).tiny)
    shift = values.copy()
    for j in range(1, k):  # equal shifts would give equal solutions
        shift[j] = min(shift[j], shift[j - 1] - 4 * EPS * scale)
    first = [0]
    for j in range(1, k):
        first.append(first[-1] if values[j - 1] - values[j] <= CLUSTER * scale else j)
    x = np.random.default_rng(12).standard_normal((n, k))
    for _ in range(ROUNDS):
        x = _solve(d, e, shift, x / np.linalg.norm(x, axis=0), scale)
        x /= np.abs(x).max(axis=0)
        for j in range(k):
            x[:, j] /= np.linalg.norm(x[:, j])
            near = x[:, first[j]:j]
            for _ in range(2 if j > first[j] else 0):
                x[:, j] -= near @ (near.T @ x[:, j])
            x[:, j] /= np.linalg.norm(x[:, j])
    return x


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns; each one's largest entry is positive."""
    n = len(a)
    k = min(k, n)
    if not k:
        return np.zeros(0), np.zeros((n, 0))
    scale = float(np.abs(a).max())
    if scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, reflectors = tridiagonal(a / scale)
    x = tridiagonal_vectors(d, e, leading_values(d, e, k))
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        x[j + 1:] -= 2 * np.outer(v, v @ x[j + 1:])
    x /= np.linalg.norm(x, axis=0)
    # the quotient is exact to the square of the vectors' error
    values = np.einsum("ij,ij->j", x, (a / scale) @ x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, x
