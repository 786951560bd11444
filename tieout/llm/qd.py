"""Eigenvalues and eigenvectors of a small Gram matrix R'R from its triangular factor R, without forming the product.

R is bidiagonalised by Householder reflections; the differential qd algorithm with shifts finds the squared singular values of the
bidiagonal matrix, from its entries alone, so that small ones are as accurate as large ones; twisted factorisations give the
vectors. Where values lie too close together for single vectors to be orthogonal, their common space is refined as one.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Values whose gap is a smaller part of them than this are taken as a cluster.
CLOSE = 1e-4
#: Values that are a smaller part of the largest are zero as far as can be told, and one cluster.
NOTHING = (100 * EPS) ** 2


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v) with r = u b v', b upper bidiagonal, u and v orthogonal."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray:
        w, size = x.copy(), np.linalg.norm(x)
        w[0] += np.copysign(size, x[0]) if size else 0.0
        length = np.linalg.norm(w)
        return w / length if length else w

    for k in range(d):
        w = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One transform by a shift; the least pivot is negative where the shift is too large."""
    new_q, new_e, d = np.empty_like(q), np.empty_like(e), q[0] - shift
    if d < 0:
        return new_q, new_e, -1.0
    least = d
    for k in range(len(e)):
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] > 0 else np.inf
        new_e[k] = e[k] * ratio if e[k] else 0.0
        d = d * ratio - shift
        if not np.isfinite(d) or d < 0:
            return new_q, new_e, -1.0
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Of an upper bidiagonal matrix, falling: dqds with deflation at both ends of the negligible."""
    found: list[float] = []
    blocks = [(diagonal.astype(float) ** 2, above.astype(float) ** 2, 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        if len(q) == 1:
            found.append(base + q[0])
            continue
        if not q.all():  # a zero on the diagonal: one step without a shift moves it to the end
            scale = max(q.max(), e.max())
            if scale == 0:
                found += [base] * len(q)
                continue
            q = np.maximum(q, scale * EPS**4)
        first, ended = True, False
        for _ in range(60 * len(q)):
            negligible = np.flatnonzero(e <= EPS**2 * (base + q[1:]) + EPS**4 * e.max(initial=0.0))
            if len(negligible):
                k = negligible[-1]
                blocks += [(q[: k + 1], e[:k], base), (q[k + 1 :], e[k + 1 :], base)]
                ended = True
                break
            if first:  # turned so that it falls, as deflation is at the end
                if q[0] < q[-1]:
                    q, e = q[::-1].copy(), e[::-1].copy()
                first = False
            least = q[-1] if len(q) == 1 else min(q[-1], _lower_bound(q, e))
            shift = max(least, 0.0)
            while True:
                new_q, new_e, least_pivot = _dqds_step(q, e, shift)
                if least_pivot >= 0 or shift == 0.0:
                    break
                shift = shift / 4 if shift > EPS * q.max() else 0.0
            q, e, base = new_q, new_e, base + shift
        if not ended:
            raise ArithmeticError("qd transforms have not settled")
    return np.sort(np.array(found))[::-1]


def _lower_bound(q: np.ndarray, e: np.ndarray) -> float:
    """A shift from the trailing two by two block, below its least value."""
    a, b, c = q[-2], e[-1], q[-1]
    total = a + b + c
    return 0.98 * 2 * a * c / (total + np.sqrt(max(total * total - 4 * a * c, 0.0))) if total else 0.0


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of b'b for an eigenvalue, by the twisted factorisation of b'b - value whose twist is least."""
    q, n = diagonal**2, len(diagonal)
    tiny = EPS * EPS * max(q.max(), value, np.finfo(float).tiny)
    side, square = diagonal[:-1] * above, above**2
    stationary, lower = np.empty(n), np.empty(max(n - 1, 0))  # from the top
    stationary[0] = -value
    for k in range(n - 1):
        pivot = stationary[k] + q[k] or tiny
        lower[k] = side[k] / pivot
        stationary[k + 1] = square[k] / pivot * stationary[k] - value
    progressive, upper = np.empty(n), np.empty(max(n - 1, 0))  # from the bottom
    progressive[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = square[k] + progressive[k + 1] or tiny
        upper[k] = side[k] / pivot
        progressive[k] = q[k] / pivot * progressive[k + 1] - value
    twist = np.abs(stationary + progressive + value)
    at = int(np.argmin(twist))
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -upper[k] * z[k]
    return z / np.linalg.norm(z)


def _refined(t: np.ndarray, values: np.ndarray, start: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of a cluster of values, by inverse iteration on its space, apart from the vectors of others."""
    x, scale = start + np.random.default_rng(0).standard_normal(start.shape) * 1e-3, max(abs(values).max(), EPS * np.abs(t).max())
    for _ in range(4):
        x -= others @ (others.T @ x)
        x, _ = np.linalg.qr(x)
        x = np.linalg.solve(t - (values.mean() + scale * 16 * EPS) * np.eye(len(t)), x)
    x -= others @ (others.T @ x)
    x, _ = np.linalg.qr(x)
    return x @ np.linalg.eigh(x.T @ t @ x)[1][:, ::-1]


def eigen_of_gram(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of r'r, values falling."""
    size = np.abs(r).max(initial=0.0)
    if size == 0:
        return np.zeros(r.shape[1]), np.eye(r.shape[1])
    diagonal, above, v = bidiagonalise(r / size)
    values = squared_singular_values(diagonal, above)
    b = np.diag(diagonal) + np.diag(above, 1)
    t = b.T @ b
    vectors = np.zeros((len(values), len(values)))
    begin = 0
    for k in range(1, len(values) + 1):
        if k < len(values) and (values[k - 1] - values[k] <= CLOSE * values[k - 1] or values[k - 1] <= NOTHING * values[0]):
            continue
        own = np.column_stack([twisted_vector(diagonal, above, x) for x in values[begin:k]])
        done = vectors[:, :begin]
        if k - begin > 1:
            own = _refined(t, values[begin:k], own, done)
        vectors[:, begin:k] = own
        begin = k
    return values * size * size, v @ vectors
