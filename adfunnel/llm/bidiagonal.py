"""Singular values and right vectors of a small square matrix by its bidiagonal form.

Householder reflections reduce the matrix to upper bidiagonal form, the dqds transform finds
the squared singular values, and twisted factorisations of ``B'B - s^2 I`` give a vector for
each wanted one. The matrix is the triangular factor of a distributed QR, so its order is
the number of columns of the data, never the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
_DONE = (16 * EPS) ** 2


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and ``b`` with ``(I - b v v') x = (alpha, 0, ...)``."""
    v = x.astype(float).copy()
    norm = np.linalg.norm(v)
    if norm == 0 or not np.any(v[1:]):
        return v, 0.0
    v[0] += np.copysign(norm, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal (both made non-negative) and right factor of ``r = U B V'``."""
    a, d = r.astype(float).copy(), len(r)
    right = np.eye(d)
    for k in range(d):
        v, b = _reflector(a[k:, k])
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, b = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= b * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= b * np.outer(right[:, k + 1:] @ v, v)
    diagonal, above = np.diag(a).copy(), np.diag(a, 1).copy()
    for k in range(d):  # signs of columns go to the right factor, those of rows to the left one
        if k and above[k - 1] < 0:
            above[k - 1], diagonal[k], right[:, k] = -above[k - 1], -diagonal[k], -right[:, k]
        if diagonal[k] < 0:
            diagonal[k] = -diagonal[k]
            if k < d - 1:
                above[k] = -above[k]
    return diagonal, above, right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform and its smallest ``d`` (negative: the shift was too large)."""
    qs, es, d = [], [], q[0] - shift
    least = d
    for i, ei in enumerate(e):
        top = d + ei
        if d < 0 or top <= 0:
            return qs, es, -1.0
        t = q[i + 1] / top
        qs.append(top)
        es.append(ei * t)
        d = d * t - shift
        least = min(least, d)
    qs.append(d)
    return qs, es, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All ``s^2`` of an upper bidiagonal matrix, largest first, by dqds with shifts and splits."""
    out = []
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while todo:
        q, e, base = todo.pop()
        shift = 0.0
        while q:
            if len(q) == 1:
                out.append(base + q.pop())
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _DONE * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], base))
                q, e, shift = q[cut + 1:], e[cut + 1:], 0.0
                continue
            if q[0] < q[-1]:  # graded the other way: the flipped matrix converges faster
                q, e = q[::-1], e[::-1]
            qs, es, least = _step(q, e, shift)
            while least < 0 and shift > 0:
                shift = shift / 4 if shift > base * EPS else 0.0
                qs, es, least = _step(q, e, shift)
            q, e, base = qs, es, base + shift
            shift = max(0.0, least - e[-1]) if least == q[-1] else 0.875 * least
    return np.sort(np.array(out))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Unit vector of ``B'B - value I`` nearly in its null space and a correction of ``value``."""
    n, tiny = len(a), EPS * EPS * max(float(a.max(initial=0)), float(b.max(initial=0)), 1e-150) ** 2
    s, p = np.empty(n), np.empty(n)
    low, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = a[i] * a[i] + s[i] or tiny
        low[i] = a[i] * b[i] / pivot
        s[i + 1] = low[i] * (b[i] / a[i]) * s[i] - value
    p[-1] = a[-1] * a[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = b[i] * b[i] + p[i + 1] or tiny
        up[i] = a[i] * b[i] / pivot
        p[i] = p[i + 1] * (a[i] * a[i] / pivot) - value
    twist = s + p + value
    k = int(np.argmin(np.abs(twist)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    norm = float(z @ z)
    return z / np.sqrt(norm), float(twist[k]) / norm


def _orthogonal(z: np.ndarray, to: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = z - to @ (to.T @ z)
    return z


def _inverse_iterated(diagonal: np.ndarray, above: np.ndarray, value: float, to: np.ndarray) -> np.ndarray:
    """A vector of ``value`` orthogonal to the columns ``to`` (of nearly the same value)."""
    d = len(diagonal)
    whole = np.diag(diagonal) + np.diag(above, 1)
    shifted = whole.T @ whole - (value * (1 + 64 * EPS)) * np.eye(d)
    z = _orthogonal(np.cos(np.arange(1.0, d + 1)), to)
    for _ in range(4):
        z = _orthogonal(np.linalg.solve(shifted + EPS * EPS * np.eye(d), z / np.linalg.norm(z)), to)
    return z


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Columns: eigenvectors of ``B'B`` for the ``wanted`` largest of its ``values``.

    Each unreduced block has simple eigenvalues; vectors of nearly equal ones are made
    orthogonal to those found before.
    """
    d, scale = len(diagonal), float(max(diagonal.max(initial=0), above.max(initial=0)))
    a = np.maximum(diagonal, EPS * EPS * scale)
    edges = [0, *(np.flatnonzero(above <= EPS * scale) + 1), d]
    found = []  # (value, vector)
    for lo, hi in zip(edges, edges[1:]):
        block_a, block_b = a[lo:hi], above[lo:hi - 1]
        own = squared_singular_values(block_a, block_b) if len(edges) > 2 else values
        for value in own[:wanted]:
            z, better = _twisted(block_a, block_b, float(value))
            if value + better > 0:
                z, _ = _twisted(block_a, block_b, float(value) + better)
            whole = np.zeros(d)
            whole[lo:hi] = z
            found.append((float(value), whole))
    found.sort(key=lambda x: -x[0])
    out = np.zeros((d, 0))
    for i, (_, z) in enumerate(found[:wanted]):
        near = [j for j in range(i) if found[j][0] - found[i][0] <= 1e-3 * found[j][0]]
        if near:
            z = _orthogonal(z, out[:, near])
            if np.linalg.norm(z) < 1e-6:  # the block's vectors of these values fell together
                z = _inverse_iterated(diagonal, above, found[i][0], out[:, near])
            z = z / np.linalg.norm(z)
        out = np.column_stack([out, z])
    return out
