"""Leading eigenpairs of R'R from the bidiagonal form of a small square matrix R.

Householder reflectors bring R to an upper bidiagonal B (R = U B V').  The
squares of B's entries are the qd array that dqds works on: differences are
never taken between large numbers, so even small singular values keep their
relative accuracy.  Each wanted value then gets its vector from a twisted
factorisation of B'B - value: the top-down and the bottom-up factors are glued
where they agree best, and two short recurrences give the vector.

All work here is on d x d numbers (d: the vectors' dimension), on the driver.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-5  # values closer than this, relatively, are orthogonalised


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, a): the reflection I - 2vv' takes x to a times the first unit vector."""
    size = np.linalg.norm(x)
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), x[0]
    a = -np.copysign(size, x[0])
    v = x.copy()
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of R = U B V'."""
    m = np.array(r, dtype=float)
    d = len(m)
    right = np.eye(d)
    diagonal, above = np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        v, diagonal[k] = _reflector(m[k:, k])
        m[k:, k + 1:] -= 2 * np.outer(v, v @ m[k:, k + 1:])
        if k < d - 1:
            v, above[k] = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return diagonal, above, right


def _step(q: list, e: list, shift: float) -> tuple[list, list] | None:
    """One dqds transform; None where the shift passes the smallest value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    if d < 0:
        return None
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if new_q[k] <= 0:
            return None
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        if d < 0:
            return None
    new_q[-1] = d
    return new_q, new_e


def dqds(q: list, e: list) -> list:
    """Eigenvalues of B'B, falling, from the squares of B's entries (all q above 0)."""
    found, total = [], 0.0
    q, e = list(q), list(e)
    while q:
        n = len(q)
        if n == 1:
            found.append(total + q.pop())
            break
        if e[-1] <= (EPS * 4) ** 2 * (total + q[-1]):
            found.append(total + q.pop())
            e.pop()
            continue
        small = [k for k in range(n - 1) if e[k] <= (EPS * 4) ** 2 * (total + min(q[k], q[k + 1]))]
        if small:
            cut = small[-1] + 1
            found += [total + x for x in dqds(q[cut:], e[cut:])]
            q, e = q[:cut], e[:cut - 1]
            continue
        # The smaller eigenvalue of the trailing 2 x 2 block, a little reduced.
        a, b, c = q[-2], q[-1], e[-1]
        half = (a + b + c) / 2
        guess = a * b / (half + np.sqrt(max(half * half - a * b, 0.0)))
        for shift in (guess * (1 - 4 * EPS), guess * 0.75, guess * 0.25, 0.0):
            done = _step(q, e, shift)
            if done:
                q, e = done
                total += shift
                break
        if not done:
            raise ArithmeticError("qd array lost its signs")
    return sorted(found, reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(unit vector, correction of the value) of B'B for an unreduced block."""
    n = len(a)
    diag, low = a * a, b / a[:-1]
    s, p = np.zeros(n), np.zeros(n)
    down, up = np.zeros(n - 1), np.zeros(n - 1)
    tiny = np.finfo(float).tiny * 1e20
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + diag[k]
        down[k] = diag[k] * low[k] / (pivot if abs(pivot) > tiny else tiny)
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = diag[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = diag[k] * low[k] ** 2 + p[k + 1]
        ratio = diag[k] / (pivot if abs(pivot) > tiny else tiny)
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    gamma = s + p + value
    twist = int(np.nanargmin(np.abs(gamma)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    size = np.linalg.norm(z)
    return z / size, gamma[twist] / size**2


def _away(a, b, value, others) -> np.ndarray:
    """A vector of a cluster orthogonal to ``others``, by inverse iteration."""
    n = len(a)
    t = np.diag(a * a) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t[np.arange(1, n), np.arange(1, n)] += b * b
    t -= (value * (1 + 8 * EPS)) * np.eye(n)  # just beside the value: t can be inverted
    z = np.cos(np.arange(n) * (1.0 + len(others)))
    for _ in range(4):
        for o in others:
            z = z - (o @ z) * o
        z = np.linalg.solve(t, z / np.linalg.norm(z))
        z /= np.linalg.norm(z)
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the k largest eigenpairs of R'R, falling.

    Values that are zero to working accuracy are returned as 0.  Each vector's
    entry of largest size is positive.
    """
    d = len(r)
    scale = np.abs(r).max() if d else 0.0
    if scale == 0:
        return np.zeros(min(k, d)), np.eye(d)[:, :k]
    a, b, right = bidiagonalise(r / scale)
    # A zero on the diagonal has an equal at rounding level, far below any component.
    a = np.where(np.abs(a) < 1e-30, 1e-30, a)
    # Entries at the rounding level of R part the matrix.
    cuts = np.flatnonzero(np.abs(b) <= EPS * max(np.abs(a).max(), np.abs(b).max(initial=0.0)))
    edges = [0, *(cuts + 1).tolist(), d]
    pairs = []
    for start, stop in zip(edges[:-1], edges[1:]):
        q, e = a[start:stop] ** 2, b[start:stop - 1] ** 2
        pairs += [(value, start, stop) for value in dqds(q.tolist(), e.tolist())]
    pairs.sort(key=lambda x: (-x[0], x[1]))
    values, vectors, blocks = [], [], []
    for value, start, stop in pairs[:k]:
        z = np.zeros(d)
        if stop - start == 1:
            z[start] = 1.0
        else:
            own_a, own_b = a[start:stop], b[start:stop - 1]
            part, change = _twisted(own_a, own_b, value)
            if abs(change) < 1e-12 * value:
                part, _ = _twisted(own_a, own_b, value + change)
            near = [
                vectors[j][start:stop] for j in range(len(values))
                if blocks[j] == start and abs(values[j] - value) <= CLUSTER * value
            ]
            if near:
                part = _away(own_a, own_b, value, near)
            z[start:stop] = part
        values.append(value)
        vectors.append(z)
        blocks.append(start)
    found = right @ np.array(vectors).T
    at = np.abs(found).argmax(axis=0)
    found *= np.sign(found[at, np.arange(found.shape[1])])
    values = np.array(values)
    values[values <= (d * EPS) ** 2 * values[0]] = 0.0
    return values * scale**2, found
