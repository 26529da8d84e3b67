"""Singular values and right directions of a small triangular matrix by qd transforms.

The matrix is reduced to an upper bidiagonal one by Householder reflections. The squares
of its singular values are found by differential qd steps with shifts (dqds), which keep
even small ones to high relative accuracy; the direction of each comes from a twisted
factorisation of the tridiagonal matrix less the value, joined from its two ends where
the middle pivot is least. Matrices have as many rows as an embedding has components and
live in one process; tables are reduced to them elsewhere.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
MAX_STEPS = 60  # qd steps per value; a few are usual
CLOSE = 1e-3  # values nearer to each other than this, relatively, share a cluster


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V, so that the matrix is U B V' with orthogonal U, V."""
    m = np.array(matrix, np.float64)
    n = len(m)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        h = x.copy()
        h[0] += np.copysign(np.linalg.norm(x), x[0])
        size = h @ h
        return h, 2 / size if size else 0.0

    for k in range(n):
        h, scale = reflector(m[k:, k])
        m[k:, k:] -= scale * np.outer(h, h @ m[k:, k:])
        if k < n - 1:
            h, scale = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= scale * np.outer(m[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= scale * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd step; also the least pivot, negative if the shift was too large."""
    d = q[0] - shift
    least = d
    new_q, new_e = [], []
    for i in range(len(e)):
        s = d + e[i]
        if s <= 0:
            return new_q, new_e, min(least, s, -1.0 * abs(s) - EPS)
        ratio = q[i + 1] / s
        new_q.append(s)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def qd_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal matrix (a, b)."""
    found: list[float] = []
    work = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while work:
        q, e, sigma = work.pop()
        steps = 0
        guess = None
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            # entries that no longer matter split the matrix or give up its last value
            cut = next(
                (
                    i
                    for i in range(n - 2, -1, -1)
                    if e[i] <= (EPS**2) * (sigma + q[i + 1]) or e[i] <= (EPS**2) * (sigma + q[i])
                    or e[i] == 0.0
                ),
                None,
            )
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                steps, guess = 0, None
                continue
            if q[-1] > 4 * q[0]:  # values converge at the end where they are small
                q, e = _flipped(q, e)
            steps += 1
            if steps > MAX_STEPS * n:
                raise ArithmeticError("qd steps do not converge")
            shift = _shift(q, e) if guess is None else guess
            while True:
                new_q, new_e, least = dqds(q, e, shift)
                if least >= 0 and len(new_q) == n:
                    break
                shift = shift / 4 if shift > EPS * (sigma + min(q)) else 0.0
                if shift == 0.0:
                    new_q, new_e, least = dqds(q, e, 0.0)
                    break
            sigma += shift
            q, e = new_q, new_e
            # the least pivot lies above the least value and close to it in the end
            guess = 0.0 if least <= 0 else None
    return np.array(sorted(found, reverse=True))


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same values read from the other end."""
    n = len(q)
    # q_i e_i are products of neighbouring entries of B'B; one reversed factorisation
    diagonal = [q[0], *(q[i + 1] + e[i] for i in range(n - 1))]
    products = [q[i] * e[i] for i in range(n - 1)]
    diagonal.reverse()
    products.reverse()
    new_q, new_e = [diagonal[0]], []
    for i in range(n - 1):
        new_e.append(products[i] / new_q[i] if new_q[i] > 0 else 0.0)
        new_q.append(max(diagonal[i + 1] - new_e[i], 0.0))
    return new_q, new_e


def _shift(q: list[float], e: list[float]) -> float:
    """A shift below the least value, or a little above it and then taken back.

    Without a shift the pivots of a step are bounds from above; sums of their inverses
    give one from below.
    """
    d = q[0]
    inverse = 1.0 / d if d > 0 else np.inf
    least = d
    for i in range(len(e)):
        s = d + e[i]
        if s <= 0:
            return 0.0
        d *= q[i + 1] / s
        least = min(least, d)
        inverse += 1.0 / d if d > 0 else np.inf
    if least <= 0:
        return 0.0
    # trace of the inverse: between 1 / least value and n / least value
    return max(1.0 / inverse if np.isfinite(inverse) else 0.0, 0.0)


def _twisted(a: np.ndarray, b: np.ndarray, value: float, skip: int) -> np.ndarray:
    """A direction of B'B for a value, twisted at the place of the ``skip``-th least pivot.

    Pivots come from above and from below by differential steps on the squares of the
    entries of B; the direction is solved for from the place r where both meet.
    """
    n, q, e = len(a), a * a, b * b
    tiny = np.finfo(np.float64).tiny * 1e10
    diagonal = q.copy()
    diagonal[1:] += e
    off = a[:-1] * b
    down, up = np.empty(n), np.empty(n)
    s = -value
    for i in range(n):  # stationary: pivots from above without subtracting near equals
        down[i] = s + q[i] or tiny
        if i < n - 1:
            s = s * e[i] / down[i] - value if np.isfinite(s) else -value
    p = q[-1] - value
    for i in range(n - 1, 0, -1):  # progressive: pivots from below
        up[i] = p + e[i - 1] or tiny
        p = p * q[i - 1] / up[i] - value
    up[0] = p or tiny
    middle = down + up - (diagonal - value)
    r = int(np.argsort(np.abs(middle))[min(skip, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -off[i] * z[i + 1] / down[i]
    for i in range(r + 1, n):
        z[i] = -off[i - 1] * z[i - 1] / up[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size else np.eye(n)[r]


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit directions of B'B in columns, for its largest values in falling order."""
    q, e = a * a, b * b
    n = len(a)
    # blocks that do not touch have directions of their own
    edges = [0, *(np.flatnonzero(e <= (EPS**2) * np.minimum(q[:-1], q[1:])) + 1).tolist(), n]
    blocks = [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo]
    of_block = [
        (float(x), lo, hi) for lo, hi in blocks for x in qd_values(a[lo:hi], b[lo : hi - 1])
    ]
    of_block.sort(key=lambda x: -x[0])
    found = np.zeros((n, len(values)))
    for k, value in enumerate(values):
        near, lo, hi = of_block[k]
        cluster = [
            i for i in range(k) if abs(values[i] - value) <= CLOSE * max(abs(value), EPS)
        ]
        best, left = None, 0.0
        for skip in range(min(hi - lo, 8)):
            z = np.zeros(n)
            z[lo:hi] = _twisted(a[lo:hi], b[lo : hi - 1], near, skip)
            for _ in range(2):
                z -= found[:, cluster] @ (found[:, cluster].T @ z)
            size = np.linalg.norm(z)
            if size > left:
                best, left = z / size, size
            if size > 0.5:
                break
        if left <= 0.5:
            best = _inverse_iteration(a, b, value, found[:, cluster], k)
        found[:, k] = best
    return found


def _inverse_iteration(
    a: np.ndarray, b: np.ndarray, value: float, known: np.ndarray, seed: int
) -> np.ndarray:
    """A direction for a value that is repeated to the last bits, apart from known ones."""
    n = len(a)
    off = a[:-1] * b
    shifted = np.diag(a * a) + np.diag(off, 1) + np.diag(off, -1)
    shifted[range(1, n), range(1, n)] += b * b
    shifted -= np.eye(n) * value * (1 + 4 * EPS)
    z = np.random.default_rng(seed).normal(size=n)
    for _ in range(4):
        z -= known @ (known.T @ z)
        z /= np.linalg.norm(z)
        z = np.linalg.lstsq(shifted, z, rcond=EPS**2)[0]
        z /= np.linalg.norm(z)
    for _ in range(2):
        z -= known @ (known.T @ z)
    return z / np.linalg.norm(z)


def top_directions(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values above rounding, and their right directions."""
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    a, b, v = bidiagonal(matrix / size)
    values = qd_values(a, b)
    kept = values[:most]
    kept = kept[kept > (EPS * len(matrix)) ** 2 * values[0]]
    z = directions(a, b, kept)
    found = v @ z
    # either sign is right; the largest entry is made positive
    at = np.abs(found).argmax(axis=0)
    found *= np.where(found[at, np.arange(len(kept))] < 0, -1.0, 1.0)
    return kept * size * size, found
