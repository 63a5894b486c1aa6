"""Leading eigenpairs of a symmetric matrix by spectrum slicing: inertia counts isolate, Rayleigh quotients converge."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
_ALPHA = (1 + 17**0.5) / 8


def negatives(matrix: np.ndarray) -> int:
    """How many eigenvalues are below zero: the signs of D in a pivoted LDL^T of the matrix (Sylvester's law)."""
    a, n, k, found = matrix.copy(), len(matrix), 0, 0
    while k < n:
        width, own = 1, abs(a[k, k])
        if k + 1 < n:
            below = np.abs(a[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            most = below[r - k - 1]
            if own < _ALPHA * most:
                beside = np.abs(a[r, k:])
                beside[r - k] = 0
                reach = beside.max()
                if own * reach < _ALPHA * most * most:
                    width = 1 if abs(a[r, r]) >= _ALPHA * reach else 2
                    at = k + width - 1
                    a[[at, r]] = a[[r, at]]
                    a[:, [at, r]] = a[:, [r, at]]
        left, rest = a[k + width :, k : k + width].copy(), slice(k + width, n)
        if width == 2:  # such a block has one eigenvalue of each sign
            found += 1
            a[rest, rest] -= left @ np.linalg.solve(a[k : k + 2, k : k + 2], left.T)
        else:
            found += a[k, k] < 0
            if a[k, k]:
                a[rest, rest] -= left @ left.T / a[k, k]
        k += width
    return int(found)


class Slices:
    """Counts of the eigenvalues above shifts, and every count taken so far."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.eye = matrix, np.eye(len(matrix))
        reach = np.abs(matrix).sum(axis=1).max() or 1.0
        self.scale = reach
        self.known = {-2 * reach: len(matrix), 2 * reach: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = negatives(shift * self.eye - self.matrix)
        return self.known[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds the k-th largest eigenvalue."""
        return max(s for s, c in self.known.items() if c >= k), min(s for s, c in self.known.items() if c < k)

    def halve(self, k: int) -> None:
        lo, hi = self.bracket(k)
        self.above((lo + hi) / 2)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the up to `most` largest eigenvalues that are above rounding, falling.

    Shifts are halved until the counts leave one eigenvalue in an interval (or a cluster within rounding). Inverse
    iteration in its middle and Rayleigh quotient steps, which converge cubically, give the pair. The counts just above
    and below its value must give its number; else it ran off to a neighbour, and the interval is halved again. Vectors have their largest entry positive."""
    d, slices = len(matrix), Slices(matrix)
    tiny = 8 * d * EPS * slices.scale
    wanted = min(most, slices.above(tiny))
    values, vectors, rng = np.zeros(0), np.zeros((d, 0)), np.random.default_rng(11)

    def against(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - vectors @ (vectors.T @ v)
        return v / (np.linalg.norm(v) or 1.0)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(matrix - shift * slices.eye, v)
        except np.linalg.LinAlgError:
            return np.linalg.solve(matrix - (shift + tiny / 8) * slices.eye, v)

    for k in range(1, wanted + 1):
        while True:
            lo, hi = slices.bracket(k)
            alone = slices.known[lo] == k and slices.known[hi] == k - 1
            close = hi - lo <= tiny
            if not alone and not close:
                slices.halve(k)
                continue
            v = against(rng.standard_normal(d))
            for _ in range(2):
                v = against(solved((lo + hi) / 2, v))
            value = v @ matrix @ v
            for _ in range(12):
                if np.linalg.norm(matrix @ v - value * v) <= 2 * EPS * slices.scale:
                    break
                v = against(solved(value, v))
                value = v @ matrix @ v
            if slices.above(value + tiny) < k <= slices.above(value - tiny):
                break
            if close:
                raise ArithmeticError(f"eigenvalue {k} is not where its count says")
            slices.halve(k)
        v = v * np.sign(v[np.abs(v).argmax()])
        values, vectors = np.append(values, value), np.column_stack([vectors, v])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
