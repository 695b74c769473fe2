"""Eigenvectors of a symmetric matrix by mixed-precision refinement: a float32 solution, corrected by matrix products in extended precision.

The correction is that of Ogita and Aishima (2018): with R = I - X'X and S = X'AX, X becomes X + XE, where E(i, j) is (S(i, j) + w(j) R(i, j)) /
(w(j) - w(i)) for well separated eigenvalues and R(i, j) / 2 for the others; it converges quadratically. Clustered eigenvalues, whose gaps are
below what S and R can tell apart, are solved for anew in the small space of their vectors (their 2019 paper), after a shift to their mean.
"""

from __future__ import annotations

import numpy as np

WIDE = np.longdouble


def clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Index sets, of two or more, of eigenvalues that neighbours no further than `width` apart chain together."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(vectors after one correction, eigenvalues, gap below which they are clustered, largest entry of the correction)."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    rest = s - np.diag(np.diag(s))
    width = 2 * (np.sqrt((rest * rest).sum()) + np.abs(values).max() * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > width
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, width, float(np.abs(e).max())


def _turned(a: np.ndarray, x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The vectors `among`, turned within the space that they span to eigenvectors of A there."""
    part = x[:, among]
    mean = (part * (a @ part)).sum() / len(among)
    small = part.T @ (a @ part - mean * part)
    most = np.abs(small).max()
    if not most:
        return part
    _, turn = np.linalg.eigh((small / most).astype(np.float64))
    return part @ turn.astype(WIDE)


def eigenvectors(matrix: np.ndarray, most_steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, to the precision of doubles, as extended numbers.

    Vectors of equal eigenvalues are some orthonormal basis of their space. The sign makes each vector's largest entry positive.
    """
    a = np.asarray(matrix, WIDE)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    enough, last = 64 * len(a) * float(np.finfo(WIDE).eps), np.inf
    for _ in range(most_steps):
        x, values, width, step = _corrected(a, x)
        for among in clusters(values, width):
            x[:, among] = _turned(a, x, among)
        if step <= enough or step >= last and last < 1e-15:
            break
        last = step
    x = x @ (WIDE(1.5) * np.eye(len(a)) - x.T @ x / 2)  # a turn in doubles leaves vectors orthogonal to doubles only
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return values[order] * scale, x
