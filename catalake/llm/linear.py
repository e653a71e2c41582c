"""Small dense linear models, fitted on bounded samples."""

from __future__ import annotations

import numpy as np

#: A sparse fit ends when no slope exceeds this share of the rows' weight.
SLOPE = 2.5e-5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 30
) -> np.ndarray:
    """Newton steps for the penalised logistic loss; without rows the zero vector."""
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


class SparseRows:
    """Rows of a sparse matrix, kept by row and by column, without a table of all cells."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.shape = (len(sizes), width)
        self._by_row = (columns, values, np.asarray(sizes))
        order = np.argsort(columns, kind="stable")
        places = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self._by_column = (places[order], values[order], np.bincount(columns, minlength=width))

    @classmethod
    def of(cls, counts: np.ndarray | SparseRows) -> SparseRows:
        if isinstance(counts, cls):
            return counts
        rows, columns = np.nonzero(counts)
        return cls(np.bincount(rows, minlength=len(counts)), columns, counts[rows, columns], counts.shape[1])

    @staticmethod
    def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of runs of these sizes."""
        out, filled = np.zeros(len(sizes)), sizes > 0
        if filled.any():
            out[filled] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[filled])
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        columns, values, sizes = self._by_row
        terms = w.astype(values.dtype)[columns]
        terms *= values
        return self._sums(terms, sizes)

    def back(self, g: np.ndarray) -> np.ndarray:
        rows, values, sizes = self._by_column
        terms = g.astype(values.dtype)[rows]
        terms *= values
        return self._sums(terms, sizes)

    def present(self, g: np.ndarray) -> np.ndarray:
        """For each column, the sum of ``g`` over the rows that have it."""
        rows, _, sizes = self._by_column
        return self._sums(g[rows], sizes)


def minimum(f, w: np.ndarray, tolerance: float, rounds: int = 150, memory: int = 5) -> np.ndarray:
    """L-BFGS with halved steps; ``f`` gives a value and its gradient."""
    value, slope = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        way, shares = -slope, []
        for s, y, r in reversed(past):
            shares.append(r * (s @ way))
            way = way - shares[-1] * y
        way = way / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else way / np.abs(slope).max()
        for (s, y, r), share in zip(past, reversed(shares), strict=True):
            way = way + s * (share - r * (y @ way))
        down, step = slope @ way, 1.0
        new, new_slope = f(w + way)
        while new > value + 1e-4 * step * down and step > 1e-6:
            step /= 2
            new, new_slope = f(w + step * way)
        if new >= value:
            break
        s, y = step * way, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s.astype(np.float32), y.astype(np.float32), 1 / (s @ y))][-memory:]
        w, value, slope = w + s, new, new_slope
    return w


def fit_sparse(
    x: SparseRows, more: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None
) -> np.ndarray:
    """Weights of a constant, of the columns of ``x`` and of the columns of ``more``, for the penalised logistic loss.

    The penalty of a column of ``x`` falls with the square of the z-score by which its presence differs between the
    classes, so it does the selection and no column is cut. With one class only the model is its constant.
    """
    width = x.shape[1]
    yes, no = weight @ y, weight @ (1 - y)
    if not yes or not no:
        return np.concatenate([[np.log((yes + 0.5) / (no + 0.5))], np.zeros(width + more.shape[1])])
    a, b = x.present(weight * y), x.present(weight * (1 - y))
    share = (a + b + 0.5) / (yes + no + 1)
    z = ((a + 0.5) / (yes + 1) - (b + 0.5) / (no + 1)) / np.sqrt(share * (1 - share) * (1 / yes + 1 / no))
    scale = np.concatenate([[1.0], np.abs(z) / 4, np.ones(more.shape[1])])
    held = np.concatenate([[0.0], np.full(width + more.shape[1], penalty)])

    def loss(u):
        w = u * scale
        margin = w[0] + x.times(w[1 : width + 1]) + more @ w[width + 1 :]
        off = weight * (sigmoid(margin) - y)
        slope = np.concatenate([[off.sum()], x.back(off), off @ more]) * scale + held * u
        return weight @ (np.logaddexp(0, margin) - y * margin) + (held * u) @ u / 2, slope

    if start is None:
        begin = np.zeros(len(scale))
        begin[0] = np.log(yes / no)
    else:
        begin = np.divide(start, scale, out=np.zeros(len(scale)), where=scale > 1e-9)
    return minimum(loss, begin, SLOPE * weight.sum()) * scale


def folds_of(ids: np.ndarray, folds: int) -> np.ndarray:
    """A fold number per id that does not follow the order of ids."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % folds
