"""Fits of one series in numpy: the seasonal naive and gradient boosting."""

from __future__ import annotations

import numpy as np

SEASON, LEAST_TREES, YEAR = 7, 30, 365.25
Z80, Z_NAIVE = 1.2816, 1.28  # fixed values: half-widths of 80% intervals in deviations


def seasonal_naive(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """The last week repeated, with the deviation of seasonal differences."""
    if len(y) < SEASON:
        raise ValueError(f"needs {SEASON} observations")
    spread = (y[SEASON:] - y[:-SEASON]).std() if len(y) > SEASON else 0.0
    return y[len(y) - SEASON + np.arange(horizon) % SEASON], np.full(horizon, spread)


def features(y: np.ndarray, days: np.ndarray, events: np.ndarray, first: int = 0) -> np.ndarray:
    """The 21 columns of `operators.features.feature_matrix` for the days from `first` on, in its order; y may end before the last day."""
    n = len(days)
    value = np.append(y, np.full(n - len(y), np.nan))
    at = np.arange(first, n)
    lag = lambda k: np.where(at >= k, value[np.maximum(at - k, 0)], np.nan)
    padded = np.append(np.zeros(1), np.cumsum(np.nan_to_num(value)))
    squares = np.append(np.zeros(1), np.cumsum(np.nan_to_num(value) ** 2))

    def rolling(w: int, least: int, spread: bool = False) -> np.ndarray:
        low = np.maximum(at - w, 0)
        count = at - low
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = (padded[at] - padded[low]) / count
            out = np.sqrt(np.maximum(squares[at] - squares[low] - count * mean**2, 0) / (count - 1)) if spread else mean
        return np.where(count >= least, out, np.nan)

    day = days[at].astype("datetime64[D]")
    dow = (day.astype(int) + 3) % 7
    month = day.astype("datetime64[M]").astype(int) % 12
    doy = (day - day.astype("datetime64[Y]")).astype(int) + 1
    angle = 2 * np.pi * doy / YEAR
    columns = [*(lag(k) for k in (1, 2, 3, 7, 14, 21, 28)), *(rolling(w, max(2, w // 2)) for w in (7, 14, 28)), rolling(7, 3, True), dow, month + 1, month // 3 + 1, doy, dow >= 5, np.sin(angle), np.cos(angle), np.sin(2 * angle), np.cos(2 * angle), np.isin(day, events)]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


class Trees:
    """Gradient-boosted trees over binned columns: splits are found from one histogram of all columns for each node."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rounds: int = 60, rate: float = 0.1, depth: int = 3, leaf: int = 5, bins: int = 64):
        self.rate, self.base = rate, float(target.mean())
        self.edges = [self._edges(c, bins) for c in x.T]
        self.bins, self.leaf = bins, leaf
        code = self._codes(x)
        fitted, self.trees = np.full(len(target), self.base), []
        for _ in range(rounds):
            tree, out = self._grow(code, target - fitted, depth)
            fitted = fitted + rate * out
            self.trees.append(tree)

    @staticmethod
    def _edges(column: np.ndarray, bins: int) -> np.ndarray:
        """Up to bins - 1 cuts, midway between neighbouring values near the column's quantiles."""
        known = np.unique(column)
        at = np.arange(1, len(known)) if len(known) <= bins else np.unique(np.searchsorted(known, np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]), "right").clip(1, len(known) - 1))
        return (known[at - 1] + known[at]) / 2

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, code: np.ndarray, g: np.ndarray, depth: int):
        mean = float(g.mean())
        if depth == 0 or len(g) < 2 * self.leaf:
            return mean, np.full(len(g), mean)
        width = code.shape[1]
        cell = (code + np.arange(width) * self.bins).ravel()
        total = np.bincount(cell, np.repeat(g, width), width * self.bins).reshape(width, -1).cumsum(axis=1)
        count = np.bincount(cell, minlength=width * self.bins).reshape(width, -1).cumsum(axis=1)
        rest = len(g) - count
        gain = np.where((count >= self.leaf) & (rest >= self.leaf), total**2 / np.maximum(count, 1) + (g.sum() - total) ** 2 / np.maximum(rest, 1), -np.inf)
        j, k = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, k] == -np.inf:
            return mean, np.full(len(g), mean)
        left = code[:, j] <= k
        low, a = self._grow(code[left], g[left], depth - 1)
        high, b = self._grow(code[~left], g[~left], depth - 1)
        out = np.empty(len(g))
        out[left], out[~left] = a, b
        return (j, k, low, high), out

    def predict(self, row: np.ndarray) -> float:
        code, out = self._codes(row[None, :])[0], self.base
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if code[tree[0]] <= tree[1] else tree[3]
            out += self.rate * tree
        return float(out)


def boosting(y: np.ndarray, days: np.ndarray, horizon: int, events: np.ndarray | None = None) -> np.ndarray:
    """Boosted trees over `features`, applied day after day to its own forecasts; never below zero."""
    events = np.array([], "datetime64[D]") if events is None else events
    rows = features(y, days, events)
    full = ~np.isnan(rows).any(axis=1)
    if full.sum() < LEAST_TREES:
        raise ValueError(f"needs {LEAST_TREES} complete rows")
    model = Trees(rows[full], y[full])
    history, calendar = y, np.append(days, days[-1] + np.arange(1, horizon + 1))
    for t in range(len(y), len(y) + horizon):
        row = np.nan_to_num(features(history, calendar[: t + 1], events, t)[0])
        history = np.append(history, max(0.0, model.predict(row)))
    return history[len(y) :]
