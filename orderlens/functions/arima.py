"""Automatic seasonal ARIMA of many series side by side.

Differences come from tests: one seasonal difference where the season is strong, plain ones while a KPSS test rejects a
level. Orders come from a stepwise search: of each series the best model so far and all its neighbours are fitted, until no
neighbour has a smaller AICc. A fit maximises the exact Gaussian likelihood by a Kalman filter, in quasi-Newton steps over
partial autocorrelations, so every model is stationary and invertible. All models of all series, and all points that a step
tries, are lanes of the same arrays: one pass over the days serves them all.

The filter's gain does not depend on the data; it is followed for `SETTLE` days and then held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .search import descend

SEASON, LEAST = 7, 21
STRONG, KPSS_LEVEL, MOST_DIFFERENCES = 0.64, 0.463, 2  # fixed values: bound of seasonal strength, 5% point of the test
SETTLE = 120


@dataclass(frozen=True)
class Limits:
    """Largest orders (p, q, P, Q), and their largest sum."""

    most: tuple[int, int, int, int]
    total: int


REDUCED, WIDE = Limits((2, 2, 1, 1), 3), Limits((5, 5, 2, 2), 8)
# The models that a search starts from.
FIRST = [(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1), (1, 1, 0, 1), (2, 0, 0, 0)]


def seasonal_strength(y: np.ndarray) -> float:
    """1 less the remainder's share of the variance of season and remainder, around a centred week's mean."""
    half = SEASON // 2
    trend = np.convolve(y, np.ones(SEASON) / SEASON, "valid")
    rest = y[half : half + len(trend)] - trend
    at = np.arange(len(rest)) % SEASON
    season = (np.bincount(at, rest, SEASON) / np.maximum(np.bincount(at, minlength=SEASON), 1))[at]
    season, whole = season - season.mean(), rest.var()
    return max(0.0, 1 - (rest - season).var() / whole) if whole > 0 else 0.0


def kpss(y: np.ndarray) -> float:
    """Statistic of the KPSS test of a level, with Bartlett weights over 3 sqrt(n) / 13 lags."""
    e = y - y.mean()
    lags = int(3 * np.sqrt(len(e)) / 13)
    long = e @ e / len(e) + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / len(e) for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (len(e) ** 2 * long)) if long > 0 else 0.0


def differences(y: np.ndarray) -> tuple[int, int]:
    """(d, D) of a series."""
    seasonal = int(len(y) > 4 * SEASON and seasonal_strength(y) > STRONG)
    w, d = (y[SEASON:] - y[:-SEASON]) if seasonal else y, 0
    while d < MOST_DIFFERENCES - seasonal and len(w) > 2 * SEASON and w.std() > 1e-9 and kpss(w) > KPSS_LEVEL:
        w, d = np.diff(w), d + 1
    return d, seasonal


def differenced(y: np.ndarray, d: int, seasonal: int) -> np.ndarray:
    w = y[SEASON:] - y[:-SEASON] if seasonal else y
    return np.diff(w, d) if d else w


def _coefficients(x: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions from free numbers (order, lanes), by the Durbin-Levinson recursion."""
    partial = np.tanh(x / 2)
    out = np.zeros_like(partial)
    for k in range(len(x)):
        out[:k] = out[:k] - partial[k] * out[:k][::-1]
        out[k] = partial[k]
    return out


def _product(plain: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
    """Coefficients, from lag 1 on, of (1 - plain)(1 - seasonal at multiples of SEASON), negated."""
    lags = len(plain) + SEASON * len(seasonal)
    out = np.zeros((lags + 1, plain.shape[1]))
    out[0] = 1
    out[1 : len(plain) + 1] = -plain
    whole = out.copy()
    for k, c in enumerate(seasonal, 1):
        whole[k * SEASON : k * SEASON + len(plain) + 1] -= c * out[: len(plain) + 1]
    return -whole[1:]


@dataclass
class Lanes:
    """Differenced series that end on the same row; for each lane its series and its first row, first rows in order."""

    w: np.ndarray
    of: np.ndarray
    begin: np.ndarray
    orders: np.ndarray  # (4, lanes): p, q, P, Q
    mean: np.ndarray

    def wide(self, times: int) -> Lanes:
        r = lambda x: np.repeat(x, times, axis=-1)
        return Lanes(self.w, r(self.of), r(self.begin), r(self.orders), r(self.mean))


def _polynomials(lanes: Lanes, x: np.ndarray, most: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive and moving-average coefficients (state size, lanes) of free numbers x (sum of most, lanes)."""
    edge = np.cumsum([0, *most])
    parts = []
    for k in range(4):
        free = x[edge[k] : edge[k + 1]].copy()
        # A short order's unused partial autocorrelations are zero, so its coefficients end there.
        free[np.arange(most[k])[:, None] >= lanes.orders[k]] = 0
        parts.append(_coefficients(free))
    ar, ma = _product(parts[0], parts[2]), -_product(-parts[1], -parts[3])
    size = max(len(ar), len(ma) + 1)
    phi, theta = np.zeros((size, x.shape[1])), np.zeros((size, x.shape[1]))
    phi[: len(ar)] = ar
    theta[0] = 1
    theta[1 : len(ma) + 1] = -ma
    return phi, theta


def _gains(phi: np.ndarray, theta: np.ndarray, days: int) -> tuple[np.ndarray, np.ndarray]:
    """Gains (days, size, lanes) and innovation variances (days, lanes) in units of the error's variance."""
    size, count = phi.shape
    move = np.zeros((count, size, size))
    move[:, :, 0] = phi.T
    move[:, np.arange(size - 1), np.arange(1, size)] = 1
    load = theta.T
    noise = load[:, :, None] * load[:, None, :]
    state, power = noise.copy(), move.copy()
    for _ in range(12):  # doubling: the first 2^12 terms of the stationary variance
        more = power @ state @ power.transpose(0, 2, 1)
        state = state + more
        if np.abs(more).max(initial=0) < 1e-9:
            break
        power = power @ power
    # From a stationary start the variance moves by products of one vector, so a day costs a vector, not a matrix.
    ahead = lambda v: phi * v[0] + np.concatenate([v[1:], np.zeros((1, count))])
    f = np.maximum(state[:, 0, 0], 1e-12)
    k = ahead(state[:, :, 0].T)
    change, weight = k.copy(), -1 / f
    gain, variance = np.zeros((days, size, count)), np.ones((days, count))
    for t in range(days):
        gain[t], variance[t] = k / f, f
        first = change[0]
        new_f = np.maximum(f + first * first * weight, 1e-12)
        if np.abs(new_f - f).max(initial=0) < 1e-9:
            gain[t:], variance[t:] = gain[t], f
            break
        moved = ahead(change)
        k = k + moved * (weight * first)
        weight = weight + weight * weight * first * first / f
        f = new_f
        change = moved - k / f * first
    return gain, variance


def kalman(lanes: Lanes, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-2 log likelihood (variance concentrated out, up to a constant), error variance, and the state after the last day."""
    rows, count = len(lanes.w), phi.shape[1]
    n = rows - lanes.begin
    days = int(min(SETTLE, rows))
    gain, variance = _gains(phi, theta, days)
    state, squares = np.zeros_like(phi), np.zeros(count)
    starts = np.searchsorted(lanes.begin, np.arange(rows), "right")
    lane = np.arange(count)
    settled = int(lanes.begin.max(initial=0)) + days - 1
    last, flat = gain[-1], 1 / variance[-1]
    old = np.seterr(all="ignore")  # a lane that runs away scores infinity
    for t in range(rows):
        c = starts[t]
        if not c:
            continue
        now = state[:, :c]
        error = lanes.w[t, lanes.of[:c]] - lanes.mean[:c] - now[0]
        if t >= settled:
            k, weight = last, flat
        else:
            age = np.minimum(t - lanes.begin[:c], days - 1)
            k, weight = gain[age, :, lane[:c]].T, 1 / variance[age, lane[:c]]
        squares[:c] += error * error * weight[:c]
        new = phi[:, :c] * now[0] + k[:, :c] * error
        new[:-1] += now[1:]
        state[:, :c] = new
    np.seterr(**old)
    logs = np.cumsum(np.log(variance), axis=0)
    determinant = logs[np.minimum(n, days) - 1, lane] + np.maximum(n - days, 0) * np.log(variance[-1])
    squares = np.maximum(squares, 1e-300)
    fit = n * np.log(squares / n) + determinant
    return np.where(np.isfinite(fit), fit, np.inf), squares / n, state


def _fit(series: list[np.ndarray], jobs: list[tuple[int, tuple[int, int, int, int], bool]], near: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, Lanes, tuple, list]:
    """Fits (series, orders, with a mean); returns values, free numbers, lanes, sizes, and the jobs in the order of lanes.

    `near` has the free numbers of a series' best model so far, from which its neighbours start.
    """
    rows = max(len(w) for w in series)
    jobs = sorted(jobs, key=lambda j: -len(series[j[0]]))
    w = np.full((rows, len(series)), np.nan)
    for s, values in enumerate(series):
        w[rows - len(values) :, s] = values
    of = np.array([j[0] for j in jobs])
    orders = np.array([j[1] for j in jobs]).T
    mean = np.array([series[s].mean() if m else 0.0 for s, _, m in jobs])
    lanes = Lanes(w, of, rows - np.array([len(series[s]) for s in of]), orders, mean)
    most = tuple(int(k) for k in orders.max(axis=1))
    count = len(jobs)

    def score(x: np.ndarray) -> np.ndarray:
        points = len(x)
        many = lanes.wide(points)
        flat = np.moveaxis(x, 0, 2).reshape(sum(most), count * points)
        return kalman(many, *_polynomials(many, flat, most))[0].reshape(count, points).T

    start, edge = np.full((sum(most), count), 0.2), np.cumsum([0, *most])
    for lane, job in enumerate(jobs):
        for k, known in enumerate(near.get(job[0], ())):
            size = min(len(known), most[k])
            start[edge[k] : edge[k] + size, lane] = known[:size]
    value, x = (score(start[None])[0], start) if not sum(most) else descend(score, start)[::-1]
    return value, x, lanes, most, jobs


def _neighbours(orders: tuple[int, int, int, int], mean: bool, limits: Limits, may_have_mean: bool):
    moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1), (1, -1, 0, 0), (0, 0, 1, -1)]
    for move in moves:
        for sign in (1, -1):
            to = tuple(a + sign * b for a, b in zip(orders, move, strict=True))
            if all(0 <= a <= m for a, m in zip(to, limits.most, strict=True)) and sum(to) <= limits.total:
                yield to, mean
    if may_have_mean:
        yield orders, not mean


@dataclass
class Fit:
    orders: tuple[int, int, int, int]
    differences: tuple[int, int]
    mean: bool
    aicc: float
    point: np.ndarray
    spread: np.ndarray
    tried: int


def _weights(phi: np.ndarray, theta: np.ndarray, d: int, seasonal: int, horizon: int) -> np.ndarray:
    """Weights of past errors in the undifferenced series, from lag 0."""
    ar = np.append(1.0, -phi)
    for _ in range(d):
        ar = np.convolve(ar, [1.0, -1.0])
    if seasonal:
        ar = np.convolve(ar, np.append(np.append(1.0, np.zeros(SEASON - 1)), -1.0))
    out = np.zeros(horizon)
    for j in range(horizon):
        out[j] = (theta[j] if j < len(theta) else 0.0) - sum(ar[k] * out[j - k] for k in range(1, min(j, len(ar) - 1) + 1))
    return out


def fit_many(series: list[np.ndarray], horizon: int, limits: Limits = REDUCED) -> list[Fit | None]:
    """The model of least AICc that the search finds for each series, with its forecasts; None for series that are too short."""
    out: list[Fit | None] = [None] * len(series)
    use = [i for i, y in enumerate(series) if len(y) >= LEAST and np.isfinite(y).all()]
    kinds = [differences(series[i]) for i in use]
    held = [differenced(series[i], *k) for i, k in zip(use, kinds, strict=True)]
    scale = [max(float(w.std()), 1e-9) for w in held]
    held = [w / s for w, s in zip(held, scale, strict=True)]
    if not use:
        return out
    tried: dict[tuple, float] = {}
    best: dict[int, tuple] = {}
    may = [sum(k) <= 1 for k in kinds]
    trim = lambda o: tuple(min(a, m) for a, m in zip(o, limits.most, strict=True))
    wanted = {(s, trim(o), may[s]) for s in range(len(use)) for o in FIRST if sum(trim(o)) <= limits.total}
    models: dict[tuple, tuple] = {}
    near: dict[int, list[np.ndarray]] = {}
    while wanted:
        value, x, lanes, most, jobs = _fit(held, sorted(wanted), near)
        edge = np.cumsum([0, *most])
        phi, theta = _polynomials(lanes, x, most)
        improved = set()
        for lane, job in enumerate(jobs):
            n, k = len(held[job[0]]), sum(job[1]) + job[2] + 1
            tried[job] = value[lane] + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1)
            if job[0] not in best or tried[job] < tried[best[job[0]]] - 1e-6:
                best[job[0]] = job
                improved.add(job[0])
                near[job[0]] = [x[edge[k] : edge[k] + job[1][k], lane].copy() for k in range(4)]
                models[job] = (phi[:, lane].copy(), theta[:, lane].copy(), lanes.mean[lane])
        wanted = {(s, o, m) for s in improved for o, m in _neighbours(best[s][1], best[s][2], limits, may[s])} - tried.keys()
    for s, i in enumerate(use):
        phi, theta, mean = models[best[s]]
        (d, seasonal), w, y = kinds[s], held[s], series[i]
        one = Lanes(w[:, None], np.zeros(1, int), np.zeros(1, int), np.zeros((4, 1), int), np.array([mean]))
        _, variance, state = kalman(one, phi[:, None], theta[:, None])
        a, ahead = state[:, 0], []
        for _ in range(horizon):
            ahead.append(a[0] + mean)
            a = phi * a[0] + np.append(a[1:], 0.0)
        path = np.array(ahead) * scale[s]
        inner = y[SEASON:] - y[:-SEASON] if seasonal else y
        for k in reversed(range(d)):
            path = np.cumsum(path) + np.diff(inner, k)[-1]
        if seasonal:
            whole = list(y[-SEASON:])
            for v in path:
                whole.append(v + whole[-SEASON])
            path = np.array(whole[SEASON:])
        spread = np.sqrt(variance[0]) * scale[s] * np.sqrt(np.cumsum(_weights(phi, theta, d, seasonal, horizon) ** 2))
        out[i] = Fit(best[s][1], kinds[s], best[s][2], float(tried[best[s]]), path, spread, sum(1 for j in tried if j[0] == s))
    return out


def simulate(ar: list[float], ma: list[float], n: int, noise: np.ndarray, d: int = 0, seasonal: int = 0) -> np.ndarray:
    """A series with the given coefficients at lags 1, 2, ..., from noise that may be longer than n."""
    w = np.zeros(len(noise))
    for t in range(len(noise)):
        w[t] = noise[t] + sum(c * w[t - k] for k, c in enumerate(ar, 1) if t >= k) + sum(c * noise[t - k] for k, c in enumerate(ma, 1) if t >= k)
    for _ in range(d):
        w = np.cumsum(w)
    if seasonal:
        for t in range(SEASON, len(w)):
            w[t] += w[t - SEASON]
    return w[-n:]
