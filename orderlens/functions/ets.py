"""Automatic exponential smoothing of many series side by side.

Every series gets every admissible state-space form: additive or multiplicative error, no, additive or damped trend, no,
additive or multiplicative weekly season. All forms of all series are lanes of the same arrays, so one pass over the days
serves them all. Parameters are fitted by likelihood: the best of some starts, then quasi-Newton steps in every lane, whose
points are lanes too. Forms are compared by AICc.

Multiplicative forms need positive series; additive errors are not combined with a multiplicative season.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .search import descend

SEASON, LEAST = 7, 14
# Bounds of the usual parameter region.
ALPHA, PHI = (1e-4, 0.9999), (0.8, 0.98)
ROUNDS = 12


@dataclass(frozen=True)
class Form:
    relative: bool  # the error is relative
    trend: bool
    damped: bool
    season: str  # N, A or M

    @property
    def name(self) -> str:
        return f"{'M' if self.relative else 'A'}{'Ad' if self.damped else 'A' if self.trend else 'N'}{self.season}"

    @property
    def parameters(self) -> int:
        """Fitted numbers: smoothing, first states and the error's deviation."""
        return 1 + self.trend + self.damped + (self.season != "N") + 1 + self.trend + (SEASON - 1) * (self.season != "N") + 1


TRENDS = [(False, False), (True, False), (True, True)]
FORMS = [Form(r, t, d, s) for r in (False, True) for t, d in TRENDS for s in "NAM" if r or s != "M"]


def admissible(y: np.ndarray) -> list[int]:
    """Places in FORMS of those that fit the series' sign and length."""
    seasonal, positive = len(y) > 2 * SEASON, bool((y > 0).all())
    return [k for k, f in enumerate(FORMS) if (positive or not f.relative) and (seasonal or f.season == "N") and len(y) > f.parameters + 1]


@dataclass
class Lanes:
    """Series that end on the same row, and for each lane its series, form and first states."""

    y: np.ndarray  # rows: days, columns: series, empty before a series begins
    begin: np.ndarray  # each lane's first row
    of: np.ndarray  # each lane's series
    form: np.ndarray
    level: np.ndarray
    slope: np.ndarray
    add: np.ndarray  # seasons by row modulo SEASON
    times: np.ndarray


def _start(y: np.ndarray, season: str) -> tuple[float, float, np.ndarray]:
    """First level, slope and season, from the first weeks freed of their season."""
    n = min(len(y), max(10, 4 * SEASON))
    head, at = y[:n], np.arange(n)
    parts = np.zeros(SEASON)
    if season != "N":
        weeks = n // SEASON * SEASON
        line = np.polyval(np.polyfit(at[:weeks], head[:weeks], 1), at[:weeks])
        parts = ((head[:weeks] - line) if season == "A" else head[:weeks] / np.maximum(line, 1e-9)).reshape(-1, SEASON).mean(axis=0)
        parts = parts - parts.mean() if season == "A" else parts / max(parts.mean(), 1e-9)
        head = head - parts[at % SEASON] if season == "A" else head / np.maximum(parts[at % SEASON], 1e-9)
    slope, level = np.polyfit(at, head, 1)
    return float(level - slope), float(slope), parts


def lanes_of(series: list[np.ndarray], forms: list[list[int]]) -> Lanes:
    """Lanes for the forms of each series, the longest series first."""
    rows, pairs = max(len(y) for y in series), sorted(((s, f) for s, held in enumerate(forms) for f in held), key=lambda p: -len(series[p[0]]))
    y = np.full((rows, len(series)), np.nan)
    for s, values in enumerate(series):
        y[rows - len(values) :, s] = values
    of, form = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    begin = rows - np.array([len(series[s]) for s in of])
    known = {(s, kind): _start(series[s], kind) for s, kind in {(s, FORMS[f].season) for s, f in pairs}}
    states = [known[s, FORMS[f].season] for s, f in pairs]
    level, slope = np.array([x[0] for x in states]), np.array([x[1] if FORMS[f].trend else 0.0 for x, (_, f) in zip(states, pairs, strict=True)])
    level = np.where([FORMS[f].trend for f in form], level, [series[s][: 2 * SEASON].mean() for s in of])
    add, times = np.zeros((SEASON, len(pairs))), np.ones((SEASON, len(pairs)))
    for lane, ((_, f), (_, _, parts)) in enumerate(zip(pairs, states, strict=True)):
        row = (begin[lane] + np.arange(SEASON)) % SEASON
        if FORMS[f].season == "A":
            add[row, lane] = parts
        elif FORMS[f].season == "M":
            times[row, lane] = np.maximum(parts, 1e-3)
    return Lanes(y, begin, of, form, level, slope, add, times)


def smooth(lanes: Lanes, parameters: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """-2 log likelihood (up to a constant) of each lane with parameters (alpha, beta, gamma, phi), and its last states.

    A multiplicative season divides the error before level and slope learn from it; a relative error moves the states as
    the plain one does, only its likelihood differs.
    """
    alpha, beta, gamma, phi = parameters
    kind = [FORMS[f] for f in lanes.form]
    relative = np.array([f.relative for f in kind])
    beta = np.where([f.trend for f in kind], beta, 0.0)
    phi = np.where([f.damped for f in kind], phi, 1.0)
    gamma_add, gamma_times = (np.where([f.season == s for f in kind], gamma, 0.0) for s in "AM")
    level, slope, add, times = lanes.level.copy(), lanes.slope.copy(), lanes.add.copy(), lanes.times.copy()
    squares, logs, product = np.zeros(len(level)), np.zeros(len(level)), np.ones(len(level))
    starts = np.searchsorted(lanes.begin, np.arange(len(lanes.y)), "right")  # lanes under way on each row: the first so many
    some = bool(relative.any())
    with np.errstate(all="ignore"):
        for t, row in enumerate(lanes.y):
            c, k = starts[t], t % SEASON
            q = slope[:c] * phi[:c]
            move = q.copy()
            q += level[:c]
            s, a = times[k, :c], add[k, :c]
            hat = q * s + a
            error = row[lanes.of[:c]] - hat
            if some:
                unit = np.where(relative[:c], hat, 1.0)
                off = error / unit
                squares[:c] += off * off
                product[:c] *= unit
                if t % 16 == 15:  # before the products grow too large
                    logs += np.log(np.abs(product))
                    product[:] = 1.0
                step = error / s
                times[k, :c] = s + gamma_times[:c] * error / q
            else:
                squares[:c] += error * error
                step = error
            level[:c] = q + alpha[:c] * step
            slope[:c] = move + beta[:c] * step
            add[k, :c] = a + gamma_add[:c] * error
        n = len(lanes.y) - lanes.begin
        fit = n * np.log(np.maximum(squares, 1e-300) / n) + 2 * (logs + np.log(np.abs(product)))
    return np.where(np.isfinite(fit), fit, np.inf), {"level": level, "slope": slope, "add": add, "times": times, "squares": squares, "phi": phi, "beta": beta, "alpha": alpha, "gamma": gamma_add + gamma_times}


def _bounded(x: np.ndarray) -> np.ndarray:
    """(alpha, beta, gamma, phi) of free numbers; beta stays below alpha, gamma below 1 - alpha."""
    a, b, g, p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    alpha = ALPHA[0] + (ALPHA[1] - ALPHA[0]) * a
    return np.stack([alpha, alpha * b, (1 - alpha) * g, PHI[0] + (PHI[1] - PHI[0]) * p])


def _wide(lanes: Lanes, times: int) -> Lanes:
    """Each lane `times` times, side by side, so that lanes stay ordered by their begin."""
    repeat = lambda x: np.repeat(x, times, axis=-1)
    return Lanes(lanes.y, repeat(lanes.begin), repeat(lanes.of), repeat(lanes.form), repeat(lanes.level), repeat(lanes.slope), repeat(lanes.add), repeat(lanes.times))


def _steps(phi: np.ndarray, horizon: int) -> np.ndarray:
    """Sums of the powers of phi from 1 to h, for h up to the horizon."""
    return np.cumsum(phi[None, :] ** np.arange(1, horizon + 1)[:, None], axis=0)


@dataclass
class Fit:
    form: str
    parameters: np.ndarray  # alpha, beta, gamma, phi; 0 or 1 where the form has none
    aicc: float
    point: np.ndarray
    spread: np.ndarray


# Starts of the search: slow and quick levels, with and without much learning of slope and season.
_STARTS = np.array([(a, b, g, 1.0) for a in (-3.0, -1.0, 1.0) for b in (-4.0, -1.0) for g in (-3.0, -0.5)]).T


def fit_many(series: list[np.ndarray], horizon: int) -> list[Fit | None]:
    """The form of least AICc of each series with its forecasts and their deviation; None where no form can be fitted."""
    forms = [admissible(y) if len(y) >= LEAST and np.isfinite(y).all() else [] for y in series]
    out: list[Fit | None] = [None] * len(series)
    use = [i for i, f in enumerate(forms) if f]
    if not use:
        return out
    lanes = lanes_of([series[i] for i in use], [forms[i] for i in use])
    count = len(lanes.of)

    def score(x: np.ndarray) -> np.ndarray:
        points = len(x)
        flat = np.moveaxis(x, 0, 2).reshape(4, count * points)  # a lane's points side by side
        return smooth(_wide(lanes, points), _bounded(flat))[0].reshape(count, points).T

    first = score(np.repeat(_STARTS.T[:, :, None], count, axis=2))
    x, fit = descend(score, _STARTS[:, first.argmin(axis=0)], ROUNDS)
    states = smooth(lanes, _bounded(x))[1]
    n = len(lanes.y) - lanes.begin
    k = np.array([FORMS[f].parameters for f in lanes.form])
    aicc = fit + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1)
    ahead, powers = np.arange(1, horizon + 1), _steps(states["phi"], horizon)
    at = (len(lanes.y) + ahead - 1) % SEASON
    point = (states["level"] + powers * states["slope"]) * states["times"][at] + states["add"][at]
    sigma = np.sqrt(states["squares"] / n)
    seasonal = (ahead % SEASON == 0)[:, None] * states["gamma"]
    learned = states["alpha"] + states["beta"] * powers + seasonal
    spread = sigma * np.sqrt(1 + np.cumsum(learned**2, axis=0) - learned**2)
    for s, i in enumerate(use):
        mine = np.flatnonzero((lanes.of == s) & np.isfinite(aicc) & np.isfinite(point).all(axis=0))
        if not len(mine):
            continue
        lane = mine[aicc[mine].argmin()]
        form = FORMS[lanes.form[lane]]
        used = np.array([states[p][lane] for p in ("alpha", "beta", "gamma", "phi")])
        wide = spread[:, lane] * (np.abs(point[:, lane]) if form.relative else 1.0)
        out[i] = Fit(form.name, used, float(aicc[lane]), point[:, lane], wide)
    return out


def last_states(series: list[np.ndarray], form: Form, parameters: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level, slope, the next day's season, and the one-step errors' deviation of each series, for fixed parameters.

    The first week's mean is the first level, its days' distances from it the first season; the first slope is 0.
    """
    lanes = lanes_of(series, [[FORMS.index(form)] for _ in series])
    for lane, s in enumerate(lanes.of):
        week = series[s][:SEASON]
        lanes.level[lane], lanes.slope[lane] = week.mean(), 0.0
        row = (lanes.begin[lane] + np.arange(SEASON)) % SEASON
        if form.season == "A":
            lanes.add[row, lane] = week - week.mean()
        elif form.season == "M":
            lanes.times[row, lane] = week / week.mean()
    states = smooth(lanes, np.repeat(np.array(parameters)[:, None], len(series), axis=1))[1]
    back = np.argsort(lanes.of)
    season = states["times" if form.season == "M" else "add"][len(lanes.y) % SEASON]
    n = len(lanes.y) - lanes.begin
    return tuple(x[back] for x in (states["level"], states["slope"], season, np.sqrt(states["squares"] / n)))


def simulate(form: Form, parameters: tuple[float, float, float, float], n: int, level: float, slope: float, season: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A series of the form with known parameters; `season` holds SEASON summands or factors."""
    alpha, beta, gamma, phi = parameters
    season, out = season.astype(float).copy(), np.zeros(n)
    phi = phi if form.damped else 1.0
    for t in range(n):
        q, s = level + phi * slope, season[t % SEASON]
        hat = q + s if form.season == "A" else q * s if form.season == "M" else q
        error = noise[t] * (hat if form.relative else 1.0)
        step = error / s if form.season == "M" else error
        out[t] = hat + error
        level, slope = q + alpha * step, (phi * slope + beta * step if form.trend else 0.0)
        season[t % SEASON] += gamma * error / (q if form.season == "M" else 1.0) if form.season != "N" else 0.0
    return out
