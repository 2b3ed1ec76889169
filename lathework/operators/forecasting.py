"""Forecast models fitted by criterion: exponential smoothing states, seasonal ARIMA, changing trends, aggregated demand; several seasons at once.

All take a series, a horizon and a season's length; they run inside grouped
Pandas functions, one series at a time.
"""

from __future__ import annotations

import numpy as np

# -- exponential smoothing ----------------------------------------------------

#: Trend (none, additive, damped) and season (none, additive, multiplicative) of the candidates.
TRENDS, SEASONS = ("N", "A", "D"), ("N", "A", "M")


def _states(y: np.ndarray, trend: str, season: str, m: int, p: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Squared errors of all parameter sets (rows of ``p``: alpha, beta, gamma, phi) at once, and the last states."""
    n = len(y)
    a, b, g, phi = p.T
    sets = len(p)
    if season == "N":
        s = np.zeros((1, sets))
        level = np.full(sets, y[:m].mean() if m > 1 and n >= 2 * m else y[0])
    else:
        first = y[:m].mean()
        s = np.repeat((y[:m] - first if season == "A" else y[:m] / first)[:, None], sets, axis=1)
        level = np.full(sets, first)
    slope = 0.0
    if trend != "N":
        k = m if n >= 2 * m and m > 1 else max(1, min(4, n - 1))
        slope = (y[k : 2 * k].mean() - y[:k].mean()) / k if n >= 2 * k else (y[-1] - y[0]) / (n - 1)
        level = level - slope * (0 if season == "N" and m <= 1 else (k - 1) / 2)
    growth = np.full(sets, slope)
    sse = np.zeros(sets)
    for t in range(n):
        k = t % len(s)
        base = level + phi * growth if trend != "N" else level
        e = y[t] - (base * s[k] if season == "M" else base + s[k])
        sse += e * e
        if season == "M":
            old = s[k]
            up = a * e / np.where(np.abs(old) < 1e-9, 1e-9, old)
            s[k] = old + g * e / np.where(np.abs(base) < 1e-9, 1e-9, base)
        else:
            up = a * e
            s[k] = s[k] + g * e
        level = base + up
        if trend != "N":
            growth = phi * growth + b * up
    return sse, (level, growth, s)


def _sets(rng: np.random.Generator, trend: str, season: str, n: int, near: np.ndarray | None, spread: float) -> np.ndarray:
    u = rng.random((n, 4)) if near is None else np.clip(near[rng.integers(0, len(near), n)] + rng.normal(0, spread, (n, 4)), 0.0, 1.0)
    return u


def _parameters(u: np.ndarray, trend: str, season: str) -> np.ndarray:
    """Unit cubes to alpha, beta (as a share of alpha), gamma (of what alpha leaves) and phi."""
    a = 0.0001 + 0.9998 * u[:, 0]
    b = u[:, 1] if trend != "N" else np.zeros(len(u))
    g = u[:, 2] * (1 - a) if season != "N" else np.zeros(len(u))
    phi = 0.8 + 0.18 * u[:, 3] if trend == "D" else np.ones(len(u))
    return np.column_stack([a, b, g, phi])


def ets(y: np.ndarray, h: int, m: int = 1, seed: int = 1) -> np.ndarray:
    """Exponential smoothing with the trend and season that the corrected Akaike criterion prefers.

    Each candidate's weights are searched in four rounds of draws that close in
    on the best ones; all draws of a round run through the series together.
    """
    y = np.asarray(y, float)
    n = len(y)
    best = None
    for season in SEASONS:
        if season != "N" and (m < 2 or n < 2 * m + 3) or season == "M" and (y <= 0).any():
            continue
        for trend in TRENDS:
            k = 2 + 2 * (trend != "N") + (trend == "D") + (season != "N") * (1 + m)
            if n - k - 1 <= 0:
                continue
            rng = np.random.default_rng(seed)
            near, spread = None, 0.25
            for _ in range(4):
                u = _sets(rng, trend, season, 96, near, spread)
                if near is not None:
                    u = np.vstack([near, u])
                with np.errstate(all="ignore"):
                    sse, _ = _states(y, trend, season, m, _parameters(u, trend, season))
                sse = np.where(np.isfinite(sse), sse, np.inf)
                near, spread = u[np.argsort(sse)[:6]], spread / 2.5
            low = float(sse.min())
            aicc = n * np.log(max(low, 1e-12) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
            if best is None or aicc < best[0]:
                best = (aicc, trend, season, near[:1])
    if best is None:
        return np.full(h, y[-1])
    _, trend, season, u = best
    p = _parameters(u, trend, season)
    _, (level, growth, s) = _states(y, trend, season, m, p)
    steps = np.cumsum(p[0, 3] ** np.arange(1, h + 1)) if trend != "N" else np.zeros(h)
    line = level[0] + steps * growth[0]
    back = s[(n + np.arange(h)) % len(s), 0]
    return line * back if season == "M" else line + back


# -- seasonal ARIMA -----------------------------------------------------------


def kpss(y: np.ndarray) -> float:
    """The KPSS statistic of a level; over 0.463 the series is not level at 5 %."""
    n = len(y)
    e = y - y.mean()
    lags = int(np.ceil(4 * (n / 100) ** 0.25))
    v = float(e @ e) / n + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return float((np.cumsum(e) ** 2).sum()) / (n * n * v) if v > 0 else 0.0


def seasonal_strength(y: np.ndarray, m: int) -> float:
    """1 less the share of the variance that a season leaves."""
    from .timeseries import decompose

    _, season, rest = decompose(y, m)
    v = float(np.var(season + rest))
    return max(0.0, 1 - float(np.var(rest)) / v) if v > 0 else 0.0


def _lagged(z: np.ndarray, lags: list[int], start: int) -> list[np.ndarray]:
    return [z[start - k : len(z) - k] for k in lags]


def _hannan_rissanen(z: np.ndarray, ar: list[int], ma: list[int]) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Variance, coefficients (mean, AR, MA) and residuals by two least-squares steps."""
    n = len(z)
    long = min(max([8, *ar, *ma]) + 4, n // 3)
    if long < 1 or n < long + max([0, *ar, *ma]) + len(ar) + len(ma) + 6:
        return None
    x = np.column_stack([np.ones(n - long), *_lagged(z, list(range(1, long + 1)), long)])
    beta, *_ = np.linalg.lstsq(x, z[long:], rcond=None)
    e = np.zeros(n)
    e[long:] = z[long:] - x @ beta
    for _ in range(3 if ma else 1):
        start = long + max([0, *ar, *ma])
        x = np.column_stack([np.ones(n - start), *_lagged(z, ar, start), *_lagged(e, ma, start)])
        beta, *_ = np.linalg.lstsq(x, z[start:], rcond=None)
        new = np.zeros(n)
        for t in range(max([0, *ar, *ma]), n):
            new[t] = z[t] - beta[0] - sum(b * z[t - k] for b, k in zip(beta[1:], ar, strict=False)) - sum(b * new[t - k] for b, k in zip(beta[1 + len(ar) :], ma, strict=True))
        if not np.isfinite(new).all() or np.abs(new).max() > 1e6 * (np.abs(z).max() + 1):
            return None
        e = new
    used = e[long:]
    return float(used @ used) / len(used) + 1e-12, beta, e


def sarima(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    """Seasonal ARIMA: differences by KPSS and the strength of the season, orders step by step by AICc."""
    y = np.asarray(y, float)
    seasonal = m > 1 and len(y) >= 3 * m
    big = 1 if seasonal and seasonal_strength(y, m) > 0.64 else 0
    z = y[m:] - y[:-m] if big else y
    d = 0
    while d < 2 and len(z) > 10 and kpss(z) > 0.463:
        z, d = np.diff(z), d + 1

    def lags(o: tuple[int, int, int, int]) -> tuple[list[int], list[int]]:
        p, q, sp, sq = o
        return [*range(1, p + 1), *(m * k for k in range(1, sp + 1))], [*range(1, q + 1), *(m * k for k in range(1, sq + 1))]

    fits: dict[tuple, tuple] = {}

    def judge(o: tuple[int, int, int, int]) -> float:
        if o not in fits:
            found = _hannan_rissanen(z, *lags(o))
            n, k = len(z), sum(o) + 2
            fits[o] = (np.inf, None, None) if found is None or n - k - 1 <= 0 else (n * np.log(found[0]) + 2 * k + 2 * k * (k + 1) / (n - k - 1), found[1], found[2])
        return fits[o][0]

    s = 1 if seasonal else 0
    now = min([(2, 2, s, s), (0, 0, 0, 0), (1, 0, s, 0), (0, 1, 0, s)], key=judge)
    while True:
        more = [tuple(now[i] + (step if i == j else 0) for i in range(4)) for j in range(4) for step in (-1, 1)]
        more += [(now[0] + a, now[1] + a, now[2], now[3]) for a in (-1, 1)]
        limit = (5, 5, 2 * s, 2 * s)
        more = [o for o in more if all(0 <= x <= top for x, top in zip(o, limit, strict=True))]
        best = min(more, key=judge)
        if judge(best) >= judge(now) - 1e-9:
            break
        now = best
    score, beta, e = fits[now]
    if beta is None:
        return np.full(h, y[-1])
    ar, ma = lags(now)
    zs, es = list(z), list(e)
    for _ in range(h):
        v = beta[0] + sum(b * zs[-k] for b, k in zip(beta[1:], ar, strict=False)) + sum(b * es[-k] for b, k in zip(beta[1 + len(ar) :], ma, strict=True))
        zs.append(float(v))
        es.append(0.0)
    out = np.array(zs[-h:])
    for k in range(d, 0, -1):
        base = np.diff(y[m:] - y[:-m] if big else y, k - 1)
        out = base[-1] + np.cumsum(out)
    if big:
        full = list(y)
        for v in out:
            full.append(full[-m] + v)
        out = np.array(full[-h:])
    return out


# -- changing trends, aggregated demand ---------------------------------------


def changing_trend(y: np.ndarray, h: int, m: int = 1, changes: int = 25, ridge: float = 10.0, terms: int = 4) -> np.ndarray:
    """A line that may bend at many places in the first four fifths (the bends held small), and Fourier terms of the season."""
    n = len(y)
    scale = float(np.abs(y).max()) or 1.0
    knots = np.linspace(0, 0.8 * (n - 1), min(changes, max(0, int(0.8 * n) - 1)) + 1)[1:]

    def table(t: np.ndarray) -> np.ndarray:
        columns = [np.ones(len(t)), t / n, *(np.maximum(0.0, t - k) / n for k in knots)]
        for k in range(1, min(terms, m // 2) + 1) if m > 1 else ():
            columns += [np.sin(2 * np.pi * k * t / m), np.cos(2 * np.pi * k * t / m)]
        return np.column_stack(columns)

    x = table(np.arange(n, dtype=float))
    penalty = np.full(x.shape[1], 0.1)
    penalty[:2] = 1e-9
    penalty[2 : 2 + len(knots)] = ridge
    beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ (y / scale))
    return scale * table(n + np.arange(h, dtype=float)) @ beta


def imapa(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    """Intermittent demand: the mean of smoothed forecasts over all levels of aggregation up to the mean gap between demands."""
    from .timeseries import ses

    at = np.flatnonzero(y > 0)
    if not len(at):
        return np.zeros(h)
    gap = int(round(len(y) / len(at)))
    rates = []
    for k in range(1, max(1, gap) + 1):
        whole = y[len(y) % k :].reshape(-1, k).sum(1)
        rates.append(ses(whole, 1)[0] / k)
    return np.full(h, float(np.mean(rates)))


# -- several seasons ----------------------------------------------------------


def mstl(y: np.ndarray, periods: list[int], rounds: int = 2) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Trend, a season for each period and the rest: each season is taken from what the others leave, shorter ones first."""
    from .timeseries import fill, stl

    y = fill(np.asarray(y, float), "interp")
    use = sorted(p for p in set(periods) if 1 < p <= len(y) // 2)
    seasons = {p: np.zeros(len(y)) for p in use}
    trend = np.full(len(y), y.mean())
    for _ in range(rounds if len(use) > 1 else 1):
        for p in use:
            free = y - sum((s for q, s in seasons.items() if q != p), np.zeros(len(y)))
            trend, seasons[p], _ = stl(free, p)
    return trend, seasons, y - trend - sum(seasons.values(), np.zeros(len(y)))
