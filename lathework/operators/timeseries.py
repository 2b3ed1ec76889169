"""Time series: regular series, gap fill, smoothing, decomposition, forecasts and their backtest.

Building a series is a grouped aggregation.  What follows works on a regular
series of one value a slot (small, whatever the table held) and runs one series
a group in ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import buckets
from . import forecasting
from .aggregate import finite
from .charts import order_statistics
from .order import attach
from .quantiles import quantiles, with_quantiles


def series(df: DataFrame, ts: str, value: str | None, grain: str, agg: str = "sum", every: int = 1, by: str | None = None) -> DataFrame:
    """(by), slot, value: one row for each slot with data."""
    slot = buckets.bucket(F.col(ts), grain, every)
    x = finite(F.col(value)) if value else None
    order = F.when(x.isNotNull(), F.col(ts)) if value else None
    how = {
        "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "median": lambda: F.median(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "count": lambda: F.count(F.lit(1)), "first": lambda: F.min_by(x, order), "last": lambda: F.max_by(x, order),
    }[agg]
    keys = [F.col(by).alias("series")] if by else []
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, slot.alias("slot")).agg(how().cast("double").alias("value"))


#: Minutes that a base slot below a day can have, the most slots that one has in a table, and the share of a typical gap that it fills; fixed values.
SLOT_MINUTES, MOST_SLOTS, FILLED, DAILY = (1, 5, 15, 30, 60), 1_500_000, 1.1, 0.75


def base_slot(df: DataFrame, ts: str) -> DataFrame:
    """One row: ``minutes`` of the base slot, ``typical`` (the middle gap between different times, in seconds) and ``gaps``.

    The slot is a day unless rows have a clock and come more than once a day;
    else the coarsest step of ``SLOT_MINUTES`` that the typical gap fills, or a
    coarser one in a very long table.  Different times are put next to each other
    by ranges (``order.attach``), and the middle gap is an order statistic of
    their counts, so no task sorts the table.  Missing times do not count;
    without two different times the slot is a day and ``typical`` null.
    """
    at = F.col(f"`{ts}`").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    times = df.where(F.col(f"`{ts}`").isNotNull()).select(micros.alias("u")).distinct()
    gaps = attach(times, "u", [("before", "previous", F.col("u"))]).select((F.col("u") - F.col("before")).cast("double").alias("_x"), F.lit(0).alias("g")).where("_x is not null")
    wanted = gaps.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("_ranks", F.array(F.floor(F.col("n") / 2)))
    middle = order_statistics(gaps, "g", wanted).select("n", (F.get("_v", F.lit(0)) / 1e6).alias("typical"))
    day = 86_400
    ends = times.agg(F.max("u").alias("hi"), F.min("u").alias("lo"), F.max((F.col("u") % F.lit(day * 10**6) != 0).cast("int")).alias("clock"))
    one = ends.join(F.broadcast(middle), F.lit(True), "left")
    span = F.col("hi") / 1e6 - F.floor(F.col("lo") / 1e6 / day) * day
    fits = [(F.col("typical") * FILLED >= 60 * m) | F.lit(m == SLOT_MINUTES[0]) for m in SLOT_MINUTES]
    out = F.lit(None).cast("int")
    for m, ok in zip(SLOT_MINUTES, fits, strict=True):  # the coarsest that fits, if it is coarse enough
        out = F.when(ok & (span / (60 * m) <= MOST_SLOTS), m).otherwise(out)
    coarser = F.lit(1440)
    for m in reversed(SLOT_MINUTES):
        coarser = F.when(span / (60 * m) <= MOST_SLOTS, m).otherwise(coarser)
    daily = F.col("typical").isNull() | (F.col("clock") != 1) | (F.col("typical") >= DAILY * day)
    return one.select(F.when(daily, 1440).otherwise(F.coalesce(out, coarser)).cast("int").alias("minutes"), "typical", F.coalesce("n", F.lit(0)).alias("gaps"))


def time_weighted_mean(df: DataFrame, ts: str, value: str, grain: str, by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Each reading holds until the next one of its group, three usual gaps at most, the last one for one; split at slot edges."""
    w = Window.partitionBy(by).orderBy(ts, *then)
    held = df.where(F.col(ts).isNotNull() & finite(F.col(value)).isNotNull()).withColumn("_next", F.lead(ts).over(w))
    seconds = F.timestamp_diff("SECOND", F.col(ts), F.col("_next"))
    usual = quantiles(held, seconds, [0.5], [by], "_usual").select(F.col(by).alias("_by"), F.get("_usual", F.lit(0)).alias("_usual"))
    held = held.join(usual, held[by].eqNullSafe(usual["_by"]), "left").drop("_by").withColumn("_hold", F.coalesce(F.least(seconds.cast("double"), 3 * F.col("_usual")), F.col("_usual"), F.lit(1.0)))
    step = {"week": "INTERVAL 7 DAYS", "quarter": "INTERVAL 3 MONTHS"}.get(grain, f"INTERVAL 1 {grain.upper()}")
    end = F.timestamp_add("SECOND", F.col("_hold").cast("int"), F.col(ts))
    held = held.withColumn("_end", end)
    slots = F.sequence(buckets.bucket(F.col(ts), grain), buckets.bucket(F.col("_end"), grain), F.expr(step))
    cut = held.withColumn("slot", F.explode(slots))
    lo, hi = F.greatest(F.col(ts), F.col("slot")), F.least(F.col("_end"), F.expr(f"slot + {step}"))
    cut = cut.withColumn("_w", F.timestamp_diff("SECOND", lo, hi).cast("double")).where("_w > 0")
    return cut.groupBy(by, "slot").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("value"))


def regular(s: DataFrame, grain: str, every: int = 1, by: str | None = None) -> DataFrame:
    """Every slot between a series' ends; missing ones have a null value."""
    step = {"week": f"INTERVAL {7 * every} DAYS", "quarter": f"INTERVAL {3 * every} MONTHS"}.get(grain, f"INTERVAL {every} {grain.upper()}S")
    keys = [by] if by else []
    ends = s.groupBy(*keys).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi")).where("_lo is not null")
    all_slots = ends.select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, {step})")).alias("slot"))
    return all_slots.join(s, [*keys, "slot"], "left")


def rolling(s: DataFrame, width: int, stat: str = "mean", centred: bool = False, by: str | None = None) -> DataFrame:
    """Trailing or centred mean, median, min or max; needs half of the window known."""
    w = Window.partitionBy(*([by] if by else [])).orderBy("slot")
    back = width // 2 if centred else width - 1
    frame = w.rowsBetween(-back, width - 1 - back)
    x = F.col("value")
    how = {"mean": F.avg, "min": F.min, "max": F.max}.get(stat)
    value = how(x).over(frame) if how else _median(F.collect_list(x).over(frame))
    enough = F.count(x).over(frame) >= -(-width // 2)
    return s.withColumn("smooth", F.when(enough, value))


def _median(values: Column) -> Column:
    v = F.array_sort(values)
    n = F.size(v)
    mid = F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(v, mid) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


# -- on one regular series ---------------------------------------------------


def fill(y: np.ndarray, how: str, season: int = 1) -> np.ndarray:
    """Gaps: zero, last, interp, lastcycle (a season earlier), seasonal (mean of the phase), local (mean of neighbours), leave."""
    out = y.copy()
    gaps = np.flatnonzero(~np.isfinite(out))
    if how == "leave" or not len(gaps) or len(gaps) == len(out):
        return np.where(np.isfinite(out), out, 0.0) if how == "zero" else out
    known = np.flatnonzero(np.isfinite(y))
    if how == "zero":
        out[gaps] = 0
    elif how == "last":
        out[gaps] = [out[known[known < g][-1]] if (known < g).any() else np.nan for g in gaps]
    elif how in ("interp", "smart"):
        out[gaps] = np.interp(gaps, known, y[known])
    elif how == "lastcycle":
        for g in gaps:
            out[g] = out[g - season] if g >= season else np.nan
    elif how == "seasonal":
        for g in gaps:
            phase = y[g % season :: season]
            phase = phase[np.isfinite(phase)]
            out[g] = phase.mean() if len(phase) else np.nan
    elif how == "local":
        for g in gaps:
            near = y[max(0, g - 3) : g + 4]
            near = near[np.isfinite(near)]
            out[g] = near.mean() if len(near) else np.nan
    return out


def decompose(y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend by a centred moving average, season by the median of each phase (mean 0), and the rest."""
    y = fill(np.asarray(y, float), "interp")
    if m > 1 and len(y) >= 2 * m:
        kernel = np.ones(m) / m if m % 2 else np.concatenate([[0.5], np.ones(m - 1), [0.5]]) / m
        half = len(kernel) // 2
        trend = np.full(len(y), np.nan)
        trend[half : len(y) - half] = np.convolve(y, kernel, "valid")
        trend = np.interp(np.arange(len(y)), np.flatnonzero(np.isfinite(trend)), trend[np.isfinite(trend)])
        phases = np.array([np.median((y - trend)[k::m]) for k in range(m)])
        season = (phases - phases.mean())[np.arange(len(y)) % m]
    else:
        trend = pd.Series(y).rolling(5, center=True, min_periods=1).mean().to_numpy()
        season = np.zeros(len(y))
    return trend, season, y - trend - season


def anomalies(rest: np.ndarray, limit: float = 3.5) -> np.ndarray:
    """Robust z-scores over the limit."""
    mid = np.median(rest)
    mad = np.median(np.abs(rest - mid))
    return np.zeros(len(rest), bool) if mad == 0 else np.abs(0.6745 * (rest - mid) / mad) > limit


def changepoint(y: np.ndarray) -> int | None:
    """Where two straight lines fit best, when they beat one line by half of its squared error."""
    n = len(y)
    if n < 8:
        return None
    t = np.arange(n, dtype=float)

    def sse(a: int, b: int) -> float:
        p = np.polyfit(t[a:b], y[a:b], 1)
        return float(((y[a:b] - np.polyval(p, t[a:b])) ** 2).sum())

    whole = sse(0, n)
    cost, at = min((sse(0, k) + sse(k, n), k) for k in range(4, n - 3))
    return at if cost < 0.5 * whole else None


def cycle(y: np.ndarray, longest: int | None = None) -> int | None:
    """The lag of the highest peak of the autocorrelation, when above 0.3."""
    y = fill(np.asarray(y, float), "interp")
    n = len(y)
    y = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n)) if n > 2 else y
    v = float((y * y).sum())
    if n < 6 or v == 0:
        return None
    acf = np.array([float((y[: n - k] * y[k:]).sum()) / v for k in range(min(longest or n // 2, n // 2) + 1)])
    peaks = [k for k in range(2, len(acf) - 1) if acf[k] > acf[k - 1] and acf[k] >= acf[k + 1] and acf[k] > 0.3]
    return max(peaks, key=lambda k: acf[k]) if peaks else None


# -- forecasts ---------------------------------------------------------------


def seasonal_naive(y: np.ndarray, h: int, m: int) -> np.ndarray:
    base = y[-m:] if len(y) >= m else y[-1:]
    return np.resize(base, h)


def naive(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    return np.full(h, y[-1])


def mean(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    return np.full(h, y.mean())


def drift(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    slope = (y[-1] - y[0]) / max(1, len(y) - 1)
    return y[-1] + slope * np.arange(1, h + 1)


def ses(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    """Simple exponential smoothing, the weight by least squares on a grid."""
    best = (np.inf, y[-1])
    for a in np.linspace(0.05, 0.95, 19):
        level, err = y[0], 0.0
        for v in y[1:]:
            err += (v - level) ** 2
            level += a * (v - level)
        best = min(best, (err, level))
    return np.full(h, best[1])


def holt_winters(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Additive season with a damped trend; weights by least squares on a grid."""
    n = len(y)
    if n < 2 * m + 2:
        return ses(y, h)
    season0 = y[:m] - y[:m].mean() if m > 1 else np.zeros(1)
    best = (np.inf, None)
    for a in (0.1, 0.3, 0.6):
        for b in (0.02, 0.1, 0.3):
            for g in (0.05, 0.2, 0.5) if m > 1 else (0.0,):
                for phi in (0.9, 0.98):
                    level, trend, s, err = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m, season0.copy(), 0.0
                    for t in range(n):
                        k = t % len(s)
                        f = level + phi * trend + s[k]
                        e = y[t] - f
                        err += e * e
                        old = level
                        level = level + phi * trend + a * e
                        trend = phi * trend + b * (level - old - phi * trend)
                        s[k] += g * e
                    if err < best[0]:
                        best = (err, (level, trend, s.copy(), phi))
    level, trend, s, phi = best[1]
    damp = np.cumsum(phi ** np.arange(1, h + 1))
    return level + damp * trend + s[(n + np.arange(h)) % len(s)]


def theta(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Theta: the mean of the straight line and the smoothed series of doubled curvature, season taken off and put back."""
    _, season, _ = decompose(y, m)
    z = y - season
    t = np.arange(len(z))
    slope, base = np.polyfit(t, z, 1)
    line = base + slope * (len(z) + np.arange(h))
    curved = ses(2 * z - (base + slope * t), h)
    back = season[-m:] if m > 1 else np.zeros(1)
    return (line + curved) / 2 + np.resize(back, h)


def croston(y: np.ndarray, h: int, m: int = 1, a: float = 0.1, kind: str = "croston") -> np.ndarray:
    """Intermittent demand: croston, sba (its bias taken off) or tsb (the chance of demand smoothed each slot)."""
    at = np.flatnonzero(y > 0)
    if not len(at):
        return np.zeros(h)
    if kind == "tsb":
        p, z = len(at) / len(y), y[at[0]]
        for v in y:
            p += a * ((v > 0) - p)
            if v > 0:
                z += a * (v - z)
        return np.full(h, p * z)
    z, gap, last = y[at[0]], float(at[0] + 1), at[0]
    for k in at[1:]:
        z += a * (y[k] - z)
        gap += a * ((k - last) - gap)
        last = k
    return np.full(h, z / gap * (1 - a / 2 if kind == "sba" else 1))


def climatology(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """The mean of each phase of the season."""
    n = len(y)
    phases = np.array([np.nanmean(y[k::m]) for k in range(min(m, n))])
    return phases[(n + np.arange(h)) % len(phases)]


def regression(y: np.ndarray, h: int, m: int, ridge: float = 1.0) -> np.ndarray:
    """Trend and Fourier terms of the season by ridge regression."""
    n = len(y)

    def terms(t: np.ndarray) -> np.ndarray:
        cols = [np.ones(len(t)), t / n]
        for k in range(1, min(4, m // 2 + 1)):
            cols += [np.sin(2 * np.pi * k * t / m), np.cos(2 * np.pi * k * t / m)]
        return np.stack(cols, 1)

    x = terms(np.arange(n, dtype=float))
    penalty = ridge * np.eye(x.shape[1])
    penalty[:2, :2] = 0
    return terms(n + np.arange(h, dtype=float)) @ np.linalg.solve(x.T @ x + penalty, x.T @ y)


def arima(y: np.ndarray, h: int, m: int = 1) -> np.ndarray:
    """AR model on the differenced series; order and difference by AICc, coefficients by least squares."""
    best = None
    for d in (0, 1):
        z = np.diff(y, d) if d else y
        for p in range(0, 6):
            n = len(z) - p
            if n < p + 6:
                continue
            x = np.column_stack([np.ones(n), *[z[p - k - 1 : len(z) - k - 1] for k in range(p)]])
            beta, *_ = np.linalg.lstsq(x, z[p:], rcond=None)
            var = float(((z[p:] - x @ beta) ** 2).mean()) + 1e-12
            k = p + 2
            aicc = n * np.log(var) + 2 * k + 2 * k * (k + 1) / max(1, n - k - 1)
            if best is None or aicc < best[0]:
                best = (aicc, d, p, beta)
    if best is None:
        return naive(y, h)
    _, d, p, beta = best
    z = list(np.diff(y, d) if d else y)
    out = []
    for _ in range(h):
        z.append(float(beta[0] + sum(beta[k + 1] * z[-k - 1] for k in range(p))))
        out.append(z[-1])
    return y[-1] + np.cumsum(out) if d else np.array(out)


MODELS = {
    "seasonal_naive": seasonal_naive, "naive": naive, "mean": mean, "drift": drift, "ses": ses, "holt_winters": holt_winters, "theta": theta,
    "climatology": climatology, "regression": regression, "arima": arima,
    "ets": forecasting.ets, "sarima": forecasting.sarima, "changing_trend": forecasting.changing_trend, "imapa": forecasting.imapa,
    "croston": croston, "sba": lambda y, h, m=1: croston(y, h, kind="sba"), "tsb": lambda y, h, m=1: croston(y, h, kind="tsb"),
}


def combination(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """The median of theta, Holt-Winters and regression."""
    return np.median([theta(y, h, m), holt_winters(y, h, m), regression(y, h, m)], axis=0)


MODELS["combination"] = combination
#: What auto chooses from.
AUTO = ("seasonal_naive", "holt_winters", "theta", "regression", "ses", "arima")


def backtest(y: np.ndarray, model: str, h: int, m: int, origins: int = 10, window: int | None = None) -> dict[str, float]:
    """Errors over up to ten origins: MASE, MAE, RMSE, WAPE, MAPE (of values that are not 0), sMAPE, bias.

    The series before an origin grows, or with ``window`` keeps its length.
    """
    least = max(m + max(4, -(-m // 4)), 8)
    step = max(1, round(h / 3))
    starts = [t for k in range(origins) if (t := len(y) - h - k * step) >= least]
    if not starts:
        return {}
    first = y[: min(starts)]
    scale = np.mean(np.abs(first[m:] - first[:-m])) if len(first) > m else np.nan
    e, a, f = [], [], []
    for t in starts:
        p = MODELS[model](y[max(0, t - window) if window else 0 : t], h, m)
        e.append(y[t : t + h] - p)
        a.append(y[t : t + h])
        f.append(p)
    e, a, f = (np.concatenate(v) for v in (e, a, f))
    some = a != 0
    return {
        "mape": float(np.mean(np.abs(e[some] / a[some]))) if some.any() else float("nan"),
        "mase": float(np.mean(np.abs(e)) / scale) if scale else float("nan"), "mae": float(np.mean(np.abs(e))), "rmse": float(np.sqrt(np.mean(e * e))),
        "wape": float(np.abs(e).sum() / max(1e-12, np.abs(a).sum())), "smape": float(np.mean(2 * np.abs(e) / np.maximum(1e-12, np.abs(a) + np.abs(f)))), "bias": float(np.mean(e)),
    }


def forecast(s: DataFrame, h: int, m: int, model: str = "auto", by: str = "series") -> DataFrame:
    """by, step, forecast, low, high, model for each series of a regular table (by, slot, value); auto takes the least MASE."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        y = fill(pdf["value"].to_numpy(float), "interp")
        y = y[np.isfinite(y)]
        name = model
        if len(y) < 3:
            return pd.DataFrame({by: [], "step": [], "forecast": [], "low": [], "high": [], "model": []})
        if model == "auto":
            tests = {k: backtest(y, k, h, m) for k in AUTO}
            # A series that repeats itself exactly has no scale: the errors themselves decide.
            scaled = all(np.isfinite(e.get("mase", np.nan)) for e in tests.values())
            name = min(tests, key=lambda k: (tests[k].get("mase" if scaled else "rmse", np.inf), k))
        p = MODELS[name](y, h, m)
        rmse = backtest(y, name, h, m).get("rmse", float(np.std(np.diff(y))))
        half = 1.96 * rmse * np.sqrt(np.arange(1, h + 1) / max(1, h / 2))
        return pd.DataFrame({by: pdf[by].iloc[0], "step": np.arange(1, h + 1), "forecast": p, "low": p - half, "high": p + half, "model": name})

    return s.groupBy(by).applyInPandas(run, f"{by} string, step int, forecast double, low double, high double, model string")


def coverage(df: DataFrame, ts: str, grain: str, by: str | None = None) -> DataFrame:
    """series, slot, n, coverage, partial: the readings of each slot against those that its length and the usual gap promise.

    The first and the last slot of a series are partial under 95 %.
    """
    keys = ["series"]
    rows = df.where(F.col(ts).isNotNull()).select((F.col(by).cast("string") if by else F.lit("all")).alias("series"), F.col(ts).alias("_at"))
    gaps = rows.withColumn("_gap", F.timestamp_diff("SECOND", F.lag("_at").over(Window.partitionBy("series").orderBy("_at")), F.col("_at"))).where("_gap > 0")
    usual = quantiles(gaps, F.col("_gap"), [0.5], keys, "_usual").select("series", F.get("_usual", F.lit(0)).alias("_usual"))
    step = {"week": "INTERVAL 7 DAYS", "quarter": "INTERVAL 3 MONTHS"}.get(grain, f"INTERVAL 1 {grain.upper()}")
    n = rows.groupBy("series", buckets.bucket(F.col("_at"), grain).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    length = F.timestamp_diff("SECOND", F.col("slot"), F.expr(f"slot + {step}")).cast("double")
    share = F.least(F.lit(1.0), F.col("n") * F.col("_usual") / length)
    own = Window.partitionBy("series")
    edge = (F.col("slot") == F.min("slot").over(own)) | (F.col("slot") == F.max("slot").over(own))
    out = n.join(usual, "series").withColumn("coverage", share).withColumn("_edge", edge)
    return out.select("series", "slot", "n", "coverage", (F.col("_edge") & (F.col("coverage") < 0.95)).alias("partial"))


def decompose_frame(s: DataFrame, m: int, by: str = "series") -> DataFrame:
    """by, slot, value, trend, season, rest, anomaly of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        trend, season, rest = decompose(pdf["value"].to_numpy(float), m)
        return pdf.assign(trend=trend, season=season, rest=rest, anomaly=anomalies(rest))[[by, "slot", "value", "trend", "season", "rest", "anomaly"]]

    return s.groupBy(by).applyInPandas(run, f"{by} string, slot timestamp_ntz, value double, trend double, season double, rest double, anomaly boolean")


# -- patterns and judgements ---------------------------------------------------


def typical(df: DataFrame, ts: str, value: str, part: str = "dow") -> DataFrame:
    """The usual course of a day, week or year: mean, median and quartiles by a part of the date."""
    label, rank = buckets.date_part(F.col(ts), part)
    x = finite(F.col(value))
    named = df.withColumns({"label": label, "rank": rank})
    g = named.groupBy("label", "rank").agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    g = with_quantiles(g, named, x, [0.25, 0.5, 0.75], ["label", "rank"], "q")
    return g.select("label", "rank", "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def shape_check(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Whether several series are interleaved: the share of time stamps that repeat, overall and within each key."""
    out = None
    for keys in ([], *[[b] for b in by]):
        n = df.where(F.col(ts).isNotNull()).groupBy(ts, *keys).agg(F.count(F.lit(1)).alias("n"))
        one = n.agg(F.lit(keys[0] if keys else "(all)").alias("key"), (F.sum(F.when(F.col("n") > 1, F.col("n"))) / F.sum("n")).alias("repeated"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("repeated", F.coalesce("repeated", F.lit(0.0)))


def box_cox_lambda(y: np.ndarray, m: int) -> float:
    """Guerrero's lambda: the power at which the spread of a season does not depend on its level."""
    m = max(2, m)
    n = len(y) // m
    if n < 2 or (y <= 0).any():
        return 1.0
    parts = y[-n * m :].reshape(n, m)
    mu, sd = parts.mean(1), parts.std(1, ddof=1)
    grid = np.linspace(-1, 2, 61)

    def spread(lam: float) -> float:
        r = sd / mu ** (1 - lam)
        return float(r.std() / r.mean()) if r.mean() > 0 else np.inf

    return float(min(grid, key=spread))


def box_cox(y: np.ndarray, lam: float) -> np.ndarray:
    return np.log(y) if abs(lam) < 1e-9 else (y**lam - 1) / lam


def inverse_box_cox(z: np.ndarray, lam: float) -> np.ndarray:
    return np.exp(z) if abs(lam) < 1e-9 else np.maximum(lam * z + 1, 0) ** (1 / lam)


def stl(y: np.ndarray, m: int, rounds: int = 2, span: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season and trend by local regression: season from smoothed phases, trend from what is left."""
    y = fill(np.asarray(y, float), "interp")
    n = len(y)
    span = span or (int(1.5 * m) | 1)
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        free = y - trend
        cycle_ = np.empty(n)
        for k in range(m):
            cycle_[k::m] = _loess(free[k::m], 7)
        low = pd.Series(cycle_).rolling(m, center=True, min_periods=1).mean().to_numpy()
        season = cycle_ - low
        trend = _loess(y - season, span)
    return trend, season, y - trend - season


def _loess(y: np.ndarray, span: int) -> np.ndarray:
    """Local lines with tricube weights over the ``span`` nearest points."""
    n = len(y)
    span = min(span, n)
    if n < 3 or span < 3:
        return np.full(n, y.mean()) if n else y
    out = np.empty(n)
    t = np.arange(n, dtype=float)
    for i in range(n):
        lo = min(max(0, i - span // 2), n - span)
        x, v = t[lo : lo + span] - i, y[lo : lo + span]
        w = (1 - (np.abs(x) / (np.abs(x).max() + 1e-9)) ** 3) ** 3
        sw, sx = w.sum(), (w * x).sum()
        sxx, sy, sxy = (w * x * x).sum(), (w * v).sum(), (w * x * v).sum()
        det = sw * sxx - sx * sx
        out[i] = (sxx * sy - sx * sxy) / det if abs(det) > 1e-12 else sy / sw
    return out


def easter(year: int) -> tuple[int, int]:
    """Month and day of Easter Sunday (the anonymous Gregorian rule)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    g = (a + 11 * h + 22 * k) // 451
    return (h + k - 7 * g + 114) // 31, (h + k - 7 * g + 114) % 31 + 1


def holidays(first: int, last: int, country: str = "US") -> list[tuple[str, str]]:
    """(ISO date, name) of public holidays by rule."""
    import datetime as dt

    def nth(year: int, month: int, weekday: int, n: int) -> dt.date:
        if n > 0:
            at = dt.date(year, month, 1)
            return at + dt.timedelta(days=(weekday - at.weekday()) % 7 + 7 * (n - 1))
        at = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
        return at - dt.timedelta(days=(at.weekday() - weekday) % 7)

    out = []
    for y in range(first, last + 1):
        sunday = dt.date(y, *easter(y))
        days = [(dt.date(y, 1, 1), "New Year"), (dt.date(y, 12, 25), "Christmas Day")]
        if country == "US":
            days += [(nth(y, 1, 0, 3), "Martin Luther King Day"), (nth(y, 5, 0, -1), "Memorial Day"), (dt.date(y, 7, 4), "Independence Day"), (nth(y, 9, 0, 1), "Labor Day"), (nth(y, 11, 3, 4), "Thanksgiving")]
        elif country == "AU":
            days += [(dt.date(y, 1, 26), "Australia Day"), (sunday - dt.timedelta(days=2), "Good Friday"), (sunday + dt.timedelta(days=1), "Easter Monday"), (dt.date(y, 4, 25), "Anzac Day"), (dt.date(y, 12, 26), "Boxing Day")]
        else:
            days += [(sunday - dt.timedelta(days=2), "Good Friday"), (sunday + dt.timedelta(days=1), "Easter Monday"), (dt.date(y, 12, 26), "Second Christmas Day")]
        out += [(d.isoformat(), n) for d, n in days]
    return sorted(out)


def verdict(y: np.ndarray, m: int, h: int) -> str:
    """How far a series can be forecast: by the best model's error against the seasonal naive one's, and its length."""
    if len(y) < 2 * max(m, 4):
        return "too short"
    base = backtest(y, "seasonal_naive", h, m).get("mae")
    best = min((backtest(y, k, h, m).get("mae", np.inf) for k in ("holt_winters", "theta", "regression")), default=np.inf)
    if base is None or not np.isfinite(best):
        return "too short"
    if base == 0:
        return "repeats exactly"
    return "good" if best < 0.8 * base else "fair" if best < base else "no better than last season"


def drivers(y: np.ndarray, others: dict[str, np.ndarray], lags: int = 3) -> list[tuple[str, int, float]]:
    """Columns that foretell the series: (name, lag, share of error taken off), judged on the last quarter."""
    n = len(y)
    cut = n - n // 4
    out = []
    for name, x in others.items():
        for lag in range(lags + 1):
            t = np.arange(max(1, lag), n)
            base = np.column_stack([np.ones(len(t)), y[t - 1]])
            full = np.column_stack([base, x[t - lag]])
            train = t < cut

            def error(a: np.ndarray) -> float:
                b, *_ = np.linalg.lstsq(a[train], y[t][train], rcond=None)
                return float(np.mean((y[t][~train] - a[~train] @ b) ** 2))

            e0, e1 = error(base), error(full)
            if e0 > 0 and e1 < 0.95 * e0:
                out.append((name, lag, 1 - e1 / e0))
    return sorted(out, key=lambda r: -r[2])


def from_view(view: DataFrame, time: str, measure: str, split: str | None = None, raw: tuple | None = None, step: float = 0.0) -> DataFrame:
    """A grouped view's periods as series: series, slot, value, partial.

    The periods are taken as they are.  The first and the last may be cut short:
    with ``raw`` (first and last time of the rows, and ``step``, their usual
    spacing in seconds) a period counts as partial when less than 95 % of its
    length is covered, the length being that of its neighbour.  Fewer than
    three periods are no series.
    """
    rows = view.where(F.col(time).isNotNull()).select(
        (F.coalesce(F.col(split).cast("string"), F.lit("(empty)")) if split else F.lit("all")).alias("series"), F.col(time).cast("timestamp_ntz").alias("slot"), F.col(measure).cast("double").alias("value")
    )
    starts = rows.select("slot").distinct()
    ends = starts.agg(F.count(F.lit(1)).alias("_n"), F.min("slot").alias("_a"), F.max("slot").alias("_z"))
    ends = ends.crossJoin(starts.orderBy("slot").limit(2).agg(F.max("slot").alias("_b"))).crossJoin(starts.orderBy(F.col("slot").desc()).limit(2).agg(F.min("slot").alias("_y")))
    out = rows.join(F.broadcast(ends)).where("_n >= 3")
    partial = F.lit(False)
    if raw:
        seconds = lambda a, b: F.timestamp_diff("SECOND", a, b).cast("double")
        lo, hi = (F.lit(x).cast("timestamp_ntz") for x in raw)
        first = (F.col("slot") == F.col("_a")) & (seconds(lo, F.col("_b")) / seconds(F.col("_a"), F.col("_b")) < 0.95)
        last = (F.col("slot") == F.col("_z")) & ((seconds(F.col("_z"), hi) + F.lit(float(step))) / seconds(F.col("_y"), F.col("_z")) < 0.95)
        partial = first | last
    return out.select("series", "slot", "value", partial.alias("partial"))
