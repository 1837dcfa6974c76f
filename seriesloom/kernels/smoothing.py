"""Exponential smoothing with trend and seasonality: one fit per (window, form)."""

from __future__ import annotations

import itertools
import math

import numpy as np

# The admissible trend and seasonal forms, simplest first.
FORMS = [(t, dmp, s) for t, dmp in (("none", False), ("add", False), ("add", True)) for s in ("none", "add", "mul")]


def _start(x: np.ndarray, m: int, trend: str, seasonal: str):
    """Initial level, slope and season from the first cycles."""
    if seasonal == "none":
        slope = float(np.polyfit(np.arange(min(10, len(x))), x[:10], 1)[0]) if trend == "add" else 0.0
        return float(x[:10].mean() - slope * (min(10, len(x)) + 1) / 2 if trend == "add" else x[0]), slope, np.zeros(1)
    cycles = len(x) // m
    means = x[: cycles * m].reshape(cycles, m)
    base = means.mean(axis=1, keepdims=True)
    season = (means - base).mean(axis=0) if seasonal == "add" else (means / base).mean(axis=0)
    slope = float((base[1, 0] - base[0, 0]) / m) if trend == "add" else 0.0
    return float(base[0, 0] - slope * (m + 1) / 2 if trend == "add" else base[0, 0]), slope, season


def _filter(x: np.ndarray, params: np.ndarray, start, m: int, trend: str, seasonal: str):
    """Run the recursion for many parameter rows at once.

    ``params`` columns: level, slope, season and damping weights. Returns
    one-step errors (rows x n) and the final states.
    """
    a, b, g, phi = params.T
    rows = len(params)
    level, slope = np.full(rows, start[0]), np.full(rows, start[1])
    season = np.tile(start[2], (rows, 1)) if seasonal != "none" else None
    errors = np.empty((rows, len(x)))
    for i, y in enumerate(x):
        carried = phi * slope if trend == "add" else 0.0
        base = level + carried
        j = i % m
        if seasonal == "add":
            s = season[:, j]
            fit, new = base + s, a * (y - s) + (1 - a) * base
            season[:, j] = g * (y - base) + (1 - g) * s
        elif seasonal == "mul":
            s = np.where(np.abs(season[:, j]) > 1e-12, season[:, j], 1e-12)
            fit, new = base * s, a * (y / s) + (1 - a) * base
            season[:, j] = g * (y / np.where(np.abs(base) > 1e-12, base, 1e-12)) + (1 - g) * s
        else:
            fit, new = base, a * y + (1 - a) * base
        if trend == "add":
            slope = b * (new - level) + (1 - b) * carried
        level = new
        errors[:, i] = y - fit
    return errors, level, slope, season


def _lattice(axes: list[np.ndarray]) -> np.ndarray:
    return np.array(list(itertools.product(*axes)))


def _weights(u: np.ndarray) -> np.ndarray:
    """Unit-cube points to admissible weights: slope under level, season under the rest."""
    a = u[:, 0]
    return np.column_stack([a, a * u[:, 1], (1 - a) * u[:, 2], u[:, 3]])


def fit_form(x: np.ndarray, m: int, form: tuple[str, bool, str]) -> dict:
    """Least-squares weights by a shrinking lattice, all points of a round in one pass."""
    trend, damped, seasonal = form
    start = _start(x, m, trend, seasonal)
    centre = np.array([0.5, 0.5, 0.5, 0.9 if damped else 1.0])
    reach = np.array([0.49, 0.49 * (trend == "add"), 0.49 * (seasonal != "none"), 0.09 * damped])
    low, high = np.array([1e-4, 1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.9999, 0.995 if damped else 1.0])
    best_u, best = centre, math.inf
    for turn in range(6):
        steps = 5 if turn == 0 else 3
        axes = [np.unique(np.clip(np.linspace(c - r, c + r, steps if r > 0 else 1), lo, hi))
                for c, r, lo, hi in zip(best_u, reach, low, high)]
        cube = np.vstack([best_u[None, :], _lattice(axes)])
        errors, *_ = _filter(x, _weights(cube), start, m, trend, seasonal)
        sse = np.where(np.isfinite(errors).all(axis=1), (errors**2).sum(axis=1), np.inf)
        k = int(np.argmin(sse))
        best_u, best = cube[k], float(sse[k])
        reach = reach * 0.45
    if not math.isfinite(best):
        return {"aicc": None}
    n = len(x)
    count = 2 + 2 * (trend == "add") + damped + (m + 1) * (seasonal != "none")
    aic = n * math.log(max(best / n, 1e-300)) + 2 * count
    room = n - count - 3
    aicc = aic + 2 * (count + 2) * (count + 3) / room if room > 0 else math.inf
    weights = _weights(best_u[None, :])
    errors, level, slope, season = _filter(x, weights, start, m, trend, seasonal)
    return {"aicc": aicc if math.isfinite(aicc) else aic, "weights": weights[0], "resid": errors[0],
            "level": float(level[0]), "slope": float(slope[0]), "season": season[0] if season is not None else None}


def forecast_form(fit: dict, n: int, m: int, form: tuple[str, bool, str], h: int) -> np.ndarray:
    trend, _, seasonal = form
    phi = fit["weights"][3]
    out = np.full(h, fit["level"])
    if trend == "add":
        out = out + fit["slope"] * np.cumsum(phi ** np.arange(1, h + 1))
    if seasonal != "none":
        s = fit["season"][(n + np.arange(h)) % m]
        out = out + s if seasonal == "add" else out * s
    return out


def cumulative_band(point: np.ndarray, resid: np.ndarray, seed: int, draws: int = 1000):
    """Percentile band of cumulated resampled innovations."""
    resid = resid[np.isfinite(resid)]
    if not len(resid):
        return None, None
    picks = np.random.default_rng(seed).choice(resid, size=(draws, len(point)), replace=True)
    paths = point[None, :] + np.cumsum(picks, axis=1)
    return np.quantile(paths, 0.025, axis=0), np.quantile(paths, 0.975, axis=0)
