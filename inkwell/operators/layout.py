"""Order-dependent work on one page, line or stroke: plain functions on small arrays, run for each page in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_page(df: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function over the rows of each page (a page is small: its words, strokes or samples)."""
    return df.groupBy(key).applyInPandas(function, schema)


def line_clusters(centres: np.ndarray, radius: float, share: float = 0.65) -> np.ndarray:
    """Words in the order given join the first line whose running mean is within share * radius, or begin a line."""
    means, counts, out = [], [], []
    for y in centres:
        at = next((i for i, m in enumerate(means) if abs(y - m) < share * radius), len(means))
        if at == len(means):
            means.append(float(y))
            counts.append(1)
        else:
            counts[at] += 1
            means[at] += (y - means[at]) / counts[at]
        out.append(at)
    return np.array(out, dtype=np.int32)


def assign_lines(df: DataFrame, page: str, order: str, centre: str, radius: float) -> DataFrame:
    """df with `line`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([centre, order], ignore_index=True)
        return rows.assign(line=line_clusters(rows[centre].to_numpy(dtype=float), radius))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return per_page(df, page, run, f"{fields}, line int")


def peaks(profile: np.ndarray, apart: int, height: float, prominence: float) -> list[int]:
    """Local maxima of a height and a prominence, the highest first claiming `apart` samples on both sides."""
    x = np.asarray(profile, dtype=float)
    found = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] >= x[i + 1] and x[i] >= height]
    keep = []
    for i in sorted(found, key=lambda i: (-x[i], i)):
        left, right = i, i
        while left > 0 and x[left - 1] <= x[i]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] <= x[i]:
            right += 1
        if x[i] - max(x[left : i + 1].min(), x[i : right + 1].min()) >= prominence and all(abs(i - j) >= apart for j in keep):
            keep.append(i)
    return sorted(keep)


def valley_cuts(profile: np.ndarray, apart: int = 50, height: float = 0.2, prominence: float = 0.15, depth: float = 0.65) -> list[int]:
    """Cuts at the lowest sample between two peaks of a profile scaled to 1, where it is below depth times the lower peak."""
    x = np.asarray(profile, dtype=float)
    x = x / x.max() if x.size and x.max() > 0 else x
    p = peaks(x, apart, height, prominence)
    cuts = [(a, b, a + int(np.argmin(x[a : b + 1]))) for a, b in zip(p, p[1:])]
    return [c for a, b, c in cuts if x[c] < depth * min(x[a], x[b])]


def task_partition(cost: np.ndarray, tasks: int, free: int = 2, penalty: float = 0.5) -> list[int]:
    """The task of each line: contiguous runs in task order of least cost (lines x tasks) plus penalty * (n - 1) for a
    run of n lines, but for the task that may have many."""
    lines = len(cost)
    best = np.full((tasks + 1, lines + 1), np.inf)
    back = np.zeros((tasks + 1, lines + 1), dtype=int)
    best[0, 0] = 0.0
    total = np.vstack([np.zeros(tasks), np.cumsum(cost, axis=0)])
    for t in range(1, tasks + 1):
        for b in range(lines + 1):
            for a in range(b + 1):
                extra = 0.0 if t - 1 == free or b == a else penalty * (b - a - 1)
                c = best[t - 1, a] + total[b, t - 1] - total[a, t - 1] + extra
                if c < best[t, b]:
                    best[t, b], back[t, b] = c, a
    out, b = [0] * lines, lines
    for t in range(tasks, 0, -1):
        for i in range(back[t, b], b):
            out[i] = t - 1
        b = back[t, b]
    return out


def arc_resample(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n points at equal steps of arc length."""
    s = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    at = np.linspace(0, s[-1], n)
    return np.interp(at, s, x), np.interp(at, s, y)


def smooth(y: np.ndarray, window: int = 7, degree: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing in a sliding window; end points from the first and last windows' polynomials."""
    half, n = window // 2, len(y)
    if n < window:
        return np.asarray(y, dtype=float)
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], mode="same").astype(float)
    for part, where in ((slice(0, window), range(half)), (slice(n - window, n), range(n - half, n))):
        c = fit @ np.asarray(y[part], dtype=float)
        for i in where:
            out[i] = sum(c[k] * float(i - part.start - half) ** k for k in range(degree + 1))
    return out


def high_share(y: np.ndarray, rate: float, cut: float) -> float:
    """Share of the spectrum's power above a frequency, the mean taken out."""
    y = np.asarray(y, dtype=float)
    power = np.abs(np.fft.rfft(y - y.mean())) ** 2
    whole = power.sum()
    return float(power[np.fft.rfftfreq(len(y), 1 / rate) > cut].sum() / whole) if whole > 0 else 0.0


def robust_line(x: np.ndarray, y: np.ndarray, residual: float, turns: int = 100, seed: int = 42) -> tuple[float, float]:
    """Slope and intercept by least squares over the largest set within `residual` of a line through two points; over all
    points if none has two."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    rng, best = np.random.default_rng(seed), np.ones(len(x), dtype=bool)
    most = 0
    for _ in range(turns if len(x) > 2 else 0):
        i, j = rng.choice(len(x), 2, replace=False)
        if x[i] == x[j]:
            continue
        m = (y[j] - y[i]) / (x[j] - x[i])
        near = np.abs(y - y[i] - m * (x - x[i])) <= residual
        if near.sum() > max(most, 2):
            most, best = int(near.sum()), near
    if np.ptp(x[best]) == 0:
        return 0.0, float(y.mean())
    m, b = np.polyfit(x[best], y[best], 1)
    return float(m), float(b)


def two_means_cut(gaps: np.ndarray, rounds: int = 100) -> float:
    """The threshold between two normal components of gap widths, by expectation-maximisation from the quartiles: where
    both are equally likely; the mean of the two where no such point lies between them."""
    g = np.asarray(gaps, dtype=float)
    if len(g) < 4 or np.ptp(g) == 0:
        return float(g.mean()) if len(g) else 0.0
    mu, var, w = np.quantile(g, [0.25, 0.75]), np.full(2, g.var() / 2 + 1e-6), np.full(2, 0.5)
    for _ in range(rounds):
        log = np.log(w) - 0.5 * np.log(var) - (g[:, None] - mu) ** 2 / (2 * var)
        r = np.exp(log - log.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0) + 1e-12
        mu, w = (r * g[:, None]).sum(axis=0) / n, n / n.sum()
        var = (r * (g[:, None] - mu) ** 2).sum(axis=0) / n + 1e-6
    lo, hi = np.argsort(mu)
    at = np.linspace(mu[lo], mu[hi], 1001)
    log = np.log(w) - 0.5 * np.log(var) - (at[:, None] - mu) ** 2 / (2 * var)
    over = np.flatnonzero(log[:, hi] >= log[:, lo])
    return float(at[over[0]]) if len(over) else float(mu.mean())
