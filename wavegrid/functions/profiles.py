"""Shape-preserving cubic profiles over time, for anisotropy and frequency tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _end_slope(h0: float, h1: float, d0: float, d1: float) -> float:
    """Three-point slope at an end, held back where it would leave the data's direction."""
    slope = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    if slope * d0 <= 0:
        return 0.0
    return 3 * d0 if d0 * d1 <= 0 and abs(slope) > 3 * abs(d0) else slope


def slopes(knots: list[tuple[float, float]]) -> list[float]:
    """Slopes at sorted knots after Fritsch and Butland: weighted harmonic means, 0 at local extrema."""
    h = [b[0] - a[0] for a, b in zip(knots, knots[1:], strict=False)]
    d = [(b[1] - a[1]) / w for a, b, w in zip(knots, knots[1:], h, strict=False)]
    if len(d) < 2:
        return [d[0], d[0]] if d else [0.0]
    inner = []
    for k in range(1, len(d)):
        left, right = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
        inner.append((left + right) / (left / d[k - 1] + right / d[k]) if d[k - 1] * d[k] > 0 else 0.0)
    return [_end_slope(h[0], h[1], d[0], d[1]), *inner, _end_slope(h[-1], h[-2], d[-1], d[-2])]


def pchip(knots: list[tuple[float, float]], t: Column, extrapolate: bool = False) -> Column:
    """The profile at ``t``; beyond the ends their values, or the outer cubics if it may extrapolate.

    Knots are a short table of a job's settings; they become constants of one expression.
    """
    knots = sorted(knots)
    if not knots or len({x for x, _ in knots}) < len(knots):
        raise ValueError("knots need to be there and at different times")
    if len(knots) == 1:
        return F.when(t.isNotNull(), F.lit(float(knots[0][1])))
    m, value = slopes(knots), None
    at = t if extrapolate else F.least(F.greatest(t, F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))
    for k, ((a, y0), (b, y1)) in enumerate(zip(knots, knots[1:], strict=False)):
        h = float(b - a)
        d = (y1 - y0) / h
        x = at - float(a)
        piece = y0 + x * (m[k] + x * ((3 * d - 2 * m[k] - m[k + 1]) / h + x * ((m[k] + m[k + 1] - 2 * d) / h**2)))
        if k == len(knots) - 2:
            value = piece if value is None else value.otherwise(piece)
        else:
            value = F.when(at < float(b), piece) if value is None else value.when(at < float(b), piece)
    return F.when(t.isNotNull(), value)


def _second_derivatives(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of cubic splines through rows of knots whose third derivative doesn't jump at the second knot from either end.

    The tridiagonal systems of all rows are eliminated forward and solved backward together, a knot at a time.
    """
    n = t.shape[1]
    h = np.diff(t, axis=1)
    d = np.diff(v, axis=1) / h
    m = np.zeros_like(t)
    if n == 3:
        m[:] = (2.0 * (d[:, 1] - d[:, 0]) / (h[:, 0] + h[:, 1]))[:, None]
    if n > 3:
        low, high = h[:, :-1].copy(), h[:, 1:].copy()
        main, right = 2.0 * (low + high), 6.0 * np.diff(d, axis=1)
        a, b = h[:, 0], h[:, 1]
        main[:, 0] += a + a * a / b
        high[:, 0] -= a * a / b
        a, b = h[:, -1], h[:, -2]
        main[:, -1] += a + a * a / b
        low[:, -1] -= a * a / b
        for i in range(1, n - 2):
            share = low[:, i] / main[:, i - 1]
            main[:, i] -= share * high[:, i - 1]
            right[:, i] -= share * right[:, i - 1]
        m[:, n - 2] = right[:, -1] / main[:, -1]
        for i in range(n - 4, -1, -1):
            m[:, i + 1] = (right[:, i] - high[:, i] * m[:, i + 2]) / main[:, i]
        m[:, 0] = m[:, 1] - h[:, 0] / h[:, 1] * (m[:, 2] - m[:, 1])
        m[:, -1] = m[:, -2] + h[:, -1] / h[:, -2] * (m[:, -2] - m[:, -3])
    return m


def spline_values(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of values at ``at`` of the splines through rows of rising knots, which go on beyond their ends."""
    n = t.shape[1]
    if n == 1:
        return np.repeat(v, at.shape[1], axis=1)
    m = _second_derivatives(t, v)
    k = np.clip((t[:, None, :] <= at[:, :, None]).sum(axis=2) - 1, 0, n - 2)
    of = lambda a, k: np.take_along_axis(a, k, axis=1)
    h = of(t, k + 1) - of(t, k)
    p, q = of(t, k + 1) - at, at - of(t, k)
    a, b = of(m, k), of(m, k + 1)
    return (a * p**3 + b * q**3) / (6 * h) + (of(v, k) / h - a * h / 6) * p + (of(v, k + 1) / h - b * h / 6) * q


def spline(knots: Column, at: Column, clip: tuple[float, float] | None = None) -> Column:
    """Values at an array of positions of the cubic spline through each row's own ``knots``, structs (t, v) in any order.

    Its third derivative doesn't jump at the second knot from either end; three knots make a parabola, two a line and one a constant, and it
    goes on beyond the knots, held within ``clip``. Knots with a null are left out; of several at one t the last counts; without
    knots the values are null.
    """

    @F.pandas_udf("array<double>")
    def run(t: pd.Series, v: pd.Series, at: pd.Series) -> pd.Series:
        out: list = [None] * len(t)
        groups: dict[tuple[int, int], list] = {}
        for i, (a, b, x) in enumerate(zip(t, v, at, strict=True)):
            if x is None:
                continue
            own = sorted({p: q for p, q in zip(a if a is not None else [], b if b is not None else [], strict=True) if p is not None and q is not None and p == p and q == q}.items())
            if own:
                groups.setdefault((len(own), len(x)), []).append((i, own, x))
            else:
                out[i] = [None] * len(x)
        for rows in groups.values():
            held = np.array([own for _, own, _ in rows], float)
            found = spline_values(held[:, :, 0], held[:, :, 1], np.array([x for *_, x in rows], float))
            for (i, *_), values in zip(rows, np.clip(found, *clip) if clip else found, strict=True):
                out[i] = values.tolist()
        return pd.Series(out)

    return run(F.transform(knots, lambda p: p["t"].cast("double")), F.transform(knots, lambda p: p["v"].cast("double")), at)
