"""Sampling an array column, or ``dual.Gathered`` traces, at a fractional position, with a fixed number of terms."""

from __future__ import annotations

import math

from pyspark.sql import Column

from wavegrid.functions.dual import absolute, at, cos, floor, sin, size, where


def nearest(samples: Column, s: Column) -> Column:
    i = floor(s + 0.5)
    return where((i >= 0) & (i < size(samples)), at(samples, i), 0.0)


def linear(samples: Column, s: Column) -> Column:
    """0 unless 0 <= s < n - 1."""
    i = floor(s)
    f = s - i
    return where((s >= 0) & (s < size(samples) - 1), at(samples, i) * (1.0 - f) + at(samples, i + 1) * f, 0.0)


def cubic(samples: Column, s: Column) -> Column:
    """Catmull-Rom; linear where a neighbour is missing."""
    i = floor(s)
    f = s - i
    p0, p1, p2, p3 = (at(samples, i + k) for k in (-1, 0, 1, 2))
    inner = p1 + 0.5 * f * (p2 - p0 + f * (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3 + f * (3.0 * (p1 - p2) + p3 - p0)))
    return where((i >= 1) & (i + 2 < size(samples)), inner, linear(samples, s))


def _kernel_sum(samples: Column, first: Column, weights: list[Column]) -> Column:
    total = sum(weights[1:], weights[0])
    value = sum((w * at(samples, first + k) for k, w in list(enumerate(weights))[1:]), weights[0] * at(samples, first))
    return where(absolute(total) > 1e-10, value / total, 0.0)


def _sinc(x: Column) -> Column:
    a = math.pi * x
    return where(absolute(x) < 1e-8, 1.0, sin(a) / a)


def sinc(samples: Column, s: Column, half: int) -> Column:
    """Hann-windowed sinc around the nearest sample, weights summing to one; linear near the ends."""
    centre = floor(s + 0.5)
    x = [s - (centre + k) for k in range(-half, half + 1)]
    weights = [where(absolute(d) <= half, _sinc(d) * 0.5 * (1.0 + cos(math.pi * d / half)), 0.0) for d in x]
    return where((centre >= half) & (centre + half < size(samples)), _kernel_sum(samples, centre - half, weights), linear(samples, s))


def lanczos(samples: Column, s: Column, a: int) -> Column:
    """Lanczos of a lobes around the sample below, weights summing to one; linear near the ends."""
    low = floor(s)
    x = [s - (low + k) for k in range(1 - a, a + 1)]
    weights = [where(absolute(d) < a, _sinc(d) * _sinc(d / a), 0.0) for d in x]
    return where((low >= a - 1) & (low + a < size(samples)), _kernel_sum(samples, low - a + 1, weights), linear(samples, s))


METHODS = {
    "nearest": nearest,
    "linear": linear,
    "cubic": cubic,
    "sinc4": lambda a, s: sinc(a, s, 2),
    "sinc8": lambda a, s: sinc(a, s, 4),
    "sinc16": lambda a, s: sinc(a, s, 8),
    "lanczos3": lambda a, s: lanczos(a, s, 3),
    "lanczos5": lambda a, s: lanczos(a, s, 5),
}
# Other names of methods.
SAME_AS = {"sinc": "sinc8", "spline": "cubic", "lanczos": "lanczos3"}


def interpolate(method: str, samples: Column, s: Column) -> Column:
    """By name; unknown names are linear."""
    return METHODS.get(SAME_AS.get(method, method), linear)(samples, s)


def recommended(priority: str = "balanced", frequency: float | None = None, dt_ms: float | None = None) -> str:
    """A method: linear for speed, sinc8 for quality, else by the frequency's share of the highest one, sinc4 where that is not known."""
    if priority in ("speed", "quality"):
        return {"speed": "linear", "quality": "sinc8"}[priority]
    if frequency is None or dt_ms is None:
        return "sinc4"
    share = frequency * dt_ms / 500.0
    return "sinc8" if share > 0.7 else "cubic" if share > 0.4 else "linear"
