"""Triangle filters against spatial aliasing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cutoffs(n: int, low: float, high: float) -> list[float]:
    """n frequencies from ``low`` to ``high`` in equal ratios."""
    return [low * (high / low) ** (k / max(n - 1, 1)) for k in range(n)]


def triangle(length: int) -> list[float]:
    """Weights of an odd length that rise to the middle, fall after it and sum to one."""
    half = length // 2
    raw = [1.0 - abs(k) / (half + 1) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def triangle_bank(n: int, low: float, high: float, dt_ms: float, most: int = 101) -> list[list[float]]:
    """A triangle for each cutoff: half its period long in samples, from 1 to ``most``, and odd."""
    lengths = [max(1, min(int(500.0 / (dt_ms * f)), most)) for f in cutoffs(n, low, high)]
    return [triangle(k + 1 - k % 2) for k in lengths]


def bank_index(f: Column, edges: list[float]) -> Column:
    """Number of the first cutoff at or above a frequency, of the last one if there is none."""
    below = sum(((f > e).cast("long") for e in edges[1:]), (f > edges[0]).cast("long"))
    return F.least(below, F.lit(len(edges) - 1).cast("long"))


def running_average(samples: Column, length: int) -> Column:
    """Samples weighted by a triangle; near the ends the weights that meet samples are scaled up to one."""
    half = length // 2
    weights = [(k, 1.0 - abs(k) / (half + 1)) for k in range(-half, half + 1)]

    def value(_: Column, i: Column) -> Column:
        total, weight = F.lit(0.0), F.lit(0.0)
        for k, w in weights:
            inside = (i + k >= 0) & (i + k < F.size(samples))
            total = total + F.when(inside, F.get(samples, i + k).cast("double") * w).otherwise(0.0)
            weight = weight + F.when(inside, w).otherwise(0.0)
        return total / weight

    return F.transform(samples, value)


def offset_sector(offset: Column, edges: list[float]) -> Column:
    """Number of the half-open interval between edges; the last one for values outside."""
    last = len(edges) - 2
    out = F.lit(last).cast("long")
    for k in range(last, -1, -1):
        out = F.when((offset >= edges[k]) & (offset < edges[k + 1]), F.lit(k).cast("long")).otherwise(out)
    return out
