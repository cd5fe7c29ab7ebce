"""Operations on sample arrays: moveout, mutes, gain, resampling and wavelets as Columns, frequency filters as Arrow UDFs."""

from __future__ import annotations

import cmath
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wavegrid.functions.interpolation import linear


def indices(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sequence(F.lit(0), F.size(samples) - 1)).otherwise(F.array().cast("array<int>"))


def nmo_constant(samples: Column, x: Column, v: float, dt: float, inverse: bool = False) -> Column:
    """Moveout at one velocity; the sample at or before the time, the last one beyond the end, the first before the start."""
    sign = -1.0 if inverse else 1.0

    def value(i: Column) -> Column:
        t0 = i * dt
        t = F.sqrt(F.greatest(t0 * t0 + sign * x * x / (v * v), F.lit(0.0)))
        return F.get(samples, F.least(F.floor(t / dt + 1e-9).cast("int"), F.size(samples) - 1)).cast("double")

    return F.transform(indices(samples), value)


def nmo_stretch(samples: Column, x: Column, v: float, dt: float, percent: float) -> Column:
    """Moveout with linear interpolation; samples stretched by more than ``percent`` and the first one are muted."""

    def value(i: Column) -> Column:
        t0 = i * dt
        t = F.sqrt(t0 * t0 + x * x / (max(v, 100.0) ** 2))
        return F.when((i == 0) | ((t - t0) > percent / 100.0 * t0), 0.0).otherwise(linear(samples, t / dt))

    return F.transform(indices(samples), value)


def velocity_mute(samples: Column, x: Column, v: float, dt_ms: float, top: bool = True) -> Column:
    limit = F.abs(x) / v * 1000.0
    return F.transform(samples, lambda a, i: F.when((i * dt_ms < limit) if top else (i * dt_ms > limit), 0.0).otherwise(a.cast("double")))


def mute_constant(t_ms: float) -> Column:
    return F.lit(t_ms)


def mute_linear(x: Column, v: float, t0_ms: float = 0.0) -> Column:
    return t0_ms + F.abs(x) / v * 1000.0


def mute_hyperbolic(x: Column, v: float, t0_ms: float) -> Column:
    return F.sqrt(F.lit(t0_ms * t0_ms) + F.pow(x / v * 1000.0, F.lit(2.0)))


def apply_mute(samples: Column, mute_ms: Column, dt_ms: float, taper_samples: int) -> Column:
    """0 before the taper, which rises as a cosine over ``taper_samples`` and ends at the mute's sample."""
    end = F.floor(mute_ms / dt_ms).cast("int")

    def value(a: Column, i: Column) -> Column:
        share = (i - end + taper_samples) / float(max(taper_samples, 1))
        return a.cast("double") * F.when(i >= end, 1.0).when(i < end - taper_samples, 0.0).otherwise(0.5 * (1.0 - F.cos(math.pi * share)))

    return F.transform(samples, value)


def agc(samples: Column, half: int, least: float = 1e-10) -> Column:
    """Each sample over the root mean square of those up to ``half`` away, fewer at the ends."""

    def value(a: Column, i: Column) -> Column:
        first = F.greatest(i - half, F.lit(0))
        own = F.slice(samples, first + 1, F.least(i + half, F.size(samples) - 1) - first + 1)
        rms = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, b: s + b.cast("double") * b.cast("double")) / F.size(own))
        return F.when(rms > least, a.cast("double") / rms).otherwise(0.0)

    return F.transform(samples, value)


def resample(samples: Column, dt: float, new_dt: float, n: int) -> Column:
    """Linear, the last sample held."""
    last = F.size(samples) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i * new_dt / dt >= last, F.get(samples, last).cast("double")).otherwise(linear(samples, i * new_dt / dt)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def rms(samples: Column) -> Column:
    return F.sqrt(dot(samples, samples) / F.size(samples))


def convolve_same(samples: Column, weights: list[float]) -> Column:
    """Convolution with an odd number of weights, zeros beyond the ends."""
    h = len(weights) // 2
    terms = lambda i: [F.coalesce(F.when(i + h - k >= 0, F.get(samples, i + h - k)).cast("double"), F.lit(0.0)) * w for k, w in enumerate(weights)]
    return F.transform(samples, lambda a, i: sum(terms(i)[1:], terms(i)[0]))


def ricker(t: Column, frequency: float) -> Column:
    a = (math.pi * frequency) ** 2 * t * t
    return (1.0 - 2.0 * a) * F.exp(-a)


def ormsby(t: Column, f1: float, f2: float, f3: float, f4: float) -> Column:
    """Trapezoidal band f1 to f4, 1 at time 0."""

    def part(f: float) -> Column:
        return (math.pi * f) ** 2 * F.when(F.abs(f * t) < 1e-8, 1.0).otherwise(F.pow(F.sin(math.pi * f * t) / (math.pi * f * t), F.lit(2.0)))

    peak = ((f4**2 - f3**2) / (f4 - f3) - (f2**2 - f1**2) / (f2 - f1)) / 1.0
    shape = (part(f4) - part(f3)) / (math.pi * (f4 - f3)) - (part(f2) - part(f1)) / (math.pi * (f2 - f1))
    return shape / (math.pi * peak)


def band_pass(low: float, high: float, dt: float, ramp: float = 5.0):
    """A pandas UDF: Fourier band-pass with cosine flanks of ``ramp`` Hz."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for x in column:
            x = np.nan_to_num(np.asarray(x if x is not None else [], np.float64))
            if not len(x):
                out.append(x)
                continue
            f = np.fft.rfftfreq(len(x), dt)
            up = np.clip((f - low + ramp) / ramp, 0, 1)
            down = np.clip((high + ramp - f) / ramp, 0, 1)
            weight = 0.25 * (1 - np.cos(np.pi * up)) * (1 - np.cos(np.pi * down))
            out.append(np.fft.irfft(np.fft.rfft(x) * weight, len(x)))
        return pd.Series(out)

    return run


def butterworth_sections(low: float | None, high: float | None, dt: float, order: int = 4) -> list[tuple[tuple[float, float, float], tuple[float, float]]]:
    """Second-order sections ((b0, b1, b2), (a1, a2)) of a Butterworth filter by the bilinear transform, edges at half power.

    Without ``low`` (or one of 0) it passes what is below ``high``, without ``high`` (or one from the Nyquist frequency on) what
    is above ``low``, and without both everything: no sections. An odd order of a one-sided filter has a first-order section.
    """
    low = low if low and low > 0 else None
    high = high if high is not None and high < 0.5 / dt else None
    if low is None and high is None:
        return []
    edge = lambda f: math.tan(math.pi * f * dt)
    halves = [cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    halves = [p for p in halves if p.imag > -1e-12]
    digital = lambda s: (1 + s) / (1 - s)
    pairs: list[tuple[complex, complex | None]] = []
    if low is not None and high is not None:
        centre2, width = edge(low) * edge(high), edge(high) - edge(low)
        for p in halves:
            root = cmath.sqrt((p * width / 2) ** 2 - centre2)
            r, q = digital(p * width / 2 + root), digital(p * width / 2 - root)
            pairs += [(r, q)] if abs(p.imag) < 1e-12 else [(r, r.conjugate()), (q, q.conjugate())]
        zeros, at = (1.0, -1.0), cmath.exp(2j * math.atan(math.sqrt(centre2)))
    else:
        w = edge(high if low is None else low)
        for p in halves:
            r = digital(p * w if low is None else w / p)
            pairs.append((r, None) if abs(p.imag) < 1e-12 else (r, r.conjugate()))
        zeros, at = ((-1.0, -1.0), 1.0) if low is None else ((1.0, 1.0), -1.0)
    out = []
    for r, q in pairs:
        b = (1.0, -(zeros[0] + zeros[1]), zeros[0] * zeros[1]) if q is not None else (1.0, -zeros[0], 0.0)
        a = (-(r + q).real, (r * q).real) if q is not None else (-r.real, 0.0)
        out.append((b, a))
    gain = math.prod(abs(1 + a[0] / at + a[1] / at**2) / abs(b[0] + b[1] / at + b[2] / at**2) for b, a in out)
    share = gain ** (1 / len(out))
    return [(tuple(x * share for x in b), a) for b, a in out]


def padding(sections: list, n: int) -> int:
    """Samples that a trace of n is continued by at both ends: three times the filter's length, one less than the trace at most."""
    short = sum(b[2] == 0 and a[1] == 0 for b, a in sections)
    return min(3 * (2 * len(sections) + 1 - short), n - 1)


def run_sections(x: np.ndarray, sections: list) -> np.ndarray:
    """Rows of traces through sections one after the other, each starting at rest at the row's first value."""
    for (b0, b1, b2), (a1, a2) in sections:
        first = x[:, 0]
        still = first * (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 * first - a2 * still
        z1 = b1 * first - a1 * still + z2
        y = np.empty_like(x)
        for t in range(x.shape[1]):
            now = x[:, t]
            y[:, t] = out = b0 * now + z1
            z1, z2 = b1 * now - a1 * out + z2, b2 * now - a2 * out
        x = y
    return x


def both_ways(x: np.ndarray, sections: list) -> np.ndarray:
    """Rows of traces through the sections forward and backward, continued at both ends by their point reflection."""
    if not sections:
        return x
    if x.shape[1] < 2:
        return x * 0.0
    n = padding(sections, x.shape[1])
    whole = np.concatenate([2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]], axis=1)
    forth = run_sections(whole, sections)
    return run_sections(forth[:, ::-1], sections)[:, ::-1][:, n : n + x.shape[1]]


def butterworth(low: float | None, high: float | None, dt: float, order: int = 4):
    """A pandas UDF: zero-phase recursive Butterworth filter, run forward and backward.

    All traces of one length in a batch take each step together. NaN and nulls count as 0; a null trace gives an empty one.
    """
    sections = butterworth_sections(low, high, dt, order)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        rows = [np.nan_to_num(np.asarray(x if x is not None else [], np.float64)) for x in column]
        out = list(rows)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            by.setdefault(len(x), []).append(i)
        for n, own in by.items():
            if n:
                for i, y in zip(own, both_ways(np.stack([rows[i] for i in own]), sections), strict=True):
                    out[i] = y
        return pd.Series(out)

    return run
