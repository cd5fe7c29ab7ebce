"""Travel times, weights and apertures of Columns or NumPy arrays. Times are seconds, lengths metres, unless named otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavegrid.functions.dual import cos, exp, greatest, least, log, sqrt, where

#: Times below this have no weight.
LEAST_TIME = 0.001


def dsr(t0: Column, source_sq: Column, receiver_sq: Column, v: Column) -> Column:
    """Double square root time from squared distances of source and receiver to the image point."""
    half, v2 = t0 * t0 / 4.0, v * v
    return sqrt(half + source_sq / v2) + sqrt(half + receiver_sq / v2)


def spreading(v: Column, t: Column) -> Column:
    return where(t < LEAST_TIME, 0.0, 1.0 / (v * t))


def obliquity(t0: Column, t: Column) -> Column:
    return where(t < LEAST_TIME, 0.0, t0 / t)


def aperture(t0: Column, v: Column, dip_degrees: float, low: float, most: float) -> Column:
    return least(greatest(v * t0 / 2.0 * math.tan(math.radians(dip_degrees)), low), most)


def taper(d: Column, aperture: Column, share: float) -> Column:
    """1 inside, 0 at the aperture and beyond, a cosine over its outer ``share``."""
    start = aperture * (1.0 - share)
    return where(d >= aperture, 0.0, where(d <= start, 1.0, 0.5 * (1.0 + cos(math.pi * (d - start) / (aperture - start)))))


def straight_ray(x: Column, z: Column, v: Column) -> Column:
    return sqrt(x * x + z * z) / v


def curved_ray(x: Column, z: Column, v0: float, k: float) -> Column:
    """One-way time where velocity is v0 + k z."""
    if abs(k) < 1e-10:
        return straight_ray(x, z, v0)
    vz, kx2 = v0 + k * z, k * k * x * x
    return log((vz + sqrt(vz * vz + kx2)) / (v0 + sqrt(v0 * v0 + kx2))) / k


def time_to_depth(t: Column, v0: float, k: float) -> Column:
    return t * v0 if abs(k) < 1e-10 else (v0 / k) * (exp(k * t) - 1.0)


def depth_to_time(z: Column, v0: float, k: float) -> Column:
    return z / v0 if abs(k) < 1e-10 else log((v0 + k * z) / v0) / k


def curved_dsr(t0: Column, source: Column, receiver: Column, v0: float, k: float) -> Column:
    z = time_to_depth(t0 / 2.0, v0, k)
    return curved_ray(source, z, v0, k) + curved_ray(receiver, z, v0, k)


def _eta_term(t0: Column, x: Column, v: Column, eta: Column) -> Column:
    x2, v2 = x * x, v * v
    return 2.0 * eta * x2 * x2 / (v2 * (t0 * t0 * v2 + (1.0 + 2.0 * eta) * x2))


def vti_leg(t0: Column, x: Column, v: Column, eta: Column) -> Column:
    """One leg of a VTI travel time: t0 is that leg's vertical time."""
    return sqrt(greatest(t0 * t0 + x * x / (v * v) - _eta_term(t0, x, v, eta), 0.0))


def vti_dsr(t0: Column, source: Column, receiver: Column, v: Column, eta: Column) -> Column:
    return vti_leg(t0 / 2.0, source, v, eta) + vti_leg(t0 / 2.0, receiver, v, eta)


def vti_moveout(t0: Column, x: Column, v: Column, eta: Column) -> Column:
    """Non-hyperbolic moveout time; t0 where t0 or v is not positive."""
    return where((t0 <= 0) | (v <= 0), t0, vti_leg(t0, x, v, eta))


def hyperbola(t0: Column, x: Column, v: Column) -> Column:
    return sqrt(t0 * t0 + x * x / (v * v))


def residual_moveout(t0: Column, x: Column, v: Column, eta: Column) -> Column:
    return vti_moveout(t0, x, v, eta) - hyperbola(t0, x, v)


def thomsen_to_eta(epsilon: Column, delta: Column) -> Column:
    return (epsilon - delta) / (1.0 + 2.0 * delta)


def common_offset_time(t0: Column, half_offset: Column, d: Column, v: Column) -> Column:
    return sqrt(t0 * t0 + 4.0 * half_offset * half_offset / (v * v) + 4.0 * d * d / (v * v))


def dip_sine(d: Column, z: Column) -> Column:
    """Sine of the angle from the vertical of a ray from depth ``z`` to a place ``d`` aside; 0 where both are 0."""
    path = sqrt(d * d + z * z)
    return d / where(path > 0, path, 1.0)


def alias_frequency(v: Column, dx: float, sin_theta: Column) -> Column:
    """Highest frequency without spatial aliasing; 500 Hz at most and where the ray is nearly vertical."""
    return where(sin_theta < 0.01, 500.0, least(v / (4.0 * dx * least(sin_theta, 0.999)), 500.0))


def alias_weight(v: Column, dx: float, sin_theta: Column, dominant: float) -> Column:
    return where(sin_theta < 0.01, 1.0, greatest(0.0, 1.0 - dominant / alias_frequency(v, dx, sin_theta)))


def linear_velocity(v0: float, k: float, t: Column) -> Column:
    return v0 + k * t


def table_lookup(table: list[tuple[float, float]], t: Column) -> Column:
    """Linear interpolation in a table sorted by time, its ends held."""
    out = F.lit(table[-1][1])
    for (ta, va), (tb, vb) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(t <= tb, va + (vb - va) * (t - ta) / (tb - ta)).otherwise(out)
    return F.when(t <= table[0][0], table[0][1]).otherwise(out)


def eta_to_thomsen(eta: Column, delta: float = 0.05) -> tuple[Column, Column]:
    """Epsilon and delta of a weakly anisotropic medium, for a delta taken as known."""
    return eta + delta, F.lit(delta)


def curved_ratio(offset: Column, z: Column, v0: float, k: float) -> Column:
    """One-way time of the curved ray over that of a straight one at the mean velocity, at half the offset; 1 where a time is 0."""
    h = offset / 2.0
    straight, curved = straight_ray(h, z, v0 + k * z / 2.0), curved_ray(h, z, v0, k)
    return F.when((straight <= 0) | (curved <= 0), 1.0).otherwise(curved / straight)
