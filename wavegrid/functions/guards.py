"""Guards against bad values, sampling rates by frequency, and standard bin sizes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin sizes in metres that surveys use.
STANDARD_BINS = (6.25, 12.5, 18.75, 25.0, 37.5, 50.0, 75.0, 100.0, 125.0, 150.0, 200.0)


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(fill)


def safe_sqrt(x: Column, least: float = 0.0) -> Column:
    return F.sqrt(F.greatest(x, F.lit(least)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def cleaned(x: Column, low: float, high: float, fill: float) -> Column:
    """What is not finite becomes ``fill``; all is clipped to the closed range."""
    return F.least(F.greatest(F.when(is_finite(x), x).otherwise(fill), F.lit(low)), F.lit(high))


def checked_time(t: Column, most: float = 20.0) -> Column:
    """A struct (valid, time): 0 where the time is negative or not finite, ``most`` beyond it."""
    usable = is_finite(t) & (t >= 0)
    return F.struct((usable & (t <= most)).alias("valid"), F.when(usable, F.least(t, F.lit(most))).otherwise(0.0).alias("time"))


def checked_sample(s: Column, n: Column, how: str) -> Column:
    """A struct (valid, sample) for interpolation at s: ``skip`` refuses what is outside 0 <= s < n - 1, ``clamp``
    moves it inside, ``extrapolate`` moves it if it is at most about one sample outside."""
    inside = F.least(F.greatest(s, F.lit(0.0)), n - 1 - 1e-6)
    valid = {"skip": (s >= 0) & (s < n - 1), "clamp": F.lit(True), "extrapolate": (s >= -1) & (s < n)}[how]
    return F.struct(valid.alias("valid"), (s if how == "skip" else F.when(valid, inside).otherwise(s)).alias("sample"))


def nearest_power_of_two(n: Column) -> Column:
    """At least 1; of two powers at one distance the lower."""
    n = F.greatest(n.cast("long"), F.lit(1).cast("long"))
    low = F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long")
    return F.when(n - low > 2 * low - n, 2 * low).otherwise(low)


def downsampling(frequency: Column, dt_ms: float, least: int = 1, most: int = 8) -> Column:
    """How many samples may become one if frequencies up to ``frequency`` are to stay: a power of two."""
    fits = nearest_power_of_two(F.floor(1000.0 / (2.0 * frequency) / dt_ms))
    return F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), fits))


def standard_bin(size: Column, tolerance: float = 0.15) -> Column:
    """The nearest standard size, the smaller of two; sizes further off than ``tolerance`` stay, with two decimals."""
    sizes = F.array(*[F.lit(s) for s in STANDARD_BINS])
    best = F.array_min(F.transform(sizes, lambda s: F.struct(F.abs(s - size).alias("off"), s.alias("size"))))
    return F.when(size <= 0, STANDARD_BINS[0]).when(best["off"] / size <= tolerance, best["size"]).otherwise(F.bround(size, 2))
