"""Stacks, slices, differences and gathers of image volumes in rows (ix, iy, it, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.functions.interpolation import linear
from wavegrid.functions.signal import indices


def velocity_at(picks: Column, t: Column) -> Column:
    """Piecewise linear through ``picks``, an array of structs (t, v) sorted by t; ends are held, none gives null."""
    n = F.size(picks)

    def between(k: Column) -> Column:
        a, b = F.get(picks, k), F.get(picks, k + 1)
        return a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"])

    at = F.size(F.filter(picks, lambda p: p["t"] <= t)) - 1
    return F.when(n <= 0, None).when(at < 0, F.get(picks, F.lit(0))["v"]).when(at >= n - 1, F.get(picks, n - 1)["v"]).otherwise(between(at))


def nmo(samples: Column, x: Column, picks: Column, dt: float, stretch: float | None = None, inverse: bool = False) -> Column:
    """Moveout with velocities that change with time, by linear interpolation, zero beyond the trace.

    Stretch is mistie over t0 (over one sample at the start), and samples above ``stretch`` percent are muted. The inverse
    reads the corrected trace at the t0 of each time and mutes nothing.
    """

    def value(i: Column) -> Column:
        t0 = i * dt
        v = velocity_at(picks, t0)
        t = F.sqrt(F.greatest(t0 * t0 + (-1.0 if inverse else 1.0) * x * x / (v * v), F.lit(0.0)))
        read = linear(samples, t / dt)
        if stretch is None or inverse:
            return read
        return F.when(F.abs(t - t0) / F.greatest(t0, F.lit(dt)) > stretch / 100.0, 0.0).otherwise(read)

    return F.transform(indices(samples), value)


def exploded(df: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """(keys, it, v) of an array column."""
    return df.select(*keys, F.posexplode(samples).alias("it", "v")).withColumns({"it": F.col("it").cast("long"), "v": F.col("v").cast("double")})


def nmo_stack(traces: DataFrame, keys: list[str], picks: Column, dt: float, stretch: float | None = None, normalise: bool = True) -> DataFrame:
    """(keys, it, stack, fold): traces corrected and added by bin; muted samples are zeros that count, as in a plain mean."""
    rows = exploded(traces.withColumn("_o", nmo(F.col("samples"), F.col("offset"), picks, dt, stretch)), keys, "_o")
    out = rows.groupBy(*keys, "it").agg(F.sum("v").alias("stack"), F.count(F.lit(1)).alias("fold"))
    return out.withColumn("stack", F.col("stack") / F.col("fold")) if normalise else out


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: samples of both, of one only, and mean, root mean square and largest difference and correlation of those of both."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    d = F.col("_a") - F.col("_b")
    return both.agg(
        F.count(d).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_first"), F.count_if(F.col("_a").isNull()).alias("n_second"),
        F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("largest"), F.corr("_a", "_b").alias("correlation"),
    )


def super_gather(rows: DataFrame, ix: int, iy: int, half: int, edges_low: float, width: float, bins: int) -> DataFrame:
    """(bin, it, v, fold): samples of all gathers up to ``half`` cells away, added in new offset bins and divided by their number."""
    near = rows.where(F.col("ix").between(ix - half, ix + half) & F.col("iy").between(iy - half, iy + half))
    near = near.withColumn("bin", F.floor((F.col("offset") - edges_low) / width).cast("long")).where(F.col("bin").between(0, bins - 1))
    return near.groupBy("bin", "it").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("fold"))


def snake(ix: Column, iy: Column, nx: int) -> Column:
    """Rank of a tile when odd rows are walked backwards."""
    return iy * nx + F.when(iy % 2 == 0, ix).otherwise(nx - 1 - ix)


def sparse_picks(values: Column, most: int) -> Column:
    """Every n / most-th element of an array, and the last one, as structs (i, v)."""
    step = F.greatest(F.floor(F.size(values) / most).cast("int"), F.lit(1))
    return F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: (p["i"] % step == 0) | (p["i"] == F.size(values) - 1))


def nearest_pick(picks: Column, t: Column, v: Column, dt: float = 50.0, dv: float = 100.0) -> Column:
    """The pick (t, v) nearest within the ellipse of half axes dt and dv, null if none; ties to the earlier one."""
    far = lambda p: F.pow((p["t"] - t) / dt, F.lit(2.0)) + F.pow((p["v"] - v) / dv, F.lit(2.0))
    near = F.filter(F.transform(picks, lambda p: F.struct(far(p).alias("d"), p["t"].alias("t"), p["v"].alias("v"))), lambda p: p["d"] < 1.0)
    return F.array_min(near)
