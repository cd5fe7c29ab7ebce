"""Aggregations over headers, contributions and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.operators.quality import quantiles


def circular_mean(degrees: Column) -> Column:
    """Mean direction in [0, 360), from sums of sines and cosines."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(r)), F.sum(F.cos(r)))), F.lit(360.0))


def bin_headers(df: DataFrame, ix: Column, iy: Column) -> DataFrame:
    """Per bin: traces, mean offset and circular mean azimuth; every trace counts once."""
    return df.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("trace_count"), F.avg("offset").alias("offset_avg"), circular_mean(F.col("azimuth")).alias("azimuth_avg"))


def fold_map(df: DataFrame, size: float, x: str = "mx", y: str = "my") -> DataFrame:
    """Rows per square cell, counted from the smallest coordinates; the last cells hold the largest coordinates too."""
    ends = df.agg(F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.max(x).alias("_x1"), F.max(y).alias("_y1"))

    def cell(c: str, low: str, high: str) -> Column:
        last = F.greatest(F.ceil((F.col(high) - F.col(low)) / size), F.lit(1)) - 1
        return F.least(F.floor((F.col(c) - F.col(low)) / size), last).cast("long")

    return df.crossJoin(F.broadcast(ends)).groupBy(cell(x, "_x0", "_x1").alias("cx"), cell(y, "_y0", "_y1").alias("cy")).agg(F.count(F.lit(1)).alias("fold"))


def histogram(df: DataFrame, value: Column, low: float, width: float, bins: int) -> DataFrame:
    """Counts of half-open bins, the last one closed; what is outside is left out."""
    at = F.floor((value - low) / width).cast("long")
    at = F.when(value == low + width * bins, F.lit(bins - 1).cast("long")).otherwise(at)
    return df.withColumn("bin", at).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def offset_statistics(df: DataFrame) -> DataFrame:
    o, (median,) = F.col("offset"), quantiles(df, "offset", [0.5])
    return df.agg(F.min(o).alias("offset_min"), F.max(o).alias("offset_max"), F.avg(o).alias("offset_mean"), F.stddev_pop(o).alias("offset_std"), F.lit(median).cast("double").alias("offset_median"))


def dominant_bin(counts: DataFrame) -> DataFrame:
    """The bin of most rows, the first of equals."""
    return counts.agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))


def clipped_bin(value: Column, low: float, width: float, bins: int) -> Column:
    """Number of the bin, what is outside counted in the end bins."""
    return F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1)).cast("long")


def cig_bin(value: Column, edges: list[float]) -> Column:
    """Number of the half-open bin between edges, -1 outside."""
    out = F.lit(-1).cast("long")
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((value >= a) & (value < b), F.lit(k).cast("long")).otherwise(out)
    return out


def edges_from_centres(centres: list[float]) -> list[float]:
    middle = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
    half = (centres[1] - centres[0]) / 2 if len(centres) > 1 else 0.5
    return [centres[0] - half, *middle, centres[-1] + (centres[-1] - centres[-2]) / 2 if len(centres) > 1 else centres[0] + half]


def normalised(amplitude: Column, fold: Column) -> Column:
    return F.when(fold > 0, amplitude / fold).otherwise(0.0)


def weighted_stack(df: DataFrame, keys: list[str], value: str, fold: str) -> DataFrame:
    """Fold-weighted mean; where fold is missing, weight 1 for values that are not zero."""
    w = F.coalesce(F.col(fold), F.when(F.col(value) != 0, 1).otherwise(0)).cast("double")
    summed = df.groupBy(*keys).agg(F.sum(F.col(value) * w).alias("_s"), F.sum(w).alias("weight"))
    return summed.select(*keys, normalised(F.col("_s"), F.col("weight")).alias("stack"), "weight")


def live_stack(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of the values that are not zero, and their number."""
    return df.groupBy(*keys).agg((F.sum(value) / F.greatest(F.count_if(F.col(value) != 0), F.lit(1))).alias("stack"), F.count_if(F.col(value) != 0).alias("fold"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, and how many rows they have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def robust_mean(df: DataFrame, value: str) -> DataFrame:
    """Mean of the values from the 5th to the 95th percentile."""
    a, b = quantiles(df, value, [0.05, 0.95])
    return df.where(F.col(value).between(a, b)).agg(F.avg(value).alias("robust_mean"), F.count(F.lit(1)).alias("n"))


def volume_statistics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    v = F.col(value)
    ok = ~F.isnan(v) & v.isNotNull()
    return df.groupBy(*keys).agg(
        F.min(F.when(ok, v)).alias("amp_min"), F.max(F.when(ok, v)).alias("amp_max"), F.avg(F.when(ok, v)).alias("amp_mean"), F.stddev_pop(F.when(ok, v)).alias("amp_std"),
        F.sqrt(F.avg(F.when(ok, v * v))).alias("amp_rms"), F.count_if(~ok).alias("n_bad"), F.count_if(F.abs(v) < 1e-30).alias("n_zero"),
    )


def strongest(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The row of largest absolute value, the first by ``order`` of equals."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(F.abs(value), *[-F.col(c) for c in order])).alias("r")).select("r.*")


def gradients(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """Change of v from the sample before, per unit of t."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumn("dv", F.col(v) - F.lag(v).over(w)).withColumn("gradient", F.col("dv") / (F.col(t) - F.lag(t).over(w)))


def covariance_azimuth(df: DataFrame, x: str, y: str) -> DataFrame:
    """Direction of the largest spread, in degrees from north, in [0, 180)."""
    m = df.agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    angle = F.degrees(0.5 * F.atan2(2.0 * F.col("c"), F.col("a") - F.col("b")))
    return m.select(F.pmod(90.0 - angle, F.lit(180.0)).alias("azimuth"))


def range_histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, low, n) of ``bins`` bins of equal width from ``low`` to ``high``, the last one closed; empty ones too."""
    width = (high - low) / bins
    own = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")
    counts = df.where(F.col(value).between(low, high)).groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", (low + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def direction(df: DataFrame, azimuth: str) -> DataFrame:
    """One row (n, mean, std, direction, strength): plain mean and deviation of azimuths in degrees, and the direction and length of their mean vector."""
    s, c = F.avg(F.sin(F.radians(azimuth))), F.avg(F.cos(F.radians(azimuth)))
    out = df.agg(F.count(azimuth).alias("n"), F.avg(azimuth).alias("mean"), F.stddev_pop(azimuth).alias("std"), s.alias("s"), c.alias("c"))
    turned = F.degrees(F.atan2("s", "c"))
    return out.select("n", "mean", "std", F.when(turned < 0, turned + 360.0).otherwise(turned).alias("direction"), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")).alias("strength"))
