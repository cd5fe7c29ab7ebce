"""Bin sizes from the spacings of midpoints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.guards import standard_bin

#: Intervals that coordinates are sorted in; only their ends are ever sorted as a whole.
CELLS = 4096
#: Spacings below are taken as repeats.
LEAST = 1.0


def spacings(df: DataFrame, column: str, least: float = LEAST, cells: int = CELLS) -> DataFrame:
    """``(gap)``: distances of at least ``least`` between neighbours among the column's different values.

    Values are sorted within ``cells`` intervals, in parallel; the gaps between intervals come from a table of
    their ends, of at most that many rows. Nulls and NaN take no part.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").distinct()
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None or low == high:
        return values.select(F.col("x").alias("gap")).limit(0)
    values = values.withColumn("cell", F.floor((F.col("x") - low) / ((high - low) / cells)))
    inside = values.select((F.col("x") - F.lag("x").over(Window.partitionBy("cell").orderBy("x"))).alias("gap"))
    ends = values.groupBy("cell").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    between = ends.select((F.col("a") - F.lag("b").over(Window.orderBy("cell"))).alias("gap"))
    return inside.union(between).where(F.col("gap") >= least)


def modal(values: DataFrame, column: str, width: float = 5.0) -> tuple[float, float]:
    """Centre of the fullest histogram bin (the first of equals) and a confidence: five times its share, 1 at most.

    (0, 0) without values, and the value with confidence one half if all are equal.
    """
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return 0.0, 0.0
    if high <= low:
        return float(low), 0.5
    bins = max(10, math.floor((high - low) / width))
    step = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1))
    best = values.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bin").first()
    return low + (best.bin + 0.5) * step, min(1.0, 5.0 * best.n / n)


def by_histogram(df: DataFrame, x: str = "mx", y: str = "my", azimuth: float = 0.0, width: float = 5.0) -> DataFrame:
    """One row: raw_dx, raw_dy, dx, dy (the nearest standard sizes), confidence, fold and n.

    Coordinates are first turned by ``azimuth`` degrees, which needs both; at 0 each axis counts by itself. Without a spacing on
    an axis, both sizes are 25 and the confidence, which is above 0 otherwise, is 0.
    """
    c, s = math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
    turned = df.select((F.col(x) * c + F.col(y) * s).alias("u"), (F.col(y) * c - F.col(x) * s).alias("v")) if azimuth else df.select(F.col(x).alias("u"), F.col(y).alias("v"))
    (raw_dx, sure_x), (raw_dy, sure_y) = (modal(spacings(turned, k), "gap", width) for k in ("u", "v"))
    if not raw_dx or not raw_dy:
        raw_dx, raw_dy, sure_x, sure_y = 25.0, 25.0, 0.0, 0.0
    found = turned.agg(F.count(F.lit(1)).alias("n"), (F.max("u") - F.min("u")).alias("width"), (F.max("v") - F.min("v")).alias("height"))
    found = found.select(F.lit(raw_dx).alias("raw_dx"), F.lit(raw_dy).alias("raw_dy"), standard_bin(F.lit(raw_dx)).alias("dx"), standard_bin(F.lit(raw_dy)).alias("dy"), F.lit((sure_x + sure_y) / 2).alias("confidence"), "n", "width", "height")
    many = lambda size, of: F.greatest(F.floor(F.coalesce(F.col(of), F.lit(0.0)) / F.col(size)), F.lit(1))
    return found.withColumn("fold", F.col("n") / (many("dx", "width") * many("dy", "height"))).drop("width", "height")


def by_neighbours(df: DataFrame, ident: str, x: str = "mx", y: str = "my") -> DataFrame:
    """One row: raw size (the median distance to the nearest other point over the root of two), size, confidence, fold and n.

    ``ident`` is unique; rows of one place are 0 apart. The confidence falls as distances differ; fewer than two points give 25 and 0.
    Rows without two finite coordinates take no part.
    """
    from wavegrid.operators.joins import neighbour_distances
    from wavegrid.operators.quality import quantiles

    near = neighbour_distances(df, x, y)
    near = near.select("mx", "my", "dist", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).checkpoint()
    n, width, height, spread = near.agg(F.count(F.lit(1)), F.max("mx") - F.min("mx"), F.max("my") - F.min("my"), F.stddev_pop("dist")).first()
    median = quantiles(near, "dist", [0.5])[0] if n > 1 else 0.0
    raw = median / math.sqrt(2.0) if n > 1 else 25.0
    found = df.sparkSession.range(1).select(F.lit(raw).alias("raw"), standard_bin(F.lit(raw)).alias("size"), F.lit(max(0.0, 1.0 - spread / median) if median > 0 else 0.0).alias("confidence"), F.lit(n).cast("long").alias("n"))
    area = F.lit((width or 0.0) * (height or 0.0))
    return found.withColumn("fold", F.when(area > 0, F.col("n") / (area / (F.col("size") * F.col("size")))).otherwise(0.0))


#: Fewer points, or cells of an axis, have no spectrum worth reading.
LEAST_POINTS, LEAST_CELLS = 1000, 32
#: Frequencies near 0 that are the survey's outline.
OUTLINE = 3


def by_fourier(df: DataFrame, x: str = "mx", y: str = "my", resolution: float = 5.0) -> DataFrame:
    """One row: raw_dx, raw_dy, dx, dy, confidence, fold and n, from the strongest periods of the density of points.

    Cells of ``resolution`` are counted along each axis; their power spectra are those of the two-dimensional density where the
    other frequency is 0. The strongest frequency beyond OUTLINE (the lowest of equals) gives the period, over all cells and one
    more; periods outside 5 to 500 count as 25. The confidence is a twentieth of how far the peaks stand above the means of
    their spectra, 1 at most. With few points or cells it is ``by_histogram``. Rows without two finite coordinates take no part.
    """
    finite = df.select(F.col(x).cast("double").alias("mx"), F.col(y).cast("double").alias("my")).where("abs(mx) < double('infinity') AND abs(my) < double('infinity')")
    n, x0, x1, y0, y1 = finite.agg(F.count(F.lit(1)), F.min("mx"), F.max("mx"), F.min("my"), F.max("my")).first()
    cells = {c: max(1, math.ceil((b - a) / resolution)) for c, a, b in (("mx", x0, x1), ("my", y0, y1)) if n}
    if n < LEAST_POINTS or min(cells.values()) + 1 < LEAST_CELLS:
        return by_histogram(finite)
    from wavegrid.operators.spectrum import axis_power

    at = lambda c, low: F.least(F.floor((F.col(c) - low) / resolution), F.lit(cells[c] - 1)).cast("long")
    ends = F.array(*[F.struct(F.lit(c).alias("axis"), at(c, low).alias("i"), F.lit(cells[c]).alias("size")) for c, low in (("mx", x0), ("my", y0))])
    counts = finite.select(F.inline(ends)).groupBy("axis", "i", "size").agg(F.count(F.lit(1)).alias("n"))
    power = axis_power(counts, "axis", "i", "n", "size").withColumn("power", F.when(F.col("k") > OUTLINE, F.col("power")).otherwise(0.0))
    peak = F.min(F.when(F.col("k") > 0, F.struct((-F.col("power")).alias("p"), "k")))
    found = {r.axis: r for r in power.groupBy("axis").agg(peak.alias("peak"), F.avg("power").alias("mean")).collect()}
    raw, rise = {}, 0.0
    for c, r in found.items():
        period = (cells[c] + 1) * resolution / max(1, r.peak.k)
        raw[c] = period if 5.0 <= period <= 500.0 else 25.0
        rise += -r.peak.p / r.mean if r.mean > 0 else 0.0
    out = df.sparkSession.range(1).select(F.lit(raw["mx"]).alias("raw_dx"), F.lit(raw["my"]).alias("raw_dy"), standard_bin(F.lit(raw["mx"])).alias("dx"), standard_bin(F.lit(raw["my"])).alias("dy"), F.lit(min(1.0, rise / 20.0)).alias("confidence"), F.lit(n).cast("long").alias("n"))
    return out.withColumn("fold", F.col("n") / ((F.lit(x1 - x0) / F.col("dx")) * (F.lit(y1 - y0) / F.col("dy"))))


#: Points from which the spectrum has a say in the ensemble.
SPECTRUM_POINTS = 10_000


def ensemble(df: DataFrame, ident: str, x: str = "mx", y: str = "my", azimuth: float = 0.0, spectrum_points: int = SPECTRUM_POINTS) -> DataFrame:
    """One row (raw_dx, raw_dy, dx, dy, confidence): sizes by histogram, by neighbours and, from ``spectrum_points`` points on,
    by spectrum, weighted by their confidence; those by histogram if none has any."""
    found = [by_histogram(df, x, y, azimuth).first()]
    near = by_neighbours(df, ident, x, y).first()
    sizes = [(r.raw_dx, r.raw_dy, r.confidence) for r in found] + [(near.raw, near.raw, near.confidence)]
    if found[0].n >= spectrum_points:
        r = by_fourier(df, x, y).first()
        sizes.append((r.raw_dx, r.raw_dy, r.confidence))
    total = sum(c for *_, c in sizes)
    weight = [c / total for *_, c in sizes] if total > 0 else [1.0] + [0.0] * (len(sizes) - 1)
    raw = [F.lit(sum(s[k] * w for s, w in zip(sizes, weight, strict=True))) for k in (0, 1)]
    return df.sparkSession.range(1).select(raw[0].alias("raw_dx"), raw[1].alias("raw_dy"), standard_bin(raw[0]).alias("dx"), standard_bin(raw[1]).alias("dy"), F.lit(max(c for *_, c in sizes)).alias("confidence"))
