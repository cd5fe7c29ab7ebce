"""The direction that a survey was acquired in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Traces of the middle inline, shots of a line and lines that a direction is read from need to be more than these.
LEAST_TRACES, LEAST_SHOTS, LEAST_LINES = 10, 5, 3
#: Extents along both principal axes are told apart from this ratio of variances on; directions this near to an axis are the axis.
LEAST_RATIO, NEAR_AXIS = 1.2, 3.0


def _bearing(dx: Column, dy: Column) -> Column:
    """Degrees from north, eastward, -180 to 180."""
    return F.degrees(F.atan2(dx, dy))


def _half_turn(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(180.0))


def by_middle_inline(df: DataFrame, inline: str, crossline: str, order: str, x: str = "mx", y: str = "my") -> DataFrame:
    """One row (azimuth): across the line from the first to the last crossline of the middle inline; null with too few traces there."""
    middle = df.agg(F.floor((F.min(inline) + F.max(inline)) / 2).alias("_middle"))
    own = df.crossJoin(F.broadcast(middle)).where(F.col(inline) == F.col("_middle"))
    at = F.struct(crossline, order, x, y)
    ends = own.agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n"))
    across = _bearing(F.col("b")[x] - F.col("a")[x], F.col("b")[y] - F.col("a")[y])
    return ends.select(F.when(F.col("n") > LEAST_TRACES, _half_turn(across + 90.0)).alias("azimuth"))


def by_shot_lines(df: DataFrame, line: str, order: str, x: str = "sx", y: str = "sy") -> DataFrame:
    """One row (azimuth): the mean step from first to last shot of the lines that have enough; null with too few such lines."""
    at = F.struct(order, x, y)
    lines = df.groupBy(line).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAST_SHOTS)
    step = lines.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("b")[x] - F.col("a")[x]).alias("dx"), F.avg(F.col("b")[y] - F.col("a")[y]).alias("dy"))
    bearing = _bearing(F.col("dx"), F.col("dy"))
    return step.select(F.when(F.col("n") > LEAST_LINES, F.when(bearing < 0, bearing + 180.0).otherwise(bearing)).alias("azimuth"))


def by_principal_axis(df: DataFrame, x: str = "mx", y: str = "my") -> DataFrame:
    """One row (azimuth): the axis of largest variance, an axis of coordinates if it is near; 0 where both axes are alike; null without points."""
    m = df.agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"), F.count(F.lit(1)).alias("n"))
    half, spread = (F.col("a") + F.col("c")) / 2.0, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2.0, F.lit(2.0)) + F.col("b") * F.col("b"))
    alike = (half - spread <= 0) | (half + spread < LEAST_RATIO * (half - spread))
    axis = _half_turn(90.0 - F.degrees(0.5 * F.atan2(2.0 * F.col("b"), F.col("a") - F.col("c"))))
    near = F.when((axis < NEAR_AXIS) | (axis > 180.0 - NEAR_AXIS), 0.0).when(F.abs(axis - 90.0) < NEAR_AXIS, 90.0).otherwise(axis)
    return m.select(F.when(F.col("n") > 0, F.when(alike, 0.0).otherwise(near)).alias("azimuth"))


def acquisition_azimuth(df: DataFrame, order: str, inline: str | None = None, crossline: str | None = None, line: str | None = None) -> DataFrame:
    """One row (azimuth, method): degrees from north, 0 to 180, of the inline direction, by the first of these that has enough to go by:
    the middle inline, where ``inline`` and ``crossline`` columns are named, the shot lines, where ``line`` is, and the principal
    axis of the midpoints. ``order`` says which shot of a line comes first.

    All of them are aggregations of one plan, so nothing is decided on the driver.
    """
    ways = []
    if inline and crossline:
        ways.append(("inline", by_middle_inline(df, inline, crossline, order)))
    if line:
        ways.append(("shot lines", by_shot_lines(df, line, order)))
    ways.append(("principal axis", by_principal_axis(df)))
    met = None
    for k, (_, way) in enumerate(ways):
        own = way.withColumnRenamed("azimuth", f"_{k}")
        met = own if met is None else met.crossJoin(F.broadcast(own))
    method = None
    for k, (name, _) in enumerate(ways):
        found = F.col(f"_{k}").isNotNull()
        method = F.when(found, name) if method is None else method.when(found, name)
    return met.select(F.coalesce(*[F.col(f"_{k}") for k in range(len(ways))]).alias("azimuth"), method.alias("method"))
