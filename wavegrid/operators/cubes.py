"""Velocity cubes: a row per pillar (ix, iy) with its values over time."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.geometry import clamp


@dataclass(frozen=True)
class Axis:
    """n values from ``start`` at distances ``step``; n is 2 or more."""

    start: float
    step: float
    n: int

    def position(self, value: Column) -> tuple[Column, Column]:
        """Number of the interval that holds a value, and the share of it that lies before; ends are held."""
        at = (clamp(value, self.start, self.start + self.step * (self.n - 1)) - self.start) / self.step
        low = F.least(F.floor(at), F.lit(self.n - 2)).cast("long")
        return low, at - low


def cells(cube: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """A row per cell of four pillars: (cx, cy, corners), corners being the arrays at 00, 10, 01 and 11."""
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
    wide = cube.select("ix", "iy", "v", F.explode(corner).alias("c"))
    wide = wide.select((F.col("ix") - F.col("c.i")).alias("cx"), (F.col("iy") - F.col("c.j")).alias("cy"), (F.col("c.j") * 2 + F.col("c.i")).alias("at"), "v")
    wide = wide.where(F.col("cx").between(0, x.n - 2) & F.col("cy").between(0, y.n - 2))
    sorted_corners = F.array_sort(F.collect_list(F.struct("at", "v")))
    return wide.groupBy("cx", "cy").agg(F.transform(sorted_corners, lambda p: p["v"]).alias("corners"))


def at_points(points: DataFrame, cube: DataFrame, x: Axis, y: Axis, t: Axis, px: str = "x", py: str = "y", pt: str = "t", out: str = "velocity") -> DataFrame:
    """``points`` with the trilinear value of a cube (ix, iy, v: an array over t), clamped to its bounds.

    Points are joined once, on the cell that holds them; they are neither copied nor grouped. A point whose
    cell lacks a pillar gets null.
    """
    (cx, fx), (cy, fy), (ct, ft) = x.position(F.col(px)), y.position(F.col(py)), t.position(F.col(pt))
    own = points.withColumns({"_cx": cx, "_cy": cy, "_p": F.struct(fx.alias("fx"), fy.alias("fy"), ct.alias("ct"), ft.alias("ft"))})
    held = cells(cube, x, y).select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "corners")
    p = F.col("_p")

    def pillar(k: int) -> Column:
        v = F.get(F.col("corners"), F.lit(k))
        return F.get(v, p["ct"].cast("int")) * (1.0 - p["ft"]) + F.get(v, p["ct"].cast("int") + 1) * p["ft"]

    front, back = (pillar(2 * j) * (1.0 - p["fx"]) + pillar(2 * j + 1) * p["fx"] for j in (0, 1))
    value = F.when(F.size("corners") == 4, front * (1.0 - p["fy"]) + back * p["fy"])
    return own.join(held, ["_cx", "_cy"], "left").withColumn(out, value).drop("_cx", "_cy", "_p", "corners")


def pillars(points: DataFrame, cube: DataFrame, x: Axis, y: Axis, px: str = "x", py: str = "y", out: str = "velocities") -> DataFrame:
    """``points`` with the array over time between the four pillars around each, bilinear and clamped to the cube; null if one is missing."""
    (cx, fx), (cy, fy) = x.position(F.col(px)), y.position(F.col(py))
    own = points.withColumns({"_cx": cx, "_cy": cy, "_f": F.struct(fx.alias("x"), fy.alias("y"))})
    held = cells(cube, x, y).select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "corners")
    mix = lambda a, b, f: F.zip_with(a, b, lambda p, q: p * (1.0 - f) + q * f)
    corner = [F.get("corners", F.lit(k)) for k in range(4)]
    f = F.col("_f")
    value = F.when(F.size("corners") == 4, mix(mix(corner[0], corner[1], f["x"]), mix(corner[2], corner[3], f["x"]), f["y"]))
    return own.join(held, ["_cx", "_cy"], "left").withColumn(out, value).drop("_cx", "_cy", "_f", "corners")


def at_node(queries: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """``queries`` (il, xl) with the value of the nearest node at most one line away on both axes, else null; ties to the smaller (il, xl).

    Each query meets the nine places around it by an equi-join; nodes without a value take no part.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    found = nodes.where(F.col(value).isNotNull()).select(F.col("il").alias("_il"), F.col("xl").alias("_xl"), F.col(value).alias("_value"))
    wide = queries.select("il", "xl").distinct().withColumn("_n", F.explode(around))
    wide = wide.select("il", "xl", (F.col("il") + F.col("_n.i")).alias("_il"), (F.col("xl") + F.col("_n.j")).alias("_xl"), (F.abs("_n.i") + F.abs("_n.j")).alias("_far"))
    best = wide.join(found, ["_il", "_xl"]).groupBy("il", "xl").agg(F.min_by("_value", F.struct("_far", "_il", "_xl")).alias(value))
    return queries.join(best, ["il", "xl"], "left")


def along_line(targets: DataFrame, nodes: DataFrame, line: str, at: str, value: str) -> DataFrame:
    """``targets`` with a value linear between the nodes of their line and on beyond them; one node holds along its line, none gives null.

    A line's nodes, the picks of an interpreter, are one array.
    """
    from wavegrid.functions.sampling import on_line

    own = nodes.groupBy(line).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("double").alias("t"), F.col(value).alias("v")))).alias("_nodes"))
    return targets.join(own, line, "left").withColumn(value, on_line(F.col("_nodes"), F.col(at).cast("double"))).drop("_nodes")


def coverage(points: DataFrame, x: Axis, y: Axis, px: str = "x", py: str = "y") -> DataFrame:
    """One row: points, those outside the cube's rectangle, percent, and the widest gaps beyond each side (0 if none)."""
    end = lambda a: a.start + a.step * (a.n - 1)
    outside = ~(F.col(px).between(x.start, end(x)) & F.col(py).between(y.start, end(y)))
    gap = lambda c: F.greatest(c, F.lit(0.0))
    out = points.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("n_outside"), gap(x.start - F.min(px)).alias("gap_x_low"), gap(F.max(px) - end(x)).alias("gap_x_high"),
        gap(y.start - F.min(py)).alias("gap_y_low"), gap(F.max(py) - end(y)).alias("gap_y_high"),
    )
    return out.withColumn("percent_outside", F.when(F.col("n") > 0, 100.0 * F.col("n_outside") / F.col("n")).otherwise(0.0))


def interval_gradient(df: DataFrame, keys: list[str], t_ms: str, v: str) -> DataFrame:
    """(keys, v0, k) of a straight line of interval velocities over depth, which half their sum over time approximates; both are clamped.

    One velocity gives itself and k 0. A key's velocities are one function of time.
    """
    w = Window.partitionBy(*keys).orderBy(t_ms)
    t, before, after = F.col(t_ms) / 1000.0, F.lag(t_ms).over(w) / 1000.0, F.lead(t_ms).over(w) / 1000.0
    step = F.coalesce((after - before) / 2.0, after - t, t - before)
    rows = df.select(*keys, t_ms, v, (F.col(v) * step).alias("_dz"))
    rows = rows.withColumn("_z", F.sum("_dz").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 2.0)
    line = rows.groupBy(*keys).agg(F.regr_slope(v, "_z").alias("_k"), F.regr_intercept(v, "_z").alias("_b"), F.avg(v).alias("_m"))
    return line.select(*keys, clamp(F.coalesce("_b", "_m"), 1000.0, 6000.0).alias("v0"), clamp(F.coalesce("_k", F.lit(0.0)), 0.0, 2.0).alias("k"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values along ``order``, per key: (keys, run from 0, value, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    numbered = df.select(*keys, order, value, new.alias("_new")).withColumn("run", F.sum("_new").over(w) - 1)
    return numbered.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def fitted_gradient(df: DataFrame, keys: list[str], t_ms: str, v: str, window_ms: float = 500.0) -> DataFrame:
    """(keys, v0, k) of a straight line through early velocities: k is twice the slope over v0; both are clamped.

    One velocity in the window, or one time, gives that mean velocity and k 0.
    """
    early = df.where(F.col(t_ms) <= window_ms).withColumn("_t", F.col(t_ms) / 1000.0)
    line = early.groupBy(*keys).agg(F.regr_slope(v, "_t").alias("_a"), F.regr_intercept(v, "_t").alias("_b"), F.avg(v).alias("_m"))
    k = F.when(F.col("_b") > 0, 2.0 * F.col("_a") / F.col("_b")).otherwise(0.0)
    return line.select(*keys, clamp(F.coalesce("_b", "_m"), 1000.0, 6000.0).alias("v0"), clamp(F.coalesce(k, F.lit(0.0)), 0.0, 2.0).alias("k"))


def gradients(cube: DataFrame) -> DataFrame:
    """(ix, iy, v, gx, gy): a cube with its changes from pillar to pillar along both axes, half of the neighbours' difference, one-sided at
    the ends; null where a pillar has no neighbour along an axis. Pillars meet their four neighbours in one exchange."""
    role = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(name).alias("name")) for i, j, name in ((0, 0, "own"), (1, 0, "left"), (-1, 0, "right"), (0, 1, "below"), (0, -1, "above"))])
    wide = cube.select("ix", "iy", "v", F.explode(role).alias("r")).select((F.col("ix") + F.col("r.i")).alias("ix"), (F.col("iy") + F.col("r.j")).alias("iy"), "r.name", "v")
    met = wide.groupBy("ix", "iy").agg(*[F.any_value(F.when(F.col("name") == n, F.col("v")), ignoreNulls=True).alias(n) for n in ("own", "left", "right", "below", "above")]).where("own IS NOT NULL")
    change = lambda a, b, by: F.zip_with(a, b, lambda p, q: (q - p) / by)

    def along(before: str, after: str) -> Column:
        a, b, o = F.col(before), F.col(after), F.col("own")
        return F.when(a.isNotNull() & b.isNotNull(), change(a, b, 2.0)).when(b.isNotNull(), change(o, b, 1.0)).when(a.isNotNull(), change(a, o, 1.0))

    return met.select("ix", "iy", F.col("own").alias("v"), along("left", "right").alias("gx"), along("below", "above").alias("gy"))


def extended(cube: DataFrame, x: Axis, y: Axis, new_x: Axis, new_y: Axis, damping: float = 0.3, low: float = 1500.0, high: float = 6000.0) -> DataFrame:
    """(ix, iy, v) on new axes: bilinear inside the cube, and beyond it the value at its edge and a damped part of the change there.

    That part is the edge's change from pillar to pillar times the distance beyond, in pillars, times the pillars' spacing. Values end
    in ``low`` to ``high``.
    """
    spark = cube.sparkSession
    grid = spark.range(new_x.n * new_y.n).select((F.col("id") % new_x.n).alias("ix"), F.floor(F.col("id") / new_x.n).cast("long").alias("iy"))
    grid = grid.withColumns({"x": new_x.start + F.col("ix") * new_x.step, "y": new_y.start + F.col("iy") * new_y.step})
    with_changes = gradients(cube).select("ix", "iy", F.concat("v", "gx", "gy").alias("v"))
    met = pillars(grid, with_changes, x, y, out="all")
    past = lambda c, a: F.col(c) - clamp(F.col(c), a.start, a.start + a.step * (a.n - 1))
    n = (F.size("all") / 3).cast("int")
    part = lambda k: F.slice("all", k * n + 1, n)
    change = F.zip_with(part(1), part(2), lambda gx, gy: damping * (gx * past("x", x) + gy * past("y", y)))
    value = F.zip_with(part(0), change, lambda v, c: F.least(F.greatest(v + c, F.lit(low)), F.lit(high)))
    return met.select("ix", "iy", value.alias("v"))


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights from -r to r, r being ``truncate`` deviations, that sum to one."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def _stencil(weights: list[float], n: int, block: int):
    """Weighted sums of neighbouring pillars of a block and its halo; lines go on beyond their ends by reflection."""
    r = len(weights) // 2

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(part["at"].tolist(), (np.asarray(v, float) for v in part["v"]), strict=True))
        rows = [i for i in sorted(held) if i // block == key[0]]
        out = []
        for i in rows:
            near = [(w, held.get(k if (k := (i + d) % (2 * n)) < n else 2 * n - 1 - k)) for d, w in zip(range(-r, r + 1), weights, strict=True)]
            near = [(w, v) for w, v in near if v is not None]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return pd.DataFrame({"at": rows, "line": [key[1]] * len(rows), "v": out})

    return run


def smoothed(cube: DataFrame, nx: int, ny: int, sigma: float = 2.0, block: int = 64) -> DataFrame:
    """(ix, iy, v) smoothed by a Gaussian along both axes of nx and ny pillars, reflected at the ends.

    In each of the two passes a pillar goes to the block of its line that holds it and, near a block's ends, to the next one,
    whose halo it is: one exchange a pass, of at most two copies of a pillar, and a task holds one block of a line at a time.
    Pillars that are missing have no weight.
    """
    if sigma <= 0:
        return cube.select("ix", "iy", "v")
    weights = gaussian(sigma)
    block = max(block, len(weights))
    for axis, other, n in (("ix", "iy", nx), ("iy", "ix", ny)):
        last = (n - 1) // block
        reach = lambda by, axis=axis, last=last: clamp(F.floor((F.col(axis) + by) / block), 0, last).cast("long")
        r = len(weights) // 2
        wide = cube.select(F.explode(F.sequence(reach(-r), reach(r))).alias("block"), F.col(other).alias("line"), F.col(axis).alias("at"), "v")
        cube = wide.groupBy("block", "line").applyInPandas(_stencil(weights, n, block), "at long, line long, v array<double>").withColumnsRenamed({"at": axis, "line": other})
    return cube.select("ix", "iy", "v")


def regenerated(cube: DataFrame, x: Axis, y: Axis, new_x: Axis, new_y: Axis, damping: float = 0.3, sigma: float = 2.0) -> DataFrame:
    """(ix, iy, v): the cube on new axes, continued beyond its edges (``extended``) and then smoothed (``smoothed``)."""
    return smoothed(extended(cube, x, y, new_x, new_y, damping), new_x.n, new_y.n, sigma)
