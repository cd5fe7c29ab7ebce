"""Values of scattered nodes at any points: linear in the Delaunay triangle around a point, by nodes near it alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.operators.joins import nearest_join
from wavegrid.session import ensure_checkpoint_dir, ship_package

#: Nodes that a tile of even density holds.
TILE_NODES = 64
#: Steps from triangle to triangle before a point is given up for this round; a walk needs a few.
STEPS = 500


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of rows (x, y), counter-clockwise; fewer than three if the points are on a line."""
    rows = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(rows) < 3:
        return np.array(rows).reshape(-1, 2)

    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(rows) + half(rows[::-1]))


def _hulls(batches):
    corners = np.empty((0, 2))
    for batch in batches:
        corners = hull(np.concatenate([corners, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)]))
    yield pa.RecordBatch.from_arrays([pa.array(corners[:, 0], pa.float64()), pa.array(corners[:, 1], pa.float64())], ["x", "y"])


def _weights(xy: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Barycentric weights of q in a triangle of rows; None if it has no area."""
    (ax, ay), (bx, by), (cx, cy) = xy - q
    area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return None if area == 0 else np.array([bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx]) / area


def around(q: np.ndarray, xy: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray] | None:
    """(rows, weights, radius, centre) of the Delaunay triangle of ``xy`` around q and its circle; None if q is outside the hull.

    Lifted to ``lift`` (squares of distances, and a bit to break ties), the triangle is the facet of the lower hull over q: the
    optimum of a linear program with three constraints. From three far corners of prohibitive height, a facet is left for
    the node that lies lowest under it until none does.
    """
    size = max(1.0, float(np.abs(xy - q).max(initial=0.0)))
    far = q + size * np.array([[-40.0, -30.0], [40.0, -30.0], [0.0, 50.0]])
    points, height = np.concatenate([xy, far]), np.r_[lift, np.full(3, 1e9 * size * size)]
    own = np.arange(len(xy), len(points))
    weight = _weights(points[own], q)
    for _ in range(STEPS):
        # the plane over the three, and how far nodes lie under it
        plane = np.linalg.solve(np.c_[points[own] - q, np.ones(3)], height[own])
        under = (points - q) @ plane[:2] + plane[2] - height
        under[own] = 0.0
        enter = int(np.argmax(under))
        if under[enter] <= 1e-12 * size * size:
            break
        share = _weights(points[own], points[enter])
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(share > 1e-15, weight / share, np.inf)
        leave = int(np.argmin(step))
        own[leave] = enter
        weight = _weights(points[own], q)
        if weight is None:
            return None
        weight = np.maximum(weight, 0.0)
    else:
        return None
    if (own >= len(xy)).any():
        return None
    (ax, ay), (bx, by), (cx, cy) = points[own] - points[own[0]]
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return own, weight / weight.sum(), math.hypot(ux, uy), points[own[0]] + (ux, uy)


def _triangles(key, targets: pd.DataFrame, nodes: pd.DataFrame, edge: float, halo: float) -> pd.DataFrame:
    """For a tile's points: three nodes and weights where the circle around them lies in the tile and its halo, else null."""
    xy = nodes[["x", "y"]].to_numpy(float)
    tx, ty = (int(k) for k in key)
    low, high = np.array([tx, ty]) * edge - halo, (np.array([tx, ty]) + 1) * edge + halo
    out = []
    for t, x, y in targets[["t", "x", "y"]].itertuples(index=False):
        q = np.array([x, y])
        if len(xy):
            lift = ((xy - q) ** 2).sum(axis=1) + nodes["tie"].to_numpy(float)
            found = around(q, xy, lift)
            if found is not None and (found[3] - found[2] >= low).all() and (found[3] + found[2] <= high).all():
                out.append((t, [int(nodes["node"].iloc[i]) for i in found[0]], found[1].tolist()))
                continue
        out.append((t, None, None))
    return pd.DataFrame(out, columns=["t", "nodes", "weights"])


def _for_tiles(edge: float, halo: float):
    def run(key, targets: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        return _triangles(key, targets, nodes, edge, halo)

    return run


def _inside(x, y, corners: np.ndarray):
    """Whether a point is in the closed convex polygon."""
    holds = F.lit(len(corners) > 2)
    for (ax, ay), (bx, by) in zip(corners.tolist(), np.roll(corners, -1, axis=0).tolist(), strict=True):
        holds = holds & ((bx - ax) * (F.col(y) - ay) - (by - ay) * (F.col(x) - ax) >= 0)
    return holds


def interpolate(nodes: DataFrame, targets: DataFrame, node_id: str = "node", value: str = "v", target_id: str = "t", tile: float | None = None) -> DataFrame:
    """``(target_id, x, y, value, how)`` of every target (target_id, x, y): ``linear`` in the Delaunay triangle of nodes
    (node_id, x, y, value) around it, of the ``nearest`` node outside their hull. ``value`` is an array, interpolated by element.

    Ids are unique longs. A tile's targets meet the nodes of the tile and a halo around it. A triangle counts once its circle lies
    within those, since then no other node can be in it; the targets left do so again in tiles and halos twice as wide, so that
    results don't depend on ``tile``. A task holds the places of the nodes that a tile and its halo have. Nodes on one circle are told apart by a small number from their ids, and of nodes
    at one place the smallest id counts. Nodes and targets without two finite coordinates take no part, nor do nodes
    without a value; without nodes there are no rows. The hull's corners are the only nodes that the driver sees.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    finite = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    held = nodes.select(F.col(node_id).cast("long").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("array<double>").alias("v")).where(f"{finite} AND v IS NOT NULL AND node IS NOT NULL")
    places = held.groupBy("x", "y").agg(F.min("node").alias("node")).checkpoint()
    asked = targets.select(F.col(target_id).cast("long").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite).checkpoint()
    n, x0, x1, y0, y1 = places.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide, high = ((x1 - x0), (y1 - y0)) if n else (0.0, 0.0)
    corners = hull(np.array([[r.x, r.y] for r in places.select("x", "y").mapInArrow(_hulls, "x double, y double").collect()]).reshape(-1, 2))
    # far below what tells neighbours apart, and the same for a node whatever tile looks at it
    tie = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20) * (1e-7 * wide * high / max(n, 1))
    placed = places.withColumn("tie", tie)
    edge = tile or max(math.sqrt(max(wide, 1e-9) * max(high, 1e-9) * TILE_NODES / max(n, 1)), max(wide, high) / 1e6, 1e-9)
    left, found, halo = asked.where(_inside("x", "y", corners)), None, edge / 2
    reach = 2 * (wide + high) + edge
    while n and not left.isEmpty():
        cell = lambda c, by=0.0, edge=edge: F.floor((F.col(c) + by) / edge).cast("long")
        of = left.withColumns({"tx": cell("x"), "ty": cell("y")})
        reached = [F.explode(F.sequence(cell(c, -halo), cell(c, halo))) for c in ("x", "y")]
        near = placed.withColumn("tx", reached[0]).withColumn("ty", reached[1]).join(of.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")

        met = of.groupBy("tx", "ty").cogroup(near.groupBy("tx", "ty")).applyInPandas(_for_tiles(edge, halo), "t long, nodes array<long>, weights array<double>").checkpoint()
        done = met.where("nodes IS NOT NULL")
        found = done if found is None else found.union(done)
        if halo > reach:
            break
        left = left.join(met.where("nodes IS NULL").select("t"), "t", "left_semi").checkpoint()
        edge, halo = 2 * edge, 2 * halo
    schema = "t long, nodes array<long>, weights array<double>"
    found = found if found is not None else spark.createDataFrame([], schema)
    rest = asked.join(found.select("t"), "t", "left_anti")
    near = _nearest(places, rest, edge)
    each = found.select("t", F.explode(F.arrays_zip("nodes", "weights")).alias("e")).select("t", F.col("e.nodes").alias("node"), F.col("e.weights").alias("w"), F.lit("linear").alias("how"))
    each = each.unionByName(near.select("t", "node", F.lit(1.0).alias("w"), F.lit("nearest").alias("how")))
    with_values = each.join(held.select("node", "v"), "node").select("t", "how", F.posexplode("v").alias("i", "x"), "w")
    summed = with_values.groupBy("t", "how", "i").agg(F.sum(F.col("x") * F.col("w")).alias("x")).groupBy("t", "how").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(value))
    return asked.join(summed, "t").select(F.col("t").alias(target_id), "x", "y", value, "how")


def _nearest(places: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(t, node) of the nearest node, ties to the smaller id."""
    points = places.select("node", F.col("x").alias("mx"), F.col("y").alias("my"))
    return nearest_join(points, targets, 1, radius, "node", "t").select("t", "node")
