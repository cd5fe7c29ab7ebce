"""Kirchhoff time migration: traces meet tiles of image points once, and tasks add whole time axes into the image of a tile."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.functions import interpolation
from wavegrid.functions import traveltime as T
from wavegrid.functions.dual import Gathered
from wavegrid.session import ensure_checkpoint_dir, ship_package

Array = np.ndarray

#: Values of the image that a task holds at once: points of a tile times times.
TILE_VALUES = 1 << 21
#: Traces that reach a tile from which it is shared by several units of work.
UNIT_TRACES = 4096
#: Traces, and values of a point's traces, that are worked on at once.
TRACES, VALUES = 1 << 14, 1 << 18
#: Zeros at both ends of a trace, as many as the longest interpolation reaches beyond a sample.
MARGIN = 9
#: Tiles whose counts are sent to all tasks; more are joined by shuffling.
BROADCAST_TILES = 1 << 16


@dataclass(frozen=True)
class Options:
    dt: float = 0.008
    t_start: float = 0.0
    #: A number, a function of t0, or the name of the image points' array column over ``it``.
    velocity: float | str | Callable[[Array], Array] = 2000.0
    max_aperture: float = 500.0
    min_aperture: float = 100.0
    dip: float = 45.0
    taper: float = 0.1
    method: str = "linear"
    spreading: bool = False
    obliquity: bool = True
    #: "time" opens the aperture with time and dip, "open" from the least one by half the path, "constant" uses the largest everywhere.
    aperture_mode: str = "time"
    #: (t0, source distance, receiver distance, velocity, one array for each of ``pillar``) to time; straight rays if None.
    travel_time: Callable[..., Array] | None = None
    dominant_frequency: float | None = None
    grid_spacing: float = 25.0
    #: Further array columns over ``it`` of the image points, such as eta.
    pillar: tuple[str, ...] = ()


@dataclass(frozen=True)
class Axis:
    """Image times: the array columns' index of each and the place where its amplitude is added (one for each different index)."""

    it: Array
    t0: Array
    place: Array


class Tile:
    """The image of some points; traces are added a batch at a time."""

    def __init__(self, o: Options, axis: Axis, x: Array, y: Array, profiles: dict[str, list]) -> None:
        self.o, self.axis, self.x, self.y = o, axis, x, y
        t0 = axis.t0[None, :]
        own = {name: self._profile(rows) for name, rows in profiles.items()}
        v = own[o.velocity] if isinstance(o.velocity, str) else o.velocity(t0) if callable(o.velocity) else np.full_like(t0, o.velocity)
        self.v, self.more = np.asarray(v, float), [own[name] for name in o.pillar]
        reach = {"time": lambda: T.aperture(t0, self.v, o.dip, o.min_aperture, o.max_aperture), "open": lambda: np.minimum(o.min_aperture + self.v * t0 / 2.0, o.max_aperture)}
        self.reach = reach.get(o.aperture_mode, lambda: np.full_like(t0, o.max_aperture))()
        self.n = int(axis.place.max(initial=-1)) + 1
        self.amp, self.fold = np.zeros((len(x), self.n)), np.zeros((len(x), self.n), np.int64)

    def _profile(self, rows: list) -> Array:
        """Values at the axis' indexes; NaN, which contributes nothing, where an array has none."""
        out = np.full((len(rows), len(self.axis.it)), np.nan)
        for own, row in zip(out, rows, strict=True):
            held = np.array(row if row is not None else [], float)
            inside = (self.axis.it >= 0) & (self.axis.it < len(held))
            own[inside] = held[self.axis.it[inside]]
        return out

    def add(self, sx: Array, sy: Array, rx: Array, ry: Array, mx: Array, my: Array, samples: Array, sizes: Array) -> None:
        """Adds traces point by point, the near traces of a point and all times being one array."""
        few = max(1, VALUES // max(1, len(self.axis.t0)))
        for at in range(0, len(sx), TRACES):
            b = slice(at, at + TRACES)
            for p, (x, y) in enumerate(zip(self.x, self.y, strict=True)):
                d2 = (mx[b] - x) ** 2 + (my[b] - y) ** 2
                near = np.flatnonzero(d2 <= self.o.max_aperture**2) + at
                for k in range(0, len(near), few):
                    i = near[k : k + few]
                    self._add(p, np.sqrt(d2[i - at])[:, None], ((sx[i] - x) ** 2 + (sy[i] - y) ** 2)[:, None], ((rx[i] - x) ** 2 + (ry[i] - y) ** 2)[:, None], i, samples, sizes)

    def _add(self, point: int, d: Array, source: Array, receiver: Array, trace: Array, samples: Array, sizes: Array) -> None:
        """Columns of traces meet rows of times; what the aperture or a trace's end leaves out counts as 0."""
        o = self.o
        of = lambda rows: rows[point : point + 1] if len(rows) > 1 else rows
        t0, v, reach = self.axis.t0[None, :], of(self.v), of(self.reach)
        t = o.travel_time(t0, np.sqrt(source), np.sqrt(receiver), v, *map(of, self.more)) if o.travel_time else T.dsr(t0, source, receiver, v)
        s = (t - o.t_start) / o.dt
        inside = (d <= reach) & (s >= 0) & (s < sizes[trace, None] - 1)
        if not inside.any():
            return
        amp = interpolation.interpolate(o.method, Gathered(samples, sizes, trace[:, None], MARGIN), np.where(inside, s, 0.0))
        if o.spreading:
            amp *= T.spreading(v, t)
        if o.obliquity:
            amp *= T.obliquity(t0, t)
        if o.dominant_frequency:
            amp *= T.alias_weight(v, o.grid_spacing, T.dip_sine(d, v * t0 / 2.0), o.dominant_frequency)
        k, j = np.nonzero(inside & (d > reach * (1.0 - o.taper)))
        amp[k, j] *= T.taper(d[k, 0], reach[0, j], o.taper)
        amp[~inside] = 0.0
        np.add.at(self.amp[point], self.axis.place, amp.sum(axis=0))
        np.add.at(self.fold[point], self.axis.place, inside.sum(axis=0))


def padded(samples: pa.Array) -> tuple[Array, Array]:
    """A row of samples for each trace, between MARGIN zeros, and the traces' lengths."""
    sizes = np.diff(samples.offsets.to_numpy())
    rows = np.zeros((len(sizes), int(sizes.max(initial=0)) + 2 * MARGIN))
    rows[:, MARGIN : rows.shape[1] - MARGIN][np.arange(rows.shape[1] - 2 * MARGIN) < sizes[:, None]] = samples.flatten().to_numpy(zero_copy_only=False)
    return rows, sizes


_COORDINATES = ("sx", "sy", "rx", "ry", "mx", "my")


def _images(batches: Iterator[pa.RecordBatch], o: Options, axis: Axis, profiles: tuple[str, ...], keys: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit of work, its image points first: the image of every unit with a trace."""
    unit, points, tile = None, [], None

    def image() -> Iterator[pa.RecordBatch]:
        if tile is None:
            return
        amp, fold = tile.amp, tile.fold
        rows = np.flatnonzero(fold.any(axis=1))
        key = pa.chunked_array([b.column("key") for b in points], keys).combine_chunks()
        for at in range(0, len(rows), step := max(1, VALUES // tile.n)):
            r = rows[at : at + step]
            offsets = pa.array(np.arange(len(r) + 1) * tile.n, pa.int32())
            yield pa.RecordBatch.from_arrays([key.take(pa.array(r)), pa.ListArray.from_arrays(offsets, pa.array(amp[r].ravel())), pa.ListArray.from_arrays(offsets, pa.array(fold[r].ravel()))], ["key", "amp", "fold"])

    with np.errstate(all="ignore"):
        for batch in batches:
            columns = np.stack([batch.column(c).to_numpy() for c in ("tx", "ty", "cut", "salt", "kind")], axis=1)
            ends = np.r_[0, np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1, batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tuple(columns[a, :4]) != unit:
                    yield from image()
                    unit, points, tile = tuple(columns[a, :4]), [], None
                if not columns[a, 4]:
                    points.append(part)
                    continue
                if tile is None:
                    table = pa.Table.from_batches(points)
                    tile = Tile(o, axis, table.column("mx").to_numpy(), table.column("my").to_numpy(), {n: table.column(n).to_pylist() for n in profiles})
                tile.add(*[part.column(c).to_numpy() for c in _COORDINATES], *padded(part.column("samples")))
        yield from image()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the sums of the arrays of each."""
    last, amp, fold, held = None, None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held, pa.array([amp]), pa.array([fold])], ["key", "amp", "fold"])

    for batch in batches:
        keys = batch.column("key").to_pylist()
        amps, folds = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None for c in ("amp", "fold"))
        for i, key in enumerate(keys):
            if key != last:
                if held is not None:
                    yield row()
                last, amp, fold, held = key, amps[i].copy(), folds[i].copy(), batch.column("key").slice(i, 1)
            else:
                amp += amps[i]
                fold += folds[i]
    if held is not None:
        yield row()


def _size_of_tiles(grid: DataFrame, o: Options, points: int) -> float:
    """The edge of a tile: two apertures at most, and so short that an evenly filled tile has under ``points`` points."""
    r = grid.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).first()
    area = max(1.0, (r.max_x or 0.0) - (r.min_x or 0.0)) * max(1.0, (r.max_y or 0.0) - (r.min_y or 0.0))
    return max(o.max_aperture / 16.0, min(2.0 * o.max_aperture, math.sqrt(points * area / max(1, r.n))))


def migrate_points(traces: DataFrame, grid: DataFrame, times: DataFrame, options: Options, keys: tuple[str, ...] = ("ix", "iy"), tile_values: int = TILE_VALUES, unit_traces: int = UNIT_TRACES) -> tuple[DataFrame, list[int]]:
    """(keys, amp, fold) of every image point that a trace reaches, arrays over time, and the ``it`` that each element stands for.

    ``traces`` have sx, sy, rx, ry, mx, my and samples, ``grid`` keys, x and y; ``times`` (it, t0) is a small axis. Image points
    lie in tiles of at most ``tile_values`` values. A trace goes to the tiles within its largest aperture. A tile with more than
    ``unit_traces`` of them is shared by several units of work, and one with too many points is cut; each unit's traces pass
    through a task once and in any number, into an image that the bound holds. Where a tile had several units, their images are
    added up, one row a point and unit. Traces or points with a null coordinate take no part; a null sample counts as NaN.
    """
    o, spark = options, traces.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    axis_rows = sorted({(r.it, r.t0) for r in times.select("it", "t0").distinct().collect()})
    its = sorted({it for it, _ in axis_rows})
    axis = Axis(np.array([r[0] for r in axis_rows], np.int64), np.array([r[1] for r in axis_rows], float), np.searchsorted(its, [r[0] for r in axis_rows]))
    profiles = tuple(dict.fromkeys([*([o.velocity] if isinstance(o.velocity, str) else []), *o.pillar]))
    limit = max(1, tile_values // max(1, len(its)))
    edge = _size_of_tiles(grid, o, limit)
    cell = lambda c: F.floor(F.col(c) / edge).cast("int")
    points = grid.where("x IS NOT NULL AND y IS NOT NULL").select(F.struct(*keys).alias("key"), F.col("x").alias("mx"), F.col("y").alias("my"), *profiles, cell("x").alias("tx"), cell("y").alias("ty"))
    around = lambda c: F.sequence(F.floor((F.col(c) - o.max_aperture) / edge).cast("int"), F.floor((F.col(c) + o.max_aperture) / edge).cast("int"))
    held = traces.where(" AND ".join(f"{c} IS NOT NULL" for c in (*_COORDINATES, "samples")))
    tiles = points.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    reached = held.select("mx", "my").withColumn("tx", F.explode(around("mx"))).withColumn("ty", F.explode(around("my"))).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("m"))
    tiles = tiles.join(reached, ["tx", "ty"]).select("tx", "ty", F.ceil(F.col("n") / limit).cast("int").alias("cuts"), F.ceil(F.col("m") / unit_traces).cast("int").alias("salts")).checkpoint()
    n, units, shared = tiles.agg(F.count(F.lit(1)), F.sum(F.col("cuts") * F.col("salts")), F.max("salts")).first()
    sent = F.broadcast(tiles) if n <= BROADCAST_TILES else tiles
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    none = lambda t: F.lit(None).cast(t)
    of_points = points.join(sent, ["tx", "ty"]).withColumn("cut", F.pmod(F.hash("key"), F.col("cuts"))).withColumn("salt", each("salts"))
    # a hash of all columns deals a place's many traces to units, the same way whenever a task runs again
    own = held.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in traces.columns])).select(*_COORDINATES, "samples", "_h")
    of_traces = own.withColumn("tx", F.explode(around("mx"))).withColumn("ty", F.explode(around("my"))).join(sent, ["tx", "ty"]).withColumn("salt", F.pmod("_h", F.col("salts")).cast("int")).withColumn("cut", each("cuts"))
    unit = ["tx", "ty", "cut", "salt"]
    key_type = points.schema["key"].dataType.simpleString()
    rows = of_points.select(*unit, F.lit(0).alias("kind"), "key", *[none("double").alias(c) for c in _COORDINATES[:4]], "mx", "my", *[F.col(p).cast("array<double>").alias(p) for p in profiles], none("array<double>").alias("samples"))
    rows = rows.unionByName(of_traces.select(*unit, F.lit(1).alias("kind"), none(key_type).alias("key"), *[F.col(c).cast("double").alias(c) for c in _COORDINATES], *[none("array<double>").alias(p) for p in profiles], F.col("samples").cast("array<double>").alias("samples")))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(least, min(2 * (units or 0), 20_000)), *unit).sortWithinPartitions(*unit, "kind")
    schema = f"key {key_type}, amp array<double>, fold array<long>"
    images = dealt.mapInArrow(partial(_images, o=o, axis=axis, profiles=profiles, keys=_arrow_type(points.schema["key"].dataType)), schema)
    if (shared or 0) > 1:
        images = images.repartition("key").sortWithinPartitions("key").mapInArrow(_added, schema)
    return images.select("key.*", "amp", "fold"), its


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def migrate(traces: DataFrame, grid: DataFrame, times: DataFrame, options: Options, keys: tuple[str, ...] = ("ix", "iy"), normalise: bool = False) -> DataFrame:
    """(keys, it, amp, fold): image and fold, the number of contributing traces of each sample, where there is one."""
    points, its = migrate_points(traces, grid, times, options, keys)
    out = points.select(*keys, F.posexplode(F.arrays_zip("amp", "fold")).alias("_i", "_own"))
    out = out.select(*keys, F.get(F.lit(its).cast("array<long>"), F.col("_i")).alias("it"), "_own.amp", "_own.fold").where("fold > 0")
    return out.withColumn("amp", F.col("amp") / F.col("fold")) if normalise else out
