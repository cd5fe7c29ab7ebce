"""Survey geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres and feet.
FEET_IN_METRE = 3.28084
METRES_IN_FOOT = 0.3048

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def midpoint(sx: C = "sx", sy: C = "sy", rx: C = "rx", ry: C = "ry") -> tuple[Column, Column]:
    return (_c(sx) + _c(rx)) / 2.0, (_c(sy) + _c(ry)) / 2.0


def distance(ax: C, ay: C, bx: C, by: C) -> Column:
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    return F.sqrt(dx * dx + dy * dy)


def offset(sx: C = "sx", sy: C = "sy", rx: C = "rx", ry: C = "ry") -> Column:
    return distance(sx, sy, rx, ry)


def azimuth(sx: C = "sx", sy: C = "sy", rx: C = "rx", ry: C = "ry") -> Column:
    """Degrees clockwise from north, from source to receiver, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(_c(rx) - _c(sx), _c(ry) - _c(sy))), F.lit(360.0))


def segy_scaled(x: C, scalar: C) -> Column:
    """Positive scalars multiply, negative ones divide, 0 changes nothing."""
    x, s = _c(x), _c(scalar)
    return F.when(s > 0, x * s).when(s < 0, x / F.abs(s)).otherwise(x)


def metres_to_feet(x: C) -> Column:
    return _c(x) * FEET_IN_METRE


def feet_to_metres(x: C) -> Column:
    return _c(x) * METRES_IN_FOOT


def ms_to_s(t: C) -> Column:
    return _c(t) / 1000.0


def s_to_ms(t: C) -> Column:
    return _c(t) * 1000.0


def sample_to_time(i: C, dt: float, t0: float = 0.0) -> Column:
    return _c(i) * dt + t0


def time_to_sample(t: C, dt: float, t0: float = 0.0) -> Column:
    return (_c(t) - t0) / dt


def time_to_index(t: C, dt: float, t0: float = 0.0, n: int | None = None) -> Column:
    """The sample at or before a time; clamped to 0..n-1 if n is given."""
    at = F.floor(time_to_sample(t, dt, t0))
    return at if n is None else F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("long")


def format_bytes(n: C) -> Column:
    n = _c(n).cast("double")
    shown = F.format_string("%.1f B", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        shown = F.when(n >= 1024.0**power, F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(shown)
    return shown


def format_duration(seconds: C) -> Column:
    """``1h 02m 03s``, or minutes and seconds, or seconds with one decimal."""
    s = _c(seconds).cast("double")
    whole = F.floor(s)
    h, m = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%dm %02ds", m, whole % 60)).otherwise(F.format_string("%dh %02dm %02ds", h, m, whole % 60))


class Grid:
    """An output grid by its origin, inline direction (degrees from x towards y) and spacings."""

    def __init__(self, x0: float, y0: float, degrees: float, dx: float, dy: float) -> None:
        a = math.radians(degrees)
        self.x0, self.y0, self.dx, self.dy = x0, y0, dx, dy
        self.u, self.v = (math.cos(a), math.sin(a)), (-math.sin(a), math.cos(a))

    def to_grid(self, x: C, y: C) -> tuple[Column, Column]:
        """Fractional inline and crossline numbers of world coordinates."""
        px, py = _c(x) - self.x0, _c(y) - self.y0
        return (px * self.u[0] + py * self.u[1]) / self.dx, (px * self.v[0] + py * self.v[1]) / self.dy

    def to_world(self, i: C, j: C) -> tuple[Column, Column]:
        a, b = _c(i) * self.dx, _c(j) * self.dy
        return self.x0 + a * self.u[0] + b * self.v[0], self.y0 + a * self.u[1] + b * self.v[1]

    def nearest_cell(self, x: C, y: C, nx: int, ny: int) -> tuple[Column, Column, Column]:
        """Nearest bin, halves to even, and whether it is on the grid."""
        i, j = (F.rint(c).cast("long") for c in self.to_grid(x, y))
        return i, j, i.between(0, nx - 1) & j.between(0, ny - 1)


def rotation_degrees(corners: list[tuple[float, float]]) -> float:
    (ax, ay), (bx, by) = corners[0], corners[1]
    return math.degrees(math.atan2(by - ay, bx - ax))


def bounding_box(corners: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = zip(*corners, strict=True)
    return min(xs), max(xs), min(ys), max(ys)


def _side(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    return (x - b[0]) * (a[1] - b[1]) - (a[0] - b[0]) * (y - b[1])


def in_triangle(x: C, y: C, a, b, c) -> Column:
    """Inside or on an edge."""
    sides = [_side(_c(x), _c(y), *p) for p in ((a, b), (b, c), (c, a))]
    negative, positive = (F.lit(False) for _ in range(2))
    for s in sides:
        negative, positive = negative | (s < 0), positive | (s > 0)
    return ~(negative & positive)


def in_quad(x: C, y: C, corners: list[tuple[float, float]]) -> Column:
    a, b, c, d = corners
    return in_triangle(x, y, a, b, c) | in_triangle(x, y, a, c, d)


def edge_distance(x: C, y: C, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Signed distance to the line from a to b, positive to its right; 0 for an edge without length."""
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    if length == 0:
        return F.lit(0.0)
    return ((_c(x) - a[0]) * (b[1] - a[1]) - (_c(y) - a[1]) * (b[0] - a[0])) / length


def quad_distance(x: C, y: C, corners: list[tuple[float, float]]) -> Column:
    """The largest of the four edge distances: at most 0 inside corners in counter-clockwise order."""
    return F.greatest(*[edge_distance(x, y, corners[k], corners[(k + 1) % 4]) for k in range(4)])


def boundary_taper(x: C, y: C, corners: list[tuple[float, float]], width: float) -> Column:
    """1 deep inside, a cosine ramp to 0 at the edge over ``width``, 0 outside."""
    inside = -quad_distance(x, y, corners)
    return F.when(inside <= 0, 0.0).when(inside >= width, 1.0).otherwise(0.5 * (1.0 - F.cos(F.lit(math.pi) * inside / width)))


def extended_corners(corners: list[tuple[float, float]], buffer: float) -> list[tuple[float, float]]:
    """Corners pushed away from their centre by ``buffer``."""
    cx, cy = (sum(v) / len(corners) for v in zip(*corners, strict=True))
    out = []
    for x, y in corners:
        d = math.hypot(x - cx, y - cy)
        out.append((x, y) if d == 0 else (x + buffer * (x - cx) / d, y + buffer * (y - cy) / d))
    return out


def _spread_bits(v: Column) -> Column:
    v = v.cast("long").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(ix: C, iy: C) -> Column:
    """Bits of two numbers of up to 16 bits interleaved, those of ix lowest."""
    return _spread_bits(_c(ix)).bitwiseOR(F.shiftleft(_spread_bits(_c(iy)), 1))


def hilbert(ix: C, iy: C, order: int) -> Column:
    """Distance along the Hilbert curve of 2^order x 2^order cells."""

    def step(at: Column, s: Column) -> Column:
        rx, ry = (F.floor(at[c] / s).cast("long") % 2 for c in ("x", "y"))
        x, y = at["x"] % s, at["y"] % s
        # within the quadrant: turned where ry is 0, and mirrored there if rx is 1
        mx, my = F.when((ry == 0) & (rx == 1), s - 1 - x).otherwise(x), F.when((ry == 0) & (rx == 1), s - 1 - y).otherwise(y)
        d = at["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, my).otherwise(mx).alias("x"), F.when(ry == 0, mx).otherwise(my).alias("y"), d.alias("d"))

    start = F.struct(_c(ix).cast("long").alias("x"), _c(iy).cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    sizes = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(order))])
    return F.aggregate(sizes, start, step, lambda at: at["d"])


def hilbert_cell(d: C, order: int) -> tuple[Column, Column]:
    """The cell at a distance along the Hilbert curve of 2^order x 2^order cells."""

    def step(at: Column, s: Column) -> Column:
        part = F.floor(_c(d) / (s * s)).cast("long") % 4
        rx = F.floor(part / 2).cast("long")
        ry = part.bitwiseXOR(rx) % 2
        turned = ry == 0
        mx, my = (F.when(turned & (rx == 1), s - 1 - at[c]).otherwise(at[c]) for c in ("x", "y"))
        return F.struct((F.when(turned, my).otherwise(mx) + s * rx).alias("x"), (F.when(turned, mx).otherwise(my) + s * ry).alias("y"))

    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    found = F.aggregate(F.array(*[F.lit(1 << k).cast("long") for k in range(order)]), start, step)
    return found["x"], found["y"]


def aperture_corners(corners: list[tuple[float, float]], offset: float, dip_degrees: float) -> list[tuple[float, float]]:
    """Corners pushed out by the aperture of an offset: as far as the dip asks for, the offset at most."""
    return extended_corners(corners, min(offset * math.tan(math.radians(dip_degrees)), offset))


def clamp(x: C, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))
