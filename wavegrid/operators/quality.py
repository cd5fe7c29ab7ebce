"""Quality reports of traces, geometry and velocities, each one pass or two over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.session import ensure_checkpoint_dir

#: Cells that a range of values is cut into while a quantile is looked for.
CELLS = 4096


def quantiles(df: DataFrame, value: str, shares: list[float], cells: int = CELLS) -> list[float | None]:
    """Exact quantiles, linear between neighbours, by counting cells and looking closer at the one that holds the rank.

    Each pass is an aggregation whose result has ``cells`` rows at most, so that no task holds the values; nulls and NaN take
    no part, infinite values rank at the ends, and without values each quantile is None.
    """
    ensure_checkpoint_dir(df.sparkSession)
    endless = float("inf")
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").checkpoint()
    inner = x.where(F.abs("x") < endless)
    below, above = x.agg(F.count_if(F.col("x") == -endless), F.count_if(F.col("x") == endless)).first()
    m, low, high = inner.agg(F.count("x"), F.min("x"), F.max("x")).first()
    n = below + m + above

    def of_rank(k: int) -> float:
        if k < below or k >= below + m:
            return -endless if k < below else endless
        a, b, before = low, high, below
        while a < b:
            # halves, so that a range as wide as all doubles has a width
            step = b / cells - a / cells
            at = F.least(F.floor(F.col("x") / step - a / step), F.lit(cells - 1)) if step > 0 else F.lit(0)
            held = inner.where(F.col("x").between(a, b)).groupBy(at.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("a").collect()
            if len(held) == 1:
                # neighbouring doubles that a cell can't tell apart: their different values are few
                held = inner.where(F.col("x").between(a, b)).groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("n", F.col("x").alias("a"), F.col("x").alias("b")).orderBy("a").collect()
            for row in held:
                if before + row.n > k:
                    a, b = row.a, row.b
                    break
                before += row.n
        return a

    known: dict[int, float] = {}
    out = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = (n - 1) * share
        for k in {math.floor(at), math.ceil(at)}:
            if k not in known:
                known[k] = of_rank(k)
        a, b = known[math.floor(at)], known[math.ceil(at)]
        out.append(a if a == b else a + (b - a) * (at - math.floor(at)))
    return out


def trace_quality(traces: DataFrame) -> DataFrame:
    """One row: traces, share of NaN samples, infinite samples, share of traces without a sample but zero, and the range."""
    v = F.transform("samples", lambda a: a.cast("double"))
    bad = lambda a: F.isnan(a) | a.isNull()
    endless = lambda a: F.abs(a) == float("inf")
    own = traces.select(
        F.size(v).alias("n"), F.size(F.filter(v, bad)).alias("nan"), F.size(F.filter(v, endless)).alias("inf"), F.forall(v, lambda a: a == 0).alias("zero"),
        F.array_min(F.filter(v, lambda a: ~bad(a))).alias("low"), F.array_max(F.filter(v, lambda a: ~bad(a))).alias("high"),
    )
    return own.agg(F.count(F.lit(1)).alias("n_traces"), (F.sum("nan") / F.sum("n")).alias("nan_share"), F.sum("inf").alias("n_inf"), (F.count_if("zero") / F.count(F.lit(1))).alias("zero_share"), F.min("low").alias("amp_min"), F.max("high").alias("amp_max"))


def geometry_report(headers: DataFrame, size: float, x: str = "mx", y: str = "my") -> DataFrame:
    """One row: traces, those under 1 m of offset, cells of the survey's rectangle, filled ones, largest and mean fold, and percent empty."""
    from wavegrid.operators.aggregates import fold_map

    folds = fold_map(headers, size, x, y).agg(F.max("fold").alias("fold_max"), F.avg("fold").alias("fold_mean"), F.count(F.lit(1)).alias("n_filled"))
    many = lambda c: F.greatest(F.ceil((F.max(c) - F.min(c)) / size), F.lit(1))
    whole = headers.agg(F.count(F.lit(1)).alias("n_traces"), F.count_if(F.col("offset") < 1.0).alias("n_zero_offset"), (many(x) * many(y)).alias("n_cells"))
    return whole.crossJoin(F.broadcast(folds)).withColumn("empty_percent", 100.0 * (1.0 - F.col("n_filled") / F.col("n_cells")))


def overlap(met: DataFrame, trace: str, tile: str) -> DataFrame:
    """One row: rows of all tiles, different traces, tiles, and their ratio and its score from 0 (none) to 1 (eleven-fold)."""
    out = met.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(trace).alias("n_traces"), F.countDistinct(tile).alias("n_tiles"))
    ratio = F.col("n_rows") / F.greatest("n_traces", F.lit(1))
    return out.withColumns({"factor": ratio, "score": F.least(F.greatest((ratio - 1.0) / 10.0, F.lit(0.0)), F.lit(1.0))})


def velocity_report(df: DataFrame, keys: list[str], t: str, v: str, low: float = 1000.0, high: float = 8000.0, drop: float = -50.0) -> DataFrame:
    """Per key: values, those outside the range, those that fall by more than ``-drop`` from the one before, and whether all is well."""
    before = F.col(v) - F.lag(v).over(Window.partitionBy(*keys).orderBy(t))
    rows = df.withColumn("_dv", before).groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(~F.col(v).between(low, high)).alias("n_outside"), F.count_if(F.col("_dv") < drop).alias("n_inversions"))
    return rows.withColumn("valid", (F.col("n_outside") == 0) & (F.col("n_inversions") == 0) & (F.col("n") > 0))


def coordinate_report(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rows, unusable coordinates, those at the origin, extents, and whether the points can make a grid."""
    usable = ~(F.col(x).isNull() | F.col(y).isNull() | F.isnan(x) | F.isnan(y))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~usable).alias("n_unusable"), F.count_if((F.col(x) == 0) & (F.col(y) == 0)).alias("n_origin"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height"))
    return out.withColumn("valid", (F.col("n") > F.col("n_unusable")) & (F.greatest("width", "height") > 0))


def outlier_report(df: DataFrame, corners: list[tuple[float, float]], x: str = "mx", y: str = "my", buffer: float = 0.0, acceptable: float = 0.05) -> DataFrame:
    """One row: points in and outside counter-clockwise ``corners`` and ``buffer``, outside ones by quadrant around their centre,
    the farthest distance, a buffer that would hold all (5 % more), and how to treat them.

    Up to a thousandth or the acceptable share they are excluded, up to 15 % the grid is better extended, above it is to be reviewed.
    """
    from wavegrid.functions.geometry import quad_distance

    cx, cy = (sum(c) / len(corners) for c in zip(*corners, strict=True))
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), quad_distance(x, y, corners).alias("d"))
    out = F.col("d") > buffer
    east, north = F.col("x") >= cx, F.col("y") >= cy
    sides = {"n_ne": east & north, "n_se": east & ~north, "n_sw": ~east & ~north, "n_nw": ~east & north}
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("n_outside"), *[F.count_if(out & c).alias(n) for n, c in sides.items()], F.max("d").alias("farthest"))
    share = F.when(F.col("n") > 0, F.col("n_outside") / F.col("n")).otherwise(0.0)
    whole = whole.withColumns({"share": share, "suggested_buffer": F.when(F.col("n_outside") > 0, F.col("farthest") * 1.05).otherwise(buffer)})
    return whole.withColumn("handling", F.when(F.col("share") <= max(0.001, acceptable), "exclude").when(F.col("share") <= 0.15, "extend").otherwise("review"))


def rotated_extent(df: DataFrame, degrees: float, x: str = "mx", y: str = "my", buffer: float = 0.005) -> DataFrame:
    """One row (x0, y0 to x3, y3): corners, counter-clockwise, of the rectangle along ``degrees`` that holds all points and a margin."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    u, v = F.col(x) * c + F.col(y) * s, F.col(y) * c - F.col(x) * s
    ends = df.agg(F.min(u).alias("a"), F.max(u).alias("b"), F.min(v).alias("p"), F.max(v).alias("q"))
    wide, high = (F.col("b") - F.col("a")) * buffer, (F.col("q") - F.col("p")) * buffer
    ends = ends.select((F.col("a") - wide).alias("a"), (F.col("b") + wide).alias("b"), (F.col("p") - high).alias("p"), (F.col("q") + high).alias("q"))
    at = [("a", "p"), ("b", "p"), ("b", "q"), ("a", "q")]
    return ends.select(*[e for k, (i, j) in enumerate(at) for e in ((F.col(i) * c - F.col(j) * s).alias(f"x{k}"), (F.col(i) * s + F.col(j) * c).alias(f"y{k}"))])


def ordered(df: DataFrame, by: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 over the whole table in the order of ``by``.

    Ranges of rows are cut by a sample of all order columns, so that rows crowded at one value, or within one of its ties, are
    shared by tasks as others are; each task sorts its range, and ranges start where the counts of those before end. Only one
    count a range is ever sorted as a whole. Rows equal in all of ``by`` are numbered one after the other in any order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    names = [f"_by{i}" for i in range(len(by))]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns(dict(zip(names, by, strict=True))).repartitionByRange(parts, *names).sortWithinPartitions(*names).drop(*names)
    # the number of the range, and the row's place in it in the lower 33 bits
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_range", "_at", "_start")


def numbered(df: DataFrame, key: Column, tie: str, name: str = "rank", cells: int | None = None) -> DataFrame:
    """Rows numbered from 0 over the whole table by ``key``, ties by the column ``tie``, in ``cells`` ranges; see ``ordered``."""
    return ordered(df, [key, F.col(tie)], name, cells)


#: Groups whose first numbers are sent to all tasks; more are joined by shuffling.
BROADCAST_GROUPS = 1 << 16


def ordered_within(df: DataFrame, groups: list[str], by: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 0 within each group, a crowded one being shared by tasks as in ``ordered``."""
    rows = ordered(df, [*[F.col(g) for g in groups], *by], "_whole").checkpoint()
    starts = rows.groupBy(*groups).agg(F.min("_whole").alias("_first")).checkpoint()
    met = F.broadcast(starts) if starts.count() <= BROADCAST_GROUPS else starts
    joined = rows.alias("r").join(met.alias("s"), F.expr(" AND ".join(f"r.`{g}` <=> s.`{g}`" for g in groups)))
    return joined.select("r.*", (F.col("_whole") - F.col("_first")).alias(name)).drop("_whole")


def by_tile_centre(df: DataFrame, size: float, tie: str, x: str = "mx", y: str = "my") -> DataFrame:
    """Traces with their square tile (tx, ty), the distance to its centre and, from 0, their ``rank`` by it within the tile, ties by ``tie``."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    dx, dy = (F.col(c) - (F.col(t) + 0.5) * size for c, t in ((x, "tx"), (y, "ty")))
    rows = df.withColumns({"tx": at(x), "ty": at(y)}).withColumn("centre_distance", F.sqrt(dx * dx + dy * dy))
    return ordered_within(rows, ["tx", "ty"], [F.col("centre_distance"), F.col(tie)])


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows (all, if fewer) that any run picks again, however the table is cut: those of smallest hashes of a long ``key``,
    ties by the key. Each task keeps its own ``n`` smallest and those are merged, so samples of parts make the sample of the whole."""
    hashed = F.pmod(F.col(key) * 2654435761, F.lit(1 << 32))
    return df.orderBy(hashed, key).limit(n)
