"""Velocity scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions.interpolation import linear
from wavegrid.functions.traveltime import hyperbola, vti_moveout


def semblance(traces: DataFrame, keys: list[str], velocities: list[float], dt: float, n: int, half: int) -> DataFrame:
    """(keys, iv, it, semblance): windowed sums over traces before they are squared, against the energy.

    0 where the window leaves the trace or there is no energy. Trial velocities and times are literals, unfolded
    after pruning; sums over traces are partial before they are shuffled.
    """
    trial = F.array(*[F.struct(F.lit(k).cast("long").alias("iv"), F.lit(v).alias("vel")) for k, v in enumerate(velocities)])
    rows = traces.select(*keys, "offset", "samples", F.inline(trial)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("it"))
    s = hyperbola(F.col("it") * dt, F.col("offset"), F.col("vel")) / dt
    rows = rows.select(*keys, "iv", "it", linear(F.col("samples"), s).alias("v"))
    sums = rows.groupBy(*keys, "iv", "it").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "iv").orderBy("it").rowsBetween(-half, half)
    sums = sums.withColumns({"p": F.sum("s1").over(w), "q": F.sum("s2").over(w), "m": F.count(F.lit(1)).over(w)})
    energy = F.col("n") * F.col("m") * F.col("q")
    return sums.select(*keys, "iv", "it", F.when((F.col("m") < 2 * half + 1) | (energy <= 1e-10), 0.0).otherwise(F.col("p") * F.col("p") / energy).alias("semblance"))


def _sums(traces: DataFrame, keys: list[str], trial: Column, time, dt: float, n: int) -> DataFrame:
    """(keys, k, at, it, n, valid, s1, s2) over traces, of the samples at or before ``time`` of (it, offset, trial value)."""
    rows = traces.select(*keys, "offset", "samples", F.inline(trial)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("it"))
    i = F.floor(time(F.col("it") * dt, F.col("offset"), F.col("at")) / dt + 1e-9)
    rows = rows.select(*keys, "k", "at", "it", F.when(i < n, F.get("samples", i.cast("int"))).cast("double").alias("v"))
    return rows.groupBy(*keys, "k", "at", "it").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))


def _trials(values: list[float]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(v).alias("at")) for k, v in enumerate(values)])


def eta_scan(traces: DataFrame, keys: list[str], v: Column, etas: list[float], dt: float, n: int) -> DataFrame:
    """(keys, it, eta, semblance) along non-hyperbolic moveout; 0 with fewer than two traces that reach it, or no energy."""
    sums = _sums(traces, keys, _trials(etas), lambda t0, x, eta: vti_moveout(t0, x, v, eta), dt, n)
    value = F.when((F.col("valid") >= 2) & (F.col("s2") > 0), F.col("s1") * F.col("s1") / (F.col("valid") * F.col("s2"))).otherwise(0.0)
    return sums.select(*keys, "it", F.col("at").alias("eta"), value.alias("semblance"))


def eta_picks(scan: DataFrame, keys: list[str]) -> DataFrame:
    """The eta of largest semblance at each time; semblances equal to nine digits count as ties, which go to the smallest eta."""
    return scan.groupBy(*keys, "it").agg(F.min_by("eta", F.struct(-F.round("semblance", 9), F.col("eta"))).alias("eta"))


def gather_semblance(gathers: DataFrame, keys: list[str], velocities: list[float], dt: float, n: int, half: int) -> DataFrame:
    """(keys, iv, it, semblance) of gathers with a row (offset, samples) for each offset bin, against the energy of all bins.

    0 nearer than ``half`` to the ends, with fewer than two bins that reach the time, or without energy.
    """
    sums = _sums(gathers, keys, _trials(velocities), hyperbola, dt, n)
    whole = F.col("it").between(half, n - half - 1) & (F.col("valid") >= 2) & (F.col("s2") > 0)
    return sums.select(*keys, F.col("k").alias("iv"), "it", F.when(whole, F.col("s1") * F.col("s1") / (F.col("n") * F.col("s2"))).otherwise(0.0).alias("semblance"))


def strong_events(gathers: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """(keys, at): times whose root mean square over the gather's rows (bin, it, v) passes a share of the largest."""
    level = gathers.groupBy(*keys, "it").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    most = F.max("rms").over(Window.partitionBy(*keys))
    return level.withColumn("most", most).where(F.col("rms") > share * F.col("most")).select(*keys, F.col("it").alias("at"))


def curvature(gathers: DataFrame, keys: list[str], centre: Column, dt_ms: float, window_ms: float) -> DataFrame:
    """(keys, at, curvature): slope over the squared offset of the picks of each strong event, three or more.

    The pick of an offset bin is its largest amplitude within half the window, ties to the earlier one. ``centre`` is a
    bin's offset.
    """
    half = int(window_ms / 2 / dt_ms)
    near = strong_events(gathers, keys).select("*", F.explode(F.sequence(F.col("at") - half, F.col("at") + half - 1)).alias("it"))
    met = near.join(gathers.select(*keys, "bin", "it", "v"), [*keys, "it"])
    picks = met.groupBy(*keys, "at", "bin").agg(F.max_by("it", F.struct(F.abs("v"), -F.col("it"))).alias("pick"))
    picks = picks.select(*keys, "at", (F.col("pick") * dt_ms).alias("t"), (centre * centre).alias("h2"))
    return picks.groupBy(*keys, "at").agg(F.regr_slope("t", "h2").alias("curvature"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")


def flatness(curvatures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_events, flatness): 1 where events do not depend on the offset, towards 0 as they bend."""
    return curvatures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), (1.0 / (1.0 + F.avg(F.abs("curvature")) * 1e6)).alias("flatness"))
