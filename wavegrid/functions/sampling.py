"""Output times whose step changes with time: windows (first time, step, number of times), all in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.operators.volumes import velocity_at

Windows = list[tuple[float, float, int]]


def times(spark: SparkSession, windows: Windows, dt: float, nt: int) -> DataFrame:
    """(window, i, it, t0): each window's times and the output samples that they stand for, nt - 1 at most."""
    own = F.array(*[F.struct(F.lit(k).cast("long").alias("window"), F.lit(a).alias("start"), F.lit(s).alias("step"), F.lit(n).alias("n")) for k, (a, s, n) in enumerate(windows)])
    rows = spark.range(1).select(F.inline(own)).where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    t0 = F.col("start") + F.col("i") * F.col("step")
    it = F.least(F.floor(t0 / dt + 1e-9).cast("long"), F.lit(nt - 1).cast("long"))
    return rows.select("window", F.col("i").cast("long").alias("i"), it.alias("it"), t0.alias("t0"))


def speedup(windows: Windows, t_min: float, t_max: float, dt: float) -> float:
    """Samples at the step dt for one of the windows; 1 without any."""
    own = sum(n for _, _, n in windows)
    return int((t_max - t_min) / dt + 1e-9) / own if own else 1.0


def uniform(rows: DataFrame, keys: list[str], value: str, nt: int) -> DataFrame:
    """(keys, it, value) at every sample from 0 to nt - 1: linear between those there, ends held.

    A key's samples are one array, as long as a trace.
    """
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("it").cast("double").alias("t"), F.col(value).alias("v")))).alias("p"))
    wide = held.select(*keys, "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nt - 1).cast("long"))).alias("it"))
    return wide.select(*keys, "it", velocity_at(F.col("p"), F.col("it").cast("double")).alias(value))


def on_line(picks: Column, at: Column) -> Column:
    """Linear through ``picks``, structs (t, v) sorted by t, and on beyond both ends; one pick is a constant, none null."""
    n = F.size(picks)
    k = F.greatest(F.least(F.size(F.filter(picks, lambda p: p["t"] <= at)) - 1, n - 2), F.lit(0))
    a, b = F.get(picks, k), F.get(picks, k + 1)
    return F.when(n <= 0, None).when(n == 1, F.get(picks, F.lit(0))["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"]))
