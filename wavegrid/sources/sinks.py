"""Writing results as partitioned Parquet: volumes, gathers, headers and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that share a bin's rows, and rows of a file.
SHARES, FILE_ROWS = 8, 4_000_000


def _clustered(df: DataFrame, by: str, *spread: str):
    """A writer of a folder for each value of ``by``, in few files of bounded length: rows of a value meet in SHARES tasks at most."""
    share = F.pmod(F.xxhash64(*spread), F.lit(SHARES))
    return df.repartition(F.col(by), share).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(by)


#: Columns of the gathers' index, null where a kind of bin has none.
INDEX = ("bin_id", "bin_type", "bin_name", "offset_min", "offset_max", "ovt_x_min", "ovt_x_max", "ovt_y_min", "ovt_y_max")


def pillars(image: DataFrame, value: str, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """One row a pillar: its samples in the order of ``it``, from partial aggregates of one pillar's size."""
    rows = F.array_sort(F.collect_list(F.struct("it", F.col(value).alias("v"))))
    return image.groupBy(*keys).agg(F.transform(rows, lambda p: p["v"]).alias("samples"), F.min("it").alias("first_it"))


def write_stack(image: DataFrame, path: str, dt: float, value: str = "amp") -> None:
    """``stack`` and ``fold``, as rows of pillars with single-precision samples, and ``axes``: the sampling in one row."""
    out = pillars(image, value)
    out.withColumn("samples", F.col("samples").cast("array<float>")).write.mode("overwrite").parquet(f"{path}/stack")
    pillars(image, "fold").withColumn("samples", F.col("samples").cast("array<int>")).write.mode("overwrite").parquet(f"{path}/fold")
    axes = image.agg(F.countDistinct("ix").alias("nx"), F.countDistinct("iy").alias("ny"), F.countDistinct("it").alias("nt"), F.lit(dt).alias("dt"))
    axes.write.mode("overwrite").parquet(f"{path}/axes")


def write_bin_headers(headers: DataFrame, path: str) -> None:
    """Only bins that have traces."""
    headers.where(F.col("trace_count") > 0).write.mode("overwrite").parquet(path)


def write_gathers(image: DataFrame, headers: DataFrame, bins: DataFrame, path: str) -> None:
    """``volumes``, a folder for each bin_id, ``gather_headers`` of all bins, and ``gathers_index`` with every column of INDEX."""
    _clustered(image, "bin_id", "ix", "iy").parquet(f"{path}/volumes")
    headers.where(F.col("trace_count") > 0).write.mode("overwrite").parquet(f"{path}/gather_headers")
    known = {f.name: f.dataType for f in bins.schema}
    columns = [F.col(c) if c in known else F.lit(None).cast("string" if c in ("bin_type", "bin_name") else "double").alias(c) for c in INDEX]
    bins.select(*columns, F.concat(F.lit("volumes/bin_id="), F.col("bin_id").cast("string")).alias("volume_path")).write.mode("overwrite").parquet(f"{path}/gathers_index")


def write_cig(gathers: DataFrame, path: str, normalise: bool = False) -> None:
    """Common-image gathers (ix, iy, bin, it, amp, fold); amplitudes over fold if asked, 0 where nothing was added."""
    amp = F.when(F.col("fold") > 0, F.col("amp") / F.col("fold")).otherwise(0.0) if normalise else F.col("amp")
    _clustered(gathers.withColumn("amp", amp), "bin", "ix", "iy").parquet(path)


def write_traces(traces: DataFrame, path: str) -> None:
    """Samples as arrays of single precision beside the trace's number."""
    traces.select("trace_idx", F.col("samples").cast("array<float>").alias("samples")).write.mode("overwrite").parquet(path)
