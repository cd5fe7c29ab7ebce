"""Small tables beside the traces: mute tables and the gather bins of a written survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mute_table(spark: SparkSession, path: str) -> DataFrame:
    """(offset, time_ms) of CSV files with a header; rows without both numbers are left out."""
    return spark.read.csv(path, schema="offset double, time_ms double", header=True).where("offset IS NOT NULL AND time_ms IS NOT NULL")


def with_mute(traces: DataFrame, table: DataFrame, out: str = "mute_ms") -> DataFrame:
    """``traces`` with the mute time of their offset: linear between the rows of ``table``, a hand-made list, ends held; null if it is empty."""
    from wavegrid.operators.volumes import velocity_at

    rows = table.agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("t"), F.col("time_ms").alias("v")))).alias("_mute"))
    return traces.crossJoin(F.broadcast(rows)).withColumn(out, velocity_at(F.col("_mute"), F.abs("offset"))).drop("_mute")


def bins(spark: SparkSession, path: str) -> DataFrame:
    """(bin_id, n, offset_avg) of volumes written by bin; bins are the folders ``bin_id=``."""
    return spark.read.parquet(path).groupBy(F.col("bin_id").cast("long").alias("bin_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("offset").alias("offset_avg"))
