"""Incremental accumulation: streaming fold and stack, and resuming by finished tiles."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def config_hash(config: dict) -> str:
    """Sixteen hex digits that are the same for equal settings."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def remaining(tiles: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("bin_id", "tile_id")) -> DataFrame:
    """Tiles that are not finished yet."""
    return tiles.join(done.select(*keys).distinct(), list(keys), "left_anti")


def header_stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 1) -> DataFrame:
    """New header files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def streaming_fold(stream: DataFrame, size: float, x: str = "mx", y: str = "my") -> DataFrame:
    """Running fold of cells; its state is bounded by the grid's cells, so it needs no watermark."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    return stream.groupBy(cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count(F.lit(1)).alias("fold"))


def streaming_activity(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums per event-time window and kind; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_end(result: DataFrame, checkpoint: str, mode: str, name: str) -> DataFrame:
    """Runs a stream over what there is and returns its table in memory; for tests and small results."""
    query = result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
