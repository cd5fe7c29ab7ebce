"""Runs that go on where they stopped: batches are committed under the settings they belong to, and a repeated one replaces itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from wavegrid.streaming.incremental import config_hash


@dataclass(frozen=True)
class Run:
    """A folder that all executors share, for one set of settings and one number of tiles: with others a run starts afresh beside it.

    A batch is one folder, which counts once its writer has finished (Spark's ``_SUCCESS``). Half-written batches are written
    again, and a batch that is repeated replaces what it wrote, so that sums over the batches are the same however often a
    run was stopped. ``manifest`` says which tiles a batch has rows of.
    """

    spark: SparkSession
    home: str
    config: dict
    tiles: int

    @property
    def path(self) -> str:
        return f"{self.home}/{config_hash(self.config | {'tiles': self.tiles})}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the finished batches."""
        at, files = self._files(f"{self.path}/batch=*/_SUCCESS")
        found = files.globStatus(at) or []
        return sorted(int(str(f.getPath().getParent().getName()).removeprefix("batch=")) for f in found)

    def commit(self, rows: DataFrame, batch: int, tile: str = "tile") -> None:
        """Writes a batch, a folder for each tile with its rows in few files, in place of what the batch wrote before."""
        rows.repartition(tile).write.mode("overwrite").partitionBy(tile).parquet(f"{self.path}/batch={batch}")

    def rows(self, schema: StructType | str) -> DataFrame:
        """All committed rows, with the number of their ``batch``; none at first."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("int"))
        return self.spark.read.option("basePath", self.path).schema(_with_batch(self.spark, schema)).parquet(*[f"{self.path}/batch={b}" for b in done])

    def manifest(self, schema: StructType | str, tile: str = "tile") -> DataFrame:
        """(batch, tile, n) of what is committed."""
        return self.rows(schema).groupBy("batch", tile).agg(F.count(F.lit(1)).alias("n"))

    def missing(self, tiles: DataFrame, schema: StructType | str, tile: str = "tile") -> DataFrame:
        """The tiles that no committed batch has rows of."""
        return tiles.join(self.rows(schema).select(tile).distinct(), tile, "left_anti")

    def total(self, keys: list[str], sums: list[str], schema: StructType | str, tile: str = "tile") -> DataFrame:
        """(tile, keys, sums) over all committed batches."""
        return self.rows(schema).groupBy(tile, *keys).agg(*[F.sum(s).alias(s) for s in sums])


def _with_batch(spark: SparkSession, schema: StructType | str) -> StructType:
    kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return StructType(list(kind.fields)).add("batch", IntegerType())


def accumulate(stream: DataFrame, run: Run, partial: Callable[[DataFrame], DataFrame], tile: str = "tile"):
    """Starts a stream over what there is now; each batch's ``partial`` sums are committed under the batch's number.

    The stream's own checkpoint lies beside the batches, so that a run that stopped goes on with the files it has not
    committed. A batch that failed after its rows were written is repeated by Spark with the same number and replaces them.
    """

    def write(batch: DataFrame, number: int) -> None:
        run.commit(partial(batch), number, tile)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{run.path}/stream").trigger(availableNow=True).start()


def fold_of_tiles(df: DataFrame, cell: float, cells: int, x: str = "mx", y: str = "my") -> DataFrame:
    """(tile, cx, cy, fold): traces by cell, cells grouped into square tiles of ``cells`` a side, numbered by name."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    name: Column = F.concat_ws("_", F.floor(F.col("cx") / cells).cast("long"), F.floor(F.col("cy") / cells).cast("long"))
    return df.groupBy(at(x).alias("cx"), at(y).alias("cy")).agg(F.count(F.lit(1)).alias("fold")).select(name.alias("tile"), "cx", "cy", "fold")
