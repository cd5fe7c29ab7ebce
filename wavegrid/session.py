"""Small helpers around a SparkSession: checkpoints and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wavegrid-checkpoints-")
    sc.setCheckpointDir(named)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wavegrid-"), "wavegrid_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("wavegrid", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class TableStore:
    """Writes a DataFrame as Parquet, beside the checkpoints if no folder is named, and reads it back.

    The files survive lost executors and are smaller than checkpoints of rows.
    """

    def __init__(self, spark: SparkSession, home: str | None = None) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.home = spark, home or f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.home}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.held.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.held[-1][0]

    def drop(self, table: DataFrame) -> None:
        """Delete the files of a stored table that nothing will read any more; other tables stay as they are."""
        for _, path in (x for x in self.held if x[0] is table):
            _delete(self.spark, path)
        self.held = [x for x in self.held if x[0] is not table]


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[TableStore]:
    """A ``TableStore`` whose files are deleted at the end of the block, so that what leaves it has to be checkpointed."""
    store = TableStore(spark)
    try:
        yield store
    finally:
        _delete(spark, store.home)


#: Whether Spark removes an action's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """In the block, shuffle files go as soon as the action that wrote them ends, not when the driver happens to collect its garbage.

    What asks for such files again has Spark make them again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
