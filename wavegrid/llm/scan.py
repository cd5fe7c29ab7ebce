"""Passing texts through Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavegrid.session import ship_package

#: Rows handed to a kernel at once, so that very long texts don't pile up.
SLICE_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(name: str) -> Column:
    """A text column as its UTF-8 bytes."""
    return F.col(name).cast("string").cast("binary")


def whole_row(df: DataFrame, but: str | None = None) -> Column:
    """All columns, or all but one, as one struct, so that working columns beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c != but])


#: Rows of an Arrow batch where the session has Spark's default; whole texts in it may be long.
BATCH_ROWS = "1000"


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package available to the workers, in batches that long texts don't make huge."""
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(partial(_released, kernel=kernel), schema)


def _released(batches: Iterator[pa.RecordBatch], kernel) -> Iterator[pa.RecordBatch]:
    """The kernel's batches; what Arrow and the C library hold beyond them goes back to the system at the end of the task."""
    yield from kernel(batches)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of a table that may be sent to every executor, where a row counts 64 and an element of its arrays 16.
SMALL_BYTES = 32 << 20


def small_or_plain(df: DataFrame, elements: Column | None = None) -> DataFrame:
    """A stored or checkpointed table, marked for broadcast if it is small by count; joins shuffle it otherwise.

    ``elements`` is the number of elements in a row's arrays.
    """
    size = F.count(F.lit(1)) * 64 + (F.coalesce(F.sum(elements), F.lit(0)) * 16 if elements is not None else F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= SMALL_BYTES else df


#: Rows of one key from which a join sends the other side of that key to them.
HOT_ROWS = 1_000_000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with a stored ``table`` that has one row a key and, in ``count``, how many of ``rows`` have it.

    Keys of more than ``hot`` rows stay where they are and get their one row by broadcast (there are at most rows / ``hot``
    of those, and their size is checked); only the others are shuffled.
    """
    whole = small_or_plain(table)
    if whole is not table:
        return rows.join(whole, on)
    often = table.where(F.col(count) > hot)
    if often.isEmpty():
        return rows.join(table, on)
    often = small_or_plain(often)
    return rows.join(often, on).unionByName(rows.join(often.select(*on), on, "left_anti").join(table.where(F.col(count) <= hot), on))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """The different numbers, sorted; for many numbers faster than ``np.unique``."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
