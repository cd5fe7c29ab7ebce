"""Common image gathers out of one image volume per offset bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extract(volumes: DataFrame, offsets: DataFrame, step_inline: int, step_crossline: int) -> DataFrame:
    """Traces of every ``step``-th image point, over all offset bins, with their place in the gather.

    ``volumes`` has offset_bin, ix, iy and samples; ``offsets`` has offset_bin and offset, a row per bin. The result
    adds inline and xline (from 1), offset, rank (by offset and bin, from 0) and n_offsets. The filter comes before
    any shuffle, so that only chosen points move; bins without an offset are left out.
    """
    chosen = volumes.where((F.col("ix") % step_inline == 0) & (F.col("iy") % step_crossline == 0)).join(offsets, "offset_bin")
    point = Window.partitionBy("ix", "iy")
    return chosen.select(
        "offset_bin", "ix", "iy", (F.col("ix") + 1).alias("inline"), (F.col("iy") + 1).alias("xline"), "offset",
        (F.row_number().over(point.orderBy("offset", "offset_bin")) - 1).alias("rank"), F.count(F.lit(1)).over(point).alias("n_offsets"), "samples",
    )
