"""Two-dimensional Fourier spectra of grids whose rows lie on many executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spectrum(cells: DataFrame, rows: int, columns: int, i: str = "i", j: str = "j", value: str = "n") -> DataFrame:
    """``(k, l, re, im, power)`` for all frequencies of a grid of ``rows`` x ``columns`` given by its cells that aren't 0.

    Rows are transformed where they lie, then an exchange brings each frequency's column together and columns are
    transformed: a task holds one row or column at a time. Only rows with a cell are transformed. Cells of one place add up.
    """

    def across(part: pd.DataFrame) -> pd.DataFrame:
        own = np.bincount(part["j"], part["v"], columns)
        out = np.fft.fft(own)
        return pd.DataFrame({"i": part["i"].iloc[0], "l": np.arange(columns), "re": out.real, "im": out.imag})

    def down(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(rows, complex)
        own[part["i"].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        out = np.fft.fft(own)
        return pd.DataFrame({"k": np.arange(rows), "l": part["l"].iloc[0], "re": out.real, "im": out.imag})

    held = cells.where(F.col(i).between(0, rows - 1) & F.col(j).between(0, columns - 1)).groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(F.sum(F.col(value).cast("double")).alias("v"))
    half = held.groupBy("i").applyInPandas(across, "i long, l long, re double, im double")
    whole = half.groupBy("l").applyInPandas(down, "k long, l long, re double, im double")
    return whole.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def axis_power(counts: DataFrame, axis: str, cell: str, n: str, size: str) -> DataFrame:
    """``(axis, k, power)`` from marginal counts of each axis: the spectrum along an axis where the other frequency is 0.

    The sum over a grid's columns has the same spectrum as the grid has there, so the grid itself is not needed. Frequencies are
    those from 0 to below the highest, ``size`` being the number of the axis' cells, and a task holds one axis.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        cells = int(part["s"].iloc[0])
        out = np.abs(np.fft.fft(np.bincount(part["i"], part["v"], cells))[: cells - cells // 2]) ** 2
        return pd.DataFrame({"axis": part["axis"].iloc[0], "k": np.arange(len(out)), "power": out})

    held = counts.select(F.col(axis).alias("axis"), F.col(cell).cast("long").alias("i"), F.col(n).cast("double").alias("v"), F.col(size).cast("long").alias("s"))
    return held.groupBy("axis").applyInPandas(run, "axis string, k long, power double")
