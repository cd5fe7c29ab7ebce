"""Elementary functions of Columns and of NumPy arrays, so that one formula serves rows and whole arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _columns(*values) -> bool:
    return any(isinstance(v, Column) for v in values)


def _either(name: str):
    def f(x):
        return getattr(F, name)(x) if _columns(x) else getattr(np, name)(x)

    return f


sqrt, exp, log, sin, cos, floor, absolute = map(_either, ("sqrt", "exp", "log", "sin", "cos", "floor", "abs"))


def greatest(a, b):
    return F.greatest(*(v if _columns(v) else F.lit(v) for v in (a, b))) if _columns(a, b) else np.maximum(a, b)


def least(a, b):
    return F.least(*(v if _columns(v) else F.lit(v) for v in (a, b))) if _columns(a, b) else np.minimum(a, b)


def where(holds, a, b):
    """``a`` where the condition holds, else ``b``, also where the condition is null."""
    return F.when(holds, a).otherwise(b) if _columns(holds) else np.where(holds, a, b)


class Gathered:
    """Samples of many traces, each position being in the trace of its ``row``; what an array column is to Column functions."""

    def __init__(self, samples: np.ndarray, sizes: np.ndarray, row: np.ndarray, margin: int) -> None:
        """``samples`` has a row a trace between ``margin`` further values, as far as positions may lie outside."""
        self.flat = samples.ravel()
        self.first, self.size = row * samples.shape[1] + margin, sizes[row]

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.flat.take((i + self.first).astype(np.intp))


def at(self, i: np.ndarray) -> np.ndarray:
        return self.flat[self.first + np.clip(i, 0, self.width - 1).astype(np.int64)]


def at(samples, i):
    return F.get(samples, i.cast("int")).cast("double") if _columns(samples) else samples.at(i)


def size(samples):
    return F.size(samples) if _columns(samples) else samples.size
