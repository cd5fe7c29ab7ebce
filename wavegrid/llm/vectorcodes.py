"""Product codes of vectors: codebooks for parts of the vectors, nearest entries found by bounds from quantised entries (VA-file)."""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import hot_join, map_batches, slices
from wavegrid.session import ensure_checkpoint_dir

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Bits of an entry's coordinate in the approximation.
CELL_BITS = 4
#: Sums leave the workers in digits of so many bits, so that sums of any size stay exact in longs.
LIMB_BITS = 32


class Codebook:
    """The entries of one part, and for every coordinate the cells that entries lie in.

    A coordinate's range is cut into 2^CELL_BITS cells of equal width; a cell keeps the smallest and the largest
    coordinate in it. For a query, a table by coordinate and cell has the least and the most that the coordinate can add to
    the distance; summing it over an entry's cells bounds that entry's distance from both sides.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        own = np.array([[((int(x) - int(a)) << CELL_BITS) // (int(b) - int(a) + 1) for x, a, b in zip(e, low, high, strict=True)] for e in entries], np.int64)
        self.cells, self.low, self.high = [], [], []
        for j in range(entries.shape[1]):
            used, cell = np.unique(own[:, j], return_inverse=True)
            self.cells.append(cell)
            self.low.append(np.array([entries[own[:, j] == c, j].min() for c in used], entries.dtype))
            self.high.append(np.array([entries[own[:, j] == c, j].max() for c in used], entries.dtype))

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of all parts to all entries."""
        least = np.zeros((len(parts), len(self.entries)), parts.dtype)
        most = np.zeros_like(least)
        for x, cell, low, high in zip(parts.T, self.cells, self.low, self.high, strict=True):
            below, above = low - x[:, None], x[:, None] - high
            gap = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += np.take(gap * gap, cell, axis=1)
            most += np.take(far * far, cell, axis=1)
        return least, most

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every part, ties to the lower index, and its squared distance; only entries whose lower
        bound is at most the smallest upper bound are looked at."""
        least, most = self.bounds(parts)
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        apart = parts[row] - self.entries[entry]
        exact = (apart * apart).sum(axis=1)
        order = np.lexsort((entry, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], entry[i])), np.int64)
        first = order[np.r_[True, np.diff(row[order]) > 0]] if len(order) else order
        return entry[first], exact[first]


def _integer(x: float) -> int:
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of vectors of one width; longs where squared distances of them fit one, else Python integers."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    most = np.abs(x).max(initial=0)
    if most * 256 + 1 > limit(width):
        return np.array([_integer(v) for v in x.ravel().tolist()] + [None], object)[:-1].reshape(x.shape)
    return np.floor(256 * x).astype(np.int64)


def limit(width: int) -> int:
    """Absolute values up to which squared distances in ``width`` coordinates fit a long."""
    return math.isqrt((1 << 62) // max(1, width)) // 2


def assigned(numbers: np.ndarray, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, nearest entries, squared distances) for each part position."""
    width = numbers.shape[1] // len(books)
    out = []
    for k, entries in enumerate(books):
        own = numbers[:, k * width : (k + 1) * width]
        if own.dtype == object or entries.dtype == object or int(np.abs(entries).max(initial=0)) > limit(numbers.shape[1]):
            own, entries = own.astype(object), entries.astype(object)
        out.append((own, *Codebook(entries).nearest(own)))
    return out


def _sums(batches, books: list[np.ndarray]):
    """What a task's vectors add to every entry: (part, entry, at, limb, total); at -1 counts them."""
    width = len(books) * books[0].shape[1]
    total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for batch in slices(batches):
        if batch.num_rows:
            for sums, (own, entry, _) in zip(total, assigned(whole_numbers(batch.column(0), width), books), strict=True):
                for e in np.unique(entry).tolist():
                    mine = own[entry == e]
                    sums[e, :-1] += mine.astype(object).sum(axis=0) if mine.dtype == object else mine.sum(axis=0).astype(object)
                    sums[e, -1] += len(mine)
    rows = []
    for p, sums in enumerate(total):
        for (e, j), v in np.ndenumerate(sums):
            limb = 0
            while v:
                rest = v if -(1 << LIMB_BITS) < v < (1 << LIMB_BITS) else v & ((1 << LIMB_BITS) - 1)
                rows.append((p, e, j if j < sums.shape[1] - 1 else -1, limb, rest))
                v, limb = (v - rest) >> LIMB_BITS, limb + 1
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int32()] * 4 + [pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "entry", "at", "limb", "total"])


def _codes(batches, books: list[np.ndarray]):
    width = len(books) * books[0].shape[1]
    for batch in slices(batches):
        fits = np.array([len(v) == width for v in batch.column(2)], bool)
        held = batch.filter(pa.array(fits))
        code, error = [None] * batch.num_rows, [None] * batch.num_rows
        if held.num_rows:
            found = assigned(whole_numbers(held.column(2), width), books)
            entries = np.array([e for _, e, _ in found], np.uint8).T
            exact = sum(d.astype(object) for _, _, d in found)
            for i, e, d in zip(np.flatnonzero(fits).tolist(), entries, exact, strict=True):
                code[i], error[i] = e.tobytes().hex(), d if d < 1 << 63 else None
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position from (id, vector): the parts of the smallest ids, moved ``rounds`` times to the
    floor of the mean of the parts that are nearest to them. An entry that is nearest to none stays.

    Every round reads all vectors; tasks pass on one sum for each entry and coordinate, so that the driver gets the size
    of the codebooks and no more. Vectors of another length than that of the smallest id take no part.
    """
    start = [r.vector for r in vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()]
    if not start:
        return []
    width = len(start[0])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    held = vectors.where(F.size("vector") == width)
    start = np.array([[_integer(x) for x in r.vector] + [None] for r in held.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()], object)[:, :-1]
    books = [_narrow(b, width) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        sums = map_batches(held.select("vector"), partial(_sums, books=books), "part int, entry int, at int, limb int, total long")
        moved: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.groupBy("part", "entry", "at", "limb").agg(F.sum("total").alias("total")).collect():
            own = moved.setdefault((r.part, r.entry), {})
            own[r.at] = own.get(r.at, 0) + (r.total << (LIMB_BITS * r.limb))
        books = [_narrow(np.array([[own.get(j, 0) // own[-1] for j in range(width // parts)] + [None] if (own := moved.get((p, e))) else [*map(int, row), None] for e, row in enumerate(b)], object)[:, :-1], width) for p, b in enumerate(books)]
    return books


def _narrow(entries: np.ndarray, width: int) -> np.ndarray:
    return entries.astype(np.int64) if max((abs(x) for x in entries.ravel()), default=0) <= limit(width) else entries


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every row whose vector is usable.

    Components become floor(256 x). ``code`` has two hex digits for each part: the index of its nearest entry. ``error`` sums
    the squared distances to the entries, exactly, and ``label_error`` the errors of all rows of one label, null being one.
    Rows whose vector is null, empty or holds null, NaN or infinity are left out. A vector of another length than that of the
    smallest id has no code and no error. An error that a long doesn't hold is null, and so is its label's. Repeated rows
    have a row each; a null id comes after all others, and rows of one id by their vectors, where the codebooks start.
    Without a usable vector there are no rows. Fewer vectors than ``entries`` make as many entries. Other columns are ignored.
    """
    ensure_checkpoint_dir(df.sparkSession)
    named = lambda c: F.col(f"`{c}`")
    rows = df.select(named(id_col).cast("long").alias("id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    books = train(rows.select("id", "vector"), parts, entries, rounds)
    schema = f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not books:
        return df.sparkSession.createDataFrame([], "id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = map_batches(rows, partial(_codes, books=books), schema).withColumn("key", F.struct("label")).checkpoint()
    beyond = F.count_if(F.col("error").isNull() & F.col("code").isNotNull())
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = coded.groupBy("key").agg(F.when(beyond == 0, whole.try_cast("long")).alias("label_error"), F.count(F.lit(1)).alias("n")).checkpoint()
    return hot_join(coded, labels, ["key"], "n").select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
