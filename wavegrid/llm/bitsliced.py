"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.scan import map_batches
from wavegrid.session import ensure_checkpoint_dir, ship_package

#: Vectors become floor(SCALE * x).
SCALE = 256
#: Vectors in a block of the index, and queries that meet a block at once.
BLOCK = 4096
QUERIES = 256
#: High bits of each attribute that are sliced; what the lower bits can add decides which rows are scored exactly.
SLICES = 5

#: Up to this size, components are 64-bit numbers; beyond it they are Python's, and so are scores beyond a long.
LARGEST = 1 << 62
LONG = (1 << 63) - 1

Bits = np.ndarray  # rows of 64-bit words


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(SCALE * x) / SCALE of the usable vectors, which doubles hold exactly, zeros after shorter ones, which are usable, and the lengths of those."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    bad = ~np.isfinite(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use = (sizes > 0) & (np.bincount(owner[bad], minlength=len(sizes)) == 0)
    out = np.zeros((int(use.sum()), int(sizes[use].max()) if use.any() else 0))
    kept = use[owner]
    x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64)[kept] if len(owner) else np.empty(0)
    small = np.abs(x) < 2.0**45
    starts = np.cumsum(sizes) - sizes
    out[(np.cumsum(use) - 1)[owner[kept]], (np.arange(len(owner)) - starts[owner])[kept]] = np.where(small, np.floor(SCALE * np.where(small, x, 0.0)) / SCALE, x)
    return out, use, sizes[use]


def whole(values: np.ndarray) -> np.ndarray:
    """SCALE times quantised components, as 64-bit numbers if all fit, else as Python's."""
    if np.abs(values).max(initial=0) * SCALE <= LARGEST:
        return (values * SCALE).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**45 else int(x * SCALE) for x in values.ravel().tolist()] + [None], object)[:-1].reshape(values.shape)


def products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exact, as Python's numbers where a long may not hold them."""
    if sum(map(abs, query.tolist())) * int(np.abs(values).max(initial=0)) <= LONG:
        return values.astype(np.int64) @ query.astype(np.int64)
    return values.astype(object) @ query.astype(object)


def beyond(score: int) -> tuple[int, bytes]:
    """Where a score is among those that a long holds (0) or doesn't (-1, 1), and bytes that order the latter."""
    if abs(score) <= LONG:
        return 0, b""
    size = -(-abs(score).bit_length() // 8)
    rank = size.to_bytes(4) + abs(score).to_bytes(size)
    return (1, rank) if score > 0 else (-1, bytes(255 - x for x in rank))


def slices_of(values: np.ndarray, bits: int) -> Bits:
    """Bitmaps (attribute, bit, words) of unsigned numbers (row, attribute), least significant first."""
    rows, width = values.shape
    words = -(-rows // 64)
    padded = np.zeros((width, words * 64), np.uint64)
    padded[:, :rows] = values.T
    planes = np.stack([(padded >> np.uint64(b)).astype(np.uint8) & 1 for b in range(bits)], axis=1)
    return np.packbits(planes, axis=2, bitorder="little").view("<u8")


def add_up(columns: dict[int, Bits]) -> list[np.ndarray]:
    """Sum slices of bitmaps of each weight (weight w stands for 2^w): carry-save adders, three bitmaps to two at a time."""
    out, w = [], 0
    while any(k >= w for k in columns):
        own = columns.pop(w, None)
        while own is not None and len(own) > 1:
            n = len(own) // 3 * 3
            if n:
                a, b, c = own[0:n:3], own[1:n:3], own[2:n:3]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
                own = np.concatenate([total, own[n:]])
            else:
                total, carry = own[0] ^ own[1], (own[0] & own[1])[None]
                own = total[None]
            columns[w + 1] = np.concatenate([columns[w + 1], carry]) if w + 1 in columns else carry
        out.append(own[0] if own is not None and len(own) else None)
        w += 1
    return out


def count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def at_least(slices: list[np.ndarray | None], value: int, every: np.ndarray) -> np.ndarray:
    """Rows whose sliced number is at least ``value``."""
    if value <= 0:
        return every
    if value >> len(slices):
        return every & 0
    more, same = every & 0, every.copy()
    for w in reversed(range(len(slices))):
        own = slices[w] if slices[w] is not None else more & 0
        if value >> w & 1:
            same = same & own
        else:
            more, same = more | (same & own), same & ~own
    return more | same


def kth_largest(slices: list[np.ndarray | None], k: int, every: np.ndarray) -> int:
    """The k-th largest sliced number (the least, if there are fewer), most significant slice downward."""
    same, left, value = every.copy(), min(k, count(every)), 0
    for w in reversed(range(len(slices))):
        own = same & slices[w] if slices[w] is not None else same & 0
        n = count(own)
        if n >= left:
            same, value = own, value | 1 << w
        else:
            left -= n
            same = same & ~own
    return value


class Block:
    """A bit-sliced index of some vectors: the high bits of each attribute above the block's least value of it."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.least = self.values.min(axis=0)
        above = self.values - self.least
        top = int(above.max()).bit_length()
        self.low = max(0, top - SLICES)
        self.bits = max(1, top - self.low)
        self.slices = slices_of((above >> self.low).astype(np.uint64), self.bits)
        self.inverse = ~self.slices
        self.every = slices_of(np.ones((len(ids), 1), np.uint64), 1)[0, 0]

    def scores(self, query: np.ndarray) -> list[np.ndarray | None]:
        """Sum slices of sum |q_d| h_d, h_d the high bits, or their complement where q_d is negative."""
        size, columns = np.abs(query), {}
        for j in range(int(size.max()).bit_length()):
            has = (size >> j & 1).astype(bool)
            for b in range(self.bits):
                own = np.concatenate([self.slices[has & (query > 0), b], self.inverse[has & (query < 0), b] & self.every])
                if len(own):
                    columns[j + b] = np.concatenate([columns[j + b], own]) if j + b in columns else own
        return add_up(columns)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that can be among the k best, best first, k of them at most.

        The sliced sum lacks at most sum |q_d| (2^low - 1), in units of 2^low, from any row's score; rows below the
        k-th sum by more than that are beaten by k others. Rows of the query's own id are cleared first, so they take no place.
        """
        others = np.zeros(len(self.every) * 64, np.uint8)
        others[: len(self.ids)] = self.ids != query_id
        if not query.any():
            rows = np.flatnonzero(others)
        else:
            sums = self.scores(query)
            slack = sum(map(abs, query.tolist())) if self.low else 0
            every = np.packbits(others, bitorder="little").view("<u8")
            found = at_least(sums, kth_largest(sums, k, every) - slack, every)
            rows = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(self.ids)])
        exact = products(self.values[rows], query)
        best = np.lexsort((self.ids[rows], -exact))[:k] if exact.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-exact[i], self.ids[rows[i]]))[:k], np.int64)
        return self.ids[rows][best], exact[best]


def _usable(batches):
    for batch in batches:
        values, use, sizes = quantised(batch.column(1))
        ids = batch.column(0).filter(pa.array(use))
        rows = [r[:n].astype("<f8").tobytes() for r, n in zip(values, sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.binary()), pa.array([len(r) // 8 for r in rows], pa.int32())], ["id", "q", "width"])


def _meet(key, index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    if index.num_rows and queries.num_rows:
        width = max(len(x) for t in (index, queries) for x in t.column("q").to_pylist()) // 8

        def matrix(t: pa.Table) -> np.ndarray:
            return whole(np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in t.column("q").to_pylist()), "<f8").reshape(-1, width))

        block = Block(index.column("id").to_numpy(), matrix(index))
        for query_id, query in zip(queries.column("id").to_pylist(), matrix(queries), strict=True):
            ids, scores = block.top(query_id, query, k)
            out[0] += [query_id] * len(ids)
            out[1] += ids.tolist()
            scores = scores.tolist()
            far = list(map(beyond, scores))
            out[2] += [x if not f else None for x, (f, _) in zip(scores, far, strict=True)]
            out[3] += [f for f, _ in far]
            out[4] += [b for _, b in far]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "id", "score", "side", "far"), out, kinds, strict=True)})


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row whose id is divisible by ``every``, the k other rows of largest
    inner product of the vectors floor(256 x), ties to the smaller id; fewer if there are fewer.

    Null vectors, vectors with null or non-finite components, empty vectors and null ids take no part. Shorter
    vectors count as ending in zeros. Components may be of any size and ranks are by exact scores; a score that a long doesn't
    hold is null. Rows that repeat an id are candidates each, though never for a query of that id; several query rows of one id
    share one ranking. The index is cut into blocks of about ``block`` rows by a hash of id, vector and row, the
    queries into blocks of about ``queries``; each pair of blocks is one task's work and leaves at most k rows a
    query, so what is shuffled is (rows x query blocks + queries x blocks). All rows are indexed and results exact.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    rows = map_batches(rows, _usable, "id long, q binary, width int").checkpoint()
    asked = F.col("id") % every == 0
    n, m = rows.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    n_blocks, n_queries = max(1, -(-n // block)), max(1, -(-m // queries))
    number = lambda of, salt: F.pmod(F.xxhash64(F.lit(salt), "id", "q"), F.lit(of))
    all_of = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    # repeats of a row must not share a block, or one that repeats often would be one task's group
    spread = F.pmod(F.xxhash64(F.lit(1), "id", "q", F.monotonically_increasing_id()), F.lit(n_blocks))
    index = rows.select(spread.alias("b"), all_of(n_queries).alias("g"), "id", "q")
    wanted = rows.where(asked).dropDuplicates(["id", "q"]).select(all_of(n_blocks).alias("b"), number(n_queries, 2).alias("g"), "id", "q")
    parts = max(n_blocks * n_queries, 1)
    meet = partial(_meet, k=k)
    met = (
        index.repartition(min(parts, 2000), "b", "g").groupBy("b", "g")
        .cogroup(wanted.repartition(min(parts, 2000), "b", "g").groupBy("b", "g"))
        .applyInArrow(lambda key, left, right: meet(key, left, right), "query_id long, id long, score long, side int, far binary")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("far"), "id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
