"""Links between fingerprints that share a bucket, without listing all pairs of a bucket."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.components import unsigned
from wavegrid.llm.scan import map_batches, small_or_plain

#: Members of a bucket that are compared in one piece; larger buckets are cut and all pairs of cuts compared.
CHUNK = 4096
#: One member in so many is looked at to find buckets that need cutting.
SAMPLED = 64
#: Up to this size a bucket's pairs are compared by shifting whole batches.
SHIFTED = 16


def large_buckets(keyed: DataFrame) -> DataFrame:
    """Buckets of over CHUNK members, by an estimate, and the pieces that they are cut into."""
    seen = keyed.where(F.pmod(F.xxhash64(F.lit(SAMPLED), "fp", "node"), F.lit(SAMPLED)) == 0).groupBy("bucket").agg((F.count(F.lit(1)) * SAMPLED).alias("n"))
    return seen.where(F.col("n") > CHUNK).select("bucket", F.ceil(F.col("n") / CHUNK).cast("long").alias("_cuts")).checkpoint()


def spread(keyed: DataFrame, *carried: str) -> DataFrame:
    """The members of buckets, sorted by bucket; ``keyed`` has bucket, fp, node and ``carried`` columns and is read twice.

    A bucket of c pieces of CHUNK members has each member sent to the c pairs of pieces that hold it, each
    a bucket of its own, so that every two members still meet, in bounded groups. Sizes are estimated from one in
    SAMPLED members, and members are dealt to pieces by node too, since many may share a fingerprint; a size guessed wrong changes how long a group takes and never what is found.
    """
    large = large_buckets(keyed)
    if large.isEmpty():
        cut = keyed
    else:
        own = F.pmod(F.xxhash64("fp", "node"), F.col("_cuts"))
        pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
        cut = keyed.join(small_or_plain(large), "bucket", "left")
        cut = cut.select(F.explode(F.when(F.col("_cuts").isNull(), F.array("bucket")).otherwise(pieces)).alias("bucket"), "fp", *carried)
    return cut.select("bucket", "fp", *carried).repartition("bucket").sortWithinPartitions("bucket")


#: A member of a bucket as it travels with ``spread_packed``.
MEMBER = np.dtype([("bucket", "<i8"), ("fp", "<i8"), ("node", "<i8"), ("table", "<i4")])
#: Members that are sorted together, and rows whose members are packed together.
SORTED_MEMBERS = 200_000
PACKED_ROWS = 32_768
#: With more large buckets than this, members travel one by one.
MOST_LARGE = 65_536
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _pieces(bucket: np.ndarray, row: np.ndarray, salt: np.ndarray, large: np.ndarray, cuts: np.ndarray):
    """Buckets and rows of members, those of a large bucket once for each pair of its pieces that holds them, as in ``spread``."""
    if not len(large):
        yield bucket, row
        return
    at = np.minimum(np.searchsorted(large, bucket), len(large) - 1)
    hot = large[at] == bucket
    yield bucket[~hot], row[~hot]
    bucket, row, n = unsigned(bucket[hot]), row[hot], cuts[at[hot]]
    own, ends, at = (_hashed(salt[row]) % n.astype(np.uint64)).astype(np.int64), np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED_MEMBERS, "right")))
        c = n[at:to]
        of = at + np.repeat(np.arange(to - at), c)
        other = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        low, high = (f(own[of], other).astype(np.uint64) for f in (np.minimum, np.maximum))
        yield _hashed(_hashed(bucket[of] + low * _A) + high * _B).view(np.int64), row[of]
        at = to


def _packed(batches, parts: int, large: np.ndarray, cuts: np.ndarray):
    """From rows of buckets (an array), fp, table and node: the members of each part, many in a row, as bytes of MEMBER."""

    def packed(held):
        table = pa.Table.from_batches(held)
        sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in table.column(0).chunks])
        buckets = np.concatenate([x.flatten().to_numpy() for x in table.column(0).chunks])
        fp, kind, node = (table.column(i).to_numpy() for i in (1, 2, 3))
        salt = unsigned(fp) ^ _hashed(unsigned(node))
        for bucket, row in _pieces(buckets, np.repeat(np.arange(len(sizes)), sizes), salt, large, cuts):
            part = _hashed(unsigned(bucket)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
            row, counts = row[order], np.bincount(part.astype(np.int64), minlength=parts)
            members = np.empty(len(row), MEMBER)
            members["bucket"], members["fp"], members["node"], members["table"] = bucket[order], fp[row], node[row], kind[row]
            used = np.flatnonzero(counts)
            ends = np.r_[0, np.cumsum(counts[used])] * MEMBER.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(members)])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), data], ["part", "members"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACKED_ROWS:
            yield from packed(held)
            held, rows = [], 0
    if rows:
        yield from packed(held)


def packed_groups(batches):
    """Columns (bucket, fp, table, node) of the whole buckets of a task, sorted by bucket; members alone in their bucket are left out."""
    held = [x.as_buffer() for batch in batches for x in batch.column(1)]
    if not held:
        return
    members = np.frombuffer(b"".join(held), MEMBER)
    order = np.argsort(members["bucket"])
    bucket = members["bucket"][order]
    same = np.r_[False, bucket[1:] == bucket[:-1], False]
    members = members[order[same[1:] | same[:-1]]]
    if len(members):
        yield [pa.array(np.ascontiguousarray(members[c])) for c in ("bucket", "fp", "table", "node")]


def spread_packed(rows: DataFrame, most: int) -> DataFrame | None:
    """As ``spread``, for rows with an array of at most ``most`` different ``buckets``, fp, table and node: packed members, one
    part a task, to be read by ``packed_groups``. Nothing if there are too many large buckets for that.

    A part has whole buckets and about SORTED_MEMBERS members at most; that each bucket is bounded is due to the pieces
    of large ones. A row for many members takes a fraction of the time that as many rows take to be shuffled and sorted.
    """
    large = large_buckets(rows.select(F.explode("buckets").alias("bucket"), "fp", "node")).limit(MOST_LARGE + 1).toPandas().sort_values("bucket")
    if len(large) > MOST_LARGE:
        return None
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * most // SORTED_MEMBERS))
    kernel = partial(_packed, parts=parts, large=large["bucket"].to_numpy(np.int64), cuts=large["_cuts"].to_numpy(np.int64))
    packed = map_batches(rows.select("buckets", "fp", "table", "node"), kernel, "part int, members binary")
    return packed.repartitionById(parts, F.col("part"))


#: Rows that are gathered from sorted batches before they are compared.
GATHERED = 16_384


def groups(batches, columns: int, gathered: int = GATHERED):
    """Columns of whole buckets from sorted batches, many buckets at once."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < gathered:
            continue
        table = pa.Table.from_batches(held)
        b = table.column(0).to_numpy()
        first = int(np.searchsorted(b, b[-1]))
        if first:
            yield [table.column(i).slice(0, first) for i in range(columns)]
        held, rows = table.slice(first).to_batches(), table.num_rows - first
    if held:
        table = pa.Table.from_batches(held)
        yield [table.column(i) for i in range(columns)]


def _walk(fp: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links of a spanning forest: each member reached leaves the comparison."""
    rest, found = np.arange(len(fp)), []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            u = stack.pop()
            near = np.bitwise_count(fp[rest] ^ fp[u]) <= radius
            if near.any():
                hit = rest[near]
                found.append((u, hit))
                stack.extend(hit.tolist())
                rest = rest[~near]
    return found


def _links(batches, radius: int):
    for bucket, fp, node in groups(batches, 3):
        bucket, node = bucket.to_numpy(), node.to_numpy()
        fp = unsigned(fp.to_numpy())
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = np.diff(np.r_[start, len(fp)])
        a, b = [], []
        few = np.repeat(size <= SHIFTED, size)
        gid, f, n = np.repeat(np.arange(len(size)), size)[few], fp[few], node[few]
        for s in range(1, min(SHIFTED, len(f))):
            at = np.flatnonzero(gid[s:] == gid[:-s])
            if not len(at):
                break
            at = at[np.bitwise_count(f[at] ^ f[at + s]) <= radius]
            a.append(n[at])
            b.append(n[at + s])
        for i in np.flatnonzero(size > SHIFTED):
            own = slice(start[i], start[i] + size[i])
            for u, hit in _walk(fp[own], radius):
                a.append(np.full(len(hit), node[own][u]))
                b.append(node[own][hit])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_links(keyed: DataFrame, radius: int) -> DataFrame:
    """``(a, b)`` links that join exactly those nodes of ``keyed`` (bucket, fp, node; all long) that a chain of
    members of common buckets, each at most ``radius`` bits from the next, joins."""
    return map_batches(spread(keyed, "node"), partial(_links, radius=radius), "a long, b long")
