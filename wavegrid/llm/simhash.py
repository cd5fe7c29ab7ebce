"""Near-duplicate documents: SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.buckets import near_links
from wavegrid.llm.components import connected_components
from wavegrid.llm.scan import hot_join, map_batches, slices, small_or_plain, utf8
from wavegrid.session import ensure_checkpoint_dir

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 16_384


def fingerprint(text: bytes | None, ngram: int) -> int:
    """64-bit SimHash, as a signed number, of the shingles of ``ngram`` words, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= ngram:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: len(words) - ngram + 1].tolist(), ends[ngram - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in pairs), np.uint64, len(words) - ngram + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.ascontiguousarray(hashes[at : at + COUNTED].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches, ngram: int):
    for batch in slices(batches):
        found = [fingerprint(x, ngram) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4) -> DataFrame:
    """``(id, fp)`` for every row."""
    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")), partial(_fingerprints, ngram=ngram), "id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 bit masks: for any ``radius`` differing bits, one mask has none of them.

    Bit i gets a non-zero vector m(i) of radius+1 bits, and the mask of a non-zero vector v has the
    bits with odd <m(i), v>. The vectors of ``radius`` bits span less than the whole space, so that a
    v is orthogonal to all of them. Each mask keeps about half of the 64 bits.
    """
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % top + 1) & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_keys(fp: Column, radius: int) -> Column:
    """Buckets of a fingerprint, one a mask: any two of at most ``radius`` differing bits share one."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(covering_masks(radius))])


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, ngram: int = 4) -> DataFrame:
    """``(id, fp, component)`` for every row: component is the smallest id that links of at most ``radius`` differing bits reach.

    A null or empty text, or one of white space, has fingerprint 0, which links like any other. Rows with
    a null id keep their fingerprint; their component is that of their fingerprint, and null when no row
    of that fingerprint has an id (such fingerprints make no links). Repeated rows share a component. Any
    other column of ``df`` is ignored. Texts are read once; only ids and fingerprints are shuffled.

    Cost: distinct fingerprints times 2^(radius+1)-1 keys of 16 bytes. Copies of a text are one fingerprint
    before that. A key keeps about 32 bits, so that chance collisions stay rare up to some 10^9 distinct
    fingerprints; beyond that they cost comparisons, not results.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = fingerprints(df, id_col, text_col, ngram).checkpoint()
    texts = rows.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).checkpoint()
    keyed = texts.where("node IS NOT NULL").select(F.explode(covering_keys(F.col("fp"), radius)).alias("bucket"), "fp", "node")
    found = connected_components(near_links(keyed, radius))
    named = texts.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "n").checkpoint()
    return hot_join(rows, named, ["fp"], "n").select("id", "fp", "component")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, ngram: int = 4) -> DataFrame:
    """The rows of ``df``, all columns, without those whose id isn't the smallest of its component.

    Rows with a null id stay. Repeated rows of a kept id all stay.
    """
    found = simhash_components(df, id_col, text_col, radius, ngram)
    drop = found.where("id <> component").select("id").distinct().checkpoint().alias("dropped")
    rows = df.alias("kept")
    return rows.join(small_or_plain(drop), F.col(f"kept.{id_col}").cast("long") == F.col("dropped.id"), "left_anti").select("kept.*")
