"""Benchmark decontamination: one Aho-Corasick automaton over word numbers of the benchmark, offsets into the original texts."""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.scan import map_batches, slices, utf8, whole_row

#: ASCII letters in lower case and digits stay, bytes of other characters stay, the rest separates words.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

#: Bytes of benchmark text in one automaton. A larger benchmark is cut into several, each scanned in turn.
SHARD_BYTES = 10 << 20

_automata: dict[str, Benchmark] = {}


def normalised(text: bytes | None) -> bytes:
    """The text with words as runs of digits, lower-case letters and non-ASCII characters; byte offsets are kept."""
    return (text or b"").translate(_WORD_BYTES)


class Benchmark:
    """Items as word numbers, and an automaton over blocks of half a window.

    Any window of ``width`` words holds a block that begins at a multiple of ``width`` // 2, so those blocks find all
    windows with a node for each word of the benchmark, not for each word of each window; where one is found, the words
    around it say how far the item goes on. Items that are shorter than a window are one block.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int) -> None:
        self.width, step = width, max(1, width // 2)
        self.number: dict[bytes, int] = {}
        self.items, self.words = [i for i, _ in items], []
        owners: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            own = array("I", (self.number.setdefault(w, len(self.number) + 1) for w in normalised(text).split()))
            self.words.append(own)
            size = step if len(own) >= width else len(own)
            for at in range(0, len(own) - size + 1, step) if own else ():
                owners.setdefault(tuple(own[at : at + size]), []).append((n, at))
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, where in owners.items():
            self.find.add_word(block, (len(block), where))
        if owners:
            self.find.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, intervals of hit words (first, last; disjoint and sorted) and the ids of the items that occur."""
        words = normalised(text).split()
        if not words or not len(self.find):
            return len(words), [], set()
        get = self.number.get
        doc = tuple([get(w, 0) for w in words])
        hits, items, done = [], set(), {}
        for end, (size, where) in self.find.iter(doc):
            first = end - size + 1
            for n, at in where:
                if done.get((n, first - at), -1) >= end:
                    continue  # the run that the item makes here is known
                own, a, b = self.words[n], first, end + 1
                while a > 0 and a - first + at > 0 and doc[a - 1] == own[a - 1 - first + at]:
                    a -= 1
                while b < len(doc) and b - first + at < len(own) and doc[b] == own[b - first + at]:
                    b += 1
                done[n, first - at] = b - 1
                if b - a >= min(self.width, len(own)):
                    hits.append((a, b - 1))
                    if self.items[n] is not None:
                        items.add(self.items[n])
        return len(words), merged(hits), items


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text, end exclusive, of intervals of words."""
    if not hits:
        return []
    inside = np.frombuffer(normalised(text), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    points = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)]
    a, b = np.array(hits).T
    return list(zip(points[edges[::2][a]].tolist(), points[edges[1::2][b]].tolist(), strict=True))


_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pairs(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in found], _PAIRS)


def _scan_batches(batches, shared, key: str, width: int):
    if key not in _automata:
        _automata.clear()
        _automata[key] = Benchmark(pickle.loads(shared.value), width)
    scan = _automata[key].scan
    for batch in slices(batches):
        counts, all_hits, all_spans, all_items = [], [], [], []
        for text, hits, items in zip(*(batch.column(n).to_pylist() for n in ("_text", "_hits", "_items")), strict=True):
            n, new, found = scan(text)
            counts.append(n)
            all_hits.append(merged([*((h["a"], h["b"]) for h in hits or ()), *new]))
            all_spans.append(spans(text or b"", all_hits[-1]))
            all_items.append(sorted({*(items or ()), *found}))
        done = {"_words": pa.array(counts, pa.int64()), "_hits": _pairs(all_hits), "_spans": _pairs(all_spans), "_items": pa.array(all_items, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays([done.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)


def shards(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in lists of about ``limit`` bytes of text, one after the other; an item without a text has no words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), utf8(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-total // limit) or 1
    for k in range(n):
        yield [(r.item, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def scan_documents(df: DataFrame, benchmark: DataFrame, row: Column, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, limit: int = SHARD_BYTES) -> DataFrame:
    """``row`` of each row of ``df``, words (count), hits (intervals of word numbers), spans (the same in code points of the
    original text, end exclusive) and items (ids as sorted strings).

    A word is a run of digits, letters and non-ASCII characters, ASCII letters lower-cased. A window is
    ``width`` consecutive words of an item, or all of a shorter item's words; a document word in any
    occurrence of a window is hit. Null and empty texts have no words; items with no word have no windows, items with a null
    id hit words like others and have no id to list; items that share an id count once, by their strings. Every text is
    scanned whole, however long, once for every SHARD_BYTES of benchmark text, which bounds the automaton that is sent to
    the workers; no documents are shuffled. Repeated rows give a row each, an empty table none, an empty benchmark no hits.
    """
    spark = df.sparkSession
    pairs = "array<struct<a:long,b:long>>"
    none = {"_words": F.lit(0).cast("long"), "_hits": F.lit(None).cast(pairs), "_spans": F.lit(None).cast(pairs), "_items": F.lit(None).cast("array<string>")}
    work = df.select(row.alias("row"), utf8(text_col).alias("_text"), *(c.alias(n) for n, c in none.items()))
    for items in shards(benchmark, item_col, item_text_col, limit):
        packed = pickle.dumps(items)
        key = f"{hashlib.sha256(packed).hexdigest()}:{width}"
        work = map_batches(work, partial(_scan_batches, shared=spark.sparkContext.broadcast(packed), key=key, width=width), work.schema)
    return work.select("row", F.col("_words").alias("words"), F.col("_hits").alias("hits"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items (sorted), hits (intervals of word numbers), spans (of the original text)."""
    work = scan_documents(df, benchmark, F.struct(F.col(id_col).cast("long").alias("id")), text_col, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["b"] - h["a"] + 1)
    return work.select("row.id", F.col("words").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits", "spans")


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, in which no window of the benchmark occurs."""
    return scan_documents(df, benchmark, whole_row(df), text_col, **options).where(F.size("hits") == 0).select("row.*")
