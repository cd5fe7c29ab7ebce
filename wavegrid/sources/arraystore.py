"""Chunked arrays of traces as a Spark data source: ``read(spark, path)``, ``write(df, path, ..)``.

A store is a folder with one metadata file and a file for each chunk of a two-dimensional array, versions 2 (``.zarray``) and 3
(``zarr.json``) of the public chunked-array format, uncompressed or by zlib, gzip or zstandard. Filters on trace numbers
choose the chunks before any is opened.
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from wavegrid.session import ship_package

# Fixed values of the format: names of metadata files and codecs, and of version 3's types.
META = {2: ".zarray", 3: "zarr.json"}
UNPACK = {"zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)}
TYPES = {"float32": "<f4", "float64": "<f8", "int16": "<i2", "int32": "<i4"}

SCHEMA = "trace_no long, samples array<float>"
#: Chunks along the traces that one task reads.
TASK_CHUNKS = 8


@dataclass(frozen=True)
class Layout:
    shape: tuple[int, int]
    chunks: tuple[int, int]
    dtype: str
    codec: str | None
    fill: float
    prefix: str
    separator: str
    order: str = "C"

    def name(self, i: int, j: int) -> str:
        return f"{self.prefix}{i}{self.separator}{j}"


def layout(store: fs.FileSystem, path: str) -> Layout:
    """What the metadata file says; arrays of other than two dimensions and other codecs are refused."""
    for version, name in META.items():
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
            with store.open_input_file(f"{path}/{name}") as f:
                m = json.loads(f.read())
            break
    else:
        raise FileNotFoundError(f"{path}: no {' or '.join(META.values())}")
    if len(m["shape"]) != 2:
        raise ValueError(f"{path}: {len(m['shape'])} dimensions, not 2")
    if version == 2:
        codec = (m.get("compressor") or {}).get("id")
        if m.get("filters"):
            raise ValueError(f"{path}: filters are not supported")
        found = Layout(tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], codec, float(m.get("fill_value") or 0), "", m.get("dimension_separator", "."), m.get("order", "C"))
    else:
        codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
        big = codecs.pop("bytes", {}).get("endian") == "big"
        if len(codecs) > 1:
            raise ValueError(f"{path}: codecs {sorted(codecs)} are not supported together")
        keys = m.get("chunk_key_encoding", {"name": "default"})
        separator = keys.get("configuration", {}).get("separator", "/" if keys["name"] == "default" else ".")
        kind = TYPES.get(m["data_type"], m["data_type"])
        found = Layout(tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), kind.replace("<", ">") if big else kind, next(iter(codecs), None), float(m.get("fill_value") or 0), f"c{separator}" if keys["name"] == "default" else "", separator)
    if found.codec is not None and found.codec not in UNPACK:
        raise ValueError(f"{path}: codec {found.codec} is not supported")
    return found


@dataclass
class Chunks(InputPartition):
    """Chunk numbers along the traces."""

    numbers: list[int]


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        #: The axis of the traces: 0 for a trace a row, 1 for a sample a row.
        self.axis = int(options.get("trace_axis", 0))
        self.least, self.most, self.wanted = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds and sets of trace numbers are kept for ``partitions``; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("trace_no",):
                if isinstance(f, (EqualTo, In)):
                    own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.wanted = own if self.wanted is None else self.wanted & own
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.most = top if self.most is None else min(self.most, top)
            yield f

    def numbers(self, own: Layout) -> list[int]:
        """The chunks along the traces that can hold a wanted one."""
        n, size = own.shape[self.axis], own.chunks[self.axis]
        most = n - 1 if self.most is None else min(self.most, n - 1)
        if self.wanted is not None:
            return sorted({v // size for v in self.wanted if v is not None and self.least <= v <= most})
        return list(range(self.least // size, most // size + 1)) if self.least <= most else []

    def partitions(self) -> list[Chunks]:
        store, path = fs.FileSystem.from_uri(self.path)
        numbers = self.numbers(layout(store, path))
        return [Chunks(numbers[i : i + TASK_CHUNKS]) for i in range(0, len(numbers), TASK_CHUNKS)] or [Chunks([])]

    def read(self, part: Chunks) -> Iterator[pa.RecordBatch]:
        if not part.numbers:
            return
        store, path = fs.FileSystem.from_uri(self.path)
        own = layout(store, path)
        for number in part.numbers:
            rows = self._traces(store, path, own, number)
            first = number * own.chunks[self.axis]
            offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.float32).ravel()))], ["trace_no", "samples"])

    def _traces(self, store: fs.FileSystem, path: str, own: Layout, number: int) -> np.ndarray:
        """The whole traces of one chunk number, from its chunks along the samples; a chunk that isn't there is the fill value."""
        a, b = self.axis, 1 - self.axis
        n = min(own.chunks[a], own.shape[a] - number * own.chunks[a])
        out = np.full((n, own.shape[b]), own.fill)
        for k in range(math.ceil(own.shape[b] / own.chunks[b])):
            name = f"{path}/{own.name(*((number, k) if a == 0 else (k, number)))}"
            if store.get_file_info(name).type != fs.FileType.File:
                continue
            with store.open_input_file(name) as f:
                raw = f.read()
            block = np.frombuffer(UNPACK[own.codec](raw) if own.codec else raw, own.dtype).reshape(own.chunks, order=own.order)
            block = block if a == 0 else block.T
            width = min(own.chunks[b], own.shape[b] - k * own.chunks[b])
            out[:, k * own.chunks[b] : k * own.chunks[b] + width] = block[:n, :width]
        return out


class ArrayStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arraystore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoreReader:
        return StoreReader(dict(self.options))


def read(spark: SparkSession, path: str, trace_axis: int = 0) -> DataFrame:
    """(trace_no, samples) of a store; filters on trace_no open only the chunks that they need (the session's pushdown into Python sources is turned on)."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayStore)
    return spark.read.format("arraystore").option("path", path).option("trace_axis", trace_axis).load()


def _written(batches: Iterator[pa.RecordBatch], path: str, own: Layout, axis: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk number: writes the chunks of each, under another name first, so that a lost task leaves no half chunk."""
    store, home = fs.FileSystem.from_uri(path)
    b = 1 - axis
    held, number = None, None

    def out() -> None:
        for k in range(math.ceil(own.shape[b] / own.chunks[b])):
            block = np.full((own.chunks[axis], own.chunks[b]), own.fill, own.dtype)
            part = held[:, k * own.chunks[b] : (k + 1) * own.chunks[b]]
            block[:, : part.shape[1]] = part
            raw = np.ascontiguousarray(block if axis == 0 else block.T).tobytes()
            name = f"{home}/{own.name(*((number, k) if axis == 0 else (k, number)))}"
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            pending = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(pending) as f:
                f.write(zlib.compress(raw) if own.codec == "zlib" else raw)
            store.move(pending, name)

    for batch in batches:
        for trace, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if trace // own.chunks[axis] != number:
                if number is not None:
                    out()
                number, held = trace // own.chunks[axis], np.full((own.chunks[axis], own.shape[b]), own.fill)
            row = np.array([math.nan if v is None else v for v in samples or []][: own.shape[b]], float)
            held[trace % own.chunks[axis], : len(row)] = row
    if number is not None:
        out()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["done"])


def write(df: DataFrame, path: str, traces: int, samples: int, chunk_traces: int = 512, chunk_samples: int = 512, trace_axis: int = 0, codec: str | None = "zlib") -> None:
    """Writes (trace_no, samples) as a store of version 2, of single precision, a task writing whole chunks.

    Numbers outside 0 to ``traces`` are left out, missing traces and the ends of short ones are 0; of several rows of one number any counts. The
    metadata appears once all chunks have been written.
    """
    ship_package(df.sparkSession)
    shape, chunks = (traces, samples), (chunk_traces, chunk_samples)
    if trace_axis:
        shape, chunks = shape[::-1], chunks[::-1]
    own = Layout(shape, chunks, "<f4", codec, 0.0, "", ".")
    held = df.select(F.col("trace_no").cast("long").alias("trace_no"), F.col("samples").cast("array<double>").alias("samples")).where(F.col("trace_no").between(0, traces - 1))
    dealt = held.withColumn("_chunk", F.floor(F.col("trace_no") / chunk_traces)).repartition("_chunk").sortWithinPartitions("trace_no").drop("_chunk")
    dealt.mapInArrow(partial(_written, path=path, own=own, axis=trace_axis), "done int").count()
    store, home = fs.FileSystem.from_uri(path)
    store.create_dir(home, recursive=True)
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": "<f4", "order": "C", "fill_value": 0.0, "filters": None, "compressor": {"id": "zlib", "level": 6} if codec == "zlib" else None}
    with store.open_output_stream(f"{home}/.zarray") as f:
        f.write(json.dumps(meta).encode())
