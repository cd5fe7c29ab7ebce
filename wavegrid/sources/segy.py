"""SEG-Y files as a Spark data source: ``spark.read.format("segy")`` and ``write.format("segy")`` after ``register``.

A file is read by byte ranges of whole traces, many tasks a file; files are written one a task, each complete,
in the order of the rows, and appear under their names only when the whole job commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wavegrid.session import ship_package

# Fixed values of the exchange format, revision 1: sizes of the headers, sample formats, and first bytes of fields, counted from 1.
TEXT, BINARY, TRACE = 3200, 400, 240
SAMPLES = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 8: ">i1"}
IBM, IEEE = 1, 5
FIELDS = {"field_record": 9, "cdp": 21, "offset": 37, "sx": 73, "sy": 77, "rx": 81, "ry": 85, "cdp_x": 181, "cdp_y": 185, "il": 189, "xl": 193}
SCALAR, COUNT, INTERVAL = 71, 115, 117
COORDINATES = ("sx", "sy", "rx", "ry", "cdp_x", "cdp_y")

SCHEMA = "file string, trace_no long, " + ", ".join(f"{c} {'double' if c in COORDINATES else 'int'}" for c in FIELDS) + ", dt_us int, samples array<float>"


def from_ibm(raw: np.ndarray) -> np.ndarray:
    """Unsigned words of sign, power of 16 (excess 64) and 24-bit fraction to doubles."""
    raw = raw.astype(np.uint32)
    sign = 1.0 - 2.0 * (raw >> 31)
    return sign * np.ldexp((raw & 0xFFFFFF).astype(np.float64), 4 * ((raw >> 24) & 0x7F).astype(np.int32) - 280)


def to_ibm(values: np.ndarray) -> np.ndarray:
    """Nearest words of ``from_ibm``; not-a-number becomes 0 and what is too large the largest of its sign."""
    largest = np.ldexp(float(0xFFFFFF), 228)
    values = np.clip(np.nan_to_num(values.astype(np.float64), nan=0.0, posinf=largest, neginf=-largest), -largest, largest)
    power = np.frexp(values)[1]
    sixteen = np.maximum(-(-power // 4), -64)
    fraction = np.rint(np.ldexp(np.abs(values), 24 - 4 * sixteen)).astype(np.int64)
    full = fraction >> 24 > 0
    fraction, sixteen = np.where(full, fraction >> 4, fraction), np.where(full, sixteen + 1, sixteen)
    words = (np.signbit(values).astype(np.int64) << 31) | (sixteen.astype(np.int64) + 64 << 24) | fraction
    return np.where(fraction == 0, 0, words).astype(">u4")


def _integer(block: np.ndarray, first: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(block[:, first - 1 : first - 1 + size]).view(kind)[:, 0]


@dataclass
class Traces(InputPartition):
    """Traces ``first`` to ``first + count`` of one file."""

    path: str
    first: int
    count: int
    start: int
    samples: int
    code: int
    interval: int


class SegyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bytes = FIELDS | {c: int(options[f"{c}_byte"]) for c in FIELDS if f"{c}_byte" in options}
        self.part = int(options.get("part_bytes", 128 << 20))
        self.batch = int(options.get("batch_bytes", 4 << 20))

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return store, [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def partitions(self) -> list[Traces]:
        store, files = self._files()
        parts = []
        for info in sorted(files, key=lambda f: f.path):
            with store.open_input_file(info.path) as f:
                head = f.read_at(BINARY, TEXT)
            if len(head) < BINARY:
                raise ValueError(f"{info.path}: no binary header")
            interval, samples = (int.from_bytes(head[i : i + 2], "big") for i in (16, 20))
            code, extended = (int.from_bytes(head[i : i + 2], "big", signed=True) for i in (24, 304))
            if code not in SAMPLES or extended < 0:
                raise ValueError(f"{info.path}: sample format {code} with {extended} further text headers is not supported")
            start, size = TEXT + BINARY + TEXT * extended, TRACE + samples * np.dtype(SAMPLES[code]).itemsize
            total, rest = divmod(info.size - start, size)
            if rest or total < 0:
                raise ValueError(f"{info.path}: its length is not one of whole traces of {samples} samples")
            step = max(1, self.part // size)
            parts += [Traces(info.path, i, min(step, total - i), start, samples, code, interval) for i in range(0, total, step)]
        return parts or [Traces("", 0, 0, 0, 0, IEEE, 0)]

    def read(self, part: Traces) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        size = TRACE + part.samples * np.dtype(SAMPLES[part.code]).itemsize
        step = max(1, self.batch // size)
        with store.open_input_file(part.path) as f:
            for i in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - i)
                yield self._batch(part, i, np.frombuffer(f.read_at(n * size, part.start + i * size), np.uint8).reshape(n, size))

    def _batch(self, part: Traces, first: int, block: np.ndarray) -> pa.RecordBatch:
        n = len(block)
        words = np.ascontiguousarray(block[:, TRACE:]).view(SAMPLES[part.code]).reshape(-1)
        values = (from_ibm(words) if part.code == IBM else words).astype(np.float32)
        factor = _integer(block, SCALAR, ">i2").astype(np.float64)
        scale = np.where(factor < 0, 1.0 / np.maximum(-factor, 1.0), np.where(factor > 0, factor, 1.0))
        columns = [pa.array([part.path] * n, pa.string()), pa.array(np.arange(first, first + n), pa.int64())]
        for c, at in self.bytes.items():
            raw = _integer(block, at, ">i4")
            columns.append(pa.array(raw * scale, pa.float64()) if c in COORDINATES else pa.array(raw.astype(np.int32), pa.int32()))
        interval = _integer(block, INTERVAL, ">u2").astype(np.int32)
        columns.append(pa.array(np.where(interval > 0, interval, part.interval).astype(np.int32), pa.int32()))
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.samples, pa.int32()), pa.array(values)))
        return pa.RecordBatch.from_arrays(columns, ["file", "trace_no", *self.bytes, "dt_us", "samples"])


@dataclass
class Written(WriterCommitMessage):
    pending: str
    final: str


class SegyWriter(DataSourceArrowWriter):
    """Columns of FIELDS and ``samples`` are written, absent ones as 0; all traces of a file are of one length."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.interval = round(float(options["dt_ms"]) * 1000)
        self.code = {"ibm": IBM, "ieee": IEEE}[options.get("samples_as", "ieee")]
        self.factor = int(options.get("scalar", -100))
        self.text = options.get("text", "").splitlines()
        self.job = uuid.uuid4().hex

    def _head(self, samples: int) -> bytes:
        lines = "".join(f"C{i:2d} {self.text[i - 1] if i <= len(self.text) else '':<76.76}" for i in range(1, 41))
        head = np.zeros(BINARY, np.uint8)
        for at, value, kind in ((1, 1, ">i4"), (5, 1, ">i4"), (9, 1, ">i4"), (13, 1, ">i2"), (17, self.interval, ">u2"), (19, self.interval, ">u2"), (21, samples, ">u2"), (23, samples, ">u2"), (25, self.code, ">i2"), (27, 1, ">i2"), (29, 4, ">i2"), (55, 1, ">i2"), (301, 0x0100, ">u2"), (303, 1, ">i2")):
            head[at - 1 : at - 1 + np.dtype(kind).itemsize] = np.frombuffer(np.array(value, kind).tobytes(), np.uint8)
        return lines.encode("cp500", errors="replace") + head.tobytes()

    def _block(self, batch: pa.RecordBatch, done: int) -> tuple[int, bytes]:
        n, lists = batch.num_rows, batch.column(batch.schema.get_field_index("samples"))
        lengths = {len(x) if x.is_valid else 0 for x in lists}
        if len(lengths) != 1:
            raise ValueError(f"traces of {sorted(lengths)} samples in one file")
        count = lengths.pop()
        if count > 0xFFFF:
            raise ValueError(f"{count} samples a trace, more than a header can hold")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, count)
        block = np.zeros((n, TRACE), np.uint8)

        def put(first: int, numbers: np.ndarray, kind: str) -> None:
            block[:, first - 1 : first - 1 + np.dtype(kind).itemsize] = np.broadcast_to(numbers, (n,)).astype(kind)[:, None].copy().view(np.uint8)

        scale = -self.factor if self.factor < 0 else 1.0 / max(self.factor, 1)
        for first in (1, 5):
            put(first, np.arange(done + 1, done + n + 1), ">i4")
        for c, first in FIELDS.items():
            at = batch.schema.get_field_index(c)
            if at >= 0:
                own = np.nan_to_num(batch.column(at).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
                put(first, np.rint(own * scale) if c in COORDINATES else own, ">i4")
        for first, value, kind in ((29, 1, ">i2"), (SCALAR, self.factor, ">i2"), (COUNT, count, ">u2"), (INTERVAL, self.interval, ">u2")):
            put(first, np.array(value), kind)
        samples = to_ibm(values) if self.code == IBM else values.astype(">f4")
        return count, np.concatenate([block, samples.view(np.uint8).reshape(n, -1)], axis=1).tobytes()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(self.path)
        pending, out, held, done = f"{path}/_pending-{self.job}/{uuid.uuid4().hex}", None, None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                count, block = self._block(batch, done)
                if out is None:
                    store.create_dir(f"{path}/_pending-{self.job}", recursive=True)
                    held, out = count, store.open_output_stream(pending)
                    out.write(self._head(count))
                if count != held:
                    raise ValueError(f"traces of {held} and {count} samples in one file")
                out.write(block)
                done += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(pending if out is not None else "", f"{path}/part-{TaskContext.get().partitionId():05d}-{self.job}.sgy")

    def _clear(self) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{path}/_pending-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_pending-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        earlier = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.extension == "sgy"]
        for m in messages:
            if m and m.pending:
                store.move(m.pending, m.final)
        for old in earlier if self.overwrite else []:
            store.delete_file(old)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class SegySource(DataSource):
    """Options: path (a file or folder, or a URI of one), ``il_byte`` and the like for fields at other bytes, ``part_bytes``
    a task; for writing ``dt_ms``, ``samples_as`` (ieee or ibm), ``scalar`` of coordinates and up to 40 lines of ``text``."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegyReader:
        return SegyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SegyWriter:
        return SegyWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(SegySource)


def read(spark: SparkSession, path: str, **places: int) -> DataFrame:
    """Traces of a file or of all files in a folder; ``il=237, xl=21`` for fields that begin at other bytes."""
    register(spark)
    return spark.read.format("segy").options(**{f"{c}_byte": str(at) for c, at in places.items()}).load(path)


def write(traces: DataFrame, path: str, dt_ms: float, samples_as: str = "ieee", text: str = "", order: tuple[str, ...] = ("il", "xl")) -> None:
    """``traces`` in ``order`` over the files' names, a range of it in each file; earlier files of the folder go."""
    register(traces.sparkSession)
    out = traces.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.format("segy").mode("overwrite").options(dt_ms=str(dt_ms), samples_as=samples_as, text=text).save(path)


def velocity_nodes(traces: DataFrame) -> DataFrame:
    """(il, xl, x, y, dt_ms, velocity): one row a node of a velocity file, the mean of traces that share one; velocities of 0 or less are null."""
    cells = traces.select("il", "xl", "cdp_x", "cdp_y", "dt_us", F.posexplode("samples").alias("it", "v")).groupBy("il", "xl", "it")
    means = cells.agg(F.avg("cdp_x").alias("x"), F.avg("cdp_y").alias("y"), F.max("dt_us").alias("dt"), F.avg(F.when(F.col("v") > 0, F.col("v").cast("double"))).alias("v"))
    row = F.array_sort(F.collect_list(F.struct("it", "v")))
    return means.groupBy("il", "xl").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), (F.max("dt") / 1000.0).alias("dt_ms"), F.transform(row, lambda p: p["v"]).alias("velocity"))
