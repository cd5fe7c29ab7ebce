"""Chunked array stores: layouts, codecs, and which chunks filters open."""

import gzip
import json

import numpy as np
import pytest
import zstandard
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from wavegrid.sources import arraystore


def stored(path, data, chunks, codec=None, version=3, skip=()):
    pack = {None: bytes, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[codec]
    path.mkdir()
    for i in range(-(-data.shape[0] // chunks[0])):
        for j in range(-(-data.shape[1] // chunks[1])):
            block = np.zeros(chunks, data.dtype)
            part = data[i * chunks[0] : (i + 1) * chunks[0], j * chunks[1] : (j + 1) * chunks[1]]
            block[: part.shape[0], : part.shape[1]] = part
            name = path / (f"c/{i}/{j}" if version == 3 else f"{i}.{j}")
            name.parent.mkdir(parents=True, exist_ok=True)
            if (i, j) not in skip:
                name.write_bytes(pack(block.tobytes()))
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {}}] if codec else [])
    meta = {"zarr_format": 3, "shape": data.shape, "data_type": str(data.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs}
    if version == 2:
        meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": codec} if codec else None}
    (path / arraystore.META[version]).write_text(json.dumps(meta))
    return str(path)


def test_filters_open_only_their_chunks(spark, tmp_path):
    data = np.random.default_rng(1).normal(size=(1000, 30)).astype(np.float32)
    path = stored(tmp_path / "a", data, (10, 8))
    reader = arraystore.StoreReader({"path": path})
    assert sum(len(p.numbers) for p in reader.partitions()) == 100
    for filters, numbers in (
        ([GreaterThan(("trace_no",), 499), LessThanOrEqual(("trace_no",), 509)], [50]),
        ([In(("trace_no",), (3, 999, 5000, None))], [0, 99]),
        ([EqualTo(("trace_no",), 42), GreaterThan(("trace_no",), 50)], []),
        ([GreaterThan(("samples",), 5)], list(range(100))),
    ):
        reader = arraystore.StoreReader({"path": path})
        # Spark applies them all again
        assert list(reader.pushFilters(filters)) == filters
        assert [n for p in reader.partitions() for n in p.numbers] == numbers
    got = {r.trace_no: r.samples for r in arraystore.read(spark, path).where("trace_no >= 495 AND trace_no < 505").collect()}
    assert sorted(got) == list(range(495, 505)) and all(np.array_equal(np.float32(got[i]), data[i]) for i in got)
    assert arraystore.read(spark, path).where("trace_no < 10").rdd.getNumPartitions() == 1


def test_layouts_codecs_and_missing_chunks(spark, tmp_path):
    data = np.arange(7 * 11, dtype=np.float64).reshape(7, 11)
    for k, (codec, version) in enumerate(((None, 2), ("gzip", 3), ("zstd", 3), ("zstd", 2))):
        path = stored(tmp_path / f"s{k}", data, (3, 4), codec, version, skip={(1, 2)})
        want = data.copy()
        want[3:6, 8:] = 0
        for axis, rows in ((0, want), (1, want.T)):
            got = sorted((r.trace_no, r.samples) for r in arraystore.read(spark, path, axis).collect())
            assert [s for _, s in got] == rows.tolist() and [n for n, _ in got] == list(range(len(rows)))
    (tmp_path / "s0" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [7, 11], "chunks": [3, 4], "dtype": "<f8", "compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError, match="blosc"):
        arraystore.StoreReader({"path": str(tmp_path / "s0")}).partitions()
    with pytest.raises(FileNotFoundError):
        arraystore.StoreReader({"path": str(tmp_path)}).partitions()


def test_written_stores_come_back(spark, tmp_path):
    rows = [(i, [float(i), None, 2.0][: i % 4]) for i in range(20) if i != 7] + [(-1, [1.0]), (99, [1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "trace_no long, samples array<double>")
    for axis, codec in ((0, "zlib"), (1, None)):
        path = str(tmp_path / f"w{axis}")
        arraystore.write(df, path, 20, 3, 6, 2, axis, codec)
        got = {r.trace_no: r.samples for r in arraystore.read(spark, path, axis).collect()}
        assert len(got) == 20 and got[7] == [0.0, 0.0, 0.0] and got[5] == [5.0, 0.0, 0.0] and got[4] == [0.0] * 3
        assert got[3][0] == 3.0 and np.isnan(got[3][1]) and got[3][2] == 2.0
