"""SEG-Y files: number format, headers, ranges of one file, odd tables."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.sources import segy

COLUMNS = "il int, xl int, cdp_x double, offset int, samples array<float>"


def test_ibm_words():
    values = np.array([0.0, 1.0, -118.625, 0.0625, 16.0, np.nan, 15.99999999])
    assert [int(w) for w in segy.to_ibm(values)] == [0, 0x41100000, 0xC276A000, 0x40100000, 0x42100000, 0, 0x42100000]
    many = np.random.default_rng(0).normal(size=10_000) * 10.0 ** np.random.default_rng(1).integers(-30, 30, 10_000)
    assert np.abs(segy.from_ibm(segy.to_ibm(many)) / many - 1).max() < 2.0**-20
    assert (np.sign(segy.from_ibm(segy.to_ibm(np.array([1e300, -np.inf])))) == [1, -1]).all()


def test_headers_ranges_and_overwriting(spark, tmp_path):
    rows = [(i // 7, i % 7, i + 0.25, -i, [float(i), 0.5, -1.0]) for i in range(70)]
    df, home = spark.createDataFrame(rows, COLUMNS), str(tmp_path / "cube")
    for _ in range(2):
        segy.write(df.repartition(5), home, 2.0, text="first line\nsecond")
    raw = open(sorted(glob.glob(f"{home}/*.sgy"))[0], "rb").read()
    assert raw[:3200].decode("cp500").startswith("C 1 first line") and raw[3216:3218] == b"\x07\xd0" and (len(raw) - 3600) % 252 == 0
    segy.register(spark)
    parts = spark.read.format("segy").option("part_bytes", "600").load(home)
    assert parts.rdd.getNumPartitions() >= 30
    got = parts.select("il", "xl", "cdp_x", "offset", "samples", "dt_us").orderBy("il", "xl").collect()
    assert [tuple(r)[:5] for r in got] == rows and {r.dt_us for r in got} == {2000}
    assert [r.trace_no for r in parts.where(F.col("file") == parts.agg(F.min("file")).first()[0]).orderBy("trace_no").collect()][:3] == [0, 1, 2]


def test_odd_tables(spark, tmp_path):
    empty, nulls, uneven = (str(tmp_path / n) for n in ("empty", "nulls", "uneven"))
    segy.write(spark.createDataFrame([], COLUMNS), empty, 2.0)
    assert segy.read(spark, empty).count() == 0
    segy.write(spark.createDataFrame([(None, 1, None, None, [1.0, None]), (2, 2, 5.0, 1, [None, 3.0])], COLUMNS).coalesce(1), nulls, 2.0)
    got = segy.read(spark, nulls).orderBy("il").collect()
    assert [(r.il, r.cdp_x, r.offset) for r in got] == [(0, 0.0, 0), (2, 5.0, 1)]
    with pytest.raises(Exception, match="samples in one file"):
        segy.write(spark.createDataFrame([(1, 1, 1.0, 1, [1.0]), (1, 1, 2.0, 2, [1.0, 2.0])], COLUMNS), uneven, 2.0)
    assert not glob.glob(f"{uneven}/*.sgy")
    bad = tmp_path / "bad.sgy"
    bad.write_bytes(b"\0" * 4000)
    with pytest.raises(Exception, match="not supported"):
        segy.read(spark, str(bad)).count()
