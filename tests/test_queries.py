"""Every core query with SQL against DuckDB, and closed-form cases."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from wavegrid import plans
from wavegrid.functions import geometry as G
from wavegrid.functions import guards as U
from wavegrid.functions import interpolation as I
from wavegrid.functions import profiles as P
from wavegrid.functions import selection as S
from wavegrid.functions import signal as X
from wavegrid.functions import traveltime as T
from wavegrid.operators import binsize as B
from wavegrid.operators import cubes as C
from wavegrid.operators import joins as J
from wavegrid.operators import migration as M
from wavegrid.sources import survey
from wavegrid.streaming import incremental

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(spark, name, plans.QUERIES[name], plans.ORACLE[name], DATA) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_zero_offset_times(spark):
    v, zero = F.lit(2000.0), F.lit(0.0)
    assert one(spark, T.dsr(F.lit(0.8), zero, zero, v)) == pytest.approx(0.8)
    assert one(spark, T.vti_dsr(F.lit(0.8), F.lit(300.0), F.lit(500.0), v, zero)) == pytest.approx(one(spark, T.dsr(F.lit(0.8), F.lit(90000.0), F.lit(250000.0), v)))
    # the logarithmic formula keeps only the vertical part as k vanishes, so it is compared at zero distance
    assert one(spark, T.curved_dsr(F.lit(0.8), zero, zero, 1800.0, 0.6)) == pytest.approx(0.8)
    assert one(spark, T.depth_to_time(T.time_to_depth(F.lit(0.4), 1800.0, 0.6), 1800.0, 0.6)) == pytest.approx(0.4)


def test_kernels_reproduce_a_slow_wave(spark):
    df = spark.createDataFrame([([math.sin(0.2 * i) for i in range(64)], 30.37)], "w array<double>, s double")
    for method, within in (("linear", 6e-3), ("cubic", 1e-3), ("sinc8", 2e-2), ("sinc16", 1e-2), ("lanczos3", 2e-2), ("lanczos5", 2e-2)):
        got = df.select(I.interpolate(method, F.col("w"), F.col("s")).alias("x")).first().x
        assert got == pytest.approx(math.sin(0.2 * 30.37), abs=within), method


def test_hilbert_visits_neighbours(spark):
    cells = survey.grid(spark, 16, 16, 1.0, 1.0).select("ix", "iy", G.hilbert("ix", "iy", 4).alias("h")).collect()
    path = [(r.ix, r.iy) for r in sorted(cells, key=lambda r: r.h)]
    assert sorted(r.h for r in cells) == list(range(256))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "unknown > 1", "[1]", "lambda: 1", "offset if 1 else 2", "'x' < offset", "offset in azimuth"])
def test_unsafe_expressions_are_refused(spark, text):
    with pytest.raises(ValueError):
        S.compile_expression(text, ["offset", "azimuth"])


def test_diffractor_focuses(spark):
    x0, y0, t0, v, dt = 500.0, 500.0, 0.4, 2000.0, 0.004
    rows = []
    for i in range(21):
        for j in range(21):
            mx, my = i * 50.0, j * 50.0
            t = 2 * math.sqrt((t0 / 2) ** 2 + ((mx - x0) ** 2 + (my - y0) ** 2) / v**2)
            rows.append((i * 21 + j, mx, my, mx, my, mx, my, [(1 - 2 * (a := (math.pi * 30 * (k * dt - t)) ** 2)) * math.exp(-a) for k in range(200)]))
    traces = spark.createDataFrame(rows, "trace_idx long, sx double, sy double, rx double, ry double, mx double, my double, samples array<double>")
    times = spark.range(90, 111).select(F.col("id").alias("it"), (F.col("id") * dt).alias("t0"))
    image = M.migrate(traces, survey.grid(spark, 5, 5, 50.0, 50.0, 400.0, 400.0), times, M.Options(dt=dt, max_aperture=400.0))
    best = image.orderBy(F.desc("amp")).first()
    assert (best.ix, best.iy) == (2, 2) and abs(best.it - 100) <= 1


def test_image_does_not_depend_on_tiles_and_units(spark):
    rows = [(i, *(float(v) for v in ((i * 37) % 400, (i * 53) % 390, (i * 41) % 410, (i * 29) % 380)), [math.sin(i + k) for k in range(40 + i % 5)]) for i in range(120)]
    rows += [(1000 + i, 100.0, 100.0, 140.0, 100.0, [float(i % 3)] * 40) for i in range(150)] + [(2000, None, 1.0, 1.0, 1.0, [1.0]), (2001, 1.0, 1.0, 1.0, 1.0, None), (2002, 1.0, 1.0, 1.0, 1.0, [])]
    traces = spark.createDataFrame(rows, "trace_idx long, sx double, sy double, rx double, ry double, samples array<double>").withColumns({"mx": F.expr("(sx + rx) / 2"), "my": F.expr("(sy + ry) / 2")})
    points = survey.grid(spark, 6, 5, 60.0, 70.0).withColumn("vs", F.expr("array_repeat(1500D + ix, 30)"))
    times = spark.range(0, 36).select(F.col("id").alias("it"), (F.col("id") * 0.008).alias("t0"))
    for o in (M.Options(max_aperture=150.0, velocity="vs", method="sinc8"), M.Options(max_aperture=90.0, velocity=lambda t: 1500.0 + 100.0 * t, aperture_mode="open", spreading=True)):
        whole, its = M.migrate_points(traces, points, times, o)
        cut, _ = M.migrate_points(traces, points, times, o, tile_values=150, unit_traces=20)
        want, got = ({(r.ix, r.iy): r for r in df.collect()} for df in (whole, cut))
        assert its == list(range(36)) and want.keys() == got.keys() and len(got) > 10
        for k, r in want.items():
            assert list(r.fold) == list(got[k].fold) and all(abs(a - b) < 1e-9 for a, b in zip(r.amp, got[k].amp, strict=True))
        if o.velocity == "vs":
            # an index beyond a profile's end images nothing
            assert all(not any(r.fold[30:]) for r in got.values())
    assert M.migrate(traces.limit(0), points, times, M.Options()).count() == 0


def test_nearest_join_reaches_far_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, 9000.0, 9000.0)], "trace_idx long, mx double, my double")
    queries = spark.createDataFrame([(0, 10.0, 0.0)], "q long, x double, y double")
    got = J.nearest_join(points, queries, 3, 10.0, "trace_idx", "q").orderBy("rank").collect()
    assert [r.trace_idx for r in got] == [1, 2, 3]


def test_streaming_fold_equals_the_batch(spark, tmp_path):
    df = spark.range(300).select((F.col("id") * 7 % 100).cast("double").alias("mx"), (F.col("id") * 3 % 50).cast("double").alias("my"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.header_stream(spark, str(tmp_path / "in"), df.schema)
    got = incremental.run_to_end(incremental.streaming_fold(stream, 10.0), str(tmp_path / "state"), "complete", "fold_now")
    want = df.groupBy(F.floor(F.col("mx") / 10.0).alias("cx"), F.floor(F.col("my") / 10.0).alias("cy")).agg(F.count(F.lit(1)).alias("fold"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_resume_skips_finished_tiles(spark):
    tiles = spark.createDataFrame([(b, t) for b in range(2) for t in range(3)], "bin_id long, tile_id long")
    done = spark.createDataFrame([(0, 1), (1, 2), (1, 2)], "bin_id long, tile_id long")
    assert incremental.remaining(tiles, done).count() == 4
    assert incremental.config_hash({"a": 1, "b": 2}) == incremental.config_hash({"b": 2, "a": 1})


def test_scan_pushes_offset_filters_to_the_files(spark, tmp_path):
    spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0, 5.0)], "trace_idx long, SOU_X double, SOU_Y double, REC_X double, REC_Y double, OFFSET double").write.parquet(str(tmp_path / "h"))
    df = survey.offset_filtered(survey.scan_headers(spark, str(tmp_path / "h")), 4.0, 6.0)
    assert df.select("trace_idx", "azimuth").first().azimuth == pytest.approx(36.8699, abs=1e-3)
    assert "GreaterThanOrEqual(OFFSET" in df._jdf.queryExecution().executedPlan().toString()


def test_cube_holds_its_ends_and_marks_missing_pillars(spark):
    x = y = C.Axis(0.0, 10.0, 3)
    t = C.Axis(0.0, 1.0, 2)
    pillars = [(i, j, [float(i + 2 * j), float(i + 2 * j + 4)]) for i in range(3) for j in range(3) if (i, j) != (2, 2)]
    cube = spark.createDataFrame(pillars, "ix long, iy long, v array<double>")
    points = spark.createDataFrame([(0, 5.0, 5.0, 0.5), (1, -9.0, 0.0, 7.0), (2, 20.0, 20.0, 0.0)], "id long, x double, y double, t double")
    got = {r.id: r.velocity for r in C.at_points(points, cube, x, y, t).collect()}
    assert got[0] == pytest.approx(0.5 + 1.0 + 2.0) and got[1] == pytest.approx(4.0) and got[2] is None


def test_guards(spark):
    bad = spark.range(1).select(U.checked_time(F.lit(float("nan"))).alias("a"), U.checked_time(F.lit(25.0)).alias("b"), U.cleaned(F.lit(float("inf")), 0.0, 9.0, 3.0).alias("c")).first()
    assert tuple(bad.a) == (False, 0.0) and tuple(bad.b) == (False, 20.0) and bad.c == 3.0
    powers = [one(spark, U.nearest_power_of_two(F.lit(n))) for n in (0, 1, 3, 5, 6, 7, 12, 13)]
    assert powers == [1, 1, 2, 4, 4, 8, 8, 16]
    assert one(spark, U.standard_bin(F.lit(26.0))) == 25.0 and one(spark, U.standard_bin(F.lit(300.0))) == 300.0


def test_profiles_keep_their_shape(spark):
    knots = [(0.0, 1.0), (1.0, 2.0), (3.0, 6.0)]
    at = lambda t, **k: one(spark, P.pchip(knots, F.lit(t).cast("double"), **k))
    assert [at(t) for t in (0.0, 1.0, 3.0)] == pytest.approx([1.0, 2.0, 6.0]) and at(-5.0) == 1.0 and at(9.0) == 6.0
    # slopes 2/3, 9/7 and 8/3 by hand; the middle one is the weighted harmonic mean of 1 and 2
    assert P.slopes(knots) == pytest.approx([2 / 3, 9 / 7, 8 / 3]) and at(4.0, extrapolate=True) > 6.0
    assert P.slopes([(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)])[1] == 0.0
    assert one(spark, P.pchip([(5.0, 3.0)], F.lit(1.0))) == 3.0 and at(None) is None
    with pytest.raises(ValueError):
        P.pchip([(1.0, 1.0), (1.0, 2.0)], F.lit(1.0))


def test_spacings_cross_cells_and_odd_tables(spark):
    xs = [0.0, 0.5, 25.0, 50.0, 75.0, 75.0, 1000.0, None, float("nan")]
    df = spark.createDataFrame([(x, x) for x in xs], "mx double, my double")
    for cells in (1, 3, 4096):
        assert sorted(r.gap for r in B.spacings(df, "mx", cells=cells).collect()) == [24.5, 25.0, 25.0, 925.0]
    assert B.spacings(df.limit(0), "mx").count() == 0 and B.spacings(df.where("mx = 75"), "mx").count() == 0
    even = spark.range(200).select((F.col("id") % 20 * 12.5).alias("mx"), (F.floor(F.col("id") / 20) * 50.0).alias("my"))
    got = B.by_histogram(even).first()
    assert (got.raw_dx, got.raw_dy, got.dx, got.dy, got.n, got.confidence) == (12.5, 50.0, 12.5, 50.0, 200, 0.5)
    assert B.by_histogram(even.limit(0)).first().confidence == 0.0


def test_bin_size_histogram_of_orders_without_a_spacing(spark, tmp_path):
    rows = [(i, i % 40, 1000.0 + i / 100) for i in range(200)]
    for name, orders in (("close", rows), ("one", rows[:1]), ("none", []), ("odd", [*rows, (300, 7000, None), (301, None, 2000.0)])):
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        got, want = plans.QUERIES["bin_size_histogram"](spark, f"{tmp_path}/{name}").collect(), duckdb.sql(plans.ORACLE["bin_size_histogram"].replace("FROM orders", f"FROM '{tmp_path}/{name}/orders.parquet/*.parquet'")).fetchall()
        assert [tuple(r) for r in got] == want and len(want) == (name == "odd")


def test_butterworth_passes_the_band_only(spark):
    dt = 0.004
    waves = {f: [math.sin(2 * math.pi * f * i * dt) for i in range(500)] for f in (2.0, 30.0, 110.0)}
    df = spark.createDataFrame([(f, w) for f, w in waves.items()] + [(0.0, None), (1.0, [3.0])], "f double, w array<double>")
    got = {r.f: r.x for r in df.select("f", X.butterworth(10.0, 60.0, dt)(F.col("w")).alias("x")).collect()}
    assert got[0.0] == [] and got[1.0] == [0.0]
    assert max(abs(a - b) for a, b in zip(got[30.0][100:400], waves[30.0][100:400], strict=True)) < 0.02
    assert all(max(map(abs, got[f][100:400])) < 0.02 for f in (2.0, 110.0))


def test_butterworth_sections_have_the_named_response():
    import cmath

    dt = 0.004
    for low, high, order in ((10.0, 60.0, 4), (10.0, 60.0, 3), (None, 40.0, 4), (0, 40.0, 5), (15.0, None, 3), (15.0, 200.0, 4), (20.0, 30.0, 1)):
        sections = X.butterworth_sections(low, high, dt, order)

        def response(f, sections=sections):
            z = cmath.exp(2j * math.pi * f * dt)
            return math.prod(abs(b[0] + b[1] / z + b[2] / z**2) / abs(1 + a[0] / z + a[1] / z**2) for b, a in sections)

        w = lambda f: math.tan(math.pi * f * dt)
        a, b = (w(low) if low else None), (w(high) if high and high < 125 else None)
        for f in (1.0, 12.0, 25.0, 38.0, 77.0, 120.0):
            u = (w(f) ** 2 - a * b) / (w(f) * (b - a)) if a and b else a / w(f) if a else w(f) / b
            assert abs(response(f) - 1 / math.sqrt(1 + u ** (2 * order))) < 1e-9
        assert len(sections) == (order if a and b else (order + 1) // 2)
        assert all(abs(p) < 1 for _, (c, e) in sections for p in ((-c + cmath.sqrt(c * c - 4 * e)) / 2, (-c - cmath.sqrt(c * c - 4 * e)) / 2))
    assert X.butterworth_sections(None, 500.0, dt) == [] and X.padding(X.butterworth_sections(10.0, 60.0, dt), 500) == 27


def test_spectrum_of_axes_is_that_of_the_plane(spark):
    import numpy as np
    from wavegrid.operators import spectrum

    rng = np.random.default_rng(8)
    grid = (rng.random((12, 9)) < 0.3) * rng.integers(1, 5, (12, 9))
    cells = spark.createDataFrame([(int(i), int(j), int(grid[i, j])) for i, j in zip(*np.nonzero(grid), strict=True)] + [(-1, 0, 5), (0, 9, 5)], "i long, j long, n long")
    got = {(r.k, r.l): complex(r.re, r.im) for r in spectrum.spectrum(cells, 12, 9).collect()}
    want = np.fft.fft2(grid)
    assert len(got) == want.size and all(abs(got[k, l] - want[k, l]) < 1e-9 for k, l in got)
    ends = cells.where("i >= 0 AND j < 9").selectExpr("stack(2, 'x', i, 12, n, 'y', j, 9, n) AS (axis, c, s, n)")
    power = {(r.axis, r.k): r.power for r in spectrum.axis_power(ends, "axis", "c", "n", "s").collect()}
    assert len(power) == 6 + 5 and all(abs(p - abs(want[k, 0] if a == "x" else want[0, k]) ** 2) < 1e-9 for (a, k), p in power.items())
    assert spectrum.spectrum(cells.limit(0), 4, 4).count() == 0


def test_bin_size_by_fourier_of_an_even_survey(spark):
    # points by threes around the lattice, so that its own period is stronger than half of it
    spread = "element_at(array(-5D, 0D, 0D, 5D), cast(1 + {} % 4 AS int))".format
    points = spark.range(24000).selectExpr(f"(id div 4 % 60) * 25D + {spread('id')} AS mx", f"(id div 240) * 50D + {spread('(id * 7 div 3)')} AS my")
    got = B.by_fourier(points).first()
    assert abs(got.raw_dx - 25) < 0.6 and abs(got.raw_dy - 50) < 1.0 and (got.dx, got.dy, got.n) == (25.0, 50.0, 24000) and got.confidence > 0.5
    few = points.limit(500)
    assert B.by_fourier(few).first() == B.by_histogram(few).first()


def test_quantiles_of_endless_and_close_values(spark):
    from wavegrid.operators.quality import quantiles

    inf, tiny = float("inf"), 5e-324
    for values in ([1.0, inf, 2.0, 3.0], [-inf, -inf, 1.0], [inf], [None, float("nan")], [1e308, -1e308, 0.0, 3.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0], [tiny, 2 * tiny, 0.0], [float(i % 7) for i in range(40)]):
        kept = sorted(v for v in values if v is not None and v == v)
        got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.0, 1 / 3, 1.0], cells=4)
        for share, q in zip([0.0, 1 / 3, 1.0], got, strict=True):
            at = (len(kept) - 1) * share
            a, b = (kept[math.floor(at)], kept[math.ceil(at)]) if kept else (None, None)
            assert q == (a if a == b else a + (b - a) * (at - math.floor(at)))


def test_scattered_values_of_a_plane_and_of_any_tiles(spark):
    from wavegrid.operators import scattered

    rng = random.Random(5)
    spots = [(rng.random() * 1000, rng.random() * 700) for _ in range(150)] + [(100.0 * i, 100.0 * j) for i in range(11) for j in range(8)] + [(100.0, 100.0)]
    rows = [(i, x, y, [3 * x - 2 * y + 5, x * y / 1000]) for i, (x, y) in enumerate(spots)] + [(900, None, 1.0, [0.0, 0.0]), (901, 5.0, float("nan"), [0.0, 0.0]), (902, 500.0, 350.0, None)]
    nodes = spark.createDataFrame(rows, "node long, x double, y double, v array<double>")
    asked = [(i, rng.random() * 1100 - 50, rng.random() * 800 - 50) for i in range(120)] + [(200, 100.0, 100.0), (201, 500.0, 0.0), (202, None, 1.0), (203, 1e6, 1e6)]
    targets = spark.createDataFrame(asked, "t long, x double, y double")
    got = {r.t: r for r in scattered.interpolate(nodes, targets).collect()}
    assert len(got) == 123
    for t, x, y in asked:
        if t == 202:
            continue
        inside = 0 <= x <= 1000 and 0 <= y <= 700
        assert got[t].how == ("linear" if inside else "nearest")
        if inside:
            assert abs(got[t].v[0] - (3 * x - 2 * y + 5)) < 1e-6
        else:
            best = min(range(len(spots)), key=lambda i: (math.hypot(spots[i][0] - x, spots[i][1] - y), i))
            assert got[t].v == rows[best][3]
    for tile in (60.0, 5000.0):
        other = {r.t: r for r in scattered.interpolate(nodes, targets, tile=tile).collect()}
        assert all(abs(a - b) < 1e-9 for t in got for a, b in zip(got[t].v, other[t].v, strict=True))
    assert scattered.interpolate(nodes.limit(0), targets).count() == 0
    line = scattered.interpolate(nodes.where("node < 2"), targets.where("t < 3"))
    assert {r.how for r in line.collect()} == {"nearest"}


def test_triangles_are_delaunay():
    import numpy as np
    from wavegrid.operators import scattered

    rng = np.random.default_rng(9)
    for _ in range(60):
        xy = rng.random((rng.integers(4, 30), 2)) * 100
        q = rng.random(2) * 100
        found = scattered.around(q, xy, ((xy - q) ** 2).sum(axis=1))
        triples = [(a, b, c) for a in range(len(xy)) for b in range(a) for c in range(b)]
        holds = [t for t in triples if (w := scattered._weights(xy[list(t)], q)) is not None and (w >= 0).all()]
        if found is None:
            assert not holds
            continue
        rows, weights, radius, centre = found
        assert np.allclose(weights @ xy[rows], q) and (np.hypot(*(xy - centre).T) >= radius - 1e-6).all()


def test_stopped_runs_go_on_and_repeated_batches_change_nothing(spark, tmp_path):
    from wavegrid.streaming import resume

    schema = "tile string, cx long, cy long, fold long"
    df = spark.range(400).select((F.col("id") * 7 % 100).cast("double").alias("mx"), (F.col("id") * 3 % 50).cast("double").alias("my"))
    df.where("mx < 50").repartition(2).write.parquet(str(tmp_path / "in"))
    run = resume.Run(spark, str(tmp_path / "run"), {"cell": 10.0}, 4)
    assert run.committed() == [] and run.rows(schema).count() == 0
    failing = [True]

    def partial(batch):
        return resume.fold_of_tiles(batch, 10.0, 3)

    def stream(of=run, work=partial):
        return resume.accumulate(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), of, work)

    commit = resume.Run.commit

    def commit_and_fail(self, rows, batch, tile="tile"):
        commit(self, rows, batch, tile)
        if batch == 1 and failing:
            failing.pop()
            raise RuntimeError("lost after the rows were written")

    resume.Run.commit = commit_and_fail
    try:
        with pytest.raises(Exception, match="lost after"):
            stream().awaitTermination()
        assert run.committed() == [0, 1]
        stream().awaitTermination()
        df.where("mx >= 50").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream().awaitTermination()
    finally:
        resume.Run.commit = commit
    assert run.committed() == [0, 1, 2, 3]
    want = sorted(tuple(r) for r in partial(df).collect())
    assert sorted(tuple(r) for r in run.total(["cx", "cy"], ["fold"], schema).collect()) == want
    # a batch that was never finished doesn't count
    (tmp_path / "run" / run.path.rsplit("/", 1)[1] / "batch=9").mkdir()
    assert run.committed() == [0, 1, 2, 3]
    tiles = spark.createDataFrame([("0_0",), ("9_9",)], "tile string")
    assert [r.tile for r in run.missing(tiles, schema).collect()] == ["9_9"]
    assert run.manifest(schema).agg(F.countDistinct("batch")).first()[0] == 4
    # other settings, or another number of tiles, start afresh
    for other in (resume.Run(spark, run.home, {"cell": 20.0}, 4), resume.Run(spark, run.home, {"cell": 10.0}, 5)):
        assert other.path != run.path and other.committed() == []


def test_nearest_join_equals_brute_force(spark):
    rng = random.Random(3)
    spots = [(rng.choice((0.0, 900.0)) + rng.random() * 10, rng.choice((0.0, 1200.0)) + rng.random() * 10) for _ in range(300)] + [(5.0, 5.0)] * 6
    asked = [(450.0, 600.0), (-1e6, 3.0), (5.0, 5.0), (905.0, 5.0), (460.0, 1205.0), (1e5, 1e5)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(900, None, 1.0), (901, float("nan"), 1.0)], "trace_idx long, mx double, my double")
    queries = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)] + [(90, float("inf"), 1.0), (91, 1.0, None)], "q long, x double, y double")
    for k in (4, 400):
        got = {}
        for r in J.nearest_join(points, queries, k, 2.0, "trace_idx", "q").orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.trace_idx)
        want = {q: [i for _, i in sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, (x, y) in enumerate(spots))][:k] for q, (a, b) in enumerate(asked)}
        assert got == want
    assert J.nearest_join(points.limit(0), queries, 3, 2.0, "trace_idx", "q").count() == 0
