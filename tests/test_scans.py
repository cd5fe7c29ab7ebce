"""Closed-form and odd cases of scans, velocity input, sampling, order and grid reports."""

import pytest
from pyspark.sql import functions as F

from wavegrid.functions import antialias as N
from wavegrid.functions import interpolation as I
from wavegrid.functions import sampling as P
from wavegrid.functions import traveltime as T
from wavegrid.operators import binsize as B
from wavegrid.operators import cubes
from wavegrid.operators import migration as M
from wavegrid.operators import quality as Q
from wavegrid.operators import velocity as V
from wavegrid.sources import tables

BOX = [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)]


def test_rows_are_numbered_without_gaps_and_ties_by_id(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 50) for i in range(500)], "i long, k long")
    got = {r.i: r["rank"] for r in Q.numbered(df, F.col("k"), "i", cells=8).collect()}
    assert sorted(got, key=got.get) == [i for _, i in sorted(((i * 7919) % 50, i) for i in range(500))]
    assert sorted(got.values()) == list(range(500))
    assert Q.numbered(df.where("false"), F.col("k"), "i").count() == 0


def test_eta_scan_finds_the_eta_of_its_event(spark):
    dt, v, eta = 0.004, 2000.0, 0.2
    one = lambda x: spark.range(1).select(T.vti_moveout(F.lit(0.4), F.lit(x), F.lit(v), F.lit(eta)).alias("t")).first().t
    rows = []
    for x in (0.0, 300.0, 600.0, 900.0):
        samples = [0.0] * 250
        samples[int(one(x) / dt + 1e-9)] = 1.0
        rows.append((0, x, samples))
    gather = spark.createDataFrame(rows, "g long, offset double, samples array<double>")
    scan = V.eta_scan(gather, ["g"], F.lit(v), [0.0, 0.1, 0.2, 0.3], dt, 250)
    assert V.eta_picks(scan, ["g"]).where("it = 100").first().eta == 0.2
    assert scan.where("it = 100 AND eta = 0.2").first().semblance == pytest.approx(1.0)


def test_flat_event_is_flat_and_a_bent_one_is_not(spark):
    flat = [(0, b, t, 1.0 if t == 20 else 0.0) for b in range(5) for t in range(40)]
    bent = [(1, b, t, 1.0 if t == 18 + b else 0.0) for b in range(5) for t in range(40)]
    df = spark.createDataFrame(flat + bent, "g long, bin long, it long, v double")
    got = {r.g: r.flatness for r in V.flatness(V.curvature(df, ["g"], F.col("bin") * 100.0, 4.0, 48.0), ["g"]).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] < 0.1
    assert V.curvature(df.where("bin < 2"), ["g"], F.col("bin") * 100.0, 4.0, 48.0).count() == 0


def test_lines_of_one_node_or_none(spark):
    nodes = spark.createDataFrame([(1, 0, 10.0), (1, 4, 18.0), (2, 3, 7.0)], "il long, xl long, v double")
    targets = spark.createDataFrame([(1, -2), (1, 1), (1, 6), (2, 9), (3, 0)], "il long, xl long")
    assert sorted((r.il, r.xl, r.v) for r in cubes.along_line(targets, nodes, "il", "xl", "v").collect()) == [(1, -2, 6.0), (1, 1, 12.0), (1, 6, 22.0), (2, 9, 7.0), (3, 0, None)]
    near = {(r.il, r.xl): r.v for r in cubes.at_node(targets, nodes, "v").collect()}
    assert near == {(1, -2): None, (1, 1): 10.0, (1, 6): None, (2, 9): None, (3, 0): None}


def test_pillars_blend_whole_arrays(spark):
    cube = spark.createDataFrame([(i, j, [float(10 * i + j), float(i)]) for i in range(2) for j in range(2)], "ix long, iy long, v array<double>")
    points = spark.createDataFrame([(0.5, 0.25), (9.0, -3.0)], "x double, y double")
    axis = cubes.Axis(0.0, 1.0, 2)
    assert [r.velocities for r in cubes.pillars(points, cube, axis, axis).orderBy("x").collect()] == [[5.25, 0.5], [10.0, 1.0]]
    assert cubes.pillars(points, cube.where("ix = 0"), axis, axis).first().velocities is None


def test_windows_fill_a_uniform_axis(spark):
    windows = [(0.0, 0.004, 3), (0.012, 0.008, 0), (0.012, 0.016, 2)]
    rows = P.times(spark, windows, 0.004, 6)
    assert [(r.window, r.it) for r in rows.orderBy("t0").collect()] == [(0, 0), (0, 1), (0, 2), (2, 3), (2, 5)]
    assert P.speedup(windows, 0.0, 0.04, 0.004) == 2.0 and P.speedup([], 0.0, 1.0, 0.1) == 1.0
    got = P.uniform(rows.select(F.lit(0).alias("g"), "it", (F.col("it") * 2.0).alias("v")), ["g"], "v", 8)
    assert [r.v for r in got.orderBy("it").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 10.0, 10.0]


def test_outliers_by_side(spark):
    points = spark.createDataFrame([(10.0, 10.0)] * 8 + [(120.0, 40.0), (-5.0, 0.0)], "mx double, my double")
    r = Q.outlier_report(points, BOX).first()
    assert (r.n, r.n_outside, r.n_ne, r.n_sw, r.handling) == (10, 2, 1, 1, "review") and r.suggested_buffer == pytest.approx(21.0)
    assert Q.outlier_report(points, BOX, buffer=25.0).first().handling == "exclude"
    assert Q.outlier_report(points.where("false"), BOX).first().n_outside == 0


def test_sizes_of_a_square_grid(spark):
    df = spark.range(400).select("id", ((F.col("id") % 20) * 25.0).alias("mx"), (F.floor(F.col("id") / 20) * 25.0).alias("my"))
    r = B.by_neighbours(df, "id").first()
    assert r.raw == pytest.approx(25.0 / 2**0.5) and r.confidence == pytest.approx(1.0)
    assert B.by_neighbours(df.where("id = 1"), "id").first().raw == 25.0 and B.by_neighbours(df.where("false"), "id").first().n == 0
    assert B.ensemble(df, "id").first().confidence == 1.0


def test_triangles(spark):
    assert all(sum(w) == pytest.approx(1.0) and len(w) % 2 for w in N.triangle_bank(10, 5.0, 100.0, 2.0))
    df = spark.createDataFrame([([3.0] * 7,), ([],), (None,)], "w array<double>")
    got = [r.w for r in df.select(N.running_average(F.col("w"), 5).alias("w")).collect()]
    assert got[0] == pytest.approx([3.0] * 7) and got[1:] == [[], None]
    edges = N.cutoffs(3, 10.0, 40.0)
    got = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (99.0,)], "f double").select(N.bank_index(F.col("f"), edges).alias("i"))
    assert [r.i for r in got.collect()] == [0, 0, 1, 2]


def test_methods_by_priority():
    assert [I.recommended("speed"), I.recommended("quality"), I.recommended(), I.recommended(frequency=100.0, dt_ms=4.0), I.recommended(frequency=60.0, dt_ms=4.0), I.recommended(frequency=10.0, dt_ms=4.0)] == ["linear", "sinc8", "sinc4", "sinc8", "cubic", "linear"]


def test_empty_mute_table_gives_no_time(spark, tmp_path):
    path = str(tmp_path / "mute")
    spark.createDataFrame([("x", "y")], "offset string, time_ms string").write.csv(path, header=True)
    rows = spark.createDataFrame([(1, -50.0)], "trace_idx long, offset double")
    assert tables.with_mute(rows, tables.mute_table(spark, path)).first().mute_ms is None


def test_crowded_rows_are_ordered_by_tasks_of_like_size(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("k"), (F.col("id") * 7919 % 20_011).alias("i"))
    rows = df.repartition(5)
    got = Q.ordered(rows, [F.col("k"), F.col("i")], parts=8).collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.k, r.i) for r in df.collect())
    # 99 % of the rows have one key, and no task sorts twice its share
    dealt = df.repartitionByRange(8, "k", "i").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < 2 * 20_000 / 8
    within = Q.ordered_within(df.withColumn("g", F.when(F.col("k") == 7, None).otherwise(F.col("k") % 3)), ["g"], [F.col("i")]).collect()
    for g in (None, 0, 1, 2):
        own = sorted((r["rank"], r.i) for r in within if r.g == g)
        assert [k for k, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)
    assert Q.ordered_within(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_samples_do_not_depend_on_how_rows_lie(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    one, other = (sorted(r.id for r in Q.sampled(x, "id", 50).collect()) for x in (df.repartition(7), df.coalesce(1)))
    assert one == other and len(one) == 50 and Q.sampled(df, "id", 5000).count() == 1000
    # samples of parts hold the sample of the whole
    parts = Q.sampled(df.where("id < 500"), "id", 50).union(Q.sampled(df.where("id >= 500"), "id", 50))
    assert sorted(r.id for r in Q.sampled(parts, "id", 50).collect()) == one


def test_smoothing_does_not_depend_on_blocks(spark):
    from wavegrid.operators import cubes

    cube = spark.range(90 * 7).select((F.col("id") % 90).alias("ix"), F.floor(F.col("id") / 90).cast("long").alias("iy")).withColumn("v", F.array(F.pmod(F.hash("ix", "iy"), F.lit(100)).cast("double"), F.lit(4.0)))
    one, other = ({(r.ix, r.iy): r.v for r in cubes.smoothed(cube, 90, 7, 1.0, block=b).collect()} for b in (1, 500))
    assert one.keys() == other.keys() and len(one) == 630
    assert all(abs(a - b) < 1e-9 for k in one for a, b in zip(one[k], other[k], strict=True)) and all(abs(v[1] - 4) < 1e-9 for v in one.values())
    assert cubes.smoothed(cube, 90, 7, 0.0).count() == 630
    plan = cubes.smoothed(cube, 90, 7, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_splines_through_the_knots_of_rows(spark):
    import numpy as np
    from wavegrid.functions import profiles

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 9):
        t, v = np.sort(rng.random((6, n)) * 10 + np.arange(n), axis=1), rng.random((6, n))
        assert np.allclose(profiles.spline_values(t, v, t), v)
        # a polynomial of the degree that the knots allow comes back, inside and beyond
        p = [1.0, -2.0, 0.5, 0.25][: min(n, 4)]
        x = np.tile(np.linspace(-3, 25, 40), (6, 1))
        poly = lambda a, p=p: sum(c * a**k for k, c in enumerate(p))
        assert np.allclose(profiles.spline_values(t, poly(t), x), poly(x), rtol=1e-6, atol=1e-6)
    t, v, e = np.arange(7.0)[None], rng.random((1, 7)), 1e-4
    f = lambda x: profiles.spline_values(t, v, np.array([[x]]))[0, 0]
    for k in range(1, 6):
        third = [(f(k + s * 4e-2 + 3 * 1e-2) - 3 * f(k + s * 4e-2 + 1e-2) + 3 * f(k + s * 4e-2 - 1e-2) - f(k + s * 4e-2 - 3e-2)) / (2e-2) ** 3 for s in (-1, 1)]
        assert abs((f(k + e) - f(k)) / e - (f(k) - f(k - e)) / e) < 1e-2
        assert (abs(third[0] - third[1]) < 1e-3) == (k in (1, 5))
    rows = [(1, [(1.0, 5.0), (0.0, 3.0), (None, 1.0)], [0.5, 9.0]), (2, [], [1.0]), (3, None, [1.0]), (4, [(2.0, 7.0)], [])]
    df = spark.createDataFrame(rows, "i long, k array<struct<t: double, v: double>>, x array<double>")
    got = {r.i: r.v for r in df.select("i", profiles.spline(F.col("k"), F.col("x"), (0.0, 10.0)).alias("v")).collect()}
    assert got == {1: [4.0, 10.0], 2: [None], 3: [None], 4: []}


def test_azimuth_goes_by_the_first_that_has_enough(spark):
    from wavegrid.operators import azimuth

    rows = [(i, i // 20, i % 20, i // 20, 25.0 * (i % 20), 50.0 * (i // 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "o long, il long, xl long, line long, mx double, my double").withColumns({"sx": F.col("mx") * 2, "sy": F.col("my")})
    pick = lambda x, **k: tuple(azimuth.acquisition_azimuth(x, "o", **k).first())
    assert pick(df, inline="il", crossline="xl", line="line") == (0.0, "inline")
    assert pick(df.where("xl < 8"), inline="il", crossline="xl", line="line") == (90.0, "shot lines")
    assert pick(df.where("xl < 8 AND line < 3"), inline="il", crossline="xl", line="line")[1] == "principal axis"
    assert pick(df.where("il = 0")) == (0.0, "principal axis") and pick(df.limit(0)) == (None, None)


def test_histograms_by_width_and_by_range(spark):
    from wavegrid.operators import aggregates as A

    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 9.9, 10.0, 355.0, 360.0, 360.1, None)], "v double")
    counts = A.histogram(df, F.col("v"), 0.0, 10.0, 36)
    assert {r.bin: r.n for r in counts.collect()} == {0: 2, 1: 1, 35: 2}
    assert tuple(A.dominant_bin(counts).first()) == (0, 2)
    assert [tuple(r) for r in A.range_histogram(df, "v", 4, 0.0, 360.0).orderBy("bin").collect()] == [(0, 0.0, 3), (1, 90.0, 0), (2, 180.0, 0), (3, 270.0, 2)]


def test_antialiased_image_at_time_zero_under_a_midpoint(spark):
    traces = spark.createDataFrame([(1, -20.0, 0.0, 20.0, 0.0, 0.0, 0.0, [1.0] * 64), (2, 0.0, 0.0, 60.0, 0.0, 30.0, 0.0, [1.0] * 64)], "trace_idx long, sx double, sy double, rx double, ry double, mx double, my double, samples array<double>")
    points = spark.createDataFrame([(0, 0, 0.0, 0.0)], "ix long, iy long, x double, y double")
    times = spark.createDataFrame([(0, 0.0), (10, 0.08)], "it long, t0 double")
    for obliquity, least in ((True, 0.0), (False, 1.0)):
        at_zero, later = M.migrate(traces, points, times, M.Options(dominant_frequency=30.0, method="cubic", obliquity=obliquity)).orderBy("it").collect()
        assert (at_zero.amp, at_zero.fold) == (least, 2) and later.amp > 0 and later.fold == 2


def test_neighbour_distances_of_crowds_copies_and_far_points(spark, monkeypatch):
    import random

    from wavegrid.operators import joins as J

    monkeypatch.setattr(J, "TILE_POINTS", 8)
    monkeypatch.setattr(J, "SEEN_POINTS", 24)
    rng = random.Random(5)
    places = [(rng.random() * 100, rng.random() * 100) for _ in range(150)] + [(50 + rng.random() * 2, 50 + rng.random() * 2) for _ in range(150)] + [(1e3, -1e3), (0.0, 0.0), (-0.0, 0.0)]
    rows = places + places[:40] * 3 + [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    got = {(r.mx, r.my): (r.n, r.dist) for r in J.neighbour_distances(spark.createDataFrame(rows, "mx double, my double")).collect()}
    want = {}
    held = [p for p in rows if p[0] is not None and abs(p[0]) < 1e9 and abs(p[1]) < 1e9]
    for i, (a, b) in enumerate(held):
        want[a, b] = (held.count((a, b)), min(((a - c) ** 2 + (b - d) ** 2) ** 0.5 for j, (c, d) in enumerate(held) if i != j))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    for few in ([], [(1.0, 2.0)], [(1.0, 2.0)] * 3, [(1.0, 2.0), (4.0, 6.0)]):
        df = spark.createDataFrame(few, "mx double, my double")
        assert [r.dist for r in J.neighbour_distances(df).collect()] == {0: [], 1: [None], 3: [0.0], 2: [5.0, 5.0]}[len(few)]
