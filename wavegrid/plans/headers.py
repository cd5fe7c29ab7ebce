"""Queries on headers: geometry, selection, statistics and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.functions import geometry as G
from wavegrid.functions import selection as S
from wavegrid.operators import aggregates as A
from wavegrid.operators import joins as J
from wavegrid.operators.binsize import spacings
from wavegrid.plans.registry import query
from wavegrid.sources.survey import grid, header_statistics, headers, literal_table, traces, with_scalar

CORNERS = [(200.0, 150.0), (2000.0, 250.0), (1900.0, 2100.0), (100.0, 2000.0)]


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("WITH {headers} SELECT trace_idx, round(mx,6) AS mx, round(my,6) AS my, round(\"offset\",6) AS offset_m, round(azimuth,6) AS azimuth FROM headers")
def geometry_midpoint_offset_azimuth(spark, d):
    return r6(headers(spark, d).select("trace_idx", "mx", "my", F.col("offset").alias("offset_m"), "azimuth"), "mx", "my", "offset_m", "azimuth")


@query("WITH {headers} SELECT trace_idx, round(sx*3.28084e0,6) AS feet, round(sx*0.3048e0,6) AS metres, sx/1000.0e0 AS s, sx*1000.0e0 AS ms, CAST(greatest(0,least(99,floor(sx/8.0e0))) AS BIGINT) AS idx, shot_id*0.008e0+0.1e0 AS t FROM headers")
def geometry_units(spark, d):
    x = F.col("sx")
    return r6(headers(spark, d).select("trace_idx", G.metres_to_feet(x).alias("feet"), G.feet_to_metres(x).alias("metres"), G.ms_to_s(x).alias("s"), G.s_to_ms(x).alias("ms"), G.time_to_index(x, 8.0, 0.0, 100).alias("idx"), G.sample_to_time("shot_id", 0.008, 0.1).alias("t")), "feet", "metres")


@query("WITH {headers}, f AS (SELECT min_by(k, trace_idx) AS k FROM (SELECT trace_idx, shot_id - 25 AS k FROM headers)) SELECT trace_idx, round(CASE WHEN k>0 THEN sx*k WHEN k<0 THEN sx/abs(k) ELSE sx END,6) AS sx FROM headers, f")
def geometry_segy_scalar(spark, d):
    return r6(with_scalar(headers(spark, d).withColumn("k", F.col("shot_id") - 25), "k", ("sx",)).select("trace_idx", "sx"), "sx")


_GRID = G.Grid(100.0, 50.0, 30.0, 25.0, 50.0)


@query("WITH {headers} SELECT trace_idx, round(((mx-100)*cos(radians(30))+(my-50)*sin(radians(30)))/25,6) AS i, round((-(mx-100)*sin(radians(30))+(my-50)*cos(radians(30)))/50,6) AS j, round(mx,6) AS x, round(my,6) AS y FROM headers")
def geometry_world_grid_round_trip(spark, d):
    i, j = _GRID.to_grid("mx", "my")
    x, y = _GRID.to_world("i", "j")
    return r6(headers(spark, d).select("trace_idx", i.alias("i"), j.alias("j")).withColumns({"x": x, "y": y}), "i", "j", "x", "y")


@query("WITH {headers}, g AS (SELECT trace_idx, round_even((mx-100)/25,0) AS a, round_even((my-50)/50,0) AS b FROM headers) SELECT CAST(a AS BIGINT) AS ix, CAST(b AS BIGINT) AS iy, count(*) AS fold FROM g WHERE a BETWEEN 0 AND 79 AND b BETWEEN 0 AND 39 GROUP BY ALL")
def geometry_cdp_bins(spark, d):
    ix, iy, ok = G.Grid(100.0, 50.0, 0.0, 25.0, 50.0).nearest_cell("mx", "my", 80, 40)
    return headers(spark, d).where(ok).groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("fold"))


def _edge_sql(x: str, y: str) -> list[str]:
    out = []
    for k in range(4):
        (ax, ay), (bx, by) = CORNERS[k], CORNERS[(k + 1) % 4]
        out.append(f"(({x}-{ax}e0)*({by - ay}e0)-({y}-{ay}e0)*({bx - ax}e0))/sqrt({(bx - ax) ** 2 + (by - ay) ** 2}e0)")
    return out


@query(f"WITH {{headers}}, e AS (SELECT trace_idx, greatest({', '.join(_edge_sql('mx', 'my'))}) AS dist FROM headers) SELECT trace_idx, round(dist,6) AS dist, dist<=0 AS inside, round(CASE WHEN -dist<=0 THEN 0 WHEN -dist>=300 THEN 1 ELSE 0.5*(1-cos(pi()*-dist/300)) END,6) AS taper FROM e")
def geometry_quad_distance_taper(spark, d):
    h = headers(spark, d)
    return r6(h.select("trace_idx", G.quad_distance("mx", "my", CORNERS).alias("dist"), G.in_quad("mx", "my", CORNERS).alias("inside"), G.boundary_taper("mx", "my", CORNERS, 300.0).alias("taper")), "dist", "taper")


@query("WITH {headers}, c AS (SELECT trace_idx, CAST(floor(mx/25) AS BIGINT)&65535 AS a, CAST(floor(my/25) AS BIGINT)&65535 AS b FROM headers) SELECT trace_idx, CAST((SELECT sum(((a>>k)&1)<<(2*k)) + sum(((b>>k)&1)<<(2*k+1)) FROM range(16) t(k)) AS BIGINT) AS morton FROM c")
def geometry_morton(spark, d):
    c = lambda x: F.floor(F.col(x) / 25.0).cast("long")
    return headers(spark, d).select("trace_idx", G.morton(c("mx").bitwiseAND(F.lit(65535)), c("my").bitwiseAND(F.lit(65535))).alias("morton"))


def hilbert_sql(order: int) -> str:
    """CTEs c0 to c<order> over ``headers``: the last has the distance d of each trace's 25 m cell along the curve."""
    cell = lambda c: f"CAST(least(greatest(floor({c}/25),0),{2**order - 1}) AS BIGINT)"
    out = [f"c0 AS (SELECT trace_idx, {cell('mx')} AS x, {cell('my')} AS y, CAST(0 AS BIGINT) AS d FROM headers)"]
    for k in range(order):
        s = 2 ** (order - 1 - k)
        parts = f"SELECT trace_idx, d, x//{s} AS p, y//{s} AS q, x%{s} AS a, y%{s} AS b FROM c{k}"
        side = lambda v: f"CASE WHEN p=1 THEN {s - 1}-{v} ELSE {v} END"
        out.append(f"c{k + 1} AS (SELECT trace_idx, CASE WHEN q=0 THEN {side('b')} ELSE a END AS x, CASE WHEN q=0 THEN {side('a')} ELSE b END AS y, d+{s * s}*xor(3*p,q) AS d FROM ({parts}))")
    return ", ".join(out)


@query(f"WITH {{headers}}, {hilbert_sql(7)} SELECT trace_idx, d AS hilbert FROM c7")
def geometry_hilbert(spark, d):
    c = lambda x: G.clamp(F.floor(F.col(x) / 25.0), 0, 127).cast("long")
    return headers(spark, d).select("trace_idx", G.hilbert(c("mx"), c("my"), 7).alias("hilbert"))


@query("WITH {headers} SELECT trace_idx, printf('%.1fs', CAST(shot_id AS DOUBLE)) AS shown FROM headers WHERE shot_id < 50")
def geometry_format_duration(spark, d):
    return headers(spark, d).where("shot_id < 50").select("trace_idx", G.format_duration("shot_id").alias("shown"))


def _count_by_shot(df: DataFrame) -> DataFrame:
    return df.groupBy("shot_id").agg(F.count(F.lit(1)).alias("n"))


def _selection(name: str, condition, sql: str) -> None:
    def run(spark, d):
        return _count_by_shot(headers(spark, d).where(condition()))

    run.__name__ = f"select_{name}"
    query(f"WITH {{headers}} SELECT shot_id, count(*) AS n FROM headers WHERE {sql} GROUP BY shot_id")(run)


_o, _a = (lambda: F.col("offset")), (lambda: F.col("azimuth"))
_ox, _oy = (lambda: F.col("rx") - F.col("sx")), (lambda: F.col("ry") - F.col("sy"))
_selection("offset_range", lambda: S.within(_o(), 100.0, 400.0), '"offset" BETWEEN 100 AND 400')
_selection("offset_open_range", lambda: S.within(_o(), 250.0, None), '"offset" >= 250')
_selection("offset_multi_range", lambda: S.offset_ranges(_o(), [(0.0, 100.0), (300.0, 350.0)]), '(abs("offset") BETWEEN 0 AND 100 OR abs("offset") BETWEEN 300 AND 350)')
_selection("offset_excluded", lambda: S.offset_ranges(_o(), [(0.0, 100.0), (300.0, 350.0)], exclude=True), 'NOT (abs("offset") BETWEEN 0 AND 100 OR abs("offset") BETWEEN 300 AND 350)')
_selection("azimuth_sector_wrap", lambda: S.azimuth_range(_a(), 315.0, 45.0), "(azimuth >= 315 OR azimuth <= 45)")
_selection("azimuth_sectors", lambda: S.azimuth_sectors(_o(), _a(), [(10.0, 60.0, 0.0, 300.0), (200.0, 250.0, None, None)]), '((azimuth BETWEEN 10 AND 60 AND abs("offset") BETWEEN 0 AND 300) OR azimuth BETWEEN 200 AND 250)')
_selection("north_south", lambda: S.azimuth_sectors(_o(), _a(), S.NORTH_SOUTH), "(azimuth BETWEEN 0 AND 45 OR azimuth BETWEEN 315 AND 360 OR azimuth BETWEEN 135 AND 225)")
_selection("east_west", lambda: S.azimuth_sectors(_o(), _a(), S.EAST_WEST), "(azimuth BETWEEN 45 AND 135 OR azimuth BETWEEN 225 AND 315)")
_selection("offset_vector", lambda: S.offset_vector(_ox(), _oy(), (-300.0, 300.0), (None, 200.0), ("NE", "SW")), "rx-sx BETWEEN -300 AND 300 AND ry-sy <= 200 AND ((rx-sx>=0 AND ry-sy>=0) OR (rx-sx<0 AND ry-sy<0))")
_selection("near_preset", lambda: S.near(_o()), 'abs("offset") <= 1500')
_selection("far_preset", lambda: S.far(_o()), 'abs("offset") >= 2500')
_selection("expression", lambda: S.compile_expression("(offset < 300 and azimuth > 90) or sqrt(abs(sx - rx)) > 18 and not (shot_id % 2 == 0)", ["offset", "azimuth", "sx", "rx", "shot_id"]), '(("offset" < 300 AND azimuth > 90) OR (sqrt(abs(sx-rx)) > 18 AND NOT (shot_id % 2 = 0)))')


@query("WITH {headers} SELECT CAST(floor((rx-sx)/100) AS BIGINT) AS tx, CASE WHEN ry-sy < -300 OR ry-sy >= 400 THEN -1 WHEN ry-sy >= 100 THEN 2 WHEN ry-sy >= -50 THEN 1 ELSE 0 END::BIGINT AS ty, count(*) AS n FROM headers GROUP BY ALL")
def select_tiles(spark, d):
    return headers(spark, d).groupBy(S.regular_tile(_ox(), 100.0).alias("tx"), S.irregular_tile(_oy(), [-300.0, -50.0, 100.0, 400.0]).alias("ty")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH {headers} SELECT count(*) AS n_total, count(*) FILTER (\"offset\" < 60) AS n_selected, round(100.0e0*count(*) FILTER (\"offset\" < 60)/count(*),6) AS percent, CASE WHEN count(*) FILTER (\"offset\" < 60)=0 THEN 'none' WHEN 100.0e0*count(*) FILTER (\"offset\" < 60)/count(*) < 10 THEN 'few' ELSE '' END AS warning FROM headers")
def select_statistics(spark, d):
    return r6(S.selection_statistics(headers(spark, d), _o() < 60.0), "percent")


@query("WITH {headers} SELECT count(*) AS n_traces, count(DISTINCT shot_id) AS n_shots, " + ", ".join(f"{f}(\"{c}\") AS {c}_{f}" if c != "azimuth" and c != "offset" else f"round({f}(\"{c}\"),6) AS {c}_{f}" for c in ("sx", "sy", "rx", "ry", "mx", "my", "azimuth", "offset") for f in ("min", "max")) + ", round(avg(\"offset\"),6) AS offset_mean FROM headers")
def header_stats(spark, d):
    return r6(header_statistics(headers(spark, d)), "azimuth_min", "azimuth_max", "offset_min", "offset_max", "offset_mean")


@query("WITH {headers}, l AS (SELECT min(mx) AS ax, max(mx) AS bx, min(my) AS ay, max(my) AS \"by\" FROM headers) SELECT least(CAST(floor((mx-ax)/50) AS BIGINT), greatest(CAST(ceil((bx-ax)/50) AS BIGINT),1)-1) AS cx, least(CAST(floor((my-ay)/50) AS BIGINT), greatest(CAST(ceil((\"by\"-ay)/50) AS BIGINT),1)-1) AS cy, count(*) AS fold FROM headers, l GROUP BY ALL")
def fold_map_query(spark, d):
    return A.fold_map(headers(spark, d), 50.0)


@query("WITH {headers} SELECT CAST(floor(mx/100) AS BIGINT) AS ix, CAST(floor(my/100) AS BIGINT) AS iy, count(*) AS trace_count, round(avg(\"offset\"),6) AS offset_avg, round(sum(sin(radians(azimuth))),4) AS sin_sum FROM headers GROUP BY ALL")
def bin_header_sums(spark, d):
    c = lambda x: F.floor(F.col(x) / 100.0).cast("long")
    sums = headers(spark, d).groupBy(c("mx").alias("ix"), c("my").alias("iy")).agg(F.count(F.lit(1)).alias("trace_count"), F.avg("offset").alias("offset_avg"), F.round(F.sum(F.sin(F.radians("azimuth"))), 4).alias("sin_sum"))
    return r6(sums, "offset_avg")


@query("WITH {headers} SELECT shot_id AS ix, CAST(0 AS BIGINT) AS iy, count(*) AS trace_count, round(avg(\"offset\"),6) AS offset_avg, round((degrees(atan2(sum(sin(radians(azimuth))),sum(cos(radians(azimuth)))))+360.0e0)%360.0e0,4) AS azimuth_avg FROM headers GROUP BY shot_id")
def bin_headers_circular_mean(spark, d):
    return r6(A.bin_headers(headers(spark, d), F.col("shot_id"), F.lit(0).cast("long")), "offset_avg").withColumn("azimuth_avg", F.round("azimuth_avg", 4))


@query("WITH {headers} SELECT min(\"offset\") AS offset_min, round(max(\"offset\"),6) AS offset_max, round(avg(\"offset\"),6) AS offset_mean, round(stddev_pop(\"offset\"),6) AS offset_std, round(median(\"offset\"),6) AS offset_median FROM headers")
def offset_stats(spark, d):
    return r6(A.offset_statistics(headers(spark, d)), "offset_max", "offset_mean", "offset_std", "offset_median")


@query("WITH {headers} SELECT CAST(CASE WHEN azimuth=360 THEN 35 ELSE floor(azimuth/10) END AS BIGINT) AS bin, count(*) AS n FROM headers GROUP BY ALL")
def azimuth_histogram(spark, d):
    return A.histogram(headers(spark, d), _a(), 0.0, 10.0, 36)


@query("WITH {headers}, h AS (SELECT CAST(CASE WHEN azimuth=360 THEN 35 ELSE floor(azimuth/10) END AS BIGINT) AS bin, count(*) AS n FROM headers GROUP BY ALL) SELECT bin, n FROM h ORDER BY n DESC, bin LIMIT 1")
def azimuth_dominant(spark, d):
    return A.dominant_bin(A.histogram(headers(spark, d), _a(), 0.0, 10.0, 36))


@query("WITH {headers} SELECT CAST(least(greatest(floor((\"offset\"-50)/100),0),3) AS BIGINT) AS bin, count(*) AS n, round(avg(\"offset\"),6) AS mean, round(min(\"offset\"),6) AS low, round(max(\"offset\"),6) AS high FROM headers GROUP BY ALL")
def offset_bins_clipped(spark, d):
    b = headers(spark, d).groupBy(A.clipped_bin(_o(), 50.0, 100.0, 4).alias("bin"))
    return r6(b.agg(F.count(F.lit(1)).alias("n"), F.avg("offset").alias("mean"), F.min("offset").alias("low"), F.max("offset").alias("high")), "mean", "low", "high")


@query("WITH {headers} SELECT shot_id, trace_idx, row_number() OVER (PARTITION BY shot_id ORDER BY \"offset\", trace_idx) - 1 AS pos FROM headers")
def sort_and_renumber(spark, d):
    w = Window.partitionBy("shot_id").orderBy("offset", "trace_idx")
    return headers(spark, d).select("shot_id", "trace_idx", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("WITH {headers} SELECT sx, sy, rx, ry, count(*) AS n FROM headers GROUP BY ALL HAVING count(*) > 1")
def duplicate_positions(spark, d):
    return A.duplicates(headers(spark, d), ["sx", "sy", "rx", "ry"])


@query("WITH {headers}, l AS (SELECT quantile_cont(\"offset\",0.05) AS a, quantile_cont(\"offset\",0.95) AS b FROM headers) SELECT round(avg(\"offset\"),6) AS robust_mean, count(*) AS n FROM headers, l WHERE \"offset\" BETWEEN a AND b")
def robust_mean_offset(spark, d):
    return r6(A.robust_mean(headers(spark, d), "offset"), "robust_mean")


@query("WITH {headers} SELECT round(((90-degrees(0.5e0*atan2(2*covar_pop(sx,sy),var_pop(sx)-var_pop(sy))))%180+180)%180,3) AS azimuth FROM headers")
def acquisition_azimuth_pca(spark, d):
    return r6(A.covariance_azimuth(headers(spark, d), "sx", "sy"), "azimuth", digits=3)


@query("WITH {headers} SELECT shot_id, round(((degrees(atan2(arg_max(sx,(trace_idx,sx,sy))-arg_min(sx,(trace_idx,sx,sy)),arg_max(sy,(trace_idx,sx,sy))-arg_min(sy,(trace_idx,sx,sy))))%360)+360)%360,6) AS azimuth, count(*) AS n FROM headers GROUP BY shot_id HAVING count(*)>5")
def shot_line_azimuth(spark, d):
    by = headers(spark, d).groupBy("shot_id").agg(*[f(c, F.struct("trace_idx", "sx", "sy")).alias(f"{c}{n}") for c in ("sx", "sy") for n, f in ((0, F.min_by), (1, F.max_by))], F.count(F.lit(1)).alias("n")).where("n > 5")
    return r6(by.select("shot_id", G.azimuth("sx0", "sy0", "sx1", "sy1").alias("azimuth"), "n"), "azimuth")


@query("WITH {headers} SELECT round(x,6) AS spacing, count(*) AS n FROM (SELECT sx - lag(sx) OVER (ORDER BY sx) AS x FROM (SELECT DISTINCT sx FROM headers)) WHERE x >= 1 GROUP BY ALL")
def coordinate_spacings(spark, d):
    gaps = spacings(headers(spark, d), "sx")
    return r6(gaps.groupBy(F.col("gap").alias("spacing")).agg(F.count(F.lit(1)).alias("n")), "spacing")


def _points(spark):
    return grid(spark, 8, 8, 300.0, 300.0).withColumn("q", F.col("iy") * 8 + F.col("ix"))


_PTS = "pts AS (SELECT i AS ix, j AS iy, j*8+i AS q, i*300.0e0 AS x, j*300.0e0 AS y FROM range(8) a(i), range(8) b(j))"


@query(f"WITH {{headers}}, {_PTS} SELECT q, count(*) AS n, round(min(sqrt((mx-x)*(mx-x)+(my-y)*(my-y))),6) AS least FROM headers JOIN pts ON (mx-x)*(mx-x)+(my-y)*(my-y) <= 22500.0e0 GROUP BY q")
def radius_join_count(spark, d):
    met = J.radius_join(headers(spark, d), _points(spark), 150.0)
    return r6(met.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least")), "least")


@query(f"WITH {{headers}}, {_PTS} SELECT q, count(*) AS n, count(DISTINCT trace_idx) AS traces FROM headers JOIN pts ON mx BETWEEN x-200 AND x+200 AND my BETWEEN y-100 AND y+100 GROUP BY q")
def rectangle_join_count(spark, d):
    boxes = _points(spark).select("q", (F.col("x") - 200).alias("x0"), (F.col("x") + 200).alias("x1"), (F.col("y") - 100).alias("y0"), (F.col("y") + 100).alias("y1"))
    return J.rectangle_join(headers(spark, d), boxes, 200.0).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trace_idx").alias("traces"))


@query(f"WITH {{traces}}, {_PTS}, k AS (SELECT q, trace_idx, sqrt((mx-x)*(mx-x)+(my-y)*(my-y)) AS dist FROM traces, pts) SELECT q, trace_idx, round(dist,6) AS dist, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, trace_idx) AS rk FROM k) WHERE rk <= 3")
def nearest_join_three(spark, d):
    found = J.nearest_join(traces(spark, d), _points(spark), 3, 100.0, "trace_idx", "q")
    return r6(found.select("q", "trace_idx", "dist", "rank"), "dist")


_BINS = [(0, 0.0, 100.0), (1, 100.0, 250.0), (2, 200.0, 600.0)]


@query("WITH {headers}, b(bin_id,low,high) AS (VALUES (0,0.0e0,100.0e0),(1,100.0e0,250.0e0),(2,200.0e0,600.0e0)) SELECT CAST(bin_id AS BIGINT) AS bin_id, count(*) AS n FROM headers JOIN b ON \"offset\" BETWEEN low AND high GROUP BY ALL")
def gather_bin_join(spark, d):
    bins = literal_table(spark, "bin_id, low, high", _BINS)
    return J.interval_join(headers(spark, d), bins, _o(), "low", "high", 100.0).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {headers}, {traces} SELECT h.trace_idx, round(h.\"offset\",6) AS offset_m FROM headers h WHERE h.trace_idx IN (SELECT trace_idx*10+1 FROM traces)")
def semi_join_by_index(spark, d):
    wanted = traces(spark, d).select((F.col("trace_idx") * 10 + 1).alias("trace_idx"))
    return r6(headers(spark, d).join(wanted, "trace_idx", "left_semi").select("trace_idx", F.col("offset").alias("offset_m")), "offset_m")
