"""Queries on scans of gathers, velocity input, changing sampling, grids and presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegrid.functions import antialias as N
from wavegrid.functions import geometry as G
from wavegrid.functions import sampling as P
from wavegrid.functions import selection as S
from wavegrid.functions import signal as X
from wavegrid.functions import traveltime as T
from wavegrid.operators import aggregates as A
from wavegrid.operators import binsize as B
from wavegrid.operators import cubes
from wavegrid.operators import migration as M
from wavegrid.operators import quality as Q
from wavegrid.operators import velocity as V
from wavegrid.operators import volumes
from wavegrid.plans.headers import hilbert_sql, r6
from wavegrid.plans.imaging import _DSR, _REACH, _RESPONSE, _image_points, _migration_sql, _rounded, _times
from wavegrid.plans.registry import query
from wavegrid.plans.volumes import _U, _folder, _image, _picks
from wavegrid.sources import tables
from wavegrid.sources.survey import headers, literal_table, traces

DT = 0.008
BOX = [(500.0, 400.0), (2000.0, 400.0), (2000.0, 1900.0), (500.0, 1900.0)]


def _cell(c):
    return G.clamp(F.floor(F.col(c) / 25.0), 0, 127).cast("long")


_CELL = "CAST(least(greatest(floor({c}/25),0),127) AS BIGINT)"


@query(f"WITH {{headers}} SELECT trace_idx, {_CELL.format(c='mx')} AS cx, {_CELL.format(c='my')} AS cy FROM headers")
def geometry_hilbert_inverse(spark, d):
    x, y = G.hilbert_cell(F.col("h"), 7)
    return headers(spark, d).select("trace_idx", G.hilbert(_cell("mx"), _cell("my"), 7).alias("h")).select("trace_idx", x.alias("cx"), y.alias("cy"))


@query(f"WITH {{headers}}, c AS (SELECT trace_idx, {_CELL.format(c='mx')} AS a, {_CELL.format(c='my')} AS b FROM headers), m AS (SELECT trace_idx, list_sum([((a>>k)&1)<<(2*k) FOR k IN range(7)])+list_sum([((b>>k)&1)<<(2*k+1) FOR k IN range(7)]) AS z FROM c) SELECT trace_idx, row_number() OVER (ORDER BY z, trace_idx)-1 AS rank FROM m")
def survey_order_morton(spark, d):
    return Q.numbered(headers(spark, d), G.morton(_cell("mx"), _cell("my")), "trace_idx").select("trace_idx", "rank")


@query(f"WITH {{headers}}, {hilbert_sql(7)} SELECT trace_idx, row_number() OVER (ORDER BY d, trace_idx)-1 AS rank FROM c7")
def survey_order_hilbert(spark, d):
    return Q.numbered(headers(spark, d), G.hilbert(_cell("mx"), _cell("my"), 7), "trace_idx").select("trace_idx", "rank")


@query("""WITH {headers}, o AS (SELECT greatest(500-mx, mx-2000, 400-my, my-1900) AS d, mx >= 1250 AS e, my >= 1150 AS n FROM headers), s AS (SELECT count(*) AS n, count(*) FILTER (d>0) AS n_outside, count(*) FILTER (d>0 AND e AND n) AS n_ne, count(*) FILTER (d>0 AND e AND NOT n) AS n_se,
    count(*) FILTER (d>0 AND NOT e AND NOT n) AS n_sw, count(*) FILTER (d>0 AND NOT e AND n) AS n_nw, round(max(d),6) AS farthest, round(count(*) FILTER (d>0)/count(*),9) AS share, round(max(d)*1.05e0,6) AS suggested_buffer FROM o)
    SELECT *, CASE WHEN share <= 0.05 THEN 'exclude' WHEN share <= 0.15 THEN 'extend' ELSE 'review' END AS handling FROM s""")
def outlier_report(spark, d):
    return r6(r6(Q.outlier_report(headers(spark, d), BOX), "farthest", "suggested_buffer"), "share", digits=9)


@query("""WITH {headers}, t AS (SELECT mx*cos(radians(30))+my*sin(radians(30)) AS u, my*cos(radians(30))-mx*sin(radians(30)) AS v FROM headers),
    e AS (SELECT min(u)-(max(u)-min(u))*0.005e0 AS a, max(u)+(max(u)-min(u))*0.005e0 AS b, min(v)-(max(v)-min(v))*0.005e0 AS p, max(v)+(max(v)-min(v))*0.005e0 AS q, cos(radians(30)) AS c, sin(radians(30)) AS s FROM t)
    SELECT round(a*c-p*s,5) AS x0, round(a*s+p*c,5) AS y0, round(b*c-p*s,5) AS x1, round(b*s+p*c,5) AS y1, round(b*c-q*s,5) AS x2, round(b*s+q*c,5) AS y2, round(a*c-q*s,5) AS x3, round(a*s+q*c,5) AS y3 FROM e""")
def rotated_extent(spark, d):
    found = Q.rotated_extent(headers(spark, d), 30.0)
    return r6(found, *found.columns, digits=5)


@query("WITH {headers} SELECT count(*) FILTER (abs(mx-1250) <= 750+b/sqrt(2) AND abs(my-1150) <= 750+b/sqrt(2)) AS n_inside, count(*) AS n FROM headers, (SELECT 500*tan(radians(40)) AS b)")
def aperture_extended_coverage(spark, d):
    wide = G.aperture_corners(BOX, 500.0, 40.0)
    return headers(spark, d).agg(F.count_if(G.quad_distance("mx", "my", wide) <= 0).alias("n_inside"), F.count(F.lit(1)).alias("n"))


@query("""WITH {headers}, h AS (SELECT *, rx-sx AS ox, ry-sy AS oy FROM headers) SELECT count(*) FILTER ("offset" < 1500) AS near_offsets, count(*) FILTER ("offset" > 2500) AS far_offsets, count(*) FILTER ("offset" BETWEEN 1000 AND 3000) AS mid_offsets,
    count(*) FILTER (azimuth < 45 OR azimuth > 315) AS ns_azimuths, count(*) FILTER (azimuth BETWEEN 45 AND 135) AS ew_azimuths, count(*) FILTER (ox>0 AND oy>0) AS quadrant_1_ne, count(*) FILTER (ox<0 AND oy>0) AS quadrant_2_nw,
    count(*) FILTER (ox<0 AND oy<0) AS quadrant_3_sw, count(*) FILTER (ox>0 AND oy<0) AS quadrant_4_se, count(*) FILTER (ox>0) AS positive_offset_x, count(*) FILTER (ox<0) AS negative_offset_x FROM h""")
def preset_expressions(spark, d):
    h = headers(spark, d).withColumns({"offset_x": F.col("rx") - F.col("sx"), "offset_y": F.col("ry") - F.col("sy")})
    return h.agg(*[F.count_if(S.compile_expression(text, h.columns)).alias(name) for name, text in S.EXPRESSIONS.items()])


@query("""WITH {headers}, t AS (SELECT trace_idx, "offset"/2 AS h, azimuth*10+5 AS z FROM headers) SELECT trace_idx, round((ln((1800+0.6e0*z+sqrt((1800+0.6e0*z)*(1800+0.6e0*z)+0.36e0*h*h))/(1800+sqrt(1800.0e0*1800.0e0+0.36e0*h*h)))/0.6e0)/(sqrt(h*h+z*z)/(1800+0.6e0*z/2)),6) AS ratio FROM t""")
def curved_to_straight_ratio(spark, d):
    return r6(headers(spark, d).select("trace_idx", T.curved_ratio(F.col("offset"), F.col("azimuth") * 10 + 5, 1800.0, 0.6).alias("ratio")), "ratio")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)*40.0e0 AS t, 1500+value AS v FROM events), g AS (SELECT *, coalesce((lead(t/1000.0e0) OVER w-lag(t/1000.0e0) OVER w)/2, lead(t/1000.0e0) OVER w-t/1000.0e0, t/1000.0e0-lag(t/1000.0e0) OVER w) AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    z AS (SELECT *, sum(v*s) OVER (PARTITION BY user_id ORDER BY t)/2 AS z FROM g), l AS (SELECT user_id, regr_slope(v,z) AS k, regr_intercept(v,z) AS b, avg(v) AS m FROM z GROUP BY user_id) SELECT user_id, round(least(greatest(coalesce(b,m),1000),6000),3) AS v0, round(least(greatest(coalesce(k,0),0),2),5) AS k FROM l""")
def gradient_from_interval_velocities(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 40.0).alias("t"), (1500.0 + F.col("value")).alias("v"))
    return cubes.interval_gradient(e, ["user_id"], "t", "v").select("user_id", F.round("v0", 3).alias("v0"), F.round("k", 5).alias("k"))


_TRIALS = "[-0.1e0,0.0e0,0.1e0,0.2e0,0.3e0]"
_ETA = f"""t AS (SELECT shot_id, "offset" AS x, samples, unnest({_TRIALS}) AS eta FROM traces), u AS (SELECT *, unnest(range(64)) AS it FROM t), m AS (SELECT *, it*0.008e0 AS t0 FROM u),
    q AS (SELECT *, CASE WHEN t0 <= 0 THEN t0 ELSE sqrt(greatest(t0*t0+x*x/(2000.0e0*2000.0e0)-2*eta*(x*x)*(x*x)/((2000.0e0*2000.0e0)*(t0*t0*(2000.0e0*2000.0e0)+(1+2*eta)*(x*x))),0)) END AS tx FROM m), r AS (SELECT *, CAST(floor(tx/0.008e0+1e-9) AS BIGINT) AS i FROM q),
    v AS (SELECT *, CASE WHEN i < 64 THEN CAST(samples[i+1] AS DOUBLE) END AS a FROM r), s AS (SELECT shot_id, it, eta, CASE WHEN count(a)>=2 AND sum(a*a)>0 THEN sum(a)*sum(a)/(count(a)*sum(a*a)) ELSE 0 END AS semblance FROM v GROUP BY ALL)"""


def _eta_scan(spark, d):
    return V.eta_scan(traces(spark, d), ["shot_id"], F.lit(2000.0), [-0.1, 0.0, 0.1, 0.2, 0.3], DT, 64)


@query(f"WITH {{traces}}, {_ETA} SELECT shot_id, it, eta, round(semblance,6) AS semblance FROM s")
def eta_scan(spark, d):
    return r6(_eta_scan(spark, d), "semblance")


@query(f"WITH {{traces}}, {_ETA} SELECT shot_id, it, arg_min(eta, (-round(semblance,9), eta)) AS eta FROM s GROUP BY ALL")
def eta_picks(spark, d):
    return V.eta_picks(_eta_scan(spark, d), ["shot_id"])


@query("""WITH {traces}, t AS (SELECT shot_id, "offset" AS x, samples, unnest(range(4)) AS iv FROM traces), u AS (SELECT *, unnest(range(64)) AS it FROM t), m AS (SELECT *, it*0.008e0 AS t0, 1600.0e0+200*iv AS v FROM u), r AS (SELECT *, CAST(floor(sqrt(t0*t0+x*x/(v*v))/0.008e0+1e-9) AS BIGINT) AS i FROM m),
    a AS (SELECT *, CASE WHEN i < 64 THEN CAST(samples[i+1] AS DOUBLE) END AS w FROM r), b AS (SELECT shot_id, iv, it, count(*) AS n, count(w) AS m, sum(w) AS s1, sum(w*w) AS s2 FROM a GROUP BY ALL)
    SELECT shot_id, iv, it, round(CASE WHEN it BETWEEN 2 AND 61 AND m>=2 AND s2>0 THEN s1*s1/(n*s2) ELSE 0 END,6) AS semblance FROM b""")
def gather_semblance(spark, d):
    return r6(V.gather_semblance(traces(spark, d), ["shot_id"], [1600.0, 1800.0, 2000.0, 2200.0], DT, 64, 2), "semblance")


_BINS = f'{_U}, g AS (SELECT ix, CAST(floor("offset"/100) AS BIGINT) AS bin, it, round(avg(v),9) AS v FROM u GROUP BY ALL)'
_CURVE = f"""{_BINS}, l AS (SELECT ix, it, sqrt(avg(v*v)) AS rms FROM g GROUP BY ALL), s AS (SELECT ix, it AS pos FROM (SELECT *, max(rms) OVER (PARTITION BY ix) AS most FROM l) WHERE rms > 0.5e0*most),
    p AS (SELECT s.ix, pos, bin, arg_max(it, (abs(v), -it)) AS pick FROM s JOIN g ON s.ix=g.ix AND g.it BETWEEN pos-3 AND pos+2 GROUP BY ALL), c AS (SELECT ix, pos, regr_slope(pick*8.0e0, (bin*100+50.0e0)*(bin*100+50.0e0)) AS k FROM p GROUP BY ALL HAVING count(*) >= 3)"""


def _curvature(spark, d):
    g = _image(spark, d).groupBy("ix", F.floor(F.col("offset") / 100.0).cast("long").alias("bin"), "it").agg(F.round(F.avg("v"), 9).alias("v"))
    return V.curvature(g, ["ix"], F.col("bin") * 100 + 50.0, 8.0, 48.0)


@query(f"WITH {{traces}}, {_CURVE} SELECT ix, CAST(pos AS BIGINT) AS \"at\", round(k*1e6,4) AS curvature FROM c")
def gather_curvature(spark, d):
    return _curvature(spark, d).select("ix", "at", F.round(F.col("curvature") * 1e6, 4).alias("curvature"))


@query(f"WITH {{traces}}, {_CURVE} SELECT ix, count(*) AS n_events, round(1/(1+avg(abs(k))*1e6),6) AS flatness FROM c GROUP BY ix")
def gather_flatness(spark, d):
    return r6(V.flatness(_curvature(spark, d), ["ix"]), "flatness")


_EDGES = [5.0, 10.0, 20.0, 40.0, 80.0]


@query('WITH {headers} SELECT trace_idx, CAST(least(len([e FOR e IN [5,10,20,40,80] IF e < "offset"/4]),4) AS BIGINT) AS filter, CAST(CASE WHEN "offset" >= 0 AND "offset" < 150 THEN 0 WHEN "offset" >= 150 AND "offset" < 300 THEN 1 ELSE 2 END AS BIGINT) AS sector FROM headers')
def alias_filter_index(spark, d):
    return headers(spark, d).select("trace_idx", N.bank_index(F.col("offset") / 4.0, _EDGES).alias("filter"), N.offset_sector(F.col("offset"), [0.0, 150.0, 300.0, 450.0]).alias("sector"))


@query("""WITH {traces}, p AS (SELECT trace_idx, samples, unnest(range(64)) AS it FROM traces), w AS (SELECT trace_idx, it, unnest(range(-2,3)) AS k, samples FROM p), x AS (SELECT trace_idx, it, 1-abs(k)/3.0e0 AS w, CAST(samples[it+k+1] AS DOUBLE) AS a FROM w WHERE it+k BETWEEN 0 AND 63)
    SELECT trace_idx, it, round(sum(w*a)/sum(w),6) AS v FROM x GROUP BY ALL""")
def running_average_triangle(spark, d):
    t = traces(spark, d).withColumn("o", N.running_average(F.col("samples"), 5))
    return r6(volumes.exploded(t, ["trace_idx"], "o"), "v")


WINDOWS = [(0.0, 0.008, 16), (0.128, 0.016, 24)]


@query("WITH {traces} SELECT CAST(CASE WHEN k < 16 THEN 0 ELSE 1 END AS BIGINT) AS \"window\", CAST(CASE WHEN k < 16 THEN k ELSE k-16 END AS BIGINT) AS i, CAST(CASE WHEN k < 16 THEN k ELSE 16+2*(k-16) END AS BIGINT) AS it, round(CASE WHEN k < 16 THEN k*0.008e0 ELSE 0.128e0+(k-16)*0.016e0 END,9) AS t0, round(127/40.0e0,9) AS speedup, (SELECT round(avg(CAST(samples[CASE WHEN k < 16 THEN k ELSE 16+2*(k-16) END + 1] AS DOUBLE)),6) FROM traces) AS v FROM range(40) t(k)")
def sampling_windows(spark, d):
    found = P.times(spark, WINDOWS, DT, 64).withColumn("speedup", F.lit(P.speedup(WINDOWS, 0.0, 1.016, DT)))
    rows = volumes.exploded(traces(spark, d), [], "samples").groupBy("it").agg(F.round(F.avg("v"), 6).alias("v"))
    return r6(found.join(rows, "it"), "t0", "speedup", digits=9)


def _window_image(spark, d):
    o = M.Options(aperture_mode="open")
    return M.migrate(traces(spark, d), _image_points(spark), P.times(spark, WINDOWS, DT, 64).select("it", (F.col("it") * DT).alias("t0")), o)


_OPEN = "least(100.0e0+v*t0/2,500.0e0)"
_WINDOWED = _migration_sql(_DSR, _OPEN).replace("FROM range(64) c(k)", "FROM range(64) c(k) WHERE k < 16 OR k % 2 = 0")


@query(_WINDOWED)
def migrate_time_windows(spark, d):
    return _rounded(_window_image(spark, d))


@query("""WITH {headers}, s AS (SELECT shot_id, trace_idx % 16 AS k, avg("offset") AS v FROM headers WHERE trace_idx % 16 IN (0,3,4,9,15) GROUP BY ALL), f AS (SELECT shot_id, list({'t': k, 'v': v} ORDER BY k) AS p FROM s GROUP BY ALL), g AS (SELECT shot_id, p, unnest(range(20)) AS it FROM f), r AS (SELECT *, len([z FOR z IN p IF z.t <= it]) AS n FROM g)
    SELECT shot_id, it, round(CASE WHEN n=0 THEN p[1].v WHEN n>=len(p) THEN p[len(p)].v ELSE p[n].v+(p[n+1].v-p[n].v)*(it-p[n].t)/(p[n+1].t-p[n].t) END,4) AS v FROM r""")
def uniform_sampling(spark, d):
    rows = headers(spark, d).withColumn("it", F.col("trace_idx") % 16).where(F.col("it").isin(0, 3, 4, 9, 15)).groupBy("shot_id", "it").agg(F.avg("offset").alias("v"))
    return r6(P.uniform(rows, ["shot_id"], "v", 20), "v", digits=4)


_I, _J = "CAST(least(floor(least(x,2000)/500.0e0),3) AS BIGINT)", "CAST(least(floor(least(y,2000)/400.0e0),4) AS BIGINT)"
_FX, _FY = f"(least(x,2000)/500.0e0-{_I})", f"(least(y,2000)/400.0e0-{_J})"
_AT = lambda i, j: f"(1600+60*({_I}+{i})+25*({_J}+{j})+(({_I}+{i})*({_J}+{j})%3)*40+9*it)"
_CUBE_V = f"(({_AT(0, 0)}*(1-{_FX})+{_AT(1, 0)}*{_FX})*(1-{_FY})+({_AT(0, 1)}*(1-{_FX})+{_AT(1, 1)}*{_FX})*{_FY})"


def _cube_points(spark):
    """Image points with velocities between the pillars of a small cube, and etas."""
    x, y = cubes.Axis(0.0, 500.0, 5), cubes.Axis(0.0, 400.0, 6)
    value = F.expr("transform(sequence(0, 63), k -> cast(1600 + 60 * ix + 25 * iy + (ix * iy % 3) * 40 + 9 * k AS double))")
    cube = spark.range(30).select((F.col("id") % 5).alias("ix"), F.floor(F.col("id") / 5).alias("iy")).withColumn("v", value)
    points = cubes.pillars(_image_points(spark), cube, x, y)
    return points.withColumn("etas", F.transform("velocities", lambda v: (F.col("ix") % 3) * 0.01 + 0.05))


@query(_migration_sql(_DSR, _REACH, v=_CUBE_V))
def migrate_velocity_cube(spark, d):
    o = M.Options(velocity="velocities")
    return _rounded(M.migrate(traces(spark, d), _cube_points(spark), _times(spark), o))


def _vti_leg(x: str) -> str:
    eta = "((ix%3)*0.01e0+0.05e0)"
    return f"sqrt(greatest((t0/2)*(t0/2)+{x}/(v*v)-2*{eta}*{x}*{x}/((v*v)*((t0/2)*(t0/2)*v*v+(1+2*{eta})*{x})),0))"


@query(_migration_sql(f"{_vti_leg('ds2')}+{_vti_leg('dr2')}", "500.0e0", v=_CUBE_V))
def migrate_eta_cube(spark, d):
    o = M.Options(velocity="velocities", pillar=("etas",), aperture_mode="constant", travel_time=T.vti_dsr)
    return _rounded(M.migrate(traces(spark, d), _cube_points(spark), _times(spark), o))


_NODES = 'k AS (SELECT CAST(floor(mx/250) AS BIGINT) AS il, CAST(floor(my/250) AS BIGINT) AS xl, round(avg("offset")+1500,6) AS v FROM headers GROUP BY ALL), n AS (SELECT * FROM k WHERE (il+2*xl) % 4 = 0 AND il % 3 <> 2), q AS (SELECT CAST(i AS BIGINT) AS il, CAST(j AS BIGINT) AS xl FROM range(9) a(i), range(9) b(j))'


def _nodes(spark, d):
    h = headers(spark, d).groupBy(F.floor(F.col("mx") / 250.0).cast("long").alias("il"), F.floor(F.col("my") / 250.0).cast("long").alias("xl")).agg(F.round(F.avg("offset") + 1500, 6).alias("v"))
    nodes = h.where("(il + 2 * xl) % 4 = 0 AND il % 3 <> 2")
    return nodes, spark.range(81).select(F.floor(F.col("id") / 9).alias("il"), (F.col("id") % 9).alias("xl"))


@query(f"WITH {{headers}}, {_NODES}, b AS (SELECT q.il, q.xl, arg_min(v, (abs(q.il-n.il)+abs(q.xl-n.xl), n.il, n.xl)) AS v FROM q JOIN n ON abs(q.il-n.il)<=1 AND abs(q.xl-n.xl)<=1 GROUP BY ALL) SELECT q.il, q.xl, v FROM q LEFT JOIN b USING (il, xl)")
def velocity_at_nearest_node(spark, d):
    nodes, queries = _nodes(spark, d)
    return cubes.at_node(queries, nodes, "v")


def _line_query(line: str, at: str) -> None:
    def run(spark, d):
        nodes, queries = _nodes(spark, d)
        return r6(cubes.along_line(queries, nodes, line, at, "v"), "v", digits=4)

    run.__name__ = f"velocity_along_{line}"
    query(f"""WITH {{headers}}, {_NODES}, f AS (SELECT {line}, list({{'t': {at}, 'v': v}} ORDER BY {at}) AS p FROM n GROUP BY {line}), r AS (SELECT q.il, q.xl, p, greatest(least(len([z FOR z IN p IF z.t <= q.{at}]), len(p)-1),1) AS i, q.{at} AS pos FROM q LEFT JOIN f USING ({line}))
        SELECT il, xl, round(CASE WHEN p IS NULL THEN NULL WHEN len(p)=1 THEN p[1].v ELSE p[i].v+(p[i+1].v-p[i].v)*(pos-p[i].t)/(p[i+1].t-p[i].t) END,4) AS v FROM r""")(run)


_line_query("il", "xl")
_line_query("xl", "il")


@query("WITH {headers}, l AS (SELECT DISTINCT CAST(floor(mx/400) AS BIGINT) AS il, CAST(floor(my/400) AS BIGINT) AS xl FROM headers) SELECT il, xl, CAST(k AS BIGINT) AS it, round(CASE WHEN k*0.05e0 < 0.2e0 THEN 1500+400*(k*0.05e0)/0.2e0 WHEN k*0.05e0 < 0.4e0 THEN 1900+700*(k*0.05e0-0.2e0)/0.2e0 ELSE 2600 END,4) AS v FROM l, range(11) c(k)")
def velocity_grid_setup(spark, d):
    lines = headers(spark, d).select(F.floor(F.col("mx") / 400.0).cast("long").alias("il"), F.floor(F.col("my") / 400.0).cast("long").alias("xl")).distinct()
    rows = lines.select("il", "xl", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("it"))
    return rows.withColumn("v", F.round(volumes.velocity_at(_picks(), F.col("it") * 0.05), 4))


@query("WITH {headers} SELECT count(*) AS n, count(*) FILTER (NOT (mx BETWEEN 100 AND 2100 AND my BETWEEN 100 AND 2100)) AS n_outside, round(100.0e0*count(*) FILTER (NOT (mx BETWEEN 100 AND 2100 AND my BETWEEN 100 AND 2100))/count(*),6) AS percent_outside, greatest(100-min(mx),0) AS gap_x_low, greatest(max(mx)-2100,0) AS gap_x_high, greatest(100-min(my),0) AS gap_y_low, greatest(max(my)-2100,0) AS gap_y_high FROM headers")
def velocity_cube_coverage(spark, d):
    return r6(cubes.coverage(headers(spark, d), cubes.Axis(100.0, 500.0, 5), cubes.Axis(100.0, 400.0, 6), "mx", "my"), "percent_outside")


_NEAR = "p AS (SELECT trace_idx AS i, mx, my FROM traces), nn AS (SELECT a.i, min(sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my))) AS d FROM p a JOIN p b ON a.i<>b.i GROUP BY a.i)"


@query(f"WITH {{traces}}, {_NEAR} SELECT count(*) AS n, round(quantile_cont(d,0.5)/sqrt(2),6) AS raw, round(greatest(0,1-stddev_pop(d)/quantile_cont(d,0.5)),6) AS confidence FROM nn")
def bin_size_by_neighbours(spark, d):
    return r6(B.by_neighbours(traces(spark, d), "trace_idx").select("n", "raw", "confidence"), "raw", "confidence")


@query("""WITH {headers} SELECT trace_idx, round(CASE WHEN "offset" < 100 THEN 20 WHEN "offset" < 300 THEN 20+180*("offset"-100)/200 WHEN "offset" < 450 THEN 200+150*("offset"-300)/150 ELSE 350 END,6) AS mute_ms FROM headers""")
def mute_table_from_csv(spark, d):
    home = _folder(spark)
    literal_table(spark, "offset, time_ms", [(300.0, 200.0), (100.0, 20.0), (450.0, 350.0)]).write.csv(home, header=True)
    return r6(tables.with_mute(headers(spark, d), tables.mute_table(spark, home)).select("trace_idx", "mute_ms"), "mute_ms")


@query(f'WITH {{traces}}, {_U} SELECT CAST(floor("offset"/200) AS BIGINT) AS bin_id, count(*) AS n, round(avg("offset"),6) AS offset_avg FROM u GROUP BY ALL')
def bins_of_written_gathers(spark, d):
    home = _folder(spark)
    _image(spark, d).withColumn("bin_id", F.floor(F.col("offset") / 200.0).cast("long")).write.partitionBy("bin_id").parquet(home)
    return r6(tables.bins(spark, home), "offset_avg")


# the band-pass of filter_band_pass and then the gain of eight samples to both sides
@query(f"WITH {{traces}}, {_RESPONSE}, x AS (SELECT trace_idx, unnest(range(64)) AS j, unnest(samples)::DOUBLE AS x FROM traces), o AS (SELECT trace_idx, (j+m)%64 AS i, sum(x*c) AS a FROM x, c GROUP BY ALL), g AS (SELECT *, sqrt(avg(a*a) OVER (PARTITION BY trace_idx ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) AS rms FROM o) SELECT trace_idx, CAST(i AS BIGINT) AS it, round(CASE WHEN rms>1e-10 THEN a/rms ELSE 0 END,6) AS v FROM g")
def band_pass_then_gain(spark, d):
    """Band-pass and gain one after the other, each on a trace alone."""
    t = traces(spark, d).withColumn("f", X.band_pass(5.0, 40.0, DT)(F.col("samples"))).withColumn("o", X.agc(F.col("f"), 8))
    return r6(volumes.exploded(t, ["trace_idx"], "o"), "v")


@query("WITH {headers}, t AS (SELECT trace_idx, CAST(floor(mx/300) AS BIGINT) AS tx, CAST(floor(my/300) AS BIGINT) AS ty, mx, my FROM headers), c AS (SELECT trace_idx, tx, ty, sqrt((mx-(tx+0.5e0)*300)*(mx-(tx+0.5e0)*300)+(my-(ty+0.5e0)*300)*(my-(ty+0.5e0)*300)) AS d FROM t) SELECT trace_idx, tx, ty, round(d,6) AS d, row_number() OVER (PARTITION BY tx, ty ORDER BY d, trace_idx)-1 AS rank FROM c")
def order_by_tile_centre(spark, d):
    found = Q.by_tile_centre(headers(spark, d), 300.0, "trace_idx")
    return found.select("trace_idx", "tx", "ty", F.round("centre_distance", 6).alias("d"), "rank")


@query("WITH {headers} SELECT trace_idx, shot_id FROM headers ORDER BY (trace_idx*2654435761)%4294967296, trace_idx LIMIT 500")
def repeatable_sample(spark, d):
    return Q.sampled(headers(spark, d), "trace_idx", 500).select("trace_idx", "shot_id")


@query('WITH {headers}, h AS (SELECT least(CAST(floor("offset"/20) AS BIGINT), 49) AS bin FROM headers WHERE "offset" BETWEEN 0 AND 1000), s AS (SELECT min("offset") AS lo, max("offset") AS hi, avg("offset") AS mean, stddev_pop("offset") AS std FROM headers) SELECT b AS bin, b*20.0e0 AS low, (SELECT count(*) FROM h WHERE bin=b) AS n, round(lo,6) AS lo, round(hi,6) AS hi, round(mean,6) AS mean, round(std,6) AS std FROM s, range(50) z(b)')
def offset_histogram(spark, d):
    h = headers(spark, d)
    whole = h.agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.avg("offset").alias("mean"), F.stddev_pop("offset").alias("std"))
    return r6(A.range_histogram(h, "offset", 50, 0.0, 1000.0).join(F.broadcast(whole)), "lo", "hi", "mean", "std")


@query("WITH {headers} SELECT count(*) AS n, round(avg(azimuth),6) AS mean, round(stddev_pop(azimuth),6) AS std, round(((degrees(atan2(sum(sin(radians(azimuth))),sum(cos(radians(azimuth)))))%360)+360)%360,4) AS direction, round(sqrt(power(avg(sin(radians(azimuth))),2)+power(avg(cos(radians(azimuth))),2)),6) AS strength FROM headers")
def azimuth_summary(spark, d):
    found = A.direction(headers(spark, d), "azimuth")
    return r6(found.withColumn("direction", F.round("direction", 4)), "mean", "std", "strength")


@query("WITH {headers}, {traces}, u AS (SELECT trace_idx, unnest(range(64)) AS it, unnest(samples)::DOUBLE AS v FROM traces), b AS (SELECT row_number() OVER (ORDER BY trace_idx DESC)-1 AS pos, trace_idx FROM traces WHERE trace_idx % 3 = 0) SELECT pos, b.trace_idx, mx, round(sum(v*v),5) AS energy FROM b JOIN (SELECT trace_idx, mx FROM traces) t USING (trace_idx) JOIN u USING (trace_idx) GROUP BY ALL")
def traces_by_position(spark, d):
    """Traces that a list of numbers asks for, with the position of each in the list."""
    t = traces(spark, d)
    wanted = Q.ordered(t.where("trace_idx % 3 = 0").select("trace_idx"), [-F.col("trace_idx")], "pos")
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return wanted.join(t.select("trace_idx", "mx", F.round(energy, 5).alias("energy")), "trace_idx").select("pos", "trace_idx", "mx", "energy")


_REGENERATED = """WITH {headers}, m AS (SELECT CAST(floor(mx/500) AS BIGINT) AS ix, CAST(floor(my/400) AS BIGINT) AS iy, 1500+avg("offset") AS a FROM headers WHERE mx BETWEEN 0 AND 2499 AND my BETWEEN 0 AND 2399 GROUP BY ALL),
    c AS (SELECT ix, iy, k, a+60*k AS v FROM m, range(3) z(k)),
    g AS (SELECT o.ix, o.iy, o.k, o.v, CASE WHEN l.v IS NULL THEN r.v-o.v WHEN r.v IS NULL THEN o.v-l.v ELSE (r.v-l.v)/2 END AS gx, CASE WHEN b.v IS NULL THEN u.v-o.v WHEN u.v IS NULL THEN o.v-b.v ELSE (u.v-b.v)/2 END AS gy
        FROM c o LEFT JOIN c l ON l.ix=o.ix-1 AND l.iy=o.iy AND l.k=o.k LEFT JOIN c r ON r.ix=o.ix+1 AND r.iy=o.iy AND r.k=o.k LEFT JOIN c b ON b.ix=o.ix AND b.iy=o.iy-1 AND b.k=o.k LEFT JOIN c u ON u.ix=o.ix AND u.iy=o.iy+1 AND u.k=o.k),
    p AS (SELECT i AS ix, j AS iy, i*220.0e0-150 AS x, j*330.0e0-200 AS y FROM range(13) a(i), range(9) b(j)),
    q AS (SELECT *, least(greatest(x,0),2000)/500 AS fx, least(greatest(y,0),2000)/400 AS fy, x-least(greatest(x,0),2000) AS dx, y-least(greatest(y,0),2000) AS dy FROM p),
    w AS (SELECT q.ix, q.iy, dx, dy, g.k, g.v, g.gx, g.gy, greatest(0,1-abs(fx-g.ix))*greatest(0,1-abs(fy-g.iy)) AS w FROM q, g),
    e AS (SELECT ix, iy, k, least(greatest(sum(w*v)+0.3e0*(sum(w*gx)*any_value(dx)+sum(w*gy)*any_value(dy)),1500),6000) AS v FROM w GROUP BY ix, iy, k),
    n AS (SELECT d, exp(-0.5e0*d*d/2.25e0)/(SELECT sum(exp(-0.5e0*d*d/2.25e0)) FROM range(-6,7) z(d)) AS w FROM range(-6,7) z(d)),
    s AS (SELECT i AS ix, e.iy, e.k, sum(n.w*e.v) AS v FROM range(13) a(i), n, e WHERE e.ix = CASE WHEN (i+d+26)%26 < 13 THEN (i+d+26)%26 ELSE 25-(i+d+26)%26 END GROUP BY ALL),
    t AS (SELECT s.ix, j AS iy, s.k, sum(n.w*s.v) AS v FROM range(9) a(j), n, s WHERE s.iy = CASE WHEN (j+d+18)%18 < 9 THEN (j+d+18)%18 ELSE 17-(j+d+18)%18 END GROUP BY ALL)
    SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(k AS BIGINT) AS it, round(v,4) AS v FROM t"""


@query(_REGENERATED)
def velocity_cube_regenerated(spark, d):
    """A cube from means of headers, continued beyond its edges and smoothed."""
    h = headers(spark, d).where("mx BETWEEN 0 AND 2499 AND my BETWEEN 0 AND 2399")
    mean = h.groupBy(F.floor(F.col("mx") / 500.0).cast("long").alias("ix"), F.floor(F.col("my") / 400.0).cast("long").alias("iy")).agg((1500 + F.avg("offset")).alias("a"))
    cube = mean.select("ix", "iy", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("a") + 60.0 * k).alias("v"))
    found = cubes.regenerated(cube, cubes.Axis(0.0, 500.0, 5), cubes.Axis(0.0, 400.0, 6), cubes.Axis(-150.0, 220.0, 13), cubes.Axis(-200.0, 330.0, 9), sigma=1.5)
    return found.select("ix", "iy", F.posexplode("v").alias("it", "v")).select("ix", "iy", F.col("it").cast("long").alias("it"), F.round("v", 4).alias("v"))
