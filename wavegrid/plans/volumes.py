"""Queries on stacks, sinks, picks and quality reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavegrid.functions import selection as S
from wavegrid.functions import traveltime as T
from wavegrid.operators import aggregates as A
from wavegrid.operators import joins as J
from wavegrid.operators import quality as Q
from wavegrid.operators import volumes as V
from wavegrid.operators.joins import rectangle_join
from wavegrid.plans.headers import r6
from wavegrid.plans.registry import query
from wavegrid.sources import sinks
from wavegrid.sources.survey import headers, literal_table, traces
from wavegrid.session import ensure_checkpoint_dir

DT = 0.008
PICKS = ((0.0, 1500.0), (0.2, 1900.0), (0.4, 2600.0))


def _picks():
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in PICKS])


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


def _image(spark, d):
    """A small volume: traces as pillars of a grid by their number."""
    rows = traces(spark, d).select((F.col("trace_idx") % 7).alias("ix"), (F.floor(F.col("trace_idx") / 7) % 5).alias("iy"), "offset", F.posexplode("samples").alias("it", "v"))
    return rows.withColumns({"it": F.col("it").cast("long"), "v": F.col("v").cast("double")})


_U = 'u AS (SELECT trace_idx, trace_idx%7 AS ix, (trace_idx//7)%5 AS iy, "offset", unnest(range(64)) AS it, unnest(samples)::DOUBLE AS v FROM traces)'


@query(f"WITH {{traces}}, {_U} SELECT ix, iy, it, round(CAST(sum(v) AS FLOAT)::DOUBLE,3) AS amp, count(*) AS fold FROM u GROUP BY ALL")
def sink_stack(spark, d):
    home = _folder(spark)
    sinks.write_stack(_image(spark, d).groupBy("ix", "iy", "it").agg(F.sum("v").alias("amp"), F.count(F.lit(1)).alias("fold")), home, DT)
    one, other = (V.exploded(spark.read.parquet(f"{home}/{n}"), ["ix", "iy"], "samples").withColumnRenamed("v", n) for n in ("stack", "fold"))
    return one.join(other, ["ix", "iy", "it"]).select("ix", "iy", "it", F.round("stack", 3).alias("amp"), F.col("fold").cast("long").alias("fold"))


@query('WITH {headers} SELECT CAST(floor(mx/200) AS BIGINT) AS ix, CAST(floor(my/200) AS BIGINT) AS iy, count(*) AS trace_count, round(avg("offset"),6) AS offset_avg FROM headers GROUP BY ALL')
def sink_bin_headers(spark, d):
    home, c = _folder(spark), lambda x: F.floor(F.col(x) / 200.0).cast("long")
    sinks.write_bin_headers(A.bin_headers(headers(spark, d), c("mx"), c("my")), home)
    return r6(spark.read.parquet(home).select("ix", "iy", "trace_count", "offset_avg"), "offset_avg")


@query(f"WITH {{traces}}, {_U} SELECT CAST(floor(\"offset\"/200) AS BIGINT) AS bin_id, 'offset' AS bin_type, CAST(NULL AS DOUBLE) AS ovt_x_min, count(*) AS n, round(sum(v),4) AS amp, 'volumes/bin_id='||CAST(floor(\"offset\"/200) AS BIGINT) AS volume_path FROM u GROUP BY ALL")
def sink_gathers(spark, d):
    home, own = _folder(spark), F.floor(F.col("offset") / 200.0).cast("long")
    rows = _image(spark, d).withColumn("bin_id", own)
    bins = rows.select("bin_id").distinct().withColumns({"bin_type": F.lit("offset"), "offset_min": F.col("bin_id") * 200.0})
    sinks.write_gathers(rows, A.bin_headers(traces(spark, d), own, F.lit(0)), bins, home)
    found = spark.read.parquet(f"{home}/volumes").groupBy(F.col("bin_id").cast("long").alias("bin_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("amp"))
    return spark.read.parquet(f"{home}/gathers_index").join(found, "bin_id").select("bin_id", "bin_type", "ovt_x_min", "n", "amp", "volume_path")


@query(f"WITH {{traces}}, {_U} SELECT ix, iy, CAST(floor(\"offset\"/250) AS BIGINT) AS bin, it, round(avg(v),5) AS amp, count(*) AS fold FROM u GROUP BY ALL")
def sink_cig(spark, d):
    home = _folder(spark)
    sums = _image(spark, d).groupBy("ix", "iy", F.floor(F.col("offset") / 250.0).cast("long").alias("bin"), "it").agg(F.sum("v").alias("amp"), F.count(F.lit(1)).alias("fold"))
    sinks.write_cig(sums, home, True)
    return spark.read.parquet(home).select("ix", "iy", F.col("bin").cast("long").alias("bin"), "it", F.round("amp", 5).alias("amp"), "fold")


@query("WITH {traces} SELECT trace_idx, len(samples) AS n, round(list_sum([CAST(x AS DOUBLE) FOR x IN samples]),5) AS total FROM traces")
def sink_traces(spark, d):
    home = _folder(spark)
    sinks.write_traces(traces(spark, d), home)
    return spark.read.parquet(home).select("trace_idx", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, a: s + a.cast("double")), 5).alias("total"))


_V = "CASE WHEN t0 < 0.2e0 THEN 1500+400*t0/0.2e0 WHEN t0 < 0.4e0 THEN 1900+700*(t0-0.2e0)/0.2e0 ELSE 2600 END"


def _nmo_sql(sign: str, mute: str) -> str:
    return f"""n AS (SELECT trace_idx, shot_id, "offset" AS x, samples, unnest(range(64)) AS i FROM traces), p AS (SELECT *, i*0.008e0 AS t0 FROM n), q AS (SELECT *, sqrt(greatest(t0*t0{sign}x*x/(({_V})*({_V})),0)) AS t FROM p),
    r AS (SELECT *, t/0.008e0 AS s FROM q), o AS (SELECT trace_idx, shot_id, i AS it, CASE WHEN {mute} THEN 0 WHEN s < 63 THEN CAST(samples[CAST(floor(s) AS BIGINT)+1] AS DOUBLE)*(1-(s-floor(s)))+CAST(samples[CAST(floor(s) AS BIGINT)+2] AS DOUBLE)*(s-floor(s)) ELSE 0 END AS v FROM r)"""


_MUTE = "abs(t-t0)/greatest(t0,0.008e0) > 0.3e0"


@query(f"WITH {{traces}}, {_nmo_sql('+', _MUTE)} SELECT trace_idx, it, round(v,6) AS v FROM o")
def nmo_velocity_profile(spark, d):
    t = traces(spark, d).withColumn("o", V.nmo(F.col("samples"), F.col("offset"), _picks(), DT, 30.0))
    return r6(V.exploded(t, ["trace_idx"], "o"), "v")


@query(f"WITH {{traces}}, {_nmo_sql('-', 'false')} SELECT trace_idx, it, round(v,6) AS v FROM o")
def nmo_velocity_profile_inverse(spark, d):
    t = traces(spark, d).withColumn("o", V.nmo(F.col("samples"), F.col("offset"), _picks(), DT, inverse=True))
    return r6(V.exploded(t, ["trace_idx"], "o"), "v")


@query(f"WITH {{traces}}, {_nmo_sql('+', _MUTE)} SELECT shot_id, it, round(avg(v),6) AS stack, count(*) AS fold FROM o GROUP BY ALL")
def nmo_stack_by_bin(spark, d):
    return r6(V.nmo_stack(traces(spark, d), ["shot_id"], _picks(), DT, 30.0), "stack")


def _line_stack(line: str):
    def run(spark, d):
        t = traces(spark, d).withColumns({"il": F.floor(F.col("mx") / 250.0).cast("long"), "xl": F.floor(F.col("my") / 250.0).cast("long")})
        return r6(V.nmo_stack(t.where(F.col(line) == 4), ["il", "xl"], _picks(), DT, 30.0), "stack")

    run.__name__ = f"nmo_stack_along_{line}"
    sql = _nmo_sql("+", _MUTE).replace("FROM traces)", f"FROM (SELECT *, CAST(floor(mx/250) AS BIGINT) AS il, CAST(floor(my/250) AS BIGINT) AS xl FROM traces) WHERE {line}=4)").replace("shot_id", "il, xl")
    query(f"WITH {{traces}}, {sql} SELECT il, xl, it, round(avg(v),6) AS stack, count(*) AS fold FROM o GROUP BY ALL")(run)


_line_stack("il")
_line_stack("xl")


@query(f"WITH {{traces}}, {_U} SELECT ix, iy, it, round(sum(v),4) AS amp FROM u WHERE \"offset\" < 400 GROUP BY ALL")
def cig_stack(spark, d):
    return _image(spark, d).where("offset < 400").groupBy("ix", "iy", "it").agg(F.round(F.sum("v"), 4).alias("amp"))


@query(f"WITH {{traces}}, {_U} SELECT CAST(floor(\"offset\"/150) AS BIGINT) AS bin, it, round(avg(v),6) AS v, count(*) AS fold FROM u WHERE ix BETWEEN 2 AND 4 AND iy BETWEEN 1 AND 3 AND \"offset\" < 600 GROUP BY ALL")
def super_gather(spark, d):
    return r6(V.super_gather(_image(spark, d), 3, 2, 1, 0.0, 150.0, 4), "v")


@query(f"WITH {{traces}}, {_U}, a AS (SELECT ix, iy, it, sum(v) AS v FROM u GROUP BY ALL), b AS (SELECT ix, iy, it, sum(v*0.5e0+\"offset\"/1e4) AS v FROM u WHERE ix < 6 GROUP BY ALL) SELECT count(a.v-b.v) AS n_both, count(*) FILTER (b.v IS NULL) AS n_first, count(*) FILTER (a.v IS NULL) AS n_second, round(avg(a.v-b.v),5) AS mean, round(sqrt(avg((a.v-b.v)*(a.v-b.v))),5) AS rms, round(max(abs(a.v-b.v)),5) AS largest, round(corr(a.v,b.v),5) AS correlation FROM a FULL JOIN b USING (ix, iy, it)")
def volume_differences(spark, d):
    rows = _image(spark, d)
    one = rows.groupBy("ix", "iy", "it").agg(F.sum("v").alias("v"))
    other = rows.where("ix < 6").groupBy("ix", "iy", "it").agg(F.sum(F.col("v") * 0.5 + F.col("offset") / 1e4).alias("v"))
    return r6(V.differences(one, other, ["ix", "iy", "it"], "v"), "mean", "rms", "largest", "correlation", digits=5)


@query(f"WITH {{traces}}, {_U} SELECT 'time' AS kind, ix AS a, iy AS b, round(sum(v),4) AS v FROM u WHERE it=20 GROUP BY ALL UNION ALL SELECT 'inline', iy, it, round(sum(v),4) FROM u WHERE ix=3 GROUP BY ALL UNION ALL SELECT 'crossline', ix, it, round(sum(v),4) FROM u WHERE iy=2 GROUP BY ALL")
def volume_slices(spark, d):
    rows, out = _image(spark, d), None
    for kind, at, where, a, b in (("time", "it", 20, "ix", "iy"), ("inline", "ix", 3, "iy", "it"), ("crossline", "iy", 2, "ix", "it")):
        own = rows.where(F.col(at) == where).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.round(F.sum("v"), 4).alias("v")).select(F.lit(kind).alias("kind"), "a", "b", "v")
        out = own if out is None else out.unionByName(own)
    return out


@query("WITH {traces} SELECT count(*) AS n_traces, round(sum(len([x FOR x IN samples IF isnan(x)]))/sum(len(samples)),9) AS nan_share, CAST(sum(len([x FOR x IN samples IF isinf(x)])) AS BIGINT) AS n_inf, count(*) FILTER (len([x FOR x IN samples IF x <> 0])=0)/count(*) AS zero_share, round(min(list_min(samples))::DOUBLE,6) AS amp_min, round(max(list_max(samples))::DOUBLE,6) AS amp_max FROM traces")
def trace_quality(spark, d):
    return r6(Q.trace_quality(traces(spark, d)), "nan_share", "amp_min", "amp_max")


_CELL = "least(CAST(floor(({c}-a{c})/50) AS BIGINT), greatest(CAST(ceil((b{c}-a{c})/50) AS BIGINT),1)-1)"
_LIM = "l AS (SELECT min(mx) AS amx, max(mx) AS bmx, min(my) AS amy, max(my) AS bmy FROM headers)"


@query(f"WITH {{headers}}, {_LIM}, f AS (SELECT {_CELL.format(c='mx')} AS cx, {_CELL.format(c='my')} AS cy, count(*) AS fold FROM headers, l GROUP BY ALL) SELECT (SELECT count(*) FROM headers) AS n_traces, (SELECT count(*) FILTER (\"offset\" < 1) FROM headers) AS n_zero_offset, greatest(CAST(ceil((bmx-amx)/50) AS BIGINT),1)*greatest(CAST(ceil((bmy-amy)/50) AS BIGINT),1) AS n_cells, max(fold) AS fold_max, round(avg(fold),6) AS fold_mean, count(*) AS n_filled, round(100.0e0*(1-count(*)/(greatest(ceil((any_value(bmx)-any_value(amx))/50),1)*greatest(ceil((any_value(bmy)-any_value(amy))/50),1))),6) AS empty_percent FROM f, l GROUP BY bmx, amx, bmy, amy")
def geometry_report(spark, d):
    return r6(Q.geometry_report(headers(spark, d), 50.0), "fold_mean", "empty_percent")


@query("WITH {headers}, m AS (SELECT trace_idx, i*3+j AS tile FROM headers, range(3) a(i), range(3) b(j) WHERE mx BETWEEN i*800-300 AND i*800+1100 AND my BETWEEN j*800-300 AND j*800+1100) SELECT count(*) AS n_rows, count(DISTINCT trace_idx) AS n_traces, count(DISTINCT tile) AS n_tiles, round(count(*)/count(DISTINCT trace_idx),6) AS factor, round(least(greatest((count(*)/count(DISTINCT trace_idx)-1)/10,0),1),6) AS score FROM m")
def tile_overlap(spark, d):
    boxes = spark.range(9).select(F.col("id").alias("tile"), F.floor(F.col("id") / 3).alias("i"), (F.col("id") % 3).alias("j"))
    boxes = boxes.select("tile", *[(F.col(c) * 800.0 + s).alias(n) for c, s, n in (("i", -300, "x0"), ("i", 1100, "x1"), ("j", -300, "y0"), ("j", 1100, "y1"))])
    return r6(Q.overlap(J.rectangle_join(headers(spark, d), boxes, 400.0), "trace_idx", "tile"), "factor", "score")


@query("WITH e AS (SELECT user_id, value*20 AS v, value*20 - lag(value*20) OVER (PARTITION BY user_id ORDER BY event_id) AS dv FROM events) SELECT user_id, count(v) AS n, count(*) FILTER (NOT v BETWEEN 1000 AND 8000) AS n_outside, count(*) FILTER (dv < -50) AS n_inversions, count(*) FILTER (NOT v BETWEEN 1000 AND 8000)=0 AND count(*) FILTER (dv < -50)=0 AND count(v)>0 AS valid FROM e GROUP BY user_id")
def velocity_report(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", (F.col("value") * 20).alias("v"))
    return Q.velocity_report(events, ["user_id"], "event_id", "v")


@query("WITH {headers} SELECT count(*) AS n, count(*) FILTER (sx IS NULL OR sy IS NULL) AS n_unusable, count(*) FILTER (sx=0 AND sy=0) AS n_origin, max(sx)-min(sx) AS width, max(sy)-min(sy) AS height, greatest(max(sx)-min(sx),max(sy)-min(sy))>0 AS valid FROM headers")
def coordinate_report(spark, d):
    return Q.coordinate_report(headers(spark, d), "sx", "sy")


@query("WITH {headers}, t AS (SELECT CAST(least(greatest(floor(mx/400),0),5) AS BIGINT) AS ix, CAST(greatest(floor(my/400),0) AS BIGINT) AS iy, count(*) AS n FROM headers GROUP BY ALL) SELECT ix, iy, n, CAST(CASE WHEN iy%2=0 THEN iy*6+ix ELSE iy*6+5-ix END AS BIGINT) AS rank FROM t")
def tile_order_snake(spark, d):
    at = lambda c: F.greatest(F.floor(F.col(c) / 400.0), F.lit(0)).cast("long")
    tiles = headers(spark, d).groupBy(F.least(at("mx"), F.lit(5)).cast("long").alias("ix"), at("my").alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return tiles.select("ix", "iy", "n", V.snake(F.col("ix"), F.col("iy"), 6).alias("rank"))


@query("WITH {headers}, t AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, e[i+1] AS x0, e[i+2] AS x1, f[j+1] AS y0, f[j+2] AS y1 FROM range(3) a(i), range(2) b(j), (SELECT [-300e0,0e0,150e0,600e0] AS e, [0e0,200e0,500e0] AS f)) SELECT i, j, x0, x1, y0, y1, count(*) AS n FROM t, headers WHERE rx-sx BETWEEN x0 AND x1 AND ry-sy BETWEEN y0 AND y1 GROUP BY ALL")
def generated_tiles(spark, d):
    """Tiles of offset vectors and the traces in each, those on an edge in both."""
    boxes = S.tiles(spark, [-300.0, 0.0, 150.0, 600.0], [0.0, 200.0, 500.0])
    vectors = headers(spark, d).select((F.col("rx") - F.col("sx")).alias("vx"), (F.col("ry") - F.col("sy")).alias("vy"))
    return rectangle_join(vectors, boxes, 150.0, "vx", "vy").groupBy("i", "j", "x0", "x1", "y0", "y1").agg(F.count(F.lit(1)).alias("n"))


@query('WITH {headers} SELECT CAST(trunc("offset"/20) AS BIGINT) AS bin, count(*) AS n FROM headers GROUP BY ALL')
def offset_bins_truncated(spark, d):
    return headers(spark, d).groupBy((F.col("offset") / 20.0).cast("int").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query('WITH {headers} SELECT count(*) FILTER ("offset" BETWEEN 100 AND 300 AND azimuth BETWEEN 0 AND 90) AS n_and, count(*) FILTER ("offset" BETWEEN 100 AND 300 OR azimuth BETWEEN 0 AND 90) AS n_or, count(*) AS n_none FROM headers')
def selection_root(spark, d):
    parts = [S.within(F.col("offset"), 100.0, 300.0), S.within(F.col("azimuth"), 0.0, 90.0)]
    return headers(spark, d).agg(F.count_if(S.combined(parts)).alias("n_and"), F.count_if(S.combined(parts, "or")).alias("n_or"), F.count_if(S.combined([])).alias("n_none"))


@query("WITH {headers}, p(t,v) AS (VALUES (100e0,1600e0),(300e0,2000e0),(420e0,2300e0)), k AS (SELECT row_number() OVER () AS r, trace_idx, \"offset\" AS a, 1500+azimuth*3 AS b FROM headers), m AS (SELECT r, trace_idx, p.t, p.v, ((t-a)/50)*((t-a)/50)+((v-b)/100)*((v-b)/100) AS d FROM k, p) SELECT trace_idx, arg_min(t,(d,t)) AS t, arg_min(v,(d,t)) AS v FROM m WHERE d < 1 GROUP BY r, trace_idx")
def nearest_velocity_pick(spark, d):
    picks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in ((100.0, 1600.0), (300.0, 2000.0), (420.0, 2300.0))])
    h = headers(spark, d).select("trace_idx", V.nearest_pick(picks, F.col("offset"), 1500.0 + F.col("azimuth") * 3).alias("p"))
    return h.where("p IS NOT NULL").select("trace_idx", "p.t", "p.v")


_FN = "f AS (SELECT user_id, list({'t': event_id::DOUBLE, 'v': value} ORDER BY event_id) AS p FROM events GROUP BY user_id)"


@query(f"WITH {_FN}, q AS (SELECT user_id, p, (p[1].t+p[len(p)].t)/2+0.25e0 AS t FROM f), r AS (SELECT *, len([z FOR z IN p IF z.t <= t]) AS k FROM q) SELECT user_id, round(CASE WHEN k>=len(p) THEN p[len(p)].v WHEN k=0 THEN p[1].v ELSE p[k].v+(p[k+1].v-p[k].v)*(t-p[k].t)/(p[k+1].t-p[k].t) END,5) AS v FROM r")
def velocity_from_picks(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.struct(F.col("event_id").cast("double").alias("t"), F.col("value").alias("v")).alias("p"))
    own = events.groupBy("user_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    middle = (F.get("p", F.lit(0))["t"] + F.get("p", F.size("p") - 1)["t"]) / 2 + 0.25
    return own.select("user_id", F.round(V.velocity_at(F.col("p"), middle), 5).alias("v"))


@query("WITH {traces} SELECT trace_idx, CAST(i AS BIGINT) AS i, round(CAST(samples[i+1] AS DOUBLE),6) AS v FROM (SELECT trace_idx, samples, unnest(range(64)) AS i FROM traces) WHERE i % 6 = 0 OR i = 63")
def grid_to_sparse_picks(spark, d):
    t = traces(spark, d).select("trace_idx", F.explode(V.sparse_picks(F.col("samples"), 10)).alias("p"))
    return r6(t.select("trace_idx", F.col("p.i").cast("long").alias("i"), F.col("p.v").cast("double").alias("v")), "v")


@query("WITH {headers}, p AS (SELECT i AS loc, i*400.0e0 AS x, i*300.0e0 AS y FROM range(6) t(i)) SELECT loc, round(avg(mx),6) AS mx, round(avg(my),6) AS my, count(*) AS n FROM headers JOIN p ON mx BETWEEN x-125 AND x+125 AND my BETWEEN y-125 AND y+125 GROUP BY loc")
def location_means(spark, d):
    boxes = spark.range(6).select(F.col("id").alias("loc"), *[(F.col("id") * at + s).alias(n) for at, s, n in ((400.0, -125.0, "x0"), (400.0, 125.0, "x1"), (300.0, -125.0, "y0"), (300.0, 125.0, "y1"))])
    return r6(J.rectangle_join(headers(spark, d), boxes, 250.0).groupBy("loc").agg(F.avg("mx").alias("mx"), F.avg("my").alias("my"), F.count(F.lit(1)).alias("n")), "mx", "my")


@query("WITH {headers}, b(bin_id,low,high) AS (VALUES (0,CAST(NULL AS DOUBLE),100.0e0),(1,100.0e0,CAST(NULL AS DOUBLE)),(2,CAST(NULL AS DOUBLE),CAST(NULL AS DOUBLE))) SELECT CAST(bin_id AS BIGINT) AS bin_id, count(*) AS n FROM headers JOIN b ON (low IS NULL OR \"offset\" >= low) AND (high IS NULL OR \"offset\" <= high) GROUP BY ALL")
def gather_bin_join_open(spark, d):
    bins = literal_table(spark, "bin_id, low, high", [(0, None, 100.0), (1, 100.0, None), (2, None, None)]).selectExpr("bin_id", "cast(low as double) low", "cast(high as double) high")
    return J.interval_join(headers(spark, d), bins, F.col("offset"), "low", "high", 100.0).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {headers} SELECT trace_idx, round(((ln((2300.0e0+sqrt(2300.0e0*2300.0e0+0.25e0*\"offset\"*\"offset\"))/(1800.0e0+sqrt(1800.0e0*1800.0e0+0.25e0*\"offset\"*\"offset\")))/0.5e0)),6) AS curved, round(azimuth/1000+0.05e0,6) AS epsilon FROM headers")
def one_way_curved_time(spark, d):
    t = T.curved_ray(F.col("offset"), F.lit(1000.0), 1800.0, 0.5)
    return r6(headers(spark, d).select("trace_idx", t.alias("curved"), T.eta_to_thomsen(F.col("azimuth") / 1000)[0].alias("epsilon")), "curved", "epsilon")
