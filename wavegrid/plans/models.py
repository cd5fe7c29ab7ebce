"""Queries on velocity models, guards and sampling rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegrid.functions import guards as U
from wavegrid.operators import cubes
from wavegrid.plans.headers import r6
from wavegrid.plans.registry import query
from wavegrid.sources.survey import headers

AXES = cubes.Axis(0.0, 500.0, 5), cubes.Axis(0.0, 400.0, 6), cubes.Axis(0.0, 0.25, 9)
_VALUE = "(1500 + 90 * {i} + 35 * {j} + 210 * {k} + (({i} * {j} + {k}) % 7) * 13)"


def _cube(spark):
    """Pillars with made-up velocities."""
    x, y, t = AXES
    value = F.expr(f"transform(sequence(0, {t.n - 1}), k -> cast({_VALUE.format(i='ix', j='iy', k='k')} AS double))")
    return spark.range(x.n * y.n).select((F.col("id") % x.n).alias("ix"), F.floor(F.col("id") / x.n).alias("iy")).withColumn("v", value)


def _points(spark, d):
    """Receivers, scaled so that no value lies halfway between two roundings, where engines may differ."""
    return headers(spark, d).select("trace_idx", (F.col("rx") * F.sqrt(F.lit(0.99))).alias("x"), (F.col("ry") * F.sqrt(F.lit(1.01))).alias("y"), (F.col("offset") / 300.0).alias("t"))


_CORNER = _VALUE.format(i="(i+di)", j="(j+dj)", k="(k+dk)")


@query(f"""WITH {{headers}}, p AS (SELECT row_number() OVER () AS r, trace_idx, greatest(0,least(2000,rx*sqrt(0.99e0)))/500.0e0 AS a, greatest(0,least(2000,ry*sqrt(1.01e0)))/400.0e0 AS b, greatest(0,least(2,"offset"/300.0e0))/0.25e0 AS c FROM headers),
    q AS (SELECT *, CAST(least(floor(a),3) AS BIGINT) AS i, CAST(least(floor(b),4) AS BIGINT) AS j, CAST(least(floor(c),7) AS BIGINT) AS k FROM p),
    e AS (SELECT r, trace_idx, (CASE WHEN di=1 THEN a-i ELSE 1-(a-i) END)*(CASE WHEN dj=1 THEN b-j ELSE 1-(b-j) END)*(CASE WHEN dk=1 THEN c-k ELSE 1-(c-k) END)*{_CORNER} AS part
          FROM q, range(2) x(di), range(2) y(dj), range(2) z(dk))
    SELECT trace_idx, round(sum(part),4) AS velocity FROM e GROUP BY r, trace_idx""")
def velocity_cube_trilinear(spark, d):
    found = cubes.at_points(_points(spark, d), _cube(spark), *AXES)
    return found.select("trace_idx", F.round("velocity", 4).alias("velocity"))


@query("""WITH {headers} SELECT trace_idx, round(CASE WHEN azimuth <> 0 THEN "offset"/azimuth ELSE -1 END,6) AS quotient, round(sqrt(greatest(sx-sy,4)),6) AS root,
    "offset"/20.0e0 <= 20 AS time_ok, round(least("offset"/20.0e0,20),6) AS time, sx/50.0e0 >= 0 AND sx/50.0e0 < 31 AS sample_ok, round(least(greatest((sx-100)/50.0e0,0),31-1e-6),6) AS clamped,
    (sx-100)/50.0e0 >= -1 AND (sx-100)/50.0e0 < 32 AS near_ok FROM headers""")
def guard_functions(spark, d):
    o, x, n = F.col("offset"), F.col("sx"), F.lit(32.0)
    time = U.checked_time(o / 20.0)
    near = (x - 100.0) / 50.0
    found = headers(spark, d).select(
        "trace_idx", U.safe_divide(o, F.col("azimuth"), -1.0).alias("quotient"), U.safe_sqrt(x - F.col("sy"), 4.0).alias("root"), time["valid"].alias("time_ok"), time["time"].alias("time"),
        U.checked_sample(x / 50.0, n, "skip")["valid"].alias("sample_ok"), U.checked_sample(near, n, "clamp")["sample"].alias("clamped"), U.checked_sample(near, n, "extrapolate")["valid"].alias("near_ok"),
    )
    return r6(found, "quotient", "root", "time", "clamped")


@query("""WITH {headers}, f AS (SELECT trace_idx, 5.0e0+"offset"*0.25e0 AS hz FROM headers), n AS (SELECT *, greatest(CAST(floor(1000.0e0/(2.0e0*hz)/2.0e0) AS BIGINT),1) AS m FROM f),
    p AS (SELECT *, CAST(pow(2,length(bin(m))-1) AS BIGINT) AS low FROM n) SELECT trace_idx, round(hz,6) AS hz, CAST(least(8, CASE WHEN m-low > 2*low-m THEN 2*low ELSE low END) AS BIGINT) AS factor FROM p""")
def downsampling_by_frequency(spark, d):
    rows = headers(spark, d).select("trace_idx", (5.0 + F.col("offset") * 0.25).alias("hz"))
    return r6(rows.withColumn("factor", U.downsampling(F.col("hz"), 2.0)), "hz")


@query("""WITH r AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 2 AS f FROM events), g AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR f IS DISTINCT FROM lag(f) OVER w THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    h AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS run FROM g)
    SELECT user_id, run, f, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM h GROUP BY user_id, run, f""")
def time_windows_of_equal_factor(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", (F.floor("value") % 2).alias("f"))
    return cubes.runs(events, ["user_id"], "event_id", "f")


@query("""WITH {headers}, s AS (SELECT trace_idx, "offset"/4-10 AS raw FROM headers), b AS (SELECT trace_idx, raw, list_sort([{'off': abs(z-raw), 's': z} FOR z IN [6.25e0,12.5e0,18.75e0,25.0e0,37.5e0,50.0e0,75.0e0,100.0e0,125.0e0,150.0e0,200.0e0]])[1].s AS s FROM s)
    SELECT trace_idx, CASE WHEN raw <= 0 THEN 6.25e0 WHEN abs(s-raw)/raw <= 0.15 THEN s ELSE round(raw,2) END AS size FROM b""")
def standard_bin_sizes(spark, d):
    return headers(spark, d).select("trace_idx", U.standard_bin(F.col("offset") / 4 - 10).alias("size"))


@query("""WITH {headers}, e AS (SELECT shot_id, "offset" AS t, 1500.0e0+0.4e0*"offset"+sx/50.0e0 AS v FROM headers WHERE "offset" <= 500),
    l AS (SELECT shot_id, regr_slope(v,t/1000.0e0) AS a, regr_intercept(v,t/1000.0e0) AS b, avg(v) AS m FROM e GROUP BY shot_id)
    SELECT shot_id, round(least(greatest(coalesce(b,m),1000),6000),4) AS v0, round(least(greatest(coalesce(CASE WHEN b>0 THEN 2*a/b ELSE 0 END,0),0),2),6) AS k FROM l""")
def gradient_from_velocities(spark, d):
    rows = headers(spark, d).select("shot_id", F.col("offset").alias("t"), (1500.0 + 0.4 * F.col("offset") + F.col("sx") / 50.0).alias("v"))
    return cubes.fitted_gradient(rows, ["shot_id"], "t", "v").select("shot_id", F.round("v0", 4).alias("v0"), F.round("k", 6).alias("k"))
