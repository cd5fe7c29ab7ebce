"""Queries on samples: interpolation, travel times, migration, gathers, signals and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegrid.functions import interpolation as I
from wavegrid.functions import signal as X
from wavegrid.functions import traveltime as T
from wavegrid.operators import aggregates as A
from wavegrid.operators import migration as M
from wavegrid.plans.headers import r6
from wavegrid.plans.registry import query
from wavegrid.sources.survey import grid, headers, traces



def _times(spark, n: int = 64, dt: float = 0.008):
    return spark.range(n).select(F.col("id").alias("it"), (F.col("id") * dt).alias("t0"))


def _image_points(spark):
    return grid(spark, 10, 10, 250.0, 250.0)


_GRID = "pts AS (SELECT CAST(i AS BIGINT) AS ix, CAST(j AS BIGINT) AS iy, i*250.0e0 AS x, j*250.0e0 AS y FROM range(10) a(i), range(10) b(j)), tm AS (SELECT CAST(k AS BIGINT) AS it, k*0.008e0 AS t0 FROM range(64) c(k))"
_MET = "met AS (SELECT *, sqrt((mx-x)*(mx-x)+(my-y)*(my-y)) AS dist, (sx-x)*(sx-x)+(sy-y)*(sy-y) AS ds2, (rx-x)*(rx-x)+(ry-y)*(ry-y) AS dr2 FROM traces, pts, tm WHERE (mx-x)*(mx-x)+(my-y)*(my-y) <= 250000.0e0)"


def _migration_sql(time: str, reach: str, v: str = "2000.0e0", weight: str = "t0/t", select: str = "ix, iy, it", final: str = "round(sum(amp),4) AS amp, count(*) AS fold") -> str:
    return f"""WITH {{traces}}, {_GRID}, {_MET},
    a AS (SELECT *, {v} AS v FROM met), b AS (SELECT *, {time} AS t, {reach} AS reach FROM a),
    c AS (SELECT *, t/0.008e0 AS s FROM b WHERE dist <= reach),
    e AS (SELECT *, CAST(floor(s) AS BIGINT) AS i FROM c WHERE s >= 0 AND s < len(samples)-1),
    f AS (SELECT *, (CAST(samples[i+1] AS DOUBLE)*(1-(s-i)) + CAST(samples[i+2] AS DOUBLE)*(s-i))
        * CASE WHEN dist>=reach THEN 0 WHEN dist<=reach*0.9e0 THEN 1 ELSE 0.5e0*(1+cos(pi()*(dist-reach*0.9e0)/(reach-reach*0.9e0))) END * {weight} AS amp FROM e)
    SELECT {select}, {final} FROM f GROUP BY {select}"""


_DSR = "sqrt(t0*t0/4+ds2/(v*v))+sqrt(t0*t0/4+dr2/(v*v))"
_REACH = "least(greatest(v*t0/2*tan(radians(45)),100.0e0),500.0e0)"


def _rounded(df):
    return df.withColumn("amp", F.round("amp", 4))


@query(_migration_sql(_DSR, _REACH))
def migrate_straight_ray(spark, d):
    return _rounded(M.migrate(traces(spark, d), _image_points(spark), _times(spark), M.Options()))


@query(_migration_sql(_DSR, "500.0e0"))
def migrate_constant_aperture(spark, d):
    return _rounded(M.migrate(traces(spark, d), _image_points(spark), _times(spark), M.Options(aperture_mode="constant")))


@query(_migration_sql(_DSR, _REACH, final="round(sum(amp)/count(*),6) AS amp, count(*) AS fold"))
def migrate_normalised(spark, d):
    return r6(M.migrate(traces(spark, d), _image_points(spark), _times(spark), M.Options(), normalise=True), "amp")


@query(_migration_sql(_DSR, _REACH, weight="(t0/t)/(v*t)*1.0e0", final="round(sum(amp),7) AS amp, count(*) AS fold"))
def migrate_with_spreading(spark, d):
    return M.migrate(traces(spark, d), _image_points(spark), _times(spark), M.Options(spreading=True)).withColumn("amp", F.round("amp", 7))


@query(_migration_sql(_DSR, _REACH, v="1800.0e0+500.0e0*t0"))
def migrate_linear_velocity(spark, d):
    return _rounded(M.migrate(traces(spark, d), _image_points(spark), _times(spark), M.Options(velocity=lambda t: T.linear_velocity(1800.0, 500.0, t))))


def _vti_sql(x: str) -> str:
    return f"sqrt(greatest((t0/2)*(t0/2)+{x}/(v*v)-2*0.1e0*{x}*{x}/((v*v)*((t0/2)*(t0/2)*v*v+1.2e0*{x})),0))"


@query(_migration_sql(f"{_vti_sql('ds2')}+{_vti_sql('dr2')}", "500.0e0"))
def migrate_vti(spark, d):
    o = M.Options(aperture_mode="constant", travel_time=lambda t0, s, r, v: T.vti_dsr(t0, s, r, v, 0.1))
    return _rounded(M.migrate(traces(spark, d), _image_points(spark), _times(spark), o))


def _curved_sql(x2: str) -> str:
    z = "(1800.0e0/0.5e0)*(exp(0.5e0*t0/2)-1)"
    return f"ln((1800.0e0+0.5e0*{z}+sqrt((1800.0e0+0.5e0*{z})*(1800.0e0+0.5e0*{z})+0.25e0*{x2}))/(1800.0e0+sqrt(1800.0e0*1800.0e0+0.25e0*{x2})))/0.5e0"


@query(_migration_sql(f"{_curved_sql('ds2')}+{_curved_sql('dr2')}", "500.0e0", weight="CASE WHEN t < 0.001e0 THEN 0 ELSE t0/t END"))
def migrate_curved_ray(spark, d):
    o = M.Options(aperture_mode="constant", travel_time=lambda t0, s, r, v: T.curved_dsr(t0, s, r, 1800.0, 0.5))
    return _rounded(M.migrate(traces(spark, d), _image_points(spark), _times(spark), o))


_CUBIC_PART = "CASE WHEN i>=1 AND i+2<len(samples) THEN samples[i+1]::DOUBLE+0.5e0*(s-i)*(samples[i+2]::DOUBLE-samples[i]::DOUBLE+(s-i)*(2*samples[i]::DOUBLE-5*samples[i+1]::DOUBLE+4*samples[i+2]::DOUBLE-samples[i+3]::DOUBLE+(s-i)*(3*(samples[i+1]::DOUBLE-samples[i+2]::DOUBLE)+samples[i+3]::DOUBLE-samples[i]::DOUBLE))) ELSE"
_SINE = "(dist/sqrt(dist*dist+(v*t0/2)*(v*t0/2)))"
_ALIAS = f"(t0/t)*CASE WHEN {_SINE}<0.01e0 THEN 1 ELSE greatest(0,1-30.0e0/least(v/(100.0e0*least({_SINE},0.999e0)),500)) END"
_LINEAR_PART = "(CAST(samples[i+1] AS DOUBLE)*(1-(s-i)) + CAST(samples[i+2] AS DOUBLE)*(s-i))"


@query(_migration_sql(_DSR, _REACH, weight=_ALIAS).replace(_LINEAR_PART, f"({_CUBIC_PART} {_LINEAR_PART} END)"))
def migrate_antialiased(spark, d):
    return _rounded(M.migrate(traces(spark, d), _image_points(spark), _times(spark), M.Options(dominant_frequency=30.0, method="cubic")))


@query(f"WITH {{traces}}, {_GRID} SELECT ix, iy, count(*) AS fold FROM traces, pts WHERE (mx-x)*(mx-x)+(my-y)*(my-y) <= 250000.0e0 GROUP BY ix, iy")
def aperture_fold(spark, d):
    from wavegrid.operators.joins import radius_join

    return radius_join(traces(spark, d), _image_points(spark), 500.0).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("fold"))


@query("WITH {headers} SELECT trace_idx, round(sqrt(0.25e0+mx*mx/4e6),6) AS hyperbola, round(ln(1+0.5e0*mx/1800)/0.5e0,6) AS t_of_z, round((1800/0.5e0)*(exp(0.5e0*azimuth/360)-1),6) AS z_of_t, round((0.2e0-0.05e0)/1.1e0,6) AS eta FROM headers")
def travel_time_functions(spark, d):
    h = headers(spark, d)
    out = h.select("trace_idx", T.hyperbola(F.lit(0.5), F.col("mx"), F.lit(2000.0)).alias("hyperbola"), T.depth_to_time(F.col("mx"), 1800.0, 0.5).alias("t_of_z"), T.time_to_depth(F.col("azimuth") / 360.0, 1800.0, 0.5).alias("z_of_t"), T.thomsen_to_eta(F.lit(0.2), F.lit(0.05)).alias("eta"))
    return r6(out, "hyperbola", "t_of_z", "z_of_t", "eta")


_TABLE = [(0.0, 1500.0), (90.0, 1800.0), (200.0, 2400.0), (300.0, 2600.0)]


@query("WITH {headers} SELECT trace_idx, round(CASE WHEN azimuth<=0 THEN 1500 WHEN azimuth<=90 THEN 1500+300*azimuth/90 WHEN azimuth<=200 THEN 1800+600*(azimuth-90)/110 WHEN azimuth<=300 THEN 2400+200*(azimuth-200)/100 ELSE 2600 END,6) AS v FROM headers")
def velocity_table_lookup(spark, d):
    return r6(headers(spark, d).select("trace_idx", T.table_lookup(_TABLE, F.col("azimuth")).alias("v")), "v")


_POS = "p AS (SELECT trace_idx, samples, CAST((trace_idx*13)%640 AS DOUBLE)/10.0e0 AS s, len(samples) AS n FROM traces), q AS (SELECT *, CAST(floor(s) AS BIGINT) AS i, s-floor(s) AS f FROM p)"
_LINEAR = "CASE WHEN s<n-1 THEN CAST(samples[i+1] AS DOUBLE)*(1-f)+CAST(samples[i+2] AS DOUBLE)*f ELSE 0 END"


def _sampled(spark, d, method: str):
    t = traces(spark, d).withColumn("s", ((F.col("trace_idx") * 13) % 640).cast("double") / 10.0)
    return r6(t.select("trace_idx", I.interpolate(method, F.col("samples"), F.col("s")).alias("a")), "a")


@query(f"WITH {{traces}}, {_POS} SELECT trace_idx, round({_LINEAR},6) AS a FROM q")
def interpolate_linear(spark, d):
    return _sampled(spark, d, "linear")


@query(f"WITH {{traces}}, {_POS} SELECT trace_idx, round(CASE WHEN floor(s+0.5e0)<n THEN CAST(samples[CAST(floor(s+0.5e0) AS BIGINT)+1] AS DOUBLE) ELSE 0 END,6) AS a FROM q")
def interpolate_nearest(spark, d):
    return _sampled(spark, d, "nearest")


@query(f"WITH {{traces}}, {_POS}, k AS (SELECT *, CAST(samples[i] AS DOUBLE) AS p0, CAST(samples[i+1] AS DOUBLE) AS p1, CAST(samples[i+2] AS DOUBLE) AS p2, CAST(samples[i+3] AS DOUBLE) AS p3 FROM q) SELECT trace_idx, round(CASE WHEN i>=1 AND i+2<n THEN p1+0.5e0*f*(p2-p0+f*(2*p0-5*p1+4*p2-p3+f*(3*(p1-p2)+p3-p0))) ELSE {_LINEAR} END,6) AS a FROM k")
def interpolate_cubic(spark, d):
    return _sampled(spark, d, "cubic")


_SINC = "CASE WHEN abs(x)<1e-8 THEN 1 ELSE sin(pi()*x)/(pi()*x) END"


def _kernel_sql(method: str) -> str:
    """Weights of a window around a sample, normalised; linear where the window leaves the trace."""
    if method.startswith("sinc"):
        half = int(method[4:]) // 2
        first, last, centre, weight = -half, half, "CAST(floor(s+0.5e0) AS BIGINT)", f"({_SINC})*0.5e0*(1+cos(pi()*x/{half}))"
        inside, near = f"c>={half} AND c+{half}<n", f"abs(x)<={half}"
    else:
        half = int(method[7:])
        first, last, centre, weight = 1 - half, half, "i", f"({_SINC})*({_SINC.replace('x)', f'x/{half})')})"
        inside, near = f"c>={half - 1} AND c+{half}<n", f"abs(x)<{half}"
    return f"""WITH {{traces}}, {_POS}, c AS (SELECT *, {centre} AS c FROM q), w AS (SELECT trace_idx, s, c, n, samples, unnest(range({first},{last + 1})) AS k FROM c), x AS (SELECT *, s-(c+k) AS x FROM w WHERE {inside}),
        y AS (SELECT trace_idx, c, CASE WHEN {near} THEN {weight} ELSE 0 END AS w, CAST(samples[c+k+1] AS DOUBLE) AS a FROM x), z AS (SELECT trace_idx, CASE WHEN abs(sum(w))>1e-10 THEN sum(w*a)/sum(w) ELSE 0 END AS a FROM y GROUP BY trace_idx)
        SELECT q.trace_idx, round(CASE WHEN z.trace_idx IS NULL THEN {_LINEAR} ELSE z.a END,6) AS a FROM q LEFT JOIN z USING (trace_idx)"""


def _register_kernels() -> None:
    for method in ("sinc4", "sinc8", "sinc16", "lanczos3", "lanczos5"):

        def run(spark, d, method=method):
            return _sampled(spark, d, method)

        run.__name__ = f"interpolate_{method}"
        query(_kernel_sql(method))(run)


_register_kernels()

_LIST = "list_transform(samples, x -> CAST(x AS DOUBLE))"


def _long(df, name: str):
    """(trace_idx, i, value) of an array column."""
    return r6(df.select("trace_idx", F.posexplode(name).alias("i", "a")).withColumn("i", F.col("i").cast("long")), "a")


_UN = "u AS (SELECT trace_idx, unnest(range(64)) AS i, samples, \"offset\" AS x FROM traces)"


@query(f"WITH {{traces}}, {_UN} SELECT trace_idx, i, round(CAST(samples[least(CAST(floor(sqrt((i*0.008e0)*(i*0.008e0)+x*x/4e6)/0.008e0+1e-9) AS BIGINT),63)+1] AS DOUBLE),6) AS a FROM u")
def nmo_constant_velocity(spark, d):
    return _long(traces(spark, d).withColumn("o", X.nmo_constant(F.col("samples"), F.col("offset"), 2000.0, 0.008)), "o")


@query(f"WITH {{traces}}, {_UN} SELECT trace_idx, i, round(CASE WHEN i*8.0e0 < abs(x)/1500*1000 THEN 0 ELSE CAST(samples[i+1] AS DOUBLE) END,6) AS a FROM u")
def mute_by_velocity(spark, d):
    return _long(traces(spark, d).withColumn("o", X.velocity_mute(F.col("samples"), F.col("offset"), 1500.0, 8.0)), "o")


@query(f"WITH {{traces}}, {_UN}, m AS (SELECT *, CAST(floor((40+abs(x)/2000*1000)/8) AS BIGINT) AS e FROM u) SELECT trace_idx, i, round(CAST(samples[i+1] AS DOUBLE)*CASE WHEN i>=e THEN 1 WHEN i<e-6 THEN 0 ELSE 0.5e0*(1-cos(pi()*(i-e+6)/6)) END,6) AS a FROM m")
def mute_linear_taper(spark, d):
    return _long(traces(spark, d).withColumn("o", X.apply_mute(F.col("samples"), X.mute_linear(F.col("offset"), 2000.0, 40.0), 8.0, 6)), "o")


@query("WITH {traces}, u AS (SELECT trace_idx, unnest(range(64)) AS i, unnest(samples)::DOUBLE AS v FROM traces) SELECT trace_idx, i, round(CASE WHEN w>1e-10 THEN v/w ELSE 0 END,6) AS a FROM (SELECT *, sqrt(avg(v*v) OVER (PARTITION BY trace_idx ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS w FROM u)")
def gain_agc(spark, d):
    return _long(traces(spark, d).withColumn("o", X.agc(F.col("samples"), 5)), "o")


@query("WITH {traces}, r AS (SELECT trace_idx, samples, unnest(range(100)) AS k FROM traces), q AS (SELECT *, k*0.005e0/0.008e0 AS s FROM r) SELECT trace_idx, k AS i, round(CASE WHEN s>=63 THEN CAST(samples[64] AS DOUBLE) ELSE CAST(samples[CAST(floor(s) AS BIGINT)+1] AS DOUBLE)*(1-(s-floor(s)))+CAST(samples[CAST(floor(s) AS BIGINT)+2] AS DOUBLE)*(s-floor(s)) END,6) AS a FROM q")
def resample_linear(spark, d):
    return _long(traces(spark, d).withColumn("o", X.resample(F.col("samples"), 0.008, 0.005, 100)), "o")


# the filter as a circular convolution: its kernel is the inverse transform of the response at 33 frequencies of 64 samples
_RESPONSE = "w AS (SELECT k, k/(64*0.008e0) AS f FROM range(33) t(k)), r AS (SELECT k, 0.25e0*(1-cos(pi()*least(greatest((f-0.0e0)/5,0),1)))*(1-cos(pi()*least(greatest((45.0e0-f)/5,0),1)))*CASE WHEN k IN (0,32) THEN 1 ELSE 2 END AS g FROM w), c AS (SELECT m, sum(g*cos(2*pi()*k*m/64))/64 AS c FROM r, range(64) t(m) GROUP BY m)"


@query(f"WITH {{traces}}, {_RESPONSE}, x AS (SELECT trace_idx, unnest(range(64)) AS j, unnest(samples)::DOUBLE AS x FROM traces), o AS (SELECT trace_idx, (j+m)%64 AS i, sum(x*c) AS a FROM x, c GROUP BY ALL) SELECT trace_idx, CAST(i AS BIGINT) AS i, round(a,6) AS a FROM o")
def filter_band_pass(spark, d):
    return _long(traces(spark, d).withColumn("o", X.band_pass(5.0, 40.0, 0.008)(F.col("samples"))), "o")


@query("WITH {headers}, t AS (SELECT trace_idx, \"offset\"/5000-0.06e0 AS t FROM headers) SELECT trace_idx, round((1-2*power(pi()*30,2)*t*t)*exp(-power(pi()*30,2)*t*t),6) AS a FROM t")
def wavelet_ricker(spark, d):
    return r6(headers(spark, d).select("trace_idx", X.ricker(F.col("offset") / 5000 - 0.06, 30.0).alias("a")), "a")


_EXPLODED = "u AS (SELECT trace_idx, shot_id, \"offset\", unnest(range(64)) AS it, unnest(samples)::DOUBLE AS v FROM traces)"


def _samples_long(spark, d):
    return traces(spark, d).select("trace_idx", "shot_id", "offset", F.posexplode("samples").alias("it", "v")).withColumns({"it": F.col("it").cast("long"), "v": F.col("v").cast("double")})


@query(f"WITH {{traces}}, {_EXPLODED} SELECT shot_id, it, round(avg(v),6) AS stack, count(*) AS fold FROM u GROUP BY ALL")
def stack_mean(spark, d):
    return r6(_samples_long(spark, d).groupBy("shot_id", "it").agg(F.avg("v").alias("stack"), F.count(F.lit(1)).alias("fold")), "stack")


@query(f"WITH {{traces}}, {_EXPLODED}, z AS (SELECT shot_id, it, CASE WHEN v<0 THEN 0 ELSE v END AS v FROM u) SELECT shot_id, it, round(sum(v)/greatest(count(*) FILTER (v<>0),1),6) AS stack, count(*) FILTER (v<>0) AS fold FROM z GROUP BY ALL")
def stack_live_samples(spark, d):
    return r6(A.live_stack(_samples_long(spark, d).withColumn("v", F.when(F.col("v") < 0, 0.0).otherwise(F.col("v"))), ["shot_id", "it"], "v"), "stack")


@query(f"WITH {{traces}}, {_EXPLODED}, w AS (SELECT *, trace_idx%4 AS f FROM u) SELECT shot_id, it, round(CASE WHEN sum(f)>0 THEN sum(v*f)/sum(f) ELSE 0 END,6) AS stack, CAST(sum(f) AS DOUBLE) AS weight FROM w GROUP BY ALL")
def stack_weighted(spark, d):
    return r6(A.weighted_stack(_samples_long(spark, d).withColumn("f", F.col("trace_idx") % 4), ["shot_id", "it"], "v", "f"), "stack")


@query(f"WITH {{traces}}, {_EXPLODED} SELECT CASE WHEN \"offset\"<0 OR \"offset\">=600 THEN -1 ELSE floor(\"offset\"/150) END::BIGINT AS bin, it, round(sum(v),5) AS amp, count(*) AS n FROM u GROUP BY ALL")
def cig_accumulate(spark, d):
    b = A.cig_bin(F.col("offset"), [0.0, 150.0, 300.0, 450.0, 600.0])
    return _samples_long(spark, d).groupBy(b.alias("bin"), "it").agg(F.round(F.sum("v"), 5).alias("amp"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {{traces}}, {_EXPLODED} SELECT shot_id, round(min(v),6) AS amp_min, round(max(v),6) AS amp_max, round(avg(v),6) AS amp_mean, round(stddev_pop(v),6) AS amp_std, round(sqrt(avg(v*v)),6) AS amp_rms, CAST(0 AS BIGINT) AS n_bad, count(*) FILTER (abs(v)<1e-30) AS n_zero FROM u GROUP BY shot_id")
def volume_stats(spark, d):
    return r6(A.volume_statistics(_samples_long(spark, d), "v", "shot_id"), "amp_min", "amp_max", "amp_mean", "amp_std", "amp_rms")


@query(f"WITH {{traces}}, {_EXPLODED} SELECT trace_idx, it, round(v,6) AS v FROM u ORDER BY abs(v) DESC, trace_idx, it LIMIT 1")
def focus_argmax(spark, d):
    return r6(A.strongest(_samples_long(spark, d).select("trace_idx", "it", "v"), "v", ["trace_idx", "it"]), "v")


@query(f"WITH {{traces}}, {_EXPLODED} SELECT it, round(avg(abs(v)),6) AS a FROM u GROUP BY it ORDER BY avg(abs(v)) DESC, it LIMIT 1")
def flat_reflector(spark, d):
    by = _samples_long(spark, d).groupBy("it").agg(F.avg(F.abs("v")).alias("a"))
    return r6(by.agg(F.max_by(F.struct("it", "a"), F.struct("a", -F.col("it"))).alias("r")).select("r.*"), "a")


@query(f"WITH {{traces}}, {_EXPLODED} SELECT it, round(sqrt(avg(v*v)),6) AS rms FROM u GROUP BY it")
def rms_by_time(spark, d):
    return r6(_samples_long(spark, d).groupBy("it").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")), "rms")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (dv < -100) AS inversions FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS dv FROM events) GROUP BY user_id")
def velocity_inversions(spark, d):
    g = A.gradients(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "event_id", "value")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dv") < -100).alias("inversions"))


_VELS = "vs AS (SELECT CAST(k AS BIGINT) AS iv, 1500.0e0+k*250 AS vel FROM range(7) t(k))"


@query(f"""WITH {{traces}}, {_VELS}, u AS (SELECT shot_id, iv, it, sqrt((it*0.008e0)*(it*0.008e0)+"offset"*"offset"/(vel*vel))/0.008e0 AS s, samples FROM traces, vs, (SELECT CAST(k AS BIGINT) AS it FROM range(64) t(k)) i),
    a AS (SELECT shot_id, iv, it, CASE WHEN s<63 THEN CAST(samples[CAST(floor(s) AS BIGINT)+1] AS DOUBLE)*(1-(s-floor(s)))+CAST(samples[CAST(floor(s) AS BIGINT)+2] AS DOUBLE)*(s-floor(s)) ELSE 0 END AS v FROM u),
    b AS (SELECT shot_id, iv, it, sum(v) AS s1, sum(v*v) AS s2, count(*) AS n FROM a GROUP BY ALL),
    w AS (SELECT shot_id, iv, it, n, sum(s1) OVER z AS p, sum(s2) OVER z AS q, count(*) OVER z AS m FROM b WINDOW z AS (PARTITION BY shot_id, iv ORDER BY it ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT shot_id, iv, it, round(CASE WHEN m<5 OR n*m*q<=1e-10 THEN 0 ELSE p*p/(n*m*q) END,5) AS semblance FROM w""")
def semblance_scan(spark, d):
    from wavegrid.operators.velocity import semblance

    return semblance(traces(spark, d), ["shot_id"], [1500.0 + 250.0 * k for k in range(7)], 0.008, 64, 2).withColumn("semblance", F.round("semblance", 5))


def survey_traces(spark, d, every: int = 1):
    """Long traces at the headers of every so many rows of lineitem: the samples of one embedding after the other, 500 of them."""
    h = headers(spark, d).where(F.col("trace_idx") % every == 0)
    e = traces(spark, d).select(F.col("trace_idx").alias("_e"), F.slice(F.flatten(F.array_repeat("samples", 8)), 1, 500).alias("samples"))
    n = e.agg(F.max("_e").alias("_n"))
    return h.crossJoin(F.broadcast(n)).withColumn("_e", F.col("trace_idx") % (F.col("_n") + 1)).join(e, "_e").drop("_e", "_n")


def survey_image(spark, d, every: int):
    """The image of 500 times under 32 x 32 points from those traces, as arrays; the largest aperture is 500 m."""
    points, _ = M.migrate_points(survey_traces(spark, d, every), grid(spark, 32, 32, 75.0, 75.0), _times(spark, 500), M.Options())
    return points
