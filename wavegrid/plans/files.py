"""Queries that write files of other formats and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavegrid.plans.registry import query
from wavegrid.plans.volumes import _folder
from wavegrid.sources import arraystore, segy
from wavegrid.sources.survey import headers, traces
from wavegrid.streaming import resume

_AS_TRACES = ["trace_idx % 50 AS il", "trace_idx div 50 AS xl", "shot_id AS field_record", "trace_idx AS cdp", "`offset` AS offset", "mx AS cdp_x", "my AS cdp_y", "sx", "sy"]


def _written(spark, d, samples, **options):
    home = _folder(spark)
    segy.write(traces(spark, d).selectExpr(*_AS_TRACES, f"transform(samples, v -> cast({samples} AS float)) AS samples"), home, 8.0, **options)
    return home


@query("WITH {traces} SELECT trace_idx AS cdp, trace_idx%50 AS il, trace_idx//50 AS xl, shot_id AS field_record, round(round(mx*100)/100,2) AS cdp_x, round(round(sy*100)/100,2) AS sy, 8000::BIGINT AS dt_us, len(samples) AS n, round(list_sum([CAST(CAST(x AS FLOAT) AS DOUBLE) FOR x IN samples]),5) AS total FROM traces")
def segy_ieee_round_trip(spark, d):
    found = segy.read(spark, _written(spark, d, "v"))
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))
    whole = [F.col(c).cast("long").alias(c) for c in ("cdp", "il", "xl", "field_record", "dt_us")]
    return found.select(*whole, F.round("cdp_x", 2).alias("cdp_x"), F.round("sy", 2).alias("sy"), F.size("samples").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("WITH {traces}, u AS (SELECT trace_idx, unnest(range(64)) AS it, unnest(samples) AS v FROM traces) SELECT trace_idx%50 AS il, trace_idx//50 AS xl, it, floor(CAST(v AS DOUBLE)*1000) AS v FROM u")
def segy_ibm_samples(spark, d):
    """Whole numbers, which both number formats hold exactly; inline and crossline are read by their bytes."""
    found = segy.read(spark, _written(spark, d, "floor(cast(v AS double) * 1000)", samples_as="ibm"), field_record=189, offset=193)
    return found.select(F.col("field_record").cast("long").alias("il"), F.col("offset").cast("long").alias("xl"), F.posexplode("samples").alias("it", "v")).withColumns({"it": F.col("it").cast("long"), "v": F.col("v").cast("double")})


@query("WITH {traces}, u AS (SELECT trace_idx%50 AS il, trace_idx//100 AS xl, unnest(range(64)) AS it, unnest(samples) AS v FROM traces), m AS (SELECT il, xl, it, avg(CASE WHEN v > 0 THEN CAST(v AS DOUBLE) END) AS v FROM u GROUP BY ALL) SELECT il, xl, 8.0::DOUBLE AS dt_ms, count(*) AS n, count(v) AS known, round(sum(v),5) AS total FROM m GROUP BY il, xl")
def segy_velocity_nodes(spark, d):
    home = _folder(spark)
    rows = traces(spark, d).selectExpr("trace_idx % 50 AS il", "trace_idx div 100 AS xl", "samples")
    segy.write(rows, home, 8.0)
    nodes = segy.velocity_nodes(segy.read(spark, home))
    known = F.filter("velocity", lambda v: v.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v))
    return nodes.select(F.col("il").cast("long").alias("il"), F.col("xl").cast("long").alias("xl"), "dt_ms", F.size("velocity").cast("long").alias("n"), F.size(known).cast("long").alias("known"), F.round(total, 5).alias("total"))


@query("WITH {headers}, c AS (SELECT CAST(floor(mx/100) AS BIGINT) AS cx, CAST(floor(my/100) AS BIGINT) AS cy, count(*) AS fold FROM headers GROUP BY ALL) SELECT CAST(floor(cx/8.0e0) AS BIGINT)||'_'||CAST(floor(cy/8.0e0) AS BIGINT) AS tile, cx, cy, fold FROM c")
def resumed_fold(spark, d):
    """A fold map from files that come in two parts: the run stops after the first, one batch is repeated, and a second run goes on."""
    home, schema = _folder(spark), "tile string, cx long, cy long, fold long"
    rows = headers(spark, d).select("trace_idx", "mx", "my")
    own = F.pmod(F.xxhash64("trace_idx"), F.lit(4))
    run = resume.Run(spark, f"{home}/run", {"cell": 100.0}, 16)
    partial = lambda batch: resume.fold_of_tiles(batch, 100.0, 8)
    for part in (own < 2, own >= 2):
        rows.where(part).repartition(2).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
        resume.accumulate(stream, run, partial).awaitTermination()
        first = run.committed()[0]
        run.commit(run.rows(schema).where(F.col("batch") == first).drop("batch").checkpoint(), first)
    return run.total(["cx", "cy"], ["fold"], schema)


@query("WITH {traces} SELECT trace_idx AS trace_no, len(samples) AS n, round(list_sum([CAST(CAST(x AS FLOAT) AS DOUBLE) FOR x IN samples]),5) AS total FROM traces WHERE trace_idx BETWEEN 20 AND 59 OR trace_idx IN (3, 77)")
def array_store_traces(spark, d):
    """Traces of two chunked stores, a trace a row and a sample a row, of which filters open a few chunks."""
    rows = traces(spark, d).select(F.col("trace_idx").alias("trace_no"), "samples")
    n = rows.agg(F.max("trace_no")).first()[0] + 1
    home = _folder(spark)
    arraystore.write(rows, f"{home}/rows", n, 64, 16, 24)
    arraystore.write(rows, f"{home}/columns", n, 64, 10, 64, trace_axis=1, codec=None)
    held = arraystore.read(spark, f"{home}/rows").where("trace_no >= 20 AND trace_no < 60")
    held = held.union(arraystore.read(spark, f"{home}/columns", 1).where("trace_no IN (3, 77)"))
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return held.select("trace_no", F.size("samples").cast("long").alias("n"), F.round(total, 5).alias("total"))
