"""Trace headers and samples: canonical columns, and a survey view over general tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.functions import geometry as G

# Canonical header columns and the names they commonly have.
ALIASES = {
    "trace_idx": ("trace_idx", "trace_index", "bin_trace_idx"),
    "sx": ("SOU_X", "source_x", "sx"),
    "sy": ("SOU_Y", "source_y", "sy"),
    "rx": ("REC_X", "receiver_x", "rx"),
    "ry": ("REC_Y", "receiver_y", "ry"),
    "offset": ("OFFSET", "offset"),
    "azimuth": ("AZIMUTH", "azimuth"),
    "shot_id": ("FFID", "shot_id"),
}
REQUIRED = ("trace_idx", "sx", "sy", "rx", "ry")


def resolve(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The first alias that the table has."""
    return next((a for a in aliases if a in columns), None)


@dataclass(frozen=True)
class ColumnMapping:
    """Canonical names to the names of a file; what is not given is found by its aliases."""

    names: dict[str, str] = field(default_factory=dict)

    def select(self, df: DataFrame) -> DataFrame:
        """Canonical columns, coordinates as doubles and ids as longs; offset and azimuth are derived where absent."""
        found = {k: self.names.get(k) or resolve(df.columns, v) for k, v in ALIASES.items()}
        if missing := [k for k in REQUIRED if not found[k]]:
            raise ValueError(f"no column for {', '.join(missing)}")
        kind = {"trace_idx": "long", "shot_id": "long"}
        out = df.select(*[F.col(v).cast(kind.get(k, "double")).alias(k) for k, v in found.items() if v])
        if not found["offset"]:
            out = out.withColumn("offset", G.offset())
        if not found["azimuth"]:
            out = out.withColumn("azimuth", G.azimuth())
        return out


def scan_headers(spark: SparkSession, path: str, mapping: ColumnMapping | None = None) -> DataFrame:
    """Lazy scan of header files; filters on stored columns reach the files."""
    return (mapping or ColumnMapping()).select(spark.read.parquet(path))


def offset_filtered(headers: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Closed interval; an open end where None."""
    if low is not None:
        headers = headers.where(F.col("offset") >= low)
    return headers if high is None else headers.where(F.col("offset") <= high)


def by_index(headers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Headers of the ids in ``wanted`` (trace_idx, pos), with pos for their order; unknown ids are left out."""
    return headers.join(wanted, "trace_idx")


def with_scalar(headers: DataFrame, scalar_col: str, columns: tuple[str, ...] = ("sx", "sy", "rx", "ry")) -> DataFrame:
    """Coordinates by the scalar of the row of smallest trace_idx: a multiplier if positive, a divisor if negative."""
    first = headers.agg(F.min_by(scalar_col, "trace_idx").alias("_scalar"))
    out = headers.crossJoin(F.broadcast(first))
    return out.withColumns({c: G.segy_scaled(F.col(c), F.col("_scalar")) for c in columns}).drop("_scalar")


def header_statistics(headers: DataFrame) -> DataFrame:
    """One row of counts and ranges in one pass."""
    mx, my = G.midpoint()
    ranges = {n: c for n, c in (("sx", F.col("sx")), ("sy", F.col("sy")), ("rx", F.col("rx")), ("ry", F.col("ry")), ("mx", mx), ("my", my), ("azimuth", F.col("azimuth")), ("offset", F.col("offset")))}
    limits = [f(c).alias(f"{n}_{at}") for n, c in ranges.items() for f, at in ((F.min, "min"), (F.max, "max"))]
    return headers.agg(F.count(F.lit(1)).alias("n_traces"), F.countDistinct("shot_id").alias("n_shots"), *limits, F.avg("offset").alias("offset_mean"))


# A survey over general tables: SQL text that any engine reads alike.
TRACES = {
    "trace_idx": "vec_id",
    "sx": "CAST((vec_id * 37) % 101 AS DOUBLE) * 25.0e0",
    "sy": "CAST((vec_id * 53) % 97 AS DOUBLE) * 25.0e0",
    "rx": "CAST((vec_id * 37) % 101 + (vec_id * 17) % 41 - 20 AS DOUBLE) * 25.0e0",
    "ry": "CAST((vec_id * 53) % 97 + (vec_id * 29) % 41 - 20 AS DOUBLE) * 25.0e0",
    "shot_id": "CAST(label AS BIGINT)",
    "samples": "embedding",
}
HEADERS = {
    "trace_idx": "l_orderkey * 10 + l_linenumber",
    "sx": "CAST((l_partkey * 37) % 101 AS DOUBLE) * 25.0e0",
    "sy": "CAST((l_suppkey * 53) % 97 AS DOUBLE) * 25.0e0",
    "rx": "CAST((l_partkey * 37) % 101 + (l_orderkey * 17) % 41 - 20 AS DOUBLE) * 25.0e0",
    "ry": "CAST((l_suppkey * 53) % 97 + (l_partkey * 29) % 41 - 20 AS DOUBLE) * 25.0e0",
    "shot_id": "l_suppkey % 50",
}
DT = 0.008


def _view(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


def view_sql(name: str, columns: dict[str, str], table: str) -> str:
    """The view as a WITH clause's part, with offset, azimuth and midpoints."""
    return (
        f"{name}_base AS ({_view(columns, table)}), {name} AS (SELECT *, sqrt((rx-sx)*(rx-sx)+(ry-sy)*(ry-sy)) AS \"offset\", "
        "((degrees(atan2(rx-sx, ry-sy)) % 360.0e0) + 360.0e0) % 360.0e0 AS azimuth, "
        f"(sx+rx)/2.0e0 AS mx, (sy+ry)/2.0e0 AS my FROM {name}_base)"
    )


def _derived(df: DataFrame) -> DataFrame:
    mx, my = G.midpoint()
    return df.withColumns({"offset": G.offset(), "azimuth": G.azimuth(), "mx": mx, "my": my})


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*[f"{e} AS {n}" for n, e in TRACES.items()]))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in HEADERS.items()]))


def grid(spark: SparkSession, nx: int, ny: int, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(ix, iy, x, y) of a rectangular grid, made on the executors."""
    cells = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    return cells.withColumns({"x": x0 + F.col("ix") * dx, "y": y0 + F.col("iy") * dy})


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as VALUES; SQL numbers of Python floats stay doubles."""
    text = lambda v: f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({columns})")


def axis_values(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
