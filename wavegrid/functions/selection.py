"""Trace selection: predicates as Columns, and user expressions compiled to Columns."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Range = tuple[float | None, float | None]


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Closed interval, open-ended where None."""
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low)
    return out if high is None else out & (value <= high)


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def offset_ranges(offset: Column, ranges: list[Range], *, absolute: bool = True, exclude: bool = False, include_negative: bool = True) -> Column:
    """In any of the ranges, or in none; without absolute values negative offsets may be shut out."""
    value = F.abs(offset) if absolute else offset
    found = any_of([within(value, *r) for r in ranges]) if ranges else F.lit(True)
    found = ~found if exclude else found
    return found if absolute or include_negative else found & (offset >= 0)


def azimuth_range(azimuth: Column, low: float, high: float) -> Column:
    """Closed, over north when low is above high."""
    return azimuth.between(low, high) if low <= high else (azimuth >= low) | (azimuth <= high)


def azimuth_sectors(offset: Column, azimuth: Column, sectors: list[tuple[float, float, float | None, float | None]]) -> Column:
    """Any of (azimuth from, to, least offset, most offset); no sector means all."""
    if not sectors:
        return F.lit(True)
    a = F.pmod(azimuth, F.lit(360.0))
    return any_of([azimuth_range(a, lo, hi) & within(F.abs(offset), near, far) for lo, hi, near, far in sectors])


def offset_vector(ox: Column, oy: Column, x: Range = (None, None), y: Range = (None, None), quadrants: tuple[str, ...] = ()) -> Column:
    """Signed offset components in closed ranges and in any of the quadrants NE, SE, SW, NW (0 counts as positive)."""
    signs = {"NE": (ox >= 0) & (oy >= 0), "SE": (ox >= 0) & (oy < 0), "SW": (ox < 0) & (oy < 0), "NW": (ox < 0) & (oy >= 0)}
    found = within(ox, *x) & within(oy, *y)
    return found & any_of([signs[q] for q in quadrants]) if quadrants else found


def regular_tile(component: Column, size: float) -> Column:
    return F.floor(component / size).cast("long")


def irregular_tile(component: Column, edges: list[float]) -> Column:
    """Number of the half-open interval between edges; -1 outside, the top edge too."""
    passed = sum(((component >= e).cast("long") for e in edges[1:]), (component >= edges[0]).cast("long"))
    return F.when((component < edges[0]) | (component >= edges[-1]), F.lit(-1).cast("long")).otherwise(passed - 1)


def near(offset: Column) -> Column:
    return F.abs(offset) <= 1500.0


def far(offset: Column) -> Column:
    return F.abs(offset) >= 2500.0


# Sectors of the presets.
NORTH_SOUTH = [(0.0, 45.0, None, None), (315.0, 360.0, None, None), (135.0, 225.0, None, None)]
EAST_WEST = [(45.0, 135.0, None, None), (225.0, 315.0, None, None)]

# Named expressions for compile_expression.
EXPRESSIONS = {
    "near_offsets": "offset < 1500",
    "far_offsets": "offset > 2500",
    "mid_offsets": "(offset >= 1000) and (offset <= 3000)",
    "ns_azimuths": "(azimuth < 45) or (azimuth > 315)",
    "ew_azimuths": "(azimuth >= 45) and (azimuth <= 135)",
    "quadrant_1_ne": "(offset_x > 0) and (offset_y > 0)",
    "quadrant_2_nw": "(offset_x < 0) and (offset_y > 0)",
    "quadrant_3_sw": "(offset_x < 0) and (offset_y < 0)",
    "quadrant_4_se": "(offset_x > 0) and (offset_y < 0)",
    "positive_offset_x": "offset_x > 0",
    "negative_offset_x": "offset_x < 0",
}

_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil, "log": F.log, "log10": F.log10, "exp": F.exp,
    "round": F.rint, "min": F.least, "max": F.greatest, "mod": lambda a, b: F.pmod(a, b),
}
_BINARY = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Pow: "__pow__"}
_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def compile_expression(text: str, columns: list[str]) -> Column:
    """A boolean Column of a Python-like expression over ``columns``; anything but arithmetic, comparison, logic and the
    functions above is refused. Nothing is ever evaluated in Python."""

    def of(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return of(body)
            case ast.Constant(value=v) if isinstance(v, (int, float, bool)):
                return F.lit(v if isinstance(v, bool) else float(v))
            case ast.Name(id=name) if name in columns:
                return F.col(name)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~of(x)
            case ast.BinOp(op=ast.BitAnd(), left=a, right=b):
                return of(a) & of(b)
            case ast.BinOp(op=ast.BitOr(), left=a, right=b):
                return of(a) | of(b)
            case ast.BinOp(op=ast.Mod(), left=a, right=b):
                return F.pmod(of(a), of(b))
            case ast.BinOp(op=op, left=a, right=b) if type(op) in _BINARY:
                return getattr(of(a), _BINARY[type(op)])(of(b))
            case ast.BoolOp(op=op, values=values):
                out = of(values[0])
                for v in values[1:]:
                    out = out & of(v) if isinstance(op, ast.And) else out | of(v)
                return out
            case ast.Compare(left=left, ops=ops, comparators=rest):
                out, a = None, of(left)
                for op, b in zip(ops, map(of, rest), strict=True):
                    if type(op) not in _COMPARE:
                        break
                    step = getattr(a, _COMPARE[type(op)])(b)
                    out, a = step if out is None else out & step, b
                else:
                    return out
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _FUNCTIONS:
                return _FUNCTIONS[name](*map(of, args))
        raise ValueError(f"not allowed in a selection: {ast.unparse(node) if isinstance(node, ast.expr) else type(node).__name__}")

    return of(ast.parse(text, mode="eval"))


def selection_statistics(df: DataFrame, chosen: Column) -> DataFrame:
    """Rows in all and selected, their share in percent, and a warning for none or under 10 %."""
    counted = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(chosen).alias("n_selected"))
    share = F.when(F.col("n_total") > 0, 100.0 * F.col("n_selected") / F.col("n_total")).otherwise(0.0)
    return counted.withColumn("percent", share).withColumn("warning", F.when(F.col("n_selected") == 0, "none").when(F.col("percent") < 10.0, "few").otherwise(""))


def combined(parts: list[Column], how: str = "and") -> Column:
    """All conditions, or any of them with ``or``; without a condition every row is selected."""
    out = None
    for c in parts:
        out = c if out is None else (out & c if how == "and" else out | c)
    return F.lit(True) if out is None else out


def tiles(spark: SparkSession, x: list[float], y: list[float]) -> DataFrame:
    """(i, j, x0, x1, y0, y1): every pair of neighbouring edges of one axis with every one of the other."""
    nx, ny = len(x) - 1, len(y) - 1
    at = lambda edges, k: F.get(F.array(*map(F.lit, edges)), k.cast("int"))
    i, j = F.floor(F.col("id") / max(ny, 1)), F.col("id") % max(ny, 1)
    return spark.range(max(nx, 0) * max(ny, 0)).select(i.alias("i"), j.alias("j"), at(x, i).alias("x0"), at(x, i + 1).alias("x1"), at(y, j).alias("y0"), at(y, j + 1).alias("y1"))
