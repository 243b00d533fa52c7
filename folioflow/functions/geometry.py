"""Rectangles as struct<x, y, width, height>: edges, tests, union; y0 and y1 are the lower and upper y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, width, height) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def from_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return rect(x0, y0, x1 - x0, y1 - y0)


def x1(r: Column) -> Column:
    return r["x"] + r["width"]


def y1(r: Column) -> Column:
    return r["y"] + r["height"]


def center_x(r: Column) -> Column:
    return r["x"] + r["width"] / 2


def center_y(r: Column) -> Column:
    return r["y"] + r["height"] / 2


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < x1(b)) & (x1(a) > b["x"]) & (a["y"] < y1(b)) & (y1(a) > b["y"])


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x"], x1(r)) & y.between(r["y"], y1(r))


def union(a: Column, b: Column) -> Column:
    return from_points(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(x1(a), x1(b)), F.greatest(y1(a), y1(b)))


def union_all(r: Column) -> Column:
    """Aggregate: the least rectangle around all."""
    return from_points(F.min(r["x"]), F.min(r["y"]), F.max(x1(r)), F.max(y1(r)))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def aligned(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < tolerance


def color(r=0.0, g=0.0, b=0.0) -> Column:
    return F.struct(F.lit(r).cast("float").alias("r"), F.lit(g).cast("float").alias("g"), F.lit(b).cast("float").alias("b"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Content stream colours: 1 - min(1, ink (1 - k) + k)."""
    one = lambda ink: 1 - F.least(F.lit(1.0), ink * (1 - k) + k)
    return F.struct(one(c).alias("r"), one(m).alias("g"), one(y).alias("b"))


def significant_rule(x0: Column, y0: Column, x1_: Column, y1_: Column, page_width: Column) -> Column:
    return (F.abs(y1_ - y0) < 1) & (F.abs(x1_ - x0) > 0.3 * page_width)
