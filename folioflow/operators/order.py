"""Reading orders of spans or blocks. Each adds `rank`, from 0, within the page; `sequence` breaks ties."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")


def _ranked(df: DataFrame, keys, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "sequence")) - 1)


def simple(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rounded y, top first, then x."""
    return _ranked(df, keys, F.round("y").desc(), "x")


def markdown(df: DataFrame, keys=KEYS, *, upward: bool = False) -> DataFrame:
    """Exact y (top first; `upward`: bottom first, as before merging), then x."""
    return _ranked(df, keys, F.asc("y") if upward else F.desc("y"), "x")


def html(df: DataFrame, keys=KEYS, *, y_axis: str = "up", by_x: bool = True) -> DataFrame:
    """Top first in a y-up page; y_axis='down' gives the order of screen coordinates."""
    return _ranked(df, keys, F.desc("y") if y_axis == "up" else F.asc("y"), *(["x"] if by_x else []))


def chars(df: DataFrame, keys=KEYS) -> DataFrame:
    """As simple, with characters whose position isn't finite last."""
    finite = lambda c: F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf"))
    return _ranked(df, keys, finite("y") | finite("x"), F.round("y").desc(), "x")


def span_columns(spans: DataFrame, keys=KEYS, bins: int = 100) -> DataFrame:
    """(keys, col, left, right): columns between wide gaps of a histogram of x extents.

    A gap is a run of bins with at most max(1, a fifth of the mean) spans, wider than 5 % of the extent,
    with text to its right; a column ends where a gap begins.
    """
    keys = list(keys)
    page = spans.groupBy(*keys).agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"))
    page = page.withColumn("step", (F.col("x1") - F.col("x0")) / bins)
    at = lambda v: F.when(F.col("step") > 0, F.floor((v - F.col("x0")) / F.col("step"))).otherwise(0).cast("int")
    placed = spans.select(*keys, "x", "width").join(page, keys)
    hit = placed.select(*keys, F.explode(F.sequence(F.least(at(F.col("x")), F.lit(bins)), F.greatest(F.least(at(F.col("x") + F.col("width")), F.lit(bins - 1)), F.least(at(F.col("x")), F.lit(bins))))).alias("bin"))
    counts = hit.where(F.col("bin") < bins).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w, by_bin = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")
    filled = counts.withColumn("limit", F.greatest(F.lit(1.0), F.sum("n").over(w) / bins * 0.2)).where(F.col("n") > F.col("limit"))
    gaps = filled.withColumn("gap_from", F.coalesce(F.lag("bin").over(by_bin), F.lit(-1)) + 1).where(F.col("bin") > F.col("gap_from"))
    cuts = gaps.join(page, keys).where((F.col("bin") - F.col("gap_from")) * F.col("step") > (F.col("x1") - F.col("x0")) * 0.05).select(*keys, (F.col("x0") + F.col("gap_from") * F.col("step")).alias("cut"))
    listed = page.join(cuts.groupBy(*keys).agg(F.sort_array(F.collect_list("cut")).alias("cuts")), keys, "left")
    edges = F.concat(F.array("x0"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("x1"))
    return listed.withColumn("edges", edges).select(*keys, "edges", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("col", "left")).select(*keys, "col", "left", F.col("edges")[F.col("col") + 1].alias("right"))


def by_columns(spans: DataFrame, keys=KEYS) -> DataFrame:
    """Column by column (the first that holds the centre), each in simple order; adds `col` and `rank`."""
    keys = list(keys)
    columns = span_columns(spans, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col", "left", "right"))).alias("cols"))
    center = F.col("x") + F.col("width") / 2
    held = F.filter("cols", lambda c: (center >= c["left"]) & (center <= c["right"]))
    joined = spans.join(columns, keys).withColumn("col", F.coalesce(F.get(held, F.lit(0))["col"], F.lit(0))).drop("cols")
    return _ranked(joined, keys, "col", F.round("y").desc(), "x")


def precedence(df: DataFrame, keys=KEYS, band: float = 5.0) -> DataFrame:
    """Topological order where a precedes b if it is left of it on its line (|dy| < band) or above it.

    Blocks whose y follow one another within `band` form a run. A run that lies within `band` as a whole is
    ordered by x alone; in a longer one the relation is applied block by block (`_topological`). Ties go by y,
    x and sequence.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("y").desc(), "x", "sequence")
    lines = df.withColumn("__new", F.coalesce(F.lag("y").over(w) - F.col("y") >= band, F.lit(True)).cast("int")).withColumn("__line", F.sum("__new").over(w)).withColumn("__row", F.row_number().over(w))
    run = Window.partitionBy(*keys, "__line")
    lines = lines.drop("__new").withColumn("__long", F.coalesce(F.max("y").over(run) - F.min("y").over(run) >= band, F.lit(False)))
    longer = lines.where("__long").select(*keys, "__line", "__row", "y", "x")
    types = {f.name: f.dataType.simpleString() for f in longer.schema.fields}

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        y, x = (table.column(c).cast(pa.float64()).fill_null(-math.inf).to_numpy() for c in ("y", "x"))
        return table.select([*keys, "__row"]).append_column("__at", pa.array(_topological(y, x, band)))

    placed = longer.groupBy(*keys, "__line").applyInArrow(place, ", ".join(f"`{c}` {types[c]}" for c in (*keys, "__row")) + ", __at long")
    same = [lines[c].eqNullSafe(placed[c]) for c in (*keys, "__row")]
    joined = lines.join(placed, reduce(lambda p, q: p & q, same), "left").select(*[lines[c] for c in df.columns], lines["__line"], "__at")
    return _ranked(joined, keys, "__line", "__at", "x").drop("__line", "__at")


def _topological(y: np.ndarray, x: np.ndarray, band: float) -> np.ndarray:
    """Place of each block (sorted by y, top first): Kahn's order of "left of it within `band`, or above it".

    Where the relation runs in a circle, the leftmost block that nothing is above goes first.
    """
    at, rest = np.zeros(len(y), dtype=np.int64), np.arange(len(y))
    for k in range(len(y)):
        near = rest[: int(np.searchsorted(-y[rest], 2 * band - y[rest[0]]))]  # what can precede a block that nothing is above
        free = near[y[near[0]] - y[near] < band]
        first = ~((x[near] < x[free, None]) & (np.abs(y[near] - y[free, None]) < band)).any(axis=1)
        chosen = free[first.argmax()] if first.any() else free[x[free].argmin()]
        at[chosen] = k
        rest = rest[rest != chosen]
    return at


def two_columns(df: DataFrame, keys=KEYS, page_width: float = 612.0) -> DataFrame:
    """Column then y where at least 30 % of the blocks lie on either side of the middle, else y, x; adds a confidence
    by the variance of y (100, 500, 2000)."""
    w = Window.partitionBy(*keys)
    right = F.col("x") + F.col("width") / 2 >= page_width / 2
    share = F.avg(right.cast("double")).over(w)
    spread = F.var_pop("y").over(w)
    confidence = F.when(spread < 100, 0.9).when(spread < 500, 0.8).when(spread < 2000, 0.7).otherwise(0.6)
    placed = df.withColumn("two_columns", share.between(0.3, 0.7)).withColumn("confidence", confidence)
    return _ranked(placed, keys, F.when(F.col("two_columns"), right.cast("int")).otherwise(0), F.desc("y"), "x")


def adaptive(blocks: DataFrame, keys=KEYS, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """The cheap order for simple pages, column by column for the others; adds `class` by layout complexity."""
    from folioflow.operators.layout import complexity

    kinds = complexity(blocks, keys, page_width, page_height).select(*keys, "class")
    rows = blocks.join(kinds, list(keys))
    hard = by_columns(rows.where("class <> 'Simple'"), keys).drop("col")
    return simple(rows.where("class = 'Simple'"), keys).unionByName(hard)


def by_structure(df: DataFrame, structure: DataFrame, keys=KEYS, *, drop_unlisted: bool = False) -> DataFrame:
    """Spans in the order of the structure tree (keys, mcid, ord); those without a listed mcid follow.

    `drop_unlisted`: those with an mcid that isn't listed go.
    """
    if drop_unlisted:
        df = df.join(structure, [*keys, "mcid"], "left_semi").unionByName(df.where("mcid IS NULL"))
    joined = df.join(structure, [*keys, "mcid"], "left")
    return _ranked(joined, keys, F.coalesce("ord", F.lit((1 << 31) - 1)), F.col("y").desc(), "x").drop("ord")


def top_k(df: DataFrame, by: str | Column, k: int) -> DataFrame:
    return df.orderBy(F.desc(by) if isinstance(by, str) else by).limit(k)
