"""Order-dependent folds: a scan over rows sorted within their group, with a state that starts anew in each.

Rows of a group come in order to one task and stream through it; no group is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: list[str], order: list, inputs: list[str], step: Callable, added: str) -> DataFrame:
    """Adds columns (`added`, a schema string) that `step(state, *inputs) -> (state, *values)` gives row by row.

    `state` is None at the first row of a group. Only `inputs` are turned into Python values.
    """
    names = df.columns
    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    new = sorted_.sparkSession.createDataFrame([], added).schema
    arrow = [(f.name, _arrow(f.dataType.simpleString())) for f in new.fields]

    def run(batches):
        last, state = object(), None
        for batch in batches:
            out = [[] for _ in arrow]
            groups = zip(*[batch.column(k).to_pylist() for k in keys])
            for group, values in zip(groups, zip(*[batch.column(c).to_pylist() for c in inputs])):
                if group != last:
                    last, state = group, None
                state, *results = step(state, *values)
                for o, r in zip(out, results):
                    o.append(r)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(o, kind) for o, (_, kind) in zip(out, arrow)]], names=[*names, *[n for n, _ in arrow]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields) + ", " + added
    return sorted_.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind]


def _near_last_kept(state, y, x):
    drop = state is not None and state[0] == y and abs(x - state[1]) < 2.0
    return (state if drop else (y, x)), not drop


def dedup_overlapping(spans: DataFrame, keys=("doc_id", "page"), order=None) -> DataFrame:
    """Drops a span on the rounded line of the last kept one and less than 2 to its side."""
    rows = spans.withColumn("__y", F.round("y").cast("long")).withColumn("__x", F.col("x").cast("double"))
    order = order or [F.col("__y").desc(), "__x", "sequence"]
    return fold(rows, list(keys), order, ["__y", "__x"], _near_last_kept, "__keep boolean").where("__keep").drop("__y", "__x", "__keep")


def _starts_group(tolerance_y, low, high):
    def step(state, y, x, width):
        joins = state is not None and abs(y - state[0]) < tolerance_y and low <= x - state[1] < high
        number = 0 if state is None else state[2] + (not joins)
        gap = None if not joins else x - state[1]
        return (state[0] if joins else y, x + width, number), number, gap

    return step


def merge_groups(spans: DataFrame, keys=("doc_id", "page"), *, tolerance_y=1.0, low=-0.5, high=3.0, order=None) -> DataFrame:
    """Adds group_no and gap (null at a group's first span): y against the group's first, x against its last."""
    rows = spans.withColumn("__d", F.array(F.col("y").cast("double"), F.col("x").cast("double"), F.col("width").cast("double")))
    rows = rows.select(*spans.columns, F.col("__d")[0].alias("__y"), F.col("__d")[1].alias("__x"), F.col("__d")[2].alias("__w"))
    order = order or [F.round("y").desc(), "__x", "sequence"]
    return fold(rows, list(keys), order, ["__y", "__x", "__w"], _starts_group(tolerance_y, low, high), "group_no bigint, gap double").drop("__y", "__x", "__w")


def thin_rules(rules: DataFrame, keys=("doc_id", "page"), apart: float = 10.0) -> DataFrame:
    """Keeps a horizontal rule if it is more than `apart` from the last kept one."""

    def step(state, y):
        keep = state is None or abs(y - state) > apart
        return (y if keep else state), keep

    rows = rules.withColumn("__y", F.col("y").cast("double"))
    return fold(rows, list(keys), [F.desc("__y")], ["__y"], step, "__keep boolean").where("__keep").drop("__y", "__keep")
