"""Exact near-dedup of embeddings: a metric range join over pivot cells.

Vectors of one label and length are compared by cosine in double precision. Cosine c of unit
vectors is the distance sqrt(2 - 2c), so pairs at or above the bound lie within a radius r.
Each vector belongs to the cell of its nearest pivot; if u of cell j lies within r of v of
cell i, then d(v, p_j) <= d(u, p_j) + r <= d(u, p_i) + r <= d(v, p_i) + 2r, so v is copied to the
cells j > i for which that holds, and cells are joined independently: own against own, own
against copies. A cell of more than `BLOCK` vectors is joined block by block, each pair of blocks in
a task of its own. Tasks return a count for each vector and the stars of the local components,
never the pairs; equal vectors are one class, counted with its size.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
those whose label is null, link with nothing; vectors of different lengths never link; rows repeated
with one vec_id are one vector; null ids link with nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import components, read_table, written

COSINE = 0.98
CELL = 2000  # vectors that one pivot is to have
PIVOTS = 32  # of one label, at most
ALL_PIVOTS = 4096  # of all labels; labels beyond them are one cell each, in blocks
BLOCK = 4096


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw): float64 bytes, null where the vector can't link."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            out = []
            values = column.values if isinstance(column, pa.ListArray) else column.flatten()
            flat = values.cast(pa.float64())
            good = ~flat.is_null().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            offsets = column.offsets.to_numpy()
            for k, there in enumerate(column.is_valid().to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                v = flat[a:b]
                fine = there and b > a and good[a:b].all() and np.isfinite(v).all() and v.any()
                # by a power of two, which changes no digit, so that no square over- or underflows
                out.append(np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, raw binary")


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _linked(x: np.ndarray, y: np.ndarray, raw_x: list[bytes], raw_y: list[bytes], cosine: float) -> np.ndarray:
    """Whether each pair reaches the bound; those on its edge are computed again, one by one."""
    s = x @ y.T
    hit = s >= cosine
    for i, j in zip(*np.nonzero(np.abs(s - cosine) < 1e-12)):
        a, b = np.frombuffer(raw_x[i]), np.frombuffer(raw_y[j])
        hit[i, j] = float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))) >= cosine
    return hit


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, most: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept, class_id) of every vector."""
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    rows = written(prepared(vectors), "vectors")
    named = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "raw")).alias("s")).select("vec_id", "s.label", "s.raw")
    able = F.col("label").isNotNull() & F.col("raw").isNotNull()
    classes = written(named.where(able).groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    width = F.length("raw")
    large = classes.groupBy("label", width.alias("width")).agg(F.count("*").alias("n")).where(F.col("n") > cell).orderBy(F.desc("n"), "label", "width").limit(ALL_PIVOTS // most)
    wanted = large.withColumn("pivots", F.least(F.ceil(F.col("n") / cell), F.lit(most)))
    by_hash = Window.partitionBy("label", "width").orderBy(F.xxhash64("rep"), "rep")
    some = classes.withColumn("width", width).withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= most)
    pivots: dict[tuple[str, int], np.ndarray] = {}
    for r in some.join(wanted, ["label", "width"]).where("at <= pivots").groupBy("label", "width").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("p")).collect():
        pivots[r["label"], r["width"]] = _unit([p["raw"] for p in r["p"]])  # ALL_PIVOTS vectors at most

    def assign(batches):
        for batch in batches:
            labels, raws = batch.column("label").to_pylist(), batch.column("raw").to_pylist()
            row, where, own = [], [], []
            groups: dict[tuple[str, int], list[int]] = {}
            for k, key in enumerate(zip(labels, map(len, raws))):
                groups.setdefault(key, []).append(k)
            for key, members in groups.items():
                members = np.array(members)
                if key not in pivots:
                    row.append(members)
                    where.append(np.zeros(len(members), np.int32))
                    own.append(np.ones(len(members), bool))
                    continue
                x = _unit([raws[k] for k in members])
                d = np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots[key].T)))
                home = d.argmin(axis=1)
                near = (d <= d[np.arange(len(d)), home][:, None] + 2 * radius) & (np.arange(d.shape[1])[None, :] >= home[:, None])
                i, j = np.nonzero(near)
                row.append(members[i])
                where.append(j.astype(np.int32))
                own.append(j == home[i])
            take = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(take), pa.array(np.concatenate(where) if where else np.zeros(0, np.int32)), pa.array(np.concatenate(own) if own else np.zeros(0, bool)), batch.column("rep").take(take), batch.column("copies").take(take), batch.column("raw").take(take)],
                names=["label", "cell", "own", "rep", "copies", "raw"],
            )

    def join(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        raw, own, rep = table.column("raw").to_pylist(), table.column("own").to_numpy(), table.column("rep").to_numpy()
        copies, at = table.column("copies").to_numpy(), table.column("block").to_numpy()
        x = _unit(raw)
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        count = np.zeros(len(rep), np.int64)
        root = rep.copy()
        edges = []
        for start in range(0, len(left), 1024):
            part = left[start : start + 1024]
            hit = _linked(x[part], x[right], [raw[k] for k in part], [raw[k] for k in right], cosine)
            hit &= own[part][:, None] | own[right][None, :]  # copies of two other cells meet elsewhere
            if i == j:
                hit &= part[:, None] != right[None, :]
                count[part] += hit @ copies[right]
            else:
                count[part] += hit @ copies[right]
                count[right] += copies[part] @ hit
            a, b = np.nonzero(hit)
            edges.append((part[a].astype(np.int32), right[b].astype(np.int32)))
        a, b = (np.concatenate(e) for e in zip(*edges)) if edges else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        while len(a):  # least ids along the local links
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (root == before).all():
                break
        some = np.flatnonzero(count)
        return pa.table({"rep": rep[some], "n": count[some], "root": root[some]})

    cells = written(classes.mapInArrow(assign, "label string, cell int, own boolean, rep long, copies long, raw binary"), "cells")
    keys = ["label", "width", "cell"]
    placed = cells.withColumn("width", width)
    sizes = placed.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = placed.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "rep", "copies", "raw")
    found = written(met.groupBy(*keys, "i", "j").applyInArrow(join, "rep long, n long, root long"), "near")
    degree = found.groupBy("rep").agg(F.sum("n").alias("others"))
    linked = degree.join(components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep"), "rep")
    members = named.join(classes, ["label", "raw"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    lost = rows.where("vec_id IS NULL").select("vec_id", F.lit(None).cast("long").alias("rep"), F.lit(1).cast("long").alias("copies"))
    component = F.coalesce("component", "rep")
    return (
        members.unionByName(lost)
        .join(linked, "rep", "left")
        .select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.col("rep").alias("class_id"))
    )


def op3_embedding_near_dedup(spark, sf_dir):
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLES: dict[str, str] = {}
