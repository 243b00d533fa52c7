"""Connected components of characters and words on a page, and lines anchored to their first member.

A page is a group; inside it all is done on arrays. Pairs are formed among neighbours in both coordinates, so that their number
follows that of the rows, not its square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) for each i and all k with low[i] <= k < high[i]."""
    count = np.maximum(high - low, 0)
    left = np.repeat(np.arange(len(low)), count)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count - low, count)


def _rows(across: np.ndarray, band: float) -> np.ndarray:
    """Numbers of bands: values at most `band` apart lie in one band or in two that touch."""
    return np.floor((across - across.min()) / (band * (1 + 1e-9))).astype(np.int64)


def near_pairs(along: np.ndarray, across: np.ndarray, reach: float, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) whose `along` differ by at most `reach`, each once: all of those whose `across` differ by at most `band`, few others."""
    if len(along) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = _rows(across, max(band, 1e-9))
    span = float(along.max() - along.min()) + 2 * reach + 1
    key = (along - along.min()) + row * span
    ranked = np.argsort(key, kind="stable")
    key = key[ranked]
    slack = 1e-9 * (1 + abs(float(key[-1])))
    i, j = _ranges(np.arange(len(key)) + 1, np.searchsorted(key, key + reach + slack, side="right"))
    above = _ranges(np.searchsorted(key, key + span - reach - slack), np.searchsorted(key, key + span + reach + slack, side="right"))
    i, j = ranked[np.concatenate([i, above[0]])], ranked[np.concatenate([j, above[1]])]
    a, b = along[i], along[j]
    near = np.maximum(a, b) <= np.minimum(a, b) + reach
    return i[near], j[near]


def follow_pairs(end: np.ndarray, begin: np.ndarray, across: np.ndarray, low: float, high: float, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i not j, with begin[j] - end[i] between `low` and `high`: all of those whose `across` differ by at most `band`, few others."""
    if len(end) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = _rows(across, band)
    ranked = np.lexsort((begin, row))
    least = min(float(begin.min()), float(end.min()))
    span = max(float(begin.max()), float(end.max())) - least + max(abs(low), abs(high)) + 1
    key, at = (begin - least)[ranked] + row[ranked] * span, (end - least) + row * span
    slack = 1e-9 * (1 + abs(float(key[-1])) + span)
    found = [_ranges(np.searchsorted(key, at + d * span + low - slack), np.searchsorted(key, at + d * span + high + slack, side="right")) for d in (-1, 0, 1)]
    i, j = np.concatenate([f[0] for f in found]), ranked[np.concatenate([f[1] for f in found])]
    return i[i != j], j[i != j]


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the least one of its component over undirected edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def _by_seed(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Clusters grown from the least node not yet taken over directed edges a -> b."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    edge = np.searchsorted(a, np.arange(n + 1))
    out = np.full(n, -1)
    for seed in range(n):
        if out[seed] < 0:
            out[seed], todo = seed, [seed]
            while todo:
                at = todo.pop()
                new = b[edge[at] : edge[at + 1]]
                new = np.unique(new[out[new] < 0])
                out[new] = seed
                todo.extend(new.tolist())
    return out


def char_roots(x, y, w, h, size, eps: float, line_share: float) -> np.ndarray:
    """For each character the first one of its word."""
    cx, cy = x + w / 2, y + h / 2
    i, j = near_pairs(cx, cy, eps, line_share * float(size.max(initial=0.0)))
    dy = np.abs(cy[i] - cy[j])
    there, back = dy < line_share * size[i], dy < line_share * size[j]
    if (there == back).all():
        return least_reachable(len(x), i[there], j[there])
    return _by_seed(len(x), np.concatenate([i[there], j[back]]), np.concatenate([j[there], i[back]]))


def euclid_roots(x, y, w, h, eps: float) -> np.ndarray:
    cx, cy = x + w / 2, y + h / 2
    i, j = near_pairs(cx, cy, eps, eps)
    near = np.hypot(cx[i] - cx[j], cy[i] - cy[j]) <= eps
    return least_reachable(len(x), i[near], j[near])


def word_roots(x, y, w, tolerance: float, most: float) -> np.ndarray:
    """For each word the first one of its line."""
    i, j = follow_pairs(x + w, x, y, -most, most, tolerance)
    near = (np.maximum(y[i], y[j]) <= np.minimum(y[i], y[j]) + tolerance) & (np.abs(x[i] + w[i] - x[j]) < most)
    return least_reachable(len(x), i[near], j[near])


def _clustered(df: DataFrame, keys, columns: list[str], order: list[str], find: Callable, name: str) -> DataFrame:
    """Adds `name`: clusters numbered from 0 by their first member in `order`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        root = find(*[table.column(c).cast(pa.float64()).to_numpy() for c in columns])
        return table.append_column(name, pa.array(np.unique(root, return_inverse=True)[1].astype(np.int32)))

    return df.groupBy(*keys).applyInArrow(run, f"{schema}, {name} int")


def char_clusters(chars: DataFrame, keys=KEYS, eps: float = 8.0, line_share: float = 0.5, eps_column: str | None = None) -> DataFrame:
    """Adds `word`: characters reached from one another where centres are at most `eps` apart across (`eps_column`: the page's own)
    and less than `line_share` of the size of the character reached from apart in height."""

    def find(x, y, w, h, size, *own):
        return char_roots(x, y, w, h, size, float(own[0][0]) if own else eps, line_share)

    order = ["sequence", *(["i"] if "i" in chars.columns else [])]
    return _clustered(chars, keys, ["x", "y", "width", "height", "font_size", *([eps_column] if eps_column else [])], order, find, "word")


def char_clusters_euclid(chars: DataFrame, keys=KEYS, eps: float = 8.0) -> DataFrame:
    """Adds `word`: characters whose centres are at most `eps` apart, and what they connect."""

    def find(x, y, w, h):
        return euclid_roots(x, y, w, h, eps)

    return _clustered(chars, keys, ["x", "y", "width", "height"], ["sequence", *(["i"] if "i" in chars.columns else [])], find, "word")


def word_clusters(words: DataFrame, keys=KEYS, tolerance: float = 5.0, most: float = 50.0) -> DataFrame:
    """Adds `line`: words at most `tolerance` apart in height whose nearest edges are less than `most` apart, and what they connect."""

    def find(x, y, w):
        return word_roots(x, y, w, tolerance, most)

    return _clustered(words, keys, ["x", "y", "width"], ["sequence"], find, "line")


def height_clusters(words: DataFrame, keys=KEYS, tolerance: float = 5.0) -> DataFrame:
    """Adds `line`: words connected by heights at most `tolerance` apart, numbered from the top."""
    from folioflow.operators.cluster import lines_of

    return lines_of(words, keys, tolerance)


def anchored_lines(df: DataFrame, keys=KEYS, tolerance: float = 2.0) -> DataFrame:
    """Adds `line`, from 0, top first: rows less than `tolerance` below the first of their line."""
    names, keys = df.columns, list(keys)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, F.desc("y"), "x", "sequence")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        last, anchor, line = None, 0.0, -1
        for batch in batches:
            n = batch.num_rows
            y = -batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            for k in keys:
                column = batch.column(k)
                same = pa.compute.equal(column.slice(1), column.slice(0, max(n - 1, 0))).fill_null(False).to_numpy(zero_copy_only=False)
                both = pa.compute.and_(column.slice(1).is_null(), column.slice(0, max(n - 1, 0)).is_null()).to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | both)
            first = [batch.column(k)[0].as_py() for k in keys] if n else last
            new[:1] = first != last
            out, at = np.zeros(n, np.int32), 0
            edges = [*np.flatnonzero(new).tolist(), n]
            begin = 0
            for end in edges:
                at = begin
                while at < end:  # one step a line
                    if line < 0 or y[at] - anchor >= tolerance:
                        line, anchor = line + 1, y[at]
                    to = at + int(np.searchsorted(y[at:end], anchor + tolerance, side="left"))
                    while to < end and y[to] - anchor < tolerance:
                        to += 1
                    to = max(to, at + 1)
                    out[at:to] = line
                    at = to
                begin, line = end, -1
            if n:
                last, line = [batch.column(k)[n - 1].as_py() for k in keys], int(out[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out)], names=[*names, "line"])

    return ordered.mapInArrow(run, schema + ", line int")
