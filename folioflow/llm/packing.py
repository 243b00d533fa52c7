"""Best-fit packing of documents into sequences of a fixed length.

Every document is tokenized and cut into full pieces and a rest. Only the number of pieces of
each length (at most `capacity` rows, whatever the corpus) comes to the driver, where the
sequences are planned as patterns with multiplicities: a bin completion branch and bound
over lengths. It fills the bin of the longest remaining piece; fillings that another one
dominates are left out; the waste that a plan may have and still beat the incumbent prunes
the rest; best-fit decreasing gives the incumbent. Then pieces take the places of their length in
the order of a distributed rank, so no task sees more than its share of any length.

Edge cases: a null text and an empty one are one piece holding the end id; repeated rows and null ids are
packed like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import read_table, shuffle_partitions, slices, written
from folioflow.llm.tokens import default_tokenizer, encoder, with_end

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents tokenized and cut, one pass over the texts."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                ids, offsets = with_end(*encoder(path).encode(part.column("text")), end_id)
                n = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(capacity, np.diff(offsets)[row] - start)
                raw, begin = ids.astype("<u4"), offsets[row] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan -----------------------------------------------------------------------------------


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, multiplicity): each piece, longest first, into the fullest bin it fits, many at a time."""
    open_: dict[int, list[list]] = {}  # room left -> [[pattern, bins], ...]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], bins: int) -> None:
        if bins:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([pattern, bins])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                fit = capacity // size
                bins, rest = divmod(left, fit)
                put(capacity - fit * size, (size,) * fit, bins)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[k]
            pattern, bins = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            fit = min(room // size, left)
            use = min(bins, left // fit)
            put(room, pattern, bins - use)
            put(room - fit * size, pattern + (size,) * fit, use)
            left -= fit * use
    return [(p, n) for room in rooms for p, n in open_[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of total length over capacity and Martello and Toth's bound L2."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        big = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if capacity - k >= s and 2 * s > capacity]
        small = sum(s * n for s, n in counts.items() if k <= s and 2 * s <= capacity)
        free = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - free) // capacity)))
    return best


def completions(room: int, sizes: list[int], counts: dict[int, int], most: int, effort: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room`, the fullest first: none of them can have a piece added or replaced by
    a longer unused one that fits. `effort` bounds the search, `most` the list."""
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def dominated(chosen: tuple[int, ...], left: int) -> bool:
        used: dict[int, int] = {}
        for s in chosen:
            used[s] = used.get(s, 0) + 1
        for s in {0, *chosen}:  # 0: a piece added
            k = bisect_right(sizes, s + left) - 1
            while k >= 0 and sizes[k] > s:
                if counts[sizes[k]] > used.get(sizes[k], 0):
                    return True
                k -= 1
        return False

    def extend(chosen: tuple[int, ...], left: int, k: int) -> bool:
        """True when nothing more is to be found."""
        nonlocal steps
        steps += 1
        if left == 0:
            found.append((0, chosen))
            return len(found) >= most
        if steps > effort:
            return True
        k = min(k, bisect_right(sizes, left) - 1)
        if k < 0:
            if not dominated(chosen, left):
                found.append((left, chosen))
            return len(found) >= most * 8
        tried = 0
        for j in range(k, -1, -1):
            s = sizes[j]
            if chosen.count(s) < counts[s]:
                if extend((*chosen, s), left - s, j):
                    return True
                tried += 1
        if not tried and not dominated(chosen, left):
            found.append((left, chosen))
        return False

    extend((), room, len(sizes) - 1)
    if not found:
        chosen, left = (), room
        for s in reversed(sizes):
            while s <= left and chosen.count(s) < counts[s]:
                chosen, left = (*chosen, s), left - s
        found.append((left, chosen))
    return [c for _, c in sorted(set(found), key=lambda f: (f[0], len(f[1])))[:most]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, *, branches: int = 3, effort: int = 4000, nodes: int = 4_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and multiplicities that hold every piece in as few bins as the search finds.

    `branches`, `effort` and `nodes` bound the search, never the input: what it leaves open
    is packed as the incumbent has it. A run of equal bins is one node of the search.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if not counts:
        return []
    done = [((s,), n) for s, n in counts.items() if s == capacity]
    rest = {s: n for s, n in counts.items() if s < capacity}
    if not rest:
        return done
    best = best_fit_decreasing(rest, capacity)
    bins = sum(n for _, n in best)
    least = lower_bound(rest, capacity)
    total = sum(s * n for s, n in rest.items())
    visited = 0

    def search(rest: dict[int, int], sizes: list[int], chosen: list, used: int, waste: int) -> bool:
        """True when the lower bound is reached or the search is used up."""
        nonlocal best, bins, visited
        if not sizes:
            if used < bins:
                best, bins = list(chosen), used
            return bins == least
        visited += 1
        if visited > nodes:
            return True
        allowed = (bins - 1) * capacity - total  # waste of any plan that beats the incumbent
        largest = sizes[-1]
        rest[largest] -= 1
        pool = sizes if rest[largest] else sizes[:-1]
        fillings = completions(capacity - largest, pool, rest, branches, effort)
        rest[largest] += 1
        for filling in fillings:
            pattern = (largest, *filling)
            need = {s: pattern.count(s) for s in set(pattern)}
            times = min(rest[s] // n for s, n in need.items())
            lost = (capacity - sum(pattern)) * times
            if waste + lost > allowed:
                continue
            for s, n in need.items():
                rest[s] -= n * times
            left = [s for s in sizes if rest[s]]
            chosen.append((pattern, times))
            over = search(rest, left, chosen, used + times, waste + lost)
            chosen.pop()
            for s, n in need.items():
                rest[s] += n * times
            if over:
                return True
        return False

    if bins > least:
        import sys

        deep = sys.getrecursionlimit()
        sys.setrecursionlimit(max(deep, 4 * sum(min(n, 40) for n in rest.values()) + 4 * capacity + 1000))
        try:
            search(dict(rest), sorted(rest), [], 0, 0)
        finally:
            sys.setrecursionlimit(deep)
    return done + best


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length the runs of places its pieces take: rank r of the run from `first` goes to sequence
    `sequence` + (r - first) // per, at `offset` of its place in the pattern."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s in pattern:
            runs.setdefault(s, []).append((at.get(s, 0), sequence, offset, times))
            at[s] = at.get(s, 0) + times
            offset += s
        sequence += times
    return {s: {"first": np.array([r[0] for r in rows], np.int64), "sequence": np.array([r[1] for r in rows], np.int64), "offset": np.array([r[2] for r in rows], np.int64)} for s, rows in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (a written table with doc_id, piece, length) with sequence_id and offset."""
    parts = shuffle_partitions(cut.sparkSession)
    rows = cut.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    # how many pieces of each length each part has; the ranks of the parts follow one another
    by_part = rows.groupBy("__part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("__before", (F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n")).cast("long")).drop("n")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    spots = places(plan(counts, capacity))  # bounded by the patterns, which don't grow with the pieces
    local = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = local.join(before, ["__part", "length"]).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__part", "__before")
    wanted = [f.name for f in cut.schema.fields]

    def assign(batches):
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for s, own in zip(*_groups(size, order)):
                spot = spots[int(s)]
                run = np.searchsorted(spot["first"], rank[own], side="right") - 1
                sequence[own] = spot["sequence"][run] + rank[own] - spot["first"][run]
                offset[own] = spot["offset"][run]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in wanted], pa.array(sequence), pa.array(offset)], names=[*wanted, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema)


def _groups(values: np.ndarray, order: np.ndarray):
    kinds, first = np.unique(values[order], return_index=True)
    return kinds, np.split(order, first[1:])


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
