"""Removal of passages that repeat across documents, by content-defined chunks of lines.

A rolling hash over each two neighbouring lines cuts a text where its value is divisible by
`every`: boundaries depend on the lines beside them alone, so they shift with the text.
Chunks of two lines and more that occur more than once, anywhere, are removed except for
their first occurrence, the one of least (doc_id, line). A passage too short to hold a whole
chunk would slip through; so the rolling hash windows themselves (two lines) count as chunks,
where no repeated chunk covers them, and so does a single line of at least `long_line` words.

Plan: (1) hashes of all units, counted with partial sums; (2) the repeated ones as sorted key
files, by which a second pass picks the bytes of repeated units only; (3) these are
compared, byte by byte, with their first occurrence's; (4) the confirmed lines are joined to
the documents by id and cut out. A hot unit is a hot key in (1), summed before the shuffle, and
in (3), where adaptive execution splits it.

Every removed line has an equal one at a lesser (doc_id, line), so no line's content is lost.

Edge cases: null and empty texts come back as they are; lines are what stands between \\n, empty
ones are never counted or removed; a text all of whose lines go becomes empty (kept false); rows
repeated with one doc_id are one document and keep what it keeps; rows with a null doc_id are
neither compared nor changed; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Sorted, read_table, slices, text_buffers, write_sorted, written
from folioflow.llm.words import _SPACE, lines, mix

EVERY = 4
LONG_LINE = 50

_C = 0x9FB21C651E98DF25
_INVERSE = pow(_C, -1, 1 << 64)


def units(column: pa.Array, every: int = EVERY, long_line: int = LONG_LINE) -> dict[str, np.ndarray]:
    """All units of a column of texts: hash, row, line (number among the row's lines), n (lines), the bytes from
    begin to end, and whether it is a chunk (else a window or a long line)."""
    raw, offsets = text_buffers(column)
    s, e, h, off = lines(raw, offsets)
    count = len(s)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    number = np.arange(count) - off[row] if count else np.zeros(0, np.int64)
    if not count:
        z = np.zeros(0, np.int64)
        return {"hash": z, "row": z, "line": z, "n": z, "begin": z, "end": z, "chunk": np.zeros(0, bool), "raw": raw}
    # words up to each byte, for the words of a line
    gap = _SPACE[raw]
    begins = ~gap
    begins[1:] &= gap[:-1]
    begins[s] |= ~gap[s]
    words = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    long_ = np.flatnonzero(words[e] - words[s] >= long_line)
    # the rolling hash ends at a line and covers the one before it
    pair = np.zeros(count, dtype=bool)
    pair[1:] = row[1:] == row[:-1]
    rolled = np.zeros(count, dtype=np.uint64)
    rolled[1:] = mix(h[:-1] * np.uint64(_C) + h[1:], 31)
    cut = pair & (rolled % np.uint64(every) == 0)
    first = np.flatnonzero(np.concatenate([[True], cut[:-1] | ~pair[1:]]))
    size = np.diff(np.append(first, count))
    first, size = first[size > 2], size[size > 2]  # of two lines: a window
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, _C, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, _INVERSE, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1], dtype=np.uint64)])
    chunk = mix((total[first + size] - total[first]) * down[first] + size.astype(np.uint64), 32)
    window = np.flatnonzero(pair) - 1
    start = np.concatenate([first, window, long_])
    n = np.concatenate([size, np.full(len(window), 2), np.ones(len(long_), np.int64)])
    return {
        "hash": np.concatenate([chunk, rolled[window + 1], mix(h[long_], 33)]).view(np.int64),
        "row": row[start],
        "line": number[start],
        "n": n,
        "begin": s[start],
        "end": e[start + n - 1],
        "chunk": np.arange(len(start)) < len(first),
        "raw": raw,
    }


def repeated_lines(docs: DataFrame, every: int = EVERY, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, line, n): units to cut out, after byte comparison with their first occurrence."""

    def hashes(batches):
        for batch in batches:
            for part in slices(batch):
                u = units(part.column("text"), every, long_line)
                yield pa.RecordBatch.from_arrays([pa.array(u["hash"]), part.column("doc_id").take(pa.array(u["row"])), pa.array(u["line"].astype(np.int32))], names=["k", "doc_id", "line"])

    own = docs.where("doc_id IS NOT NULL")
    seen = own.mapInArrow(hashes, "k long, doc_id long, line int")
    counted = seen.groupBy("k").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "line")).alias("first")).where("c > 1")
    files = write_sorted(counted.select("k", F.col("first.doc_id").alias("doc"), F.col("first.line").cast("long").alias("line")), "repeated", ("doc", "line"))

    def pick(batches):
        known = Sorted(files)
        for batch in batches:
            for part in slices(batch):
                u = units(part.column("text"), every, long_line)
                doc, line = known.values(u["hash"], "doc", "line", absent=-1, kind=np.int64)
                ids = part.column("doc_id").to_numpy()[u["row"]]
                there = line >= 0
                keeper = there & (doc == ids) & (line == u["line"])
                # windows and long lines inside a repeated chunk that goes anyway needn't be compared
                gone = np.flatnonzero(there & u["chunk"] & ~keeper)
                position = u["row"] * (1 << 32) + u["line"]
                order = gone[np.argsort(position[gone], kind="stable")]
                inside = np.searchsorted(position[order], position, side="right") - 1
                covered = (inside >= 0) & ~u["chunk"]
                if len(order):
                    host = order[np.maximum(inside, 0)]
                    covered &= position + u["n"] <= position[host] + u["n"][host]
                    covered &= u["row"] == u["row"][host]
                else:
                    covered[:] = False
                take = np.flatnonzero(there & (keeper | ~covered))
                raw = u["raw"]
                data = [raw[a:b].tobytes() for a, b in zip(u["begin"][take].tolist(), u["end"][take].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u["hash"][take]), pa.array(ids[take]), pa.array(u["line"][take].astype(np.int32)), pa.array(u["n"][take].astype(np.int32)), pa.array(keeper[take]), pa.array(data, pa.binary())],
                    names=["k", "doc_id", "line", "n", "keeper", "bytes"],
                )

    found = written(own.mapInArrow(pick, "k long, doc_id long, line int, n int, keeper boolean, bytes binary"), "units")
    keepers = found.where("keeper").dropDuplicates(["k"]).select("k", F.col("bytes").alias("kept"))
    return found.where("NOT keeper").join(keepers, "k").where("bytes = kept").select("doc_id", "line", "n")


def dedup_lines(docs: DataFrame, every: int = EVERY, long_line: int = LONG_LINE) -> DataFrame:
    """`docs` with the remaining text, n_lines, removed_lines (numbers, from 0) and kept."""
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    cuts = repeated_lines(typed.select("doc_id", "text"), every, long_line)
    spans = cuts.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line", "n"))).alias("__cuts"))
    base = typed.drop("n_lines", "removed_lines", "kept")
    joined = base.join(spans, "doc_id", "left")
    names = base.columns

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                totals = np.diff(lines(*text_buffers(part.column("text")))[3])
                cuts = part.column("__cuts")
                hit = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
                texts, changed, gone = part.column("text").take(pa.array(hit)).to_pylist(), [], {}
                for k, text, spans in zip(hit.tolist(), texts, cuts.take(pa.array(hit)).to_pylist()):
                    drop = {i for s in spans for i in range(s["line"], s["line"] + s["n"])}
                    at, kept = -1, []
                    for x in text.split("\n"):
                        at += x != ""
                        if x == "" or at not in drop:
                            kept.append(x)
                    changed.append("\n".join(kept) if totals[k] > len(drop) else "")
                    gone[k] = sorted(drop)
                mask = np.zeros(part.num_rows, dtype=bool)
                mask[hit] = True
                text = pc.replace_with_mask(part.column("text"), pa.array(mask), pa.array(changed, part.column("text").type))
                columns = [text if c == "text" else part.column(c) for c in names]
                size = np.array([len(gone.get(k, ())) for k in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(totals.astype(np.int32)), pa.array([gone.get(k, []) for k in range(part.num_rows)], pa.list_(pa.int32())), pa.array((size == 0) | (size < totals))],
                    names=[*names, "n_lines", "removed_lines", "kept"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return joined.mapInArrow(cut, schema + ", n_lines int, removed_lines array<int>, kept boolean")


def op4_line_dedup(spark, sf_dir):
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES: dict[str, str] = {}
