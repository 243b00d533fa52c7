"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct shingles. Two sets with
100 * |x & y| >= 90 * |x | y| miss at most m = n - ceil(0.9 n) of each other's members, so in
any one global order of the tokens the first m + 1 of both share a token, and longer
prefixes share more: with p1 rare and p2 frequent tokens in a prefix where
p1 + (p2 - 1) = m + 1, the sets share a rare token or two frequent ones. Rare tokens (in few
documents) come first in the order and are indexed alone; frequent ones are indexed as
pairs. Where a prefix would need many frequent tokens, pairs are too many: such a "wide"
document indexes its frequent tokens alone, the others that hold one index it alone as well, and
those entries meet only if at least one of them is wide. So no link is lost and no index
grows faster than the texts.

Plan: (1) one pass gives each document's set fingerprint (128 bits and the size); equal sets form a
class, represented by its least doc_id; (2) tokens are counted in blocks, and the frequent
ones written as sorted key files; (3) the classes' prefixes are indexed in blocks by hash
range, and the entries of one signature paired (sorted by size, so only sizes within the bound
meet); (4) the candidates' sets are joined and the intersections counted; (5) links, weighted
by class size, give degrees and components. Copies are never expanded into pairs.

Edge cases: null and empty texts, and those without words, have n_shingles 0 and link with
nothing; rows repeated with one doc_id are one document, listed once; rows with a
null doc_id link with nothing and are listed as they are; an empty table gives an empty
result; other columns are ignored. A doc_id that comes with different texts is one document too; which
of its texts is compared is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Sorted, bucket_bits, components, packed, read_table, shuffle_partitions, slices, text_buffers, write_sorted, written
from folioflow.llm.words import mix, shingles, spans

K = 5
PERCENT = 90
FREQUENT = 24  # a token in more documents than this is indexed in pairs
WIDE = 24  # more frequent tokens than this in a prefix: no pairs
HOT = 3000  # a longer list of entries is paired in blocks, by more than one task
BLOCK_TOKENS = 2 << 20

_SIGN = np.uint64(1 << 63)


def token_sets(column: pa.Array, k: int = K):
    """Distinct shingle hashes of each row, ascending, and the n+1 offsets of the rows."""
    raw, offsets = text_buffers(column)
    _, _, h, word_off = spans(raw, offsets, lower=True)
    tokens, off = shingles(h, word_off, k)
    rows, sizes = [], np.zeros(len(off) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        row = np.sort(tokens[a:b])
        if len(row) > 1:
            row = row[np.concatenate([[True], row[1:] != row[:-1]])]
        rows.append(row)
        sizes[i] = len(row)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                flat, off = token_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(_sums(mix(flat, 11), off).view(np.int64)), pa.array(_sums(mix(flat, 12), off).view(np.int64)), pa.array(np.diff(off))],
                    names=["doc_id", "f1", "f2", "n"],
                )

    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, n long")


def _others_dropped(part: pa.RecordBatch, copies: Sorted) -> pa.RecordBatch:
    """The rows that stand for their class: neither copies nor null ids."""
    ids = part.column("doc_id")
    keep = ~copies.contains(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)
    return part.filter(pa.array(keep))


def _short(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def frequent_tokens(docs: DataFrame, copies: list[dict], bits: int, k: int = K, more_than: int = FREQUENT) -> DataFrame:
    """(k): prefixes of `bits` + 32 bits of the hashes that more than so many class representatives hold.

    Blocks of sorted 32-bit remainders travel, four bytes a token, keyed by the leading bits.
    """

    def blocks(batches):
        seen, held = Sorted(copies), []

        def flush():
            tokens = np.sort(np.concatenate(held))
            edges = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            low = (tokens >> np.uint64(32 - bits)).astype(np.uint32)
            off = np.concatenate([[0], edges, [len(tokens)]])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), pa.array(packed(low, off), pa.binary())], names=["bucket", "low"])

        size = 0
        for batch in batches:
            for part in slices(_others_dropped(batch, seen)):
                flat, _ = token_sets(part.column("text"), k)
                held.append(flat)
                size += len(flat)
                if size > BLOCK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(key, table):
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), dtype=np.uint32)
        low = np.sort(low)
        n = len(low) - more_than
        often = np.unique(low[:n][low[:n] == low[more_than:]]) if n > 0 else low[:0]
        return pa.table({"k": (np.int64(key[0].as_py()) << np.int64(32)) | often.astype(np.int64)})

    return docs.mapInArrow(blocks, "bucket int, low binary").groupBy("bucket").applyInArrow(count, "k long")


def signatures(tokens: np.ndarray, often: np.ndarray, percent: int = PERCENT, wide: int = WIDE):
    """(signatures, wide mark) of one set: rare tokens alone, frequent ones in pairs or, from `wide` on, alone.

    `tokens` ascend, `often` marks the frequent ones.
    """
    n = len(tokens)
    need = n - (percent * n + 99) // 100 + 1
    rare = tokens[~often]
    if len(rare) >= need:
        return mix(rare[:need], 21), False
    some = tokens[often][: need - len(rare) + 1]
    alone = mix(some, 22)
    if len(some) < 2 or len(some) > wide:
        return np.concatenate([mix(rare, 21), alone]), True
    a, b = np.triu_indices(len(some), 1)
    pairs = mix(some[a] * np.uint64(0x9FB21C651E98DF25) + some[b], 23)
    return np.concatenate([mix(rare, 21), pairs, alone]), False


#: Of an entry's n: bit 30 marks a frequent token indexed alone, bit 31 a wide document.
_ALONE, _WIDE, _N = np.uint32(1 << 30), np.uint32(1 << 31), np.uint32((1 << 30) - 1)


def index_blocks(docs: DataFrame, copies: list[dict], frequent: list[dict], bits: int, k: int = K, percent: int = PERCENT) -> DataFrame:
    def run(batches):
        seen, common = Sorted(copies), Sorted(frequent)
        sig, ids, sizes, total = [], [], [], 0

        def flush():
            s, d, n = np.concatenate(sig), np.concatenate(ids), np.concatenate(sizes)
            order = np.argsort(s, kind="stable")
            s, d, n = s[order], d[order], n[order]
            off = np.concatenate([[0], np.searchsorted(s, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(s)]])
            some = np.flatnonzero(np.diff(off))
            columns = [[x for x, take in zip(packed(c, off), np.diff(off) > 0) if take] for c in (s, d, n)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "sig", "id", "n"])

        for batch in batches:
            for part in slices(_others_dropped(batch, seen)):
                flat, off = token_sets(part.column("text"), k)
                often = common.contains((flat >> np.uint64(32 - bits)).view(np.int64))
                for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if b - a < 2:  # one shingle: linked to equal sets only, and those are one class
                        continue
                    found, is_wide = signatures(flat[a:b], often[a:b], percent)
                    mark = np.full(len(found), b - a, dtype=np.uint32)
                    lone = 0
                    n_rare = (b - a) - int(often[a:b].sum())
                    need = (b - a) - (percent * (b - a) + 99) // 100 + 1
                    if n_rare < need:
                        lone = min(int(often[a:b].sum()), need - n_rare + 1)
                    if lone:
                        mark[len(mark) - lone :] |= _ALONE
                    if is_wide:
                        mark |= _WIDE
                    sig.append(found)
                    ids.append(np.full(len(found), part.column("doc_id")[row].as_py(), dtype=np.int64))
                    sizes.append(mark)
                    total += len(found)
                if total > BLOCK_TOKENS // 4:
                    yield flush()
                    sig, ids, sizes, total = [], [], [], 0
        if total:
            yield flush()

    return docs.mapInArrow(run, "bucket int, sig binary, id binary, n binary")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ids", pa.binary()), ("ns", pa.binary()), ("at", pa.int32()), ("sig", pa.int64())])


def _meet(ids: np.ndarray, ns: np.ndarray, first: int, last: int, percent: int):
    """Pairs (i, j), j > i, for i in [first, last) of one list sorted by size, within the size bound."""
    n = (ns & _N).astype(np.int64)
    wide, alone = (ns & _WIDE) > 0, (ns & _ALONE) > 0
    ends = np.searchsorted(n, n[first:last] * 100 // percent, side="right")
    for i, end in zip(range(first, last), ends.tolist()):
        j = np.arange(i + 1, end)
        if alone[i] and not wide[i]:
            j = j[wide[j]]
        if len(j):
            yield np.full(len(j), ids[i]), ids[j]


def _as_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) < 2_000_000 else np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    none = pa.nulls(len(both), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none, none, pa.nulls(len(both), pa.int32()), pa.nulls(len(both), pa.int64())], schema=_PAIRS)


def pair_index(blocks: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """Candidates (a < b); lists longer than `hot` come as blocks (ids, ns, at) for other tasks to pair."""

    def pair(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], []]
        for batch in batches:
            for held, name, kind in zip(cols, ("sig", "id", "n"), (np.uint64, np.int64, np.uint32)):
                held.extend(np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist())
        sig, ids, ns = (np.concatenate(c) for c in cols)
        order = np.lexsort((ids, ns & _N, sig))
        sig, ids, ns = sig[order], ids[order], ns[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
        sig, ids, ns = sig[fresh], ids[fresh], ns[fresh]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lengths = np.diff(np.append(starts, len(sig)))
        left, right, held = [], [], 0
        for length in np.unique(lengths[(lengths > 1) & (lengths <= 16)]).tolist():
            at = starts[lengths == length]
            i, j = np.triu_indices(length, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            n, wide, alone = (ns & _N).astype(np.int64), (ns & _WIDE) > 0, (ns & _ALONE) > 0
            good = (100 * n[i] >= percent * n[j]) & (~alone[i] | wide[i] | wide[j])
            left.append(ids[i[good]])
            right.append(ids[j[good]])
        for at, length in zip(starts[lengths > 16].tolist(), lengths[lengths > 16].tolist()):
            one, size = ids[at : at + length], ns[at : at + length]
            if length > hot:
                n = (size & _N).astype(np.int64)
                for first in range(0, length, max(1, hot // 4)):
                    last = min(first + max(1, hot // 4), length)
                    end = int(np.searchsorted(n, n[last - 1] * 100 // percent, side="right"))
                    for other in range(first, end, hot):  # every block of the list against what follows it
                        some = np.arange(max(other, last), min(other + hot, end)) if other + hot > last else np.arange(0)
                        own = np.concatenate([np.arange(first, last), some])
                        if other > first and not len(some):
                            continue
                        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([one[own].tobytes()], pa.binary()), pa.array([size[own].tobytes()], pa.binary()), pa.array([last - first if other == first else first - last], pa.int32()), pa.array([int(sig[at].view(np.int64))])], schema=_PAIRS)
                continue
            for a, b in _meet(one, size, 0, length, percent):
                left.append(a)
                right.append(b)
                held += len(a)
            if held > 1_000_000:
                yield _as_pairs(np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
        if left:
            yield _as_pairs(np.concatenate(left), np.concatenate(right))

    def expand(batches):
        for batch in batches:
            for ids, ns, at in zip(batch.column("ids").to_pylist(), batch.column("ns").to_pylist(), batch.column("at").to_pylist()):
                ids, ns = np.frombuffer(ids, np.int64), np.frombuffer(ns, np.uint32)
                own = abs(at)
                n, wide, alone = (ns & _N).astype(np.int64), (ns & _WIDE) > 0, (ns & _ALONE) > 0
                left, right, held = [], [], 0
                for i in range(own):
                    end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
                    j = np.arange(i + 1 if at > 0 else own, end)
                    if alone[i] and not wide[i]:
                        j = j[wide[j]]
                    left.append(np.full(len(j), ids[i]))
                    right.append(ids[j])
                    held += len(j)
                    if held > 500_000:
                        yield _as_pairs(np.concatenate(left), np.concatenate(right)).select(["a", "b"])
                        left, right, held = [], [], 0
                if left:
                    yield _as_pairs(np.concatenate(left), np.concatenate(right)).select(["a", "b"])

    found = written(blocks.groupBy("bucket").applyInArrow(pair, "a long, b long, ids binary, ns binary, at int, sig long"), "candidates")
    plain = found.where("ids IS NULL").select("a", "b")
    split = found.where("ids IS NOT NULL").select("ids", "ns", "at").repartition(shuffle_partitions(found.sparkSession), F.xxhash64("ids")).mapInArrow(expand, "a long, b long")
    return plain.unionByName(split).distinct()


def verified(docs: DataFrame, candidates: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(u, v) of the candidates (a, b) whose sets pass the bound; only their texts are read again."""
    pairs = written(candidates, "pairs")
    wanted = write_sorted(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "wanted")

    def sets(batches):
        want = Sorted(wanted)
        for batch in batches:
            ids = batch.column("doc_id")
            batch = batch.filter(pa.array(want.contains(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)))
            for part in slices(batch):
                flat, off = token_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(flat, off), pa.binary())], names=["id", "tokens"])

    def compare(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    known = written(docs.mapInArrow(sets, "id long, tokens binary"), "sets")  # a row repeated with its id comes twice
    joined = pairs.join(known.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(known.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return joined.select(F.col("a").alias("u"), F.col("b").alias("v"), "ta", "tb").mapInArrow(compare, "u long, v long").distinct()


def ngram_classes(docs: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents with their class (doc_id, n_shingles, rep, copies) and the links between classes (u, v)."""
    bits = bucket_bits(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = written(fingerprints(docs, k), "fingerprints")
    named = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "f1", "f2")).alias("s")).select("doc_id", "s.*")
    sets = ["f1", "f2", "n"]
    classes = named.where("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    rows = written(
        named.join(classes, sets, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
        .unionByName(marks.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("rep"), F.lit(1).cast("long").alias("copies"))),
        "classes",
    )
    copies = write_sorted(rows.where("rep <> doc_id").select(F.col("doc_id").alias("k")), "copies")
    frequent = write_sorted(frequent_tokens(docs, copies, bits, k), "frequent")
    candidates = pair_index(index_blocks(docs, copies, frequent, bits, k, percent), percent)
    return rows, written(verified(docs, candidates, k, percent), "links")


def ngram_join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id, class_id, class_size) of every document."""
    rows, links = ngram_classes(docs, k, percent)
    reps = rows.where("doc_id = rep").select(F.col("rep").alias("v"), "copies")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(reps, "v").groupBy(F.col("u").alias("rep")).agg(F.sum("copies").alias("others"))
    linked = degree.join(components(links).withColumnRenamed("node", "rep"), "rep")
    return rows.join(linked, "rep", "left").select(
        "doc_id",
        "n_shingles",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_similar"),
        F.coalesce("component", "rep").alias("component_id"),
        F.col("rep").alias("class_id"),
        F.col("copies").alias("class_size"),
    )


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
