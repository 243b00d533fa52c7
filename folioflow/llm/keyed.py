"""Sums by hashed key over a whole corpus: sorted compressed blocks in the shuffle, sorted arrays in the shared folder.

A task sums its own texts' keys and sends, for each range of keys (bucket) and language, one block: the
sorted keys as differences and the values as byte planes, compressed; about four bytes a key instead of
a row. The task of a bucket merges its blocks, takes the counts of counts and writes the entries
as arrays, so nothing is sorted or shuffled a second time. Keys are the upper 48 bits of 64-bit hashes.

Entries whose `once` columns are all 1 may be left out of the files (they are in the counts of counts).
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Sorted, _array, _Sink, bucket_bits, roomy, shared_dir, slices, tidy, write_sorted, written
from folioflow.llm.words import sorting

BITS = 48
BLOCK = 2_250_000  # distinct keys that a task holds before it sends them


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what has ended, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(data: bytes, kind, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def _short(values: np.ndarray, cut: int) -> np.ndarray:
    """Float32 values without their last `cut` bits, rounded; whole numbers stay as they are."""
    bits = values.astype(np.float32).view(np.uint32)
    return np.where(values == np.rint(values), bits, (bits + np.uint32(1 << (cut - 1))) & ~np.uint32((1 << cut) - 1)).view(np.float32)


_CODEC = pa.Codec("zstd", 1)


def encoded(keys: np.ndarray, values: list[np.ndarray], cuts: list[int]) -> tuple[bytes, bytes, bytes]:
    """Ascending keys (uint64, 48 bits) and their float32 values: what doesn't compress, what does a little, and the rest."""
    high = keys >> np.uint64(16)
    step = np.diff(high, prepend=high[:1]).astype(np.uint32)
    step[:1] = high[:1]
    planes = step.view(np.uint8).reshape(-1, 4).T
    rest = planes[1:].tobytes() + b"".join(_planes(_short(v, cut)) for v, cut in zip(values, cuts))
    return keys.astype(np.uint16).tobytes() + planes[0].tobytes(), _CODEC.compress(rest[: len(keys)], asbytes=True), _CODEC.compress(rest[len(keys) :], asbytes=True)


def decoded(raw: bytes, second: bytes, more: bytes, n: int, n_values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    low = np.frombuffer(raw[: 2 * n], np.uint16)
    second = _CODEC.decompress(second, decompressed_size=n, asbytes=True)
    more = _CODEC.decompress(more, decompressed_size=n * (2 + 4 * n_values), asbytes=True)
    step = np.frombuffer(raw[2 * n :] + second + more[: 2 * n], np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
    keys = (np.cumsum(step, dtype=np.uint64) << np.uint64(16)) | low
    return keys, [_unplanes(more[n * (2 + 4 * k) : n * (6 + 4 * k)], np.float32, n) for k in range(n_values)]


def ordering(keys: np.ndarray) -> np.ndarray:
    """An order that sorts keys (uint64, 48 bits): their upper bits are sorted with the places in the lower ones, then the few that agree in those."""
    bits = max(1, (len(keys) - 1).bit_length()) if len(keys) else 1
    if bits > 24:
        return np.argsort(keys)
    shift, mask = np.uint64(max(0, BITS + bits - 64)), np.uint64((1 << bits) - 1)
    both = keys >> shift
    both <<= np.uint64(bits)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & mask).view(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    both >>= np.uint64(bits)
    for upper in np.unique(both[wrong]).tolist():
        a, b = np.searchsorted(both, np.array([upper, upper + 1], np.uint64)).tolist()
        order[a:b] = order[a:b][np.argsort(ordered[a:b], kind="stable")]
    return order


def _merged(held: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The parts (lang, keys, values) that `held` has as one, summed by key; it is emptied, a column after the other, to spare memory."""
    langs, keys, columns = [p[0] for p in held], [p[1] for p in held], [list(v) for v in zip(*(p[2] for p in held))]
    held.clear()
    keys = np.concatenate(keys)
    order = ordering(keys)
    keys, lang = keys[order], np.concatenate(langs)[order]
    del langs
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (lang[1:] != lang[:-1])])) if len(keys) else np.zeros(0, np.int64)
    keys, lang, values = keys[first], lang[first], []
    while columns:
        column = np.concatenate(columns.pop(0))[order]
        values.append(np.add.reduceat(column, first, dtype=np.float64).astype(np.float32) if len(first) else column)
    return lang, keys, values


def _counted(held: list, n_langs: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """As `_merged`, of parts without values, each key of which counts once, or with a count: one sort of keys and languages together."""
    if n_langs > 1 << (64 - BITS):
        held[:] = [(lang, keys, values or [np.ones(len(keys), np.float32)]) for lang, keys, values in held]
        return _merged(held)
    free = np.uint64(64 - BITS)
    summed, once = [p for p in held if p[2]], [p for p in held if not p[2]]
    held.clear()
    parts = []
    while once:
        lang, keys, _ = once.pop()
        parts.append(keys << free | lang.astype(np.uint64))
    both = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(both))).astype(np.float32)
    both = both[first]
    lang, keys = (both & np.uint64((1 << int(free)) - 1)).astype(np.int32), both >> free
    return _merged([*summed, (lang, keys, [counts])]) if summed else (lang, keys, [counts])


def _save(root: str, bits: int, keys: np.ndarray, values: dict[str, np.ndarray], whole: tuple[str, ...], shares: dict[str, str]) -> str:
    """Writes the arrays of one bucket.

    rem: the keys' lower 32 bits. start: where each range of keys begins, four to eight keys a range. Whole numbers take a
    byte; those from 255 on stand in `more` with their places. A share is stored as its part of the other value, in 16 bits.
    """
    part, rest = uuid.uuid4().hex, BITS - bits
    low = min(32, rest, max(0, rest - (len(keys) >> 3).bit_length()))
    inside = keys & np.uint64((1 << rest) - 1)
    ranges = np.arange((1 << (rest - low)) + 1, dtype=np.uint64)
    arrays = {"rem": inside.astype(np.uint32), "start": np.searchsorted(inside, ranges << np.uint64(low)).astype(np.uint32 if len(keys) < 1 << 32 else np.int64)}
    for name, x in values.items():
        if name in whole:
            big = np.flatnonzero(x >= 255)
            arrays |= {name: np.minimum(x, 255).astype(np.uint8), f"{name}.more": np.stack([big.astype(np.int64), x[big].astype(np.int64)])}
        else:
            other = values[shares[name]]
            arrays[name] = np.rint(65535 * np.clip(x / np.maximum(other, 1), 0, 1)).astype(np.uint16)
    filesystem, inner = pafs.FileSystem.from_uri(root)
    for name, array in arrays.items():
        with filesystem.open_output_stream(f"{inner}/{part}.{name}.tmp") as out:
            np.save(_Sink(out), array)
        filesystem.move(f"{inner}/{part}.{name}.tmp", f"{inner}/{part}.{name}.npy")  # a repeated task leaves files that no list names
    return part


class Sums:
    """What `sums` found: files by bucket, and the counts of counts of every language (`done`)."""

    def __init__(self, done: DataFrame, root: str, bits: int, whole: tuple[str, ...], shares: dict[str, str]):
        self.root, self.bits, self.done, self.whole, self.shares = root, bits, done, whole, shares
        self.parts = {r["bucket"]: r["part"] for r in done.select("bucket", "part").distinct().collect()}  # a row for each bucket
        self.numbers = write_sorted(self._discounts(), "discounts", ("d1", "d2", "d3", "total", "mass", "distinct"))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "done"}

    def _discounts(self) -> DataFrame:
        n = self.done.groupBy(F.col("lang_id").alias("k")).agg(*[F.sum(f"n{i}").cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)], F.sum("total").alias("total"), F.sum("distinct").cast("double").alias("distinct"))
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        d = [F.least(F.greatest(F.lit(i) - (i + 1) * y * F.when(F.col(f"n{i}") > 0, F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5)), F.lit(0.1)), F.lit(i - 0.1)) for i in (1, 2, 3)]
        rated = n.withColumns({f"d{i}": x for i, x in zip((1, 2, 3), d)})
        return rated.withColumn("mass", F.expr("n1 * d1 + n2 * d2 + (distinct - n1 - n2) * d3"))

    def language_numbers(self, langs: np.ndarray, *names: str) -> list[np.ndarray]:
        """`names` (d1, d2, d3: discounts; total, mass, distinct: sum, discounts and number of counts) of each language; 0 if unknown."""
        distinct, inverse = np.unique(langs, return_inverse=True)
        return [v[inverse] for v in Sorted(self.numbers).values(distinct, *names, absent=0.0, kind=np.float64)]

    def discounts(self, langs: np.ndarray) -> np.ndarray:
        """Discounts of counts 0, 1, 2 and from 3 on, a row for each of `langs`."""
        return np.stack([np.zeros(len(langs)), *self.language_numbers(langs, "d1", "d2", "d3")], 1)

    def values(self, keys: np.ndarray, *names: str, absent: float = 0.0) -> list[np.ndarray]:
        """Values of every 64-bit key, `absent` where there is no entry."""
        order = sorting(keys.view(np.uint64))
        ordered = keys.view(np.uint64)[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        found = self.ordered_values(ordered[first], *names, absent=absent)
        number, out = np.cumsum(first) - 1, []
        for x in found:
            out.append(np.empty(len(keys)))
            out[-1][order] = x[number]
        return out

    def ordered_values(self, keys: np.ndarray, *names: str, absent: float = 0.0) -> list[np.ndarray]:
        """The same of keys (uint64) whose upper bits ascend."""
        ordered = keys >> np.uint64(64 - BITS)
        out = [np.full(len(keys), float(absent)) for _ in names]
        rest = BITS - self.bits
        edges = np.concatenate([[0], np.searchsorted(ordered, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(rest)), [len(keys)]])
        for b in np.flatnonzero(np.diff(edges)).tolist():
            if b not in self.parts:
                continue
            array = lambda name, b=b: _array(self.root, f"{self.parts[b]}.{name}.npy")
            own = ordered[edges[b] : edges[b + 1]] & np.uint64((1 << rest) - 1)
            rem, start = array("rem"), array("start")
            if not len(rem):
                continue
            low = rest - (len(start) - 1).bit_length() + 1
            sub, want = (own >> np.uint64(low)).view(np.int64), own.astype(np.uint32)
            last, end = start.take(sub).astype(np.int64) - 1, start.take(sub + 1).astype(np.int64)
            step = 1 << int((end - last).max() - 1).bit_length() >> 1
            while step:  # a binary search of all keys at once: last is before the key's place
                probe = last + step
                less = rem.take(probe, mode="clip") < want
                less &= probe < end
                last += less * step if step > 1 else less
                step >>= 1
            last += 1
            found = np.flatnonzero((rem.take(last, mode="clip") == want) & (last < end))
            at, to = last[found], edges[b] + found

            def numbers(name):
                x = array(name)[at].astype(np.float64)
                if len(large := np.flatnonzero(x == 255)):
                    place, value = array(f"{name}.more")
                    x[large] = value[np.searchsorted(place, at[large])]
                return x

            for o, name in zip(out, names):
                o[to] = numbers(name) if name in self.whole else array(name)[at] / 65535 * numbers(self.shares[name])
        return out


_ROW = "bucket int, lang_id long, n int, raw binary, second binary, more binary"
_DONE = "part string, bucket int, lang_id long, n1 long, n2 long, n3 long, n4 long, total double, distinct long"


def sums(docs: DataFrame, rows_of, names: tuple[str, ...], what: str, once: tuple[str, ...] = (), shares: dict[str, str] | None = None) -> Sums:
    """Sums by (language, key) of what `rows_of` gives for a slice of `docs`: languages, 64-bit keys, values.

    The first of `names` is the count of the counts of counts; no values: each key counts once. Those of `shares` are between 0 and the value they name;
    all others are rounded to whole numbers.
    """
    shares = shares or {}
    whole = tuple(x for x in names if x not in shares)
    spark = docs.sparkSession
    bits, root = bucket_bits(spark), shared_dir(spark, what)
    cuts = [8 if x in shares else 12 for x in names]  # what is rounded to whole numbers in the end needs fewer bits

    def send(batches):
        roomy()
        held: list = []
        size, numbers = 0, {}
        merged = lambda: _counted(held, len(numbers)) if any(not p[2] for p in held) else _merged(held)

        def sent(lang, keys, values):
            for name, number in numbers.items():
                own = np.flatnonzero(lang == number)
                if not len(own):
                    continue
                k = keys[own]
                edges = np.concatenate([[0], np.searchsorted(k, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(BITS - bits)), [len(k)]])
                rows = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = own[edges[b] : edges[b + 1]]
                    rows.append((b, name, len(at), *encoded(keys[at], [v[at] for v in values], cuts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "lang_id", "n", "raw", "second", "more"])

        for batch in batches:
            for part in slices(batch, most=1 << 20):
                lang, keys, values = rows_of(part)
                heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(lang)), bool), lang[1:] != lang[:-1]]))
                distinct, inverse = np.unique(lang[heads], return_inverse=True)
                for x in distinct.tolist():
                    numbers.setdefault(x, len(numbers))
                small = np.repeat(np.array([numbers[x] for x in distinct.tolist()], np.int32)[inverse], np.diff(np.append(heads, len(lang)))) if len(lang) else np.zeros(0, np.int32)
                held.append((small, keys.view(np.uint64) >> np.uint64(64 - BITS), [np.asarray(v, np.float32) for v in values]))
                size += len(held[-1][1])
                if size > 2 * BLOCK:
                    held = [merged()]
                    size = len(held[0][1])
                    if size > BLOCK:  # bounds the worker's memory; what is sent twice is summed in its bucket
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*merged())
        held = []
        tidy()

    def take(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list] = {}
        for batch in batches:
            for lang, n, *block in zip(*(batch.column(c).to_pylist() for c in ("lang_id", "n", "raw", "second", "more"))):
                of.setdefault(lang, []).append(decoded(*block, n, len(names)))
        rows, kept = [], []
        for lang, parts in of.items():
            k = np.concatenate([p[0] for p in parts])
            order = ordering(k)
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            v = [np.add.reduceat(np.concatenate(x)[order], first, dtype=np.float64) for x in zip(*(p[1] for p in parts))]
            v = [np.rint(x) if name in whole else x for name, x in zip(names, v)]
            c = v[0][v[0] > 0]
            rows.append((lang, *[int((c == i).sum()) for i in (1, 2, 3, 4)], float(c.sum()), len(c)))
            alone = np.ones(len(first), bool) if once else np.zeros(len(first), bool)
            for name in once:
                alone &= v[names.index(name)] == 1
            kept.append((k[first][~alone], [x[~alone] for x in v]))
        keys = np.concatenate([p[0] for p in kept])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], [np.concatenate(x)[order] for x in zip(*(p[1] for p in kept))]
        part = _save(root, bits, keys, dict(zip(names, values)), whole, shares)
        columns = list(zip(*[(part, key[0].as_py(), *r) for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.int64()))], names=[x.split()[0] for x in _DONE.split(", ")])
        tidy()

    blocks = docs.mapInArrow(send, _ROW)
    found = Sums(written(blocks.groupBy("bucket").applyInArrow(take, _DONE), f"{what}-done"), root, bits, whole, shares)
    freed(spark)  # after further jobs: the driver holds on to its last one
    return found
