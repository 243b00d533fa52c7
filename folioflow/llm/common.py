"""What the training-data operators share: the shared folder, written tables, sorted key files.

Intermediate results that are read more than once are written as Parquet below the
folder named by ``spark.checkpoint.dir`` (all executors see it), so that a lost
executor costs a re-read and never a recomputation of a half-finished chain.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern ``[^\x20\x09-\x0D]+`` leaves it out.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own: list[str] = []
_open: list[set[str]] = []


def _cleanup() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_cleanup)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder for `what` below spark.checkpoint.dir; that setting is made here only where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        _own.append(base[len("file://"):])
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/folioflow-{what}-{uuid.uuid4().hex[:12]}"
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path)
    filesystem, inner = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(inner, recursive=True)
    if _open:
        _open[-1].add(path)
    if isinstance(filesystem, pafs.LocalFileSystem):
        _own.append(inner)
    return path


@contextmanager
def scratch():
    """Within it, the folders of shared_dir are of passing use: they go when it ends, but for those taken off the set it gives."""
    folders: set[str] = set()
    _open.append(folders)
    try:
        yield folders
    finally:
        _open.pop()
        for path in folders:
            filesystem, inner = pafs.FileSystem.from_uri(path)
            filesystem.delete_dir(inner)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, computes it once."""
    spark = df.sparkSession
    path = shared_dir(spark, what) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(spark: SparkSession) -> int:
    """log2 of a number of key ranges that keeps every shuffle partition busy."""
    return max(3, min(20, (shuffle_partitions(spark) - 1).bit_length()))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@lru_cache(maxsize=1)
def roomy() -> None:
    """Lets arrays of up to 32 MB come from the heap, which costs less than mapping each of them anew; `tidy` gives back what is free."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


def tidy() -> None:
    """Gives freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 2 << 20):
    """Row slices of a batch with about `most` bytes of text each; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    _, off = text_buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    tidy()


def packed(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = values.tobytes()
    width = values.itemsize
    return [raw[a * width : b * width] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


# --- sorted key files -------------------------------------------------------------------------


def write_sorted(df: DataFrame, what: str, values: tuple[str, ...] = ()) -> list[dict]:
    """Writes column `k` (long), sorted, and `values` (long or float) beside it as .npy files; returns their list.

    The files are ranges of the sorted whole: range partitioning, one file a task. Tasks
    write under a name of their own and rename, so a repeated task does no harm. Only the
    list of files comes to the driver, a row for each of them.
    """
    spark = df.sparkSession
    root = shared_dir(spark, what)
    names = ("k", *values)

    def write(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        filesystem, inner = pafs.FileSystem.from_uri(root)
        part = uuid.uuid4().hex
        for name in names:
            array = table.column(name).to_numpy()
            with filesystem.open_output_stream(f"{inner}/{part}.{name}.tmp") as out:
                np.save(_Sink(out), array)
            filesystem.move(f"{inner}/{part}.{name}.tmp", f"{inner}/{part}.{name}.npy")
        keys = table.column("k").to_numpy()
        yield pa.RecordBatch.from_pydict({"part": [part], "lo": [int(keys[0])], "hi": [int(keys[-1])]})

    done = (
        df.select(F.col("k").cast("long").alias("k"), *values)
        .repartitionByRange("k")
        .sortWithinPartitions("k")
        .mapInArrow(write, "part string, lo long, hi long")
    )
    return sorted(({"root": root, **row.asDict()} for row in done.collect()), key=lambda r: r["lo"])


class _Sink:
    def __init__(self, out):
        self.out = out

    def write(self, data):
        self.out.write(memoryview(data).cast("B") if not isinstance(data, bytes) else data)
        return len(data)


@lru_cache(maxsize=2048)
def _array(root: str, name: str) -> np.ndarray:
    filesystem, inner = pafs.FileSystem.from_uri(root)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.asarray(np.load(f"{inner}/{name}", mmap_mode="r"))
    with filesystem.open_input_file(f"{inner}/{name}") as source:
        import io

        return np.load(io.BytesIO(source.read()))


class Sorted:
    """Look-ups in the files of write_sorted; they are memory mapped where the folder is a mounted one."""

    def __init__(self, files: list[dict]):
        self.files = files
        self.lows = np.array([f["lo"] for f in files], dtype=np.int64)

    def places(self, keys: np.ndarray):
        """(slice or index of keys, file, positions in it, found) for every file that `keys` touch."""
        if not len(self.files) or not len(keys):
            return
        seg = np.searchsorted(self.lows, keys, side="right") - 1
        one = len(self.files) == 1
        for s in [0] if one else np.unique(seg[seg >= 0]).tolist():
            own = np.flatnonzero(seg == s)
            array = _array(self.files[s]["root"], f"{self.files[s]['part']}.k.npy")
            at = np.minimum(np.searchsorted(array, keys[own]), len(array) - 1)
            yield own, self.files[s], at, array[at] == keys[own]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for own, _, _, hit in self.places(keys):
            found[own] = hit
        return found

    def values(self, keys: np.ndarray, *names: str, absent=np.nan, kind=np.float32) -> tuple[np.ndarray, ...]:
        """An array for each name, `absent` where the key is absent."""
        out = tuple(np.full(len(keys), absent, dtype=kind) for _ in names)
        for own, file, at, hit in self.places(keys):
            for o, name in zip(out, names):
                o[own[hit]] = _array(file["root"], f"{file['part']}.{name}.npy")[at[hit]]
        return out


# --- connected components -----------------------------------------------------------------------


def _local_stars(batches):
    """Edges of one partition replaced by stars around the least node of each of their components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars():
        out = [(x, root(x)) for x in parent if root(x) != x]
        return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounds the worker's memory, not the result
            yield stars()
            parent = {}
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over the edges (u, v); nodes without edges are absent.

    Alternating large-star and small-star rounds; each is written to the shared folder. Their
    number is logarithmic in the diameter. Partial minima are taken before each shuffle.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now, last = written(pairs.mapInArrow(_local_stars, "u long, v long").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.mapInArrow(_local_stars, "u long, v long").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "small")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = (state["n"], state["s"])


def aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns of the given names put aside under others, and how to name them back."""
    clash = {c: f"__own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(clash), {v: k for k, v in clash.items()}
