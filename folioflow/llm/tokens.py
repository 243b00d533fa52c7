"""Token ids of whole texts, a bit-packed file format for them, and its reader.

Encoding. A tokenizer that throws white space away, whose normalizer works on characters
and whose pre-tokenizer never joins what white space parts encodes a text as the
concatenation of its words; `word_local` reads that from the tokenizer's own file. For such
a tokenizer each worker encodes every distinct word once and gathers the ids by numpy;
for any other, texts are encoded whole.

Files. One shard holds the documents of a range of ids, ascending. Ids are stored in the
least bits that the vocabulary needs, block after block of `BLOCK` ids; every block begins
at a whole byte and the header lists the blocks' offsets, so any document is unpacked by
numpy from its blocks alone.

    magic 'FFTB0001' | header length, uint32 | JSON header | int64 doc ids | int64 offsets
    (n+1, in ids) | int64 block offsets in bytes | payload

Edge cases: a null text and an empty one hold the end id only; a null doc_id sorts first and
comes back as null; rows of one doc_id (or without one) are stored in the order of their texts' hashes; an empty
table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import _Sink, packed, read_table, shared_dir, slices, text_buffers, written
from folioflow.llm.words import spans, take_ranges

#: The pre-tokenizer pattern that _pre_tokens splits by.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: An apostrophe, or anything but printable ASCII and the Latin letters below U+0250.
_UNUSUAL = re.compile("[^\x21-\x26\x28-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]")
MAGIC = b"FFTB0001"
BLOCK = 4096
NO_ID = -(1 << 63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_local(spec: dict) -> bool:
    """Whether the ids of a text are those of its white-space separated words, in a row."""

    def parts(node, key):
        return [] if node is None else node[key] if node["type"] == "Sequence" else [node]

    normal = parts(spec.get("normalizer"), "normalizers")
    if any(n["type"] not in ("NFC", "NFD", "Lowercase", "Replace") for n in normal):
        return False
    if any(n["type"] == "Replace" and n["pattern"] != {"Regex": r"\s+"} for n in normal):
        return False
    pre = parts(spec.get("pre_tokenizer"), "pretokenizers")
    if not pre or pre[0]["type"] != "Split" or pre[0]["behavior"] != "Removed" or not pre[0]["invert"]:
        return False
    pattern = pre[0]["pattern"].get("Regex", "")
    # every alternative must be free of white space: letters, digits, or a class that leaves \s out
    safe = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")
    if any(alternative not in safe for alternative in pattern.split("|")):
        return False
    if any(p["type"] != "ByteLevel" or p.get("add_prefix_space") or p.get("use_regex") for p in pre[1:]):
        return False
    return spec.get("model", {}).get("type") == "BPE" and not any(a.get("single_word") or any(c.isspace() for c in a["content"]) for a in spec.get("added_tokens", []))


_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_RARE = np.zeros(256, dtype=bool)
_RARE[[0x27, *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, 0xC2, *range(0xCA, 0x100)]] = True


def _pre_tokens(raw: np.ndarray, offsets: np.ndarray, lower: bool):
    """Spans of the pre-tokens by byte classes; a word with an apostrophe, an added token's beginning
    or a letter from beyond U+024F stays whole, to be encoded by the tokenizer as it is."""
    s, e, h, off = spans(raw, offsets, classes=_CLASS, lower=lower)
    rare = _RARE[raw]
    if len(raw) > 1:
        a, b = raw[:-1], raw[1:]
        rare[:-1] |= ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0x3C) & (b == 0x7C))
    at = np.flatnonzero(rare)
    if not len(at):
        return s, e, h, off
    ws, we, wh, _ = spans(raw, offsets, lower=lower)
    own = np.unique(np.searchsorted(ws, at, side="right") - 1)
    own = own[own >= 0]
    inside = np.searchsorted(ws[own], s, side="right") - 1
    drop = (inside >= 0) & (s < we[own][np.maximum(inside, 0)])
    s, e, h = (np.concatenate([x[~drop], y[own]]) for x, y in ((s, ws), (e, we), (h, wh)))
    order = np.argsort(s, kind="stable")
    return s[order], e[order], h[order], np.searchsorted(s[order], offsets)


class Encoder:
    """Ids of many texts at a time; one for each worker process and tokenizer file."""

    def __init__(self, path: str, most_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.local = word_local(spec)
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.separator = next(((a["content"], a["id"]) for a in spec.get("added_tokens", [])), None)
        self.local &= self.separator is not None
        self.most_words = most_words
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        self.pattern = None
        if self.local and suffix and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _KNOWN:
            self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.ends = np.zeros(self.vocab_size, dtype=bool)
            for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[number] = token.endswith(suffix)
        self._clear()

    def _clear(self):
        self.table = np.full(1 << 16, -1, dtype=np.int32)
        self.rows = tuple(np.zeros(1 << 14, dtype=t) for t in (np.uint64, np.uint64, np.uint64, np.int32, np.int64, np.int32))
        self.known = 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _find(self, h, head, tail, size):
        """Numbers of the known words, -1 where unknown. A word of up to 16 bytes is held against all its bytes."""
        out = np.full(len(h), -1, dtype=np.int64)
        mask = len(self.table) - 1
        slot, open_ = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(open_):
            row = self.table[slot]
            there = row >= 0
            open_, slot, row = open_[there], slot[there], row[there]
            same = (self.rows[0][row] == h[open_]) & (self.rows[1][row] == head[open_]) & (self.rows[2][row] == tail[open_]) & (self.rows[3][row] == size[open_])
            out[open_[same]] = row[same]
            open_, slot = open_[~same], (slot[~same] + 1) & mask
        return out

    def _add(self, *columns):
        n = len(columns[0])
        if self.known + n > len(self.rows[0]):
            self.rows = tuple(np.concatenate([r[: self.known], np.zeros(self.known // 2 + n, r.dtype)]) for r in self.rows)
        for r, c in zip(self.rows, columns):
            r[self.known : self.known + n] = c
        new, self.known = np.arange(self.known, self.known + n, dtype=np.int32), self.known + n
        if 3 * self.known > 2 * len(self.table):
            self.table = np.full(1 << (2 * self.known).bit_length(), -1, dtype=np.int32)
            new = np.arange(self.known, dtype=np.int32)
        mask = len(self.table) - 1
        slot = (self.rows[0][new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.table[slot] < 0
            self.table[slot[free]] = new[free]
            left = self.table[slot] != new
            new, slot = new[left], (slot[left] + 1) & mask

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode_words, for pre-tokens: in a joined text each of them ends with its own end-of-word id."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        usual = [k for k, t in enumerate(texts) if not _UNUSUAL.search(t) and "<|" not in t]
        flat, sizes = [], np.zeros(len(texts), dtype=np.int32)
        groups = [" ".join(texts[k] for k in usual[a : a + 32]) for a in range(0, len(usual), 32)]
        for a, e in zip(range(0, len(usual), 32), self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            own = usual[a : a + 32]
            assert len(cut) == len(own)
            sizes[own] = np.diff(cut, prepend=0)
            flat.append(ids)
        if len(usual) == len(texts):
            return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), sizes
        common = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        rest = np.setdiff1d(np.arange(len(texts)), usual)
        rows = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([texts[k] for k in rest.tolist()], add_special_tokens=False)]
        sizes[rest] = [len(r) for r in rows]
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        out = np.empty(int(starts[-1]), dtype=np.uint32)
        own = np.array(usual, dtype=np.int64)
        out[take_ranges(starts[own], sizes[own])] = common
        for k, row in zip(rest.tolist(), rows):
            out[starts[k] : starts[k + 1]] = row
        return out, sizes

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All their ids in a row, and how many each has."""
        texts = [w.decode("utf-8", "replace") for w in words]
        mark, mark_id = self.separator
        odd = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        plain = texts if not odd else [t if k not in set(odd) else "" for k, t in enumerate(texts)]
        groups = [mark.join(plain[k : k + 256]) for k in range(0, len(plain), 256)]
        lengths, ids = [], []
        for start, e in zip(range(0, len(plain), 256), self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            row = np.array(e.ids, dtype=np.uint32)
            cut = np.flatnonzero(row == mark_id)
            n = min(256, len(plain) - start)
            assert len(cut) == n - 1
            edges = np.concatenate([[-1], cut, [len(row)]])
            lengths.append(np.diff(edges) - 1)
            ids.append(row[row != mark_id])
        size, flat = np.concatenate(lengths).astype(np.int32), np.concatenate(ids)
        if odd:
            start = np.concatenate([[0], np.cumsum(size)])
            rows = [flat[start[k] : start[k + 1]] for k in range(len(size))]
            for k in odd:
                rows[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
            size, flat = np.array([len(r) for r in rows], dtype=np.int32), np.concatenate(rows)
        return flat, size

    def _word_ids(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray):
        """For every word where its ids begin in self.ids and how many they are."""
        size = (e - s).astype(np.int32)
        wide = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
        view = np.ndarray((len(wide) - 7,), dtype="<u8", buffer=wide, strides=(1,))
        short = np.minimum(size, 8).astype(np.uint64)
        keep = np.where(short >= 8, ~np.uint64(0), (np.uint64(1) << (short * np.uint64(8))) - np.uint64(1))
        head = view[s + 8] & keep
        tail = view[e] & np.where(size > 8, ~np.uint64(0), np.uint64(0))
        row = self._find(h, head, tail, size)
        rest = np.flatnonzero(row < 0)
        if len(rest):
            keys = h[rest] ^ (head[rest] * np.uint64(0x9E3779B97F4A7C15)) ^ tail[rest]
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            new = rest[first]
            flat, n = (self._encode_words if self.pattern is None else self._encode_pieces)([raw[a:b].tobytes() for a, b in zip(s[new].tolist(), e[new].tolist())])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + len(flat), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            row[rest] = self.known + inverse
            self._add(h[new], head[new], tail[new], size[new], self.used + np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64), n)
            self.used += len(flat)
        begins, counts = self.rows[4][row], self.rows[5][row]
        return begins, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (uint32) and the n+1 offsets of the rows in them."""
        raw, offsets = text_buffers(column)
        if not self.local:
            rows = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(r) for r in rows], dtype=np.int64)
            return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if self.known > self.most_words:  # forgetting costs time, not results
            self._clear()
        if self.pattern is None:
            s, e, h, word_off = spans(raw, offsets)
        else:  # letters of ASCII are folded early, but not where an added token may begin: it is matched as written
            lower = not ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)).any()
            s, e, h, word_off = _pre_tokens(raw, offsets, lower)
            raw = _FOLD[raw] if lower else raw
        begins, counts = self._word_ids(raw, s, e, h)
        before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return self.ids[take_ranges(begins, counts)], before[word_off]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by the end id."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    moved = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))
    out[moved] = ids
    return out, offsets + np.arange(n + 1)


# --- the file format --------------------------------------------------------------------------


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Ids in `bits` bits each, least significant bit first; the blocks' byte offsets."""
    whole, n = len(ids) // block, len(ids)
    bytes_per = (block * bits + 7) // 8
    offsets = np.concatenate([np.arange(whole + 1, dtype=np.int64) * bytes_per, [whole * bytes_per + ((n - whole * block) * bits + 7) // 8] if n % block else []]).astype(np.int64)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").view(np.uint8), offsets
    out = np.empty(int(offsets[-1]), dtype=np.uint8)
    step = 64
    for b in range(0, len(offsets) - 1, step):  # a bit matrix of some blocks at a time
        for k in range(b, min(b + step, len(offsets) - 1)):
            row = ids[k * block : (k + 1) * block]
            matrix = (row[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
            out[offsets[k] : offsets[k + 1]] = np.packbits(matrix.astype(np.uint8).ravel(), bitorder="little")
    return out, offsets


def unpack(payload: np.ndarray, bits: int, n: int) -> np.ndarray:
    """`n` ids from the bytes of one block (or of blocks of whole bytes in a row, for 8, 16 and 32 bits)."""
    if bits in (8, 16, 32):
        return payload.view(f"<u{bits // 8}")[:n].astype(np.uint32)
    flat = np.unpackbits(payload, bitorder="little")[: n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(out, doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> None:
    payload, blocks = pack(ids, bits, block)
    header = json.dumps({"bits": bits, "block": block, "docs": len(doc_ids), "ids": len(ids), "blocks": len(blocks) - 1, "payload": int(len(payload))}).encode()
    header += b" " * (-len(header) % 8 + 4)  # the arrays begin at a multiple of 8
    out.write(MAGIC + struct.pack("<I", len(header)) + header)
    for array in (doc_ids.astype("<i8"), offsets.astype("<i8"), blocks.astype("<i8"), payload):
        out.write(array.tobytes())


class Shard:
    """Reads a shard; `doc(k)` unpacks the blocks of one document only."""

    def __init__(self, data: bytes | memoryview | np.ndarray):
        self.data = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
        if self.data[:8].tobytes() != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack("<I", self.data[8:12].tobytes())[0]
        self.header = json.loads(self.data[12 : 12 + size].tobytes())
        at = 12 + size
        n, b = self.header["docs"], self.header["blocks"]
        self.doc_ids = self.data[at : at + 8 * n].view("<i8")
        at += 8 * n
        self.offsets = self.data[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.blocks = self.data[at : at + 8 * (b + 1)].view("<i8")
        self.payload = self.data[at + 8 * (b + 1) :][: self.header["payload"]]

    def range(self, start: int, end: int) -> np.ndarray:
        block, bits = self.header["block"], self.header["bits"]
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // block, (end - 1) // block
        rows = [unpack(self.payload[self.blocks[b] : self.blocks[b + 1]], bits, min(block, self.header["ids"] - b * block)) for b in range(first, last + 1)]
        return np.concatenate(rows)[start - first * block : end - first * block]

    def doc(self, k: int) -> np.ndarray:
        return self.range(int(self.offsets[k]), int(self.offsets[k + 1]))


SHARD_IDS = 32 << 20  # a task begins another shard when it holds so many ids


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, root: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes `docs` (doc_id, text) as shards in ascending doc_id order; returns their manifest as a written table.

    One range shuffle of the texts by id (and hash of the text, so that rows of one id or without one spread too), then
    each task encodes and writes its own range, in shards of `shard_ids` ids and the rest of a document.
    The manifest has a row for each shard: root, name, lo, tie, seq (by which they are in order), hi, docs, ids.
    """
    path = tokenizer or default_tokenizer()
    root = root or shared_dir(docs.sparkSession, "tokens")
    fields = {"root": pa.string(), "name": pa.string(), "lo": pa.int64(), "tie": pa.int64(), "seq": pa.int64(), "hi": pa.int64(), "docs": pa.int64(), "ids": pa.int64()}

    def write(batches):
        doc_ids, ends, rows, total, seq, tie = [], [np.zeros(1, np.int64)], [], 0, 0, 0
        bits = max(1, (encoder(path).vocab_size - 1).bit_length())

        def shard():
            filesystem, inner = pafs.FileSystem.from_uri(root)
            name, own = f"shard-{uuid.uuid4().hex}", np.concatenate(doc_ids)
            with filesystem.open_output_stream(f"{inner}/{name}.tmp") as out:
                write_shard(_Sink(out), own, np.concatenate(ends), np.concatenate(rows), bits)
            filesystem.move(f"{inner}/{name}.tmp", f"{inner}/{name}.bin")  # a repeated task leaves a file that no manifest names
            row = {"root": root, "name": f"{name}.bin", "lo": int(own[0]), "tie": tie, "seq": seq, "hi": int(own[-1]), "docs": len(own), "ids": total}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(list(fields.items())))

        for batch in batches:
            for part in slices(batch):
                enc = encoder(path)
                ids, offsets = with_end(*enc.encode(part.column("text")), end_id)
                if not doc_ids:
                    tie = part.column("tie")[0].as_py()
                rows.append(ids.astype(np.uint16 if enc.vocab_size <= 1 << 16 else np.uint32))
                doc_ids.append(part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                ends.append(offsets[1:] + total)
                total += len(ids)
                if total >= shard_ids:
                    yield shard()
                    doc_ids, ends, rows, total, seq = [], [np.zeros(1, np.int64)], [], 0, seq + 1
        if doc_ids:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranges = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranges.mapInArrow(write, ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in fields.items())), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards' bytes."""
    # one row a shard; the shards of a task follow one another, and the tasks' ranges of (id, hash) are disjoint
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("lo", "tie", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, inner = pafs.FileSystem.from_uri(row["root"])
                with filesystem.open_input_file(f"{inner}/{row['name']}") as source:
                    shard = Shard(source.read())
                offsets = shard.offsets
                crc = np.empty(len(shard.doc_ids), dtype=np.int64)
                step = 256  # unpack some documents at a time
                for k in range(0, len(crc), step):
                    end = min(k + step, len(crc))
                    ids = shard.range(int(offsets[k]), int(offsets[end])).astype("<u4")
                    for j in range(k, end):
                        crc[j] = zlib.crc32(ids[offsets[j] - offsets[k] : offsets[j + 1] - offsets[k]])
                doc_ids = np.asarray(shard.doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(row["start"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # the manifest's few bytes would otherwise be one task's
    return placed.select("root", "name", "start").repartition(max(1, manifest.count()), F.col("name")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, end_id=1))


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
