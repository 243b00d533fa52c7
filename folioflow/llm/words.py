"""Words of whole texts and their hashes, vectorised over the bytes of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 18
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser over 64-bit words; different salts give unrelated functions."""
    h = h ^ _U((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


@lru_cache(maxsize=1)
def _tables():
    rng = np.random.default_rng(20240229)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    folded = letters.copy()
    folded[ord("A") : ord("Z") + 1] = letters[ord("a") : ord("z") + 1]
    return letters, folded


@lru_cache(maxsize=2)
def _powers(n: int):
    inverse = pow(_B, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n, _B, dtype=np.uint64)
        up[0] = 1
        down = np.full(n, inverse, dtype=np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _span_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    letters, folded = _tables()
    n = len(piece)
    up, down = _powers(max(SEGMENT + (1 << 16), 1 << (n + 1).bit_length()) if n > SEGMENT else SEGMENT + (1 << 16))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((folded if lower else letters)[piece] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts], 1)


def _cut(raw: np.ndarray, start: int, separator: np.ndarray) -> int:
    """End of the segment that begins at `start`: after a separator, or the end of the bytes."""
    end = start + SEGMENT
    if end >= len(raw):
        return len(raw)
    near = np.flatnonzero(separator[raw[max(start, end - 65536) : end]])
    if len(near):
        return max(start, end - 65536) + int(near[-1]) + 1
    while end < len(raw):
        near = np.flatnonzero(separator[raw[end : end + 65536]])
        if len(near):
            return end + int(near[0]) + 1
        end += 65536
    return len(raw)


def spans(raw: np.ndarray, offsets: np.ndarray, *, separator: np.ndarray = _SPACE, lower: bool = False, classes: np.ndarray | None = None):
    """Maximal runs of bytes that aren't separators, within each row; with `classes`, runs of one
    class (0 separates, 2 is never joined).

    Returns starts, ends (bytes), hashes (uint64) and the n+1 offsets of each row's runs.
    Segments of a quarter of a megabyte bound the memory, whatever a text's length; a segment ends
    after a separator.
    """
    all_s, all_e, all_h = [], [], []
    start = 0
    while start < len(raw):
        end = _cut(raw, start, separator)
        piece = raw[start:end]
        gap = separator[piece]
        before = np.empty(len(piece), dtype=bool)
        before[0] = True
        before[1:] = gap[:-1]
        first, last = np.searchsorted(offsets, [start, end])
        rows = offsets[first:last]
        before[rows[rows < end] - start] = True
        if classes is not None:
            kind = classes[piece]
            before[1:] |= kind[1:] != kind[:-1]
            before |= kind == 2
        opens = ~gap & before
        after = np.empty(len(piece), dtype=bool)
        after[-1] = True
        after[:-1] = before[1:]
        after[:-1] |= gap[1:]
        s = np.flatnonzero(opens)
        e = np.flatnonzero(~gap & after) + 1
        all_h.append(_span_hashes(piece, s, e, lower))
        all_s.append(s + start)
        all_e.append(e + start)
        start = end
    if not all_s:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    s = np.concatenate(all_s)
    return s, np.concatenate(all_e), np.concatenate(all_h), np.searchsorted(s, offsets)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row and the rows' offsets, as `spans` finds them, without hashes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = raw - np.uint8(9) > 4
    word &= raw != 0x20
    edge = np.empty(len(raw) + 1, dtype=bool)  # the byte before isn't of the same word
    edge[0] = edge[-1] = True
    np.logical_not(word[:-1], out=edge[1:-1])
    edge[offsets] = True
    s = np.flatnonzero(word & edge[:-1])
    edge[1:-1] = ~word[1:]
    edge[offsets] = True
    e = np.flatnonzero(word & edge[1:]) + 1
    return s, e, np.searchsorted(s, offsets)


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


LONG = 64  # bytes from which on a word's hash is that of its bytes' polynomial
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each s to its e (one byte at least), eight bytes a step; other ones than those of `spans`."""
    if not len(s):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), np.uint64, padded, 0, (1,))  # the eight bytes from each place on
    n = e - s
    with np.errstate(over="ignore"):
        h = mix((eight[s] & _LOW_BYTES[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _U(_B)), 2)
        long = n > LONG
        rest = np.flatnonzero((n > 8) & ~long)
        for k in range(8, LONG, 8):
            if not len(rest):
                break
            h[rest] = mix(h[rest] + (eight[s[rest] + k] & _LOW_BYTES[np.minimum(n[rest] - k, 8)]) * _U(_B), 3)
            rest = rest[n[rest] > k + 8]
        if long.any():
            own = np.flatnonzero(long)
            off = np.concatenate([[0], np.cumsum(n[own])])
            b = 0
            while b < len(own):
                a, b = b, max(b + 1, int(np.searchsorted(off, off[b] + SEGMENT, side="right")) - 1)
                h[own[a:b]] = mix(_span_hashes(raw[take_ranges(s[own[a:b]], n[own[a:b]])], off[a:b] - off[a], off[a + 1 : b + 1] - off[a], False), 4)
    return h


_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True


def lines(raw: np.ndarray, offsets: np.ndarray):
    r"""Lines between \n that hold at least one byte: starts, ends, hashes and the rows' offsets."""
    return spans(raw, offsets, separator=_NEWLINE)


def shingles(h: np.ndarray, word_off: np.ndarray, k: int):
    """Hashes of k consecutive words of each row and the rows' offsets; a row of fewer words gives its whole sequence."""
    counts = np.diff(word_off)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_off = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(out_off[-1], dtype=np.uint64)
    if len(h) >= k:
        c = _U(0x9FB21C651E98DF25)
        total = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            total = total * c + h[j : len(h) - k + 1 + j]
        total = mix(total, k)
        full = np.flatnonzero(counts >= k)
        if len(full):
            src = np.repeat(word_off[full] - np.concatenate([[0], np.cumsum(n[full])])[:-1], n[full]) + np.arange(n[full].sum())
            dst = np.repeat(out_off[full] - np.concatenate([[0], np.cumsum(n[full])])[:-1], n[full]) + np.arange(n[full].sum())
            out[dst] = total[src]
    for row in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        value = 0
        for x in h[word_off[row] : word_off[row + 1]].tolist():
            value = (value * 0x9FB21C651E98DF25 + x) & _MASK
        out[out_off[row]] = mix(np.array([value], dtype=np.uint64), int(counts[row]))[0]
    return out, out_off


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one after another."""
    total = int(lengths.sum())
    before = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return np.repeat(starts - before, lengths) + np.arange(total)


def sorting(keys: np.ndarray) -> np.ndarray:
    """An order that sorts keys (uint64, hashes) by their upper bits; few keys are sorted with their places in the lower ones."""
    bits = max(1, (len(keys) - 1).bit_length()) if len(keys) else 1
    if bits > 20:
        return np.argsort(keys)
    mask = np.uint64((1 << bits) - 1)
    both = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & mask).astype(np.int64)


class Grouped:
    """Hashed keys (uint64) by key and row, from one sort; `row` ascends.

    keys: the distinct keys in order. Of each (key, row): key (its number), at (a place), size. number: the group of each place.
    """

    def __init__(self, keys: np.ndarray, row: np.ndarray):
        n = len(keys)
        order = sorting(keys) if n <= 1 << 20 else np.argsort(keys, kind="stable")
        ordered = keys[order]
        apart = ordered[1:] ^ ordered[:-1]
        if n <= 1 << 20 and ((apart != 0) & (apart < 1 << 20)).any():  # may be told apart by bits that didn't sort
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            apart = ordered[1:] ^ ordered[:-1]
        new_key, new = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_key[1:] = apart != 0
        rows = row[order]
        new[1:] = new_key[1:] | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        self.keys = ordered[new_key]
        self.key = np.cumsum(new_key[at]) - 1
        self.at = order[at]
        self.size = np.diff(np.append(at, n))
        self.number = np.empty(n, dtype=np.int64)
        self.number[order] = np.repeat(np.arange(len(at)), self.size)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashed keys: a place for each distinct one, the number of each key's group, and the groups' sizes."""
    order = sorting(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], number, np.diff(np.append(at, len(keys)))
