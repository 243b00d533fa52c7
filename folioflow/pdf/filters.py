"""Stream filters and predictors. Limits against decompression bombs always hold."""

from __future__ import annotations

import re
import zlib

import numpy as np

from folioflow.pdf.objects import PdfError

MOST_BYTES = 100 << 20
MOST_RATIO = 100
SLACK = 1 << 20


def _guard(out: int, source: int) -> None:
    if out > MOST_BYTES or out > SLACK + MOST_RATIO * max(source, 1):
        raise PdfError("DecompressionLimit", f"{out} bytes of {source}")


def _inflate(data: bytes, wbits: int) -> tuple[bytes, bool]:
    d, out, total, complete = zlib.decompressobj(wbits), [], 0, False
    rest = data
    try:
        while rest and not d.eof:
            part = d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
            if not part and not rest:
                break
            out.append(part)
            total += len(part)
            _guard(total, len(data))
        complete = d.eof
        out.append(d.flush())
    except zlib.error:
        pass
    return b"".join(out), complete


def flate(data: bytes) -> bytes:
    """Inflates; of damaged data what can be had: with the zlib header, without, after it, from some offset."""
    best = b""
    tries = [(data, 15), (data, -15), (data[2:], -15), *[(data[k:], -15) for k in range(3, 21)], *[(data[k:], 15) for k in range(1, 21)]]
    for part, wbits in tries:
        out, complete = _inflate(part, wbits)
        if complete:
            return out
        if len(out) > len(best):
            best = out
        if best and part is data and wbits == 15:
            return best  # a cut off stream: its beginning is good
    if best or not data:
        return best
    raise PdfError("FlateError")


def lzw(data: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, total = [], 0
    width, buffer, bits, previous = 9, 0, 0, None

    def reset():
        nonlocal table, width, previous
        table = [bytes((i,)) for i in range(256)] + [b"", b""]
        width, previous = 9, None

    reset()
    for byte in data:
        buffer, bits = (buffer << 8) | byte, bits + 8
        while bits >= width:
            code = (buffer >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            buffer &= (1 << bits) - 1
            if code == 256:
                reset()
                continue
            if code == 257:
                return b"".join(out)
            if previous is None:
                entry = table[code] if code < len(table) else b""
            elif code < len(table):
                entry = table[code]
                table.append(previous + entry[:1])
            else:
                entry = previous + previous[:1]
                table.append(entry)
            out.append(entry)
            total += len(entry)
            _guard(total, len(data))
            previous = entry
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    if data.lstrip().startswith(b"<~"):
        data = data.lstrip()[2:]
    for c in data:
        if c == 126:
            break
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                v = 0
                for g in group:
                    v = v * 85 + g
                out += (v & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        v = 0
        for g in group + [84] * (5 - n):
            v = v * 85 + g
        out += (v & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        _guard(len(out), len(data))
    return bytes(out)


def predict(data: bytes, params: dict) -> bytes:
    kind = params.get("Predictor", 1)
    if kind == 1 or not isinstance(kind, int):
        return data
    colors, bits, columns = (int(params.get(k, d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    width, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if kind == 2:
        if bits != 8:
            return data
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[len(data) // width * width :]
    out, above = [], np.zeros(width, np.uint8)
    for at in range(0, len(data), width + 1):
        tag, row = data[at], np.frombuffer(data[at + 1 : at + 1 + width].ljust(width, b"\0"), np.uint8).copy()
        if tag == 1:
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step], dtype=np.uint8)
        elif tag == 2:
            row += above
        elif tag in (3, 4):
            line, up = row.tolist(), above.tolist()
            for i in range(width):
                a, b, c = (line[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if tag == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = (line[i] + guess) & 255
            row = np.array(line, np.uint8)
        above = row
        out.append(row.tobytes())
    return b"".join(out)


SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}
IMAGES = ("DCTDecode", "CCITTFaxDecode", "JBIG2Decode", "JPXDecode")


def decode(data: bytes, filters: list[str], params: list[dict] | None = None) -> bytes:
    """Filters in order, each with its predictor; image codecs pass through; an unknown filter is an error."""
    params = params or []
    for k, name in enumerate(filters):
        name = SHORT.get(name, name)
        own = params[k] if k < len(params) and isinstance(params[k], dict) else {}
        if name == "FlateDecode":
            data = predict(flate(data), own)
        elif name == "LZWDecode":
            data = predict(lzw(data, own.get("EarlyChange", 1)), own)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name not in IMAGES and name != "Crypt":
            raise PdfError("UnsupportedFilter", name)
        _guard(len(data), MOST_BYTES)
    return data
