"""Raw image samples to PNG, and CMYK samples to RGB."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def cmyk_to_rgb(data: bytes) -> bytes:
    """(1 - c)(1 - k) for each component."""
    v = np.frombuffer(data[: len(data) // 4 * 4], np.uint8).reshape(-1, 4).astype(np.uint32)
    return ((255 - v[:, :3]) * (255 - v[:, 3:]) // 255).astype(np.uint8).tobytes()


COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "Indexed": 1, "Separation": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4}


def to_png(image: dict) -> bytes | None:
    """A PNG of a raw image of 1 or 8 bits; None for what has too few samples."""
    width, height, bits = image["width"], image["height"], image["bpc"]
    data = image["data"]
    n = COMPONENTS.get(image["color_space"] or "DeviceGray") or (len(data) // max(1, width * height) or 1)
    if n == 4:
        data, n = cmyk_to_rgb(data), 3
    if n not in (1, 3) or bits not in (1, 8):
        return None
    row = (width * n * bits + 7) // 8
    if not width or not height or len(data) < row * height:
        return None
    raw = b"".join(b"\0" + data[i * row : (i + 1) * row] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, 0 if n == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
