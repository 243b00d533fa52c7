"""Lexer and object parser over bytes. Values: None, bool, int, float, bytes (strings), Name, list, dict, Ref, Stream."""

from __future__ import annotations

import re
from typing import NamedTuple

SPACE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12, ord("("): 40, ord(")"): 41, ord("\\"): 92}
MAX_DEPTH = 100


class Name(str):
    __slots__ = ()


class Keyword(bytes):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    __slots__ = ("dict", "raw", "owner")

    def __init__(self, dict_: dict, raw: bytes, owner: Ref | None = None):
        self.dict, self.raw, self.owner = dict_, raw, owner


class PdfError(ValueError):
    """A file or object that can't be read; `kind` goes to the error_kind column."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


class Parser:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def literal(self) -> bytes:
        data, i, depth, out = self.data, self.pos + 1, 1, bytearray()
        n = len(data)
        while i < n:
            c = data[i]
            if c == 92 and i + 1 < n:
                i += 1
                e = data[i]
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 48 <= e <= 55:
                    j = i
                    while j < i + 3 and j < n and 48 <= data[j] <= 55:
                        j += 1
                    out.append(int(data[i:j], 8) & 255)
                    i = j - 1
                elif e == 13:
                    if i + 1 < n and data[i + 1] == 10:
                        i += 1
                elif e != 10:
                    out += bytes((92, e))  # unknown escapes stay as they are
            elif c == 40:
                depth += 1
                out.append(c)
            elif c == 41:
                depth -= 1
                if not depth:
                    self.pos = i + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.pos = n
        return bytes(out)

    def hex(self) -> bytes:
        end = self.data.find(b">", self.pos)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.pos + 1 : end])
        self.pos = end + 1
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def name(self) -> Name:
        m = _WORD.match(self.data, self.pos + 1)
        raw = m.group() if m else b""
        self.pos = m.end() if m else self.pos + 1
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x.group(1).decode()), raw)
        try:
            return Name(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return Name(raw.decode("latin-1"))

    def value(self, depth: int = 0):
        """The next object or Keyword; raises EOFError at the end."""
        self.skip()
        data, pos = self.data, self.pos
        if pos >= len(data):
            raise EOFError
        if depth > MAX_DEPTH:
            raise PdfError("RecursionLimit")
        c = data[pos : pos + 1]
        if c == b"/":
            return self.name()
        if c == b"(":
            return self.literal()
        if c == b"<":
            if data[pos + 1 : pos + 2] == b"<":
                self.pos += 2
                return self.dictionary(depth)
            return self.hex()
        if c == b"[":
            self.pos += 1
            out = []
            while True:
                self.skip()
                if self.pos >= len(data):
                    return out
                if data[self.pos : self.pos + 1] == b"]":
                    self.pos += 1
                    return out
                v = self.value(depth + 1)
                if isinstance(v, Keyword):
                    if v in (b"endobj", b"endstream"):
                        return out
                    continue
                out.append(v)
        m = _NUMBER.match(data, pos)
        if m:
            self.pos = m.end()
            text = m.group()
            if b"." in text:
                return float(text)
            number = int(text)
            r = _REF.match(data, self.pos) if number >= 0 else None
            if r:
                self.pos = r.end()
                return Ref(number, int(r.group(1)))
            return number
        m = _WORD.match(data, pos)
        if not m:
            self.pos += 2 if data[pos : pos + 2] == b">>" else 1
            return Keyword(data[pos : self.pos])
        self.pos = m.end()
        word = m.group()
        if word == b"true":
            return True
        if word == b"false":
            return False
        if word == b"null":
            return None
        return Keyword(word)

    def dictionary(self, depth: int = 0) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.pos >= len(self.data):
                return out
            if self.data[self.pos : self.pos + 2] == b">>":
                self.pos += 2
                return out
            key = self.value(depth + 1)
            if isinstance(key, Keyword) and key in (b"endobj", b"stream"):
                self.pos -= len(key)
                return out
            if not isinstance(key, Name):
                continue
            try:
                v = self.value(depth + 1)
            except EOFError:
                return out
            if isinstance(v, Keyword):
                if v == b">>":
                    return out
                continue
            out[key] = v

    def object(self, length=lambda v: v if isinstance(v, int) else None):
        """A value, with the stream that follows a dictionary; `length` resolves /Length."""
        v = self.value()
        if not isinstance(v, dict):
            return v
        after = self.pos
        self.skip()
        if self.data[self.pos : self.pos + 6] != b"stream":
            self.pos = after
            return v
        self.pos += 6
        if self.data[self.pos : self.pos + 2] == b"\r\n":
            self.pos += 2
        elif self.data[self.pos : self.pos + 1] in (b"\n", b"\r"):
            self.pos += 1
        start, n = self.pos, length(v.get("Length"))
        if n is not None and 0 <= n <= len(self.data) - start:
            tail = _SKIP.match(self.data, start + n).end()
            if self.data[tail : tail + 9] == b"endstream":
                self.pos = tail + 9
                return Stream(v, self.data[start : start + n])
        end = self.data.find(b"endstream", start)
        end = len(self.data) if end < 0 else end
        self.pos = min(end + 9, len(self.data))
        raw = self.data[start:end]
        if raw.endswith(b"\r\n"):
            raw = raw[:-2]
        elif raw[-1:] in (b"\n", b"\r"):
            raw = raw[:-1]
        return Stream(v, raw)


def tokens(data: bytes) -> list[tuple[str, str]]:
    """(kind, text) of every token; containers come as their brackets."""
    p, out = Parser(data), []
    while True:
        p.skip()
        if p.pos >= len(data):
            return out
        two, one = data[p.pos : p.pos + 2], data[p.pos : p.pos + 1]
        if two in (b"<<", b">>") or one in (b"[", b"]", b"{", b"}"):
            n = 2 if two in (b"<<", b">>") else 1
            out.append(("bracket", data[p.pos : p.pos + n].decode()))
            p.pos += n
            continue
        if one == b"/":
            out.append(("name", str(p.name())))
        elif one == b"(":
            out.append(("string", p.literal().decode("latin-1")))
        elif one == b"<":
            out.append(("hex", p.hex().hex()))
        else:
            m = _NUMBER.match(data, p.pos)
            w = _WORD.match(data, p.pos)
            if m and (not w or m.end() == w.end()):
                p.pos = m.end()
                out.append(("real" if b"." in m.group() else "integer", m.group().decode()))
            elif w:
                p.pos = w.end()
                out.append(("keyword", w.group().decode("latin-1")))
            else:
                p.pos += 1


def text_string(raw: bytes) -> str:
    """A text string: UTF-16BE or UTF-8 by its mark, else PDFDocEncoding."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    from folioflow.pdf.fonts import PDF_DOC

    return "".join(PDF_DOC.get(b, chr(b)) for b in raw)
