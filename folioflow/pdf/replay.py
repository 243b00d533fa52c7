"""Content streams: operators of a page, and their replay to text spans, characters and rules."""

from __future__ import annotations

import re

from folioflow.pdf.document import Document
from folioflow.pdf.objects import Keyword, Name, Parser, PdfError, Stream

#: Operand counts of the operators; None where they vary.
ARITY = {
    "q": 0, "Q": 0, "cm": 6, "w": 1, "J": 1, "j": 1, "M": 1, "d": 2, "ri": 1, "i": 1, "gs": 1, "m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "h": 0, "re": 4, "S": 0, "s": 0, "f": 0, "F": 0,
    "f*": 0, "B": 0, "B*": 0, "b": 0, "b*": 0, "n": 0, "W": 0, "W*": 0, "BT": 0, "ET": 0, "Tc": 1, "Tw": 1, "Tz": 1, "TL": 1, "Tf": 2, "Tr": 1, "Ts": 1, "Td": 2, "TD": 2, "Tm": 6, "T*": 0,
    "Tj": 1, "TJ": 1, "'": 1, '"': 3, "CS": 1, "cs": 1, "SC": None, "SCN": None, "sc": None, "scn": None, "G": 1, "g": 1, "RG": 3, "rg": 3, "K": 4, "k": 4, "sh": 1, "BI": None, "Do": 1,
    "MP": 1, "DP": 2, "BMC": 1, "BDC": 2, "EMC": 0, "BX": 0, "EX": 0, "d0": 2, "d1": 6,
}
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
FORM_DEPTH = 20


def operators(data: bytes):
    """(operator, operands) in order; bytes that parse as nothing are skipped; inline images come as BI."""
    p, stack = Parser(data), []
    while True:
        try:
            v = p.value()
        except EOFError:
            return
        except (PdfError, ValueError):
            p.pos += 1
            continue
        if not isinstance(v, Keyword):
            stack.append(v)
            if len(stack) > 4096:
                stack = stack[-64:]
            continue
        op = v.decode("latin-1")
        if op == "BI":
            yield "BI", [_inline(p)]
        elif op in ARITY:
            yield op, stack
        stack = []


def _inline(p: Parser) -> Stream:
    d: dict = {}
    while True:
        try:
            k = p.value()
        except EOFError:
            return Stream(d, b"")
        if isinstance(k, Keyword):
            break
        d[k] = p.value()
    start = p.pos + 1
    m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(p.data, start)
    end = m.start() if m else len(p.data)
    p.pos = m.end() if m else len(p.data)
    return Stream(d, p.data[start:end])


def valid(op: str, operands: list) -> bool:
    n = ARITY.get(op)
    return op in ARITY and (n is None or len(operands) == n)


def multiply(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def invertible(m) -> bool:
    return abs(m[0] * m[3] - m[1] * m[2]) > 1e-12


def _numbers(values) -> list[float]:
    return [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]


class State:
    __slots__ = ("ctm", "font", "size", "char", "word", "scale", "leading", "rise", "mode", "color", "space", "line_width", "dash")

    def __init__(self):
        self.ctm, self.font, self.size = IDENTITY, None, 0.0
        self.char = self.word = self.leading = self.rise = 0.0
        self.scale, self.mode, self.color, self.space, self.line_width, self.dash = 1.0, 0, (0.0, 0.0, 0.0), "DeviceGray", 1.0, ()

    def copy(self) -> State:
        s = State.__new__(State)
        for k in State.__slots__:
            setattr(s, k, getattr(self, k))
        return s


def rgb(values: list[float], space: str = "") -> tuple[float, float, float]:
    """Gray, RGB or CMYK by their number; Lab and separations roughly."""
    if space == "Lab" and len(values) == 3:
        g = max(0.0, min(1.0, values[0] / 100))
        return g, g, g
    if len(values) == 1:
        g = 1 - values[0] if space in ("Separation", "DeviceN") else values[0]
        return g, g, g
    if len(values) == 3:
        return values[0], values[1], values[2]
    if len(values) == 4:
        k = values[3]
        return tuple(1 - min(1.0, v * (1 - k) + k) for v in values[:3])
    return 0.0, 0.0, 0.0


class Replay:
    """Runs a page. `spans`, `chars` and `rules` are lists of dicts in rendering order.

    Positions are in page space (the transformation matrix applied; `use_ctm=False` leaves it out). A TJ offset
    below `space_threshold` thousandths parts the text with a blank.
    """

    def __init__(self, doc: Document, page: dict, *, use_ctm: bool = True, space_threshold: float = -120.0, want_chars: bool = False):
        self.doc, self.page, self.use_ctm, self.threshold, self.want_chars = doc, page, use_ctm, space_threshold, want_chars
        self.spans: list[dict] = []
        self.chars: list[dict] = []
        self.rules: list[dict] = []
        self.state, self.stack = State(), []
        self.tm = self.tlm = IDENTITY
        self.mcids: list[int | None] = []
        self.buffer: dict | None = None
        self.seen: set[int] = set()
        self.path: list[tuple] = []
        self.at = (0.0, 0.0)

    def run(self) -> Replay:
        self._content(self.doc.content(self.page), self.page.get("Resources"), 0)
        self._flush()
        return self

    def _content(self, data: bytes, resources, depth: int) -> None:
        resources = self.doc.resolve(resources)
        resources = resources if isinstance(resources, dict) else {}
        fonts = self.doc.fonts(resources)
        for op, args in operators(data):
            try:
                self._execute(op, args, resources, fonts, depth)
            except (IndexError, TypeError, ValueError, KeyError, OverflowError):
                continue  # wrong operands

    def _execute(self, op, args, resources, fonts, depth):
        s = self.state
        if op in ("Tj", "'", '"'):
            if op == '"':
                s.word, s.char = _numbers(args[:2])
            if op != "Tj":
                self._next_line(0.0, -s.leading)
            self._show(args[-1])
        elif op == "TJ":
            for x in args[0]:
                if isinstance(x, bytes):
                    self._show(x)
                elif isinstance(x, (int, float)):
                    if x < self.threshold:
                        self._space(-x / 1000 * s.size * s.scale)
                    self.tm = multiply((1, 0, 0, 1, -x / 1000 * s.size * s.scale, 0), self.tm)
        elif op in ("Td", "TD"):
            x, y = _numbers(args)
            if op == "TD":
                s.leading = -y
            self._next_line(x, y)
        elif op == "Tm":
            self._flush()
            self.tm = self.tlm = tuple(_numbers(args))
        elif op == "T*":
            self._next_line(0.0, -s.leading)
        elif op == "Tf":
            self._flush()
            s.font, s.size = fonts.get(args[0]), float(args[1])
        elif op in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr"):
            v = float(args[0])
            if op == "Tz":
                s.scale = v / 100
            elif op == "Tr":
                s.mode = int(v)
            else:
                setattr(s, {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise"}[op], v)
        elif op == "BT":
            self.tm = self.tlm = IDENTITY
        elif op == "ET":
            self._flush()
        elif op == "q":
            self.stack.append(s.copy())
        elif op == "Q":
            self._flush()
            if self.stack:
                self.state = self.stack.pop()
        elif op == "cm":
            self._flush()
            s.ctm = multiply(tuple(_numbers(args)), s.ctm)
        elif op in ("g", "rg", "k", "sc", "scn"):
            self._flush()
            s.color = tuple(rgb(_numbers(args), s.space if op in ("sc", "scn") else ""))
        elif op == "cs":
            s.space = self.doc.color_space(args[0]) or "DeviceGray"
            table = self.doc.resolve(resources.get("ColorSpace")) or {}
            if args[0] in table:
                s.space = self.doc.color_space(table[args[0]]) or s.space
        elif op == "w":
            s.line_width = float(args[0])
        elif op == "d":
            s.dash = tuple(_numbers(args[0]))
        elif op == "BMC":
            self._flush()
            self.mcids.append(None)
        elif op == "BDC":
            self._flush()
            props = args[1]
            if isinstance(props, Name):
                props = self.doc.resolve((self.doc.resolve(resources.get("Properties")) or {}).get(props))
            mcid = self.doc.resolve(props.get("MCID")) if isinstance(props, dict) else None
            self.mcids.append(mcid if isinstance(mcid, int) else None)
        elif op == "EMC":
            self._flush()
            if self.mcids:
                self.mcids.pop()
        elif op == "Do":
            self._form(args[0], resources, depth)
        elif op in ("m", "l", "re", "h", "S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n", "c", "v", "y"):
            self._draw(op, _numbers(args))

    # --- paths ---

    def _draw(self, op, n):
        if op == "m":
            self.at = self.start = (n[0], n[1])
        elif op == "l":
            self.path.append((*self.at, n[0], n[1]))
            self.at = (n[0], n[1])
        elif op in ("c", "v", "y"):
            self.at = (n[-2], n[-1])
        elif op == "re":
            x, y, w, h = n
            self.path += [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)]
        elif op == "h" and self.path:
            self.path.append((*self.at, *getattr(self, "start", self.at)))
        elif op not in ("m", "l", "re", "h"):
            if op != "n":
                for a, b, c, d in self.path:
                    x0, y0 = apply(self.state.ctm, a, b)
                    x1, y1 = apply(self.state.ctm, c, d)
                    gaps = self.state.dash
                    self.rules.append({"x0": min(x0, x1), "y0": min(y0, y1), "x1": max(x0, x1), "y1": max(y0, y1), "line_width": self.state.line_width, "dashed": bool(gaps) and max(gaps) > 2 * self.state.line_width, "dotted": bool(gaps) and max(gaps) <= 2 * self.state.line_width})
            self.path = []

    # --- forms ---

    def _form(self, name, resources, depth):
        ref = (self.doc.resolve(resources.get("XObject")) or {}).get(name)
        s = self.doc.resolve(ref)
        if not isinstance(s, Stream) or s.dict.get("Subtype") != "Form" or depth >= FORM_DEPTH:
            return
        key = s.owner.num if s.owner else id(s)
        if key in self.seen:
            return
        self.seen.add(key)
        self._flush()
        saved = self.state, self.stack, self.tm, self.tlm
        self.state, self.stack = self.state.copy(), []
        matrix = self.doc.resolve(s.dict.get("Matrix"))
        if isinstance(matrix, list) and len(matrix) == 6:
            self.state.ctm = multiply(tuple(_numbers(map(self.doc.resolve, matrix))), self.state.ctm)
        try:
            data = self.doc.stream_data(s)
        except PdfError:
            data = b""
        self._content(data, s.dict.get("Resources", resources), depth + 1)
        self._flush()
        self.state, self.stack, self.tm, self.tlm = saved

    # --- text ---

    def _next_line(self, x: float, y: float) -> None:
        self._flush()
        self.tlm = multiply((1, 0, 0, 1, x, y), self.tlm)
        self.tm = self.tlm

    def _matrix(self):
        return multiply(self.tm, self.state.ctm) if self.use_ctm else self.tm

    def _style(self) -> dict:
        s, m = self.state, self._matrix()
        size = abs(s.size) * ((m[2] ** 2 + m[3] ** 2) ** 0.5 or 1.0)
        font = s.font
        return {"font_name": font.base if font else "Unknown", "font_size": size, "font_weight": font.weight if font else 400, "italic": bool(font and font.italic), "color": s.color, "mcid": next((m_ for m_ in reversed(self.mcids) if m_ is not None), None)}

    def _show(self, raw) -> None:
        if not isinstance(raw, bytes) or not raw:
            return
        s, font = self.state, self.state.font
        codes = font.codes(raw) if font else list(raw)
        if self.buffer is None:
            m = self._matrix()
            x, y = apply(m, 0.0, s.rise)
            self.buffer = self._style() | {"text": "", "x": x, "y": y}
        for code in codes:
            text = font.text(code) if font else chr(code)
            advance = ((font.width(code) if font else 500.0) / 1000 * s.size + s.char + (s.word if code == 32 and not (font and font.two_byte) else 0.0)) * s.scale
            if text and not (len(text) == 1 and (ord(text) < 32 and text not in "\t\n\r" or 0x7F <= ord(text) < 0xA0)):
                self.buffer["text"] += text
                if self.want_chars:
                    self._chars(text, advance)
            self.tm = multiply((1, 0, 0, 1, advance, 0), self.tm)

    def _chars(self, text: str, advance: float) -> None:
        text = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}.get(text, text)
        m, style = self._matrix(), self._style()
        for i, c in enumerate(text):
            x, y = apply(m, advance * i / len(text), self.state.rise)
            x1, _ = apply(m, advance * (i + 1) / len(text), self.state.rise)
            self.chars.append(style | {"char": c, "x": x, "y": y, "width": x1 - x, "height": style["font_size"]})

    def _flush(self) -> None:
        b, self.buffer = self.buffer, None
        if b and b["text"]:
            x1, _ = apply(self._matrix(), 0.0, self.state.rise)
            b["width"], b["height"] = max(0.0, x1 - b["x"]), b["font_size"]
            b["sequence"] = len(self.spans)
            self.spans.append(b)

    def _space(self, width: float) -> None:
        """A wide gap inside TJ: the text so far is a span, the gap a blank one."""
        if self.buffer is None:
            return
        before = self.buffer["text"]
        self._flush()
        if before and not before.endswith(" "):
            m = self._matrix()
            x, y = apply(m, 0.0, self.state.rise)
            x1, _ = apply(m, width, 0.0)
            self.spans.append(self._style() | {"text": " ", "x": x, "y": y, "width": max(0.0, x1 - x), "height": abs(self.state.size), "sequence": len(self.spans)})
