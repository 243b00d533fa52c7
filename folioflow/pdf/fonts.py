"""Encodings, glyph names and character maps; a font turns codes into text and widths."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from folioflow.pdf.objects import Keyword, Name, Parser

_PDF_DOC = {0x18: "˘", 0x19: "ˇ", 0x1A: "ˆ", 0x1B: "˙", 0x1C: "˝", 0x1D: "˛", 0x1E: "˚", 0x1F: "˜", 0xA0: "€"}
PDF_DOC = _PDF_DOC | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"))
WIN_ANSI = {b: bytes((b,)).decode("cp1252", "ignore") or "•" for b in range(32, 256)}
MAC_ROMAN = {b: bytes((b,)).decode("mac_roman") for b in range(32, 256)}
STANDARD = {b: chr(b) for b in range(32, 127)} | {0x27: "’", 0x60: "‘"} | dict(
    zip(
        (*range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, *range(0xE8, 0xEC), 0xF1, 0xF5, *range(0xF8, 0xFC)),
        "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß",
    )
)
_GREEK = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ"
SYMBOL = {b: chr(b) for b in (*range(0x30, 0x3C), 0x20, 0x21, 0x23, 0x25, 0x26, 0x28, 0x29, 0x2B, 0x2C, 0x2E, 0x2F, 0x3D, 0x3C, 0x3E, 0x3F, 0x5B, 0x5D, 0x5F, 0x7B, 0x7C, 0x7D)}
SYMBOL |= {0x41 + i: c for i, c in enumerate(_GREEK)} | {0x61 + i: c for i, c in enumerate("αβχδεφγηιϕκλμνοπθρστυϖωξψζ")}
SYMBOL |= {0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2A: "∗", 0x2D: "−", 0x40: "≅", 0x5C: "∴", 0x5E: "⊥", 0x7E: "∼", 0xA0: "€"}
SYMBOL |= dict(zip(range(0xA1, 0xFF), "ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪ 〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"))
DINGBATS = {0x20: " "} | {b: chr(0x2701 + b - 0x21) for b in range(0x21, 0x7F)} | {b: chr(0x2761 + b - 0xA1) for b in range(0xA1, 0xA8)}
DINGBATS |= dict(zip(range(0xA8, 0xAC), "♣♦♥♠")) | {b: chr(0x2460 + b - 0xAC) for b in range(0xAC, 0xB6)} | {b: chr(0x2776 + b - 0xB6) for b in range(0xB6, 0xFF)}
DINGBATS |= {0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xD5: "→", 0xD6: "↔", 0xD7: "↕"}
ENCODINGS = {"StandardEncoding": STANDARD, "WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": MAC_ROMAN, "PDFDocEncoding": {b: PDF_DOC.get(b, chr(b)) for b in range(24, 256)}}

_MARKS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "caron": "CARON", "ring": "RING ABOVE", "cedilla": "CEDILLA",
    "ogonek": "OGONEK", "macron": "MACRON", "breve": "BREVE", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "slash": "STROKE", "commaaccent": "CEDILLA", "croat": "STROKE", "dotbelow": "DOT BELOW", "hookabove": "HOOK ABOVE", "horn": "HORN",
}
_SIGNS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*",
    "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«",
    "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "Oslash": "Ø", "oslash": "ø", "florin": "ƒ", "circumflex": "ˆ",
    "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’",
    "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰",
    "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "nbspace": "\xa0",
    "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "infinity": "∞", "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "lozenge": "◊",
    "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "arrowboth": "↔", "element": "∈", "emptyset": "∅", "gradient": "∇", "existential": "∃", "universal": "∀",
    "intersection": "∩", "union": "∪", "logicaland": "∧", "logicalor": "∨", "proportional": "∝", "equivalence": "≡", "similar": "∼", "congruent": "≅", "asteriskmath": "∗", "angle": "∠", "therefore": "∴",
    "circleplus": "⊕", "circlemultiply": "⊗", "perpendicular": "⊥", "propersubset": "⊂", "propersuperset": "⊃", "reflexsubset": "⊆", "reflexsuperset": "⊇", "aleph": "ℵ", "Omega": "Ω", "Delta": "∆",
}
_DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789"))


@lru_cache(maxsize=None)
def glyph_text(name: str) -> str | None:
    """The text of a glyph name: signs, letters with marks, Greek and Cyrillic names, uniXXXX, uXXXXX; None if unknown."""
    base = name.split(".")[0] or name
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    if base in _SIGNS:
        return _SIGNS[base]
    if base in _DIGITS:
        return _DIGITS[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", base):
        return bytes.fromhex(m.group(1)).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", base):
        return chr(int(m.group(1), 16)) if int(m.group(1), 16) < 0x110000 else None
    case = lambda s: "CAPITAL" if s[0].isupper() else "SMALL"
    for mark, words in _MARKS.items():
        if base.endswith(mark) and len(base) - len(mark) == 1:
            try:
                return unicodedata.lookup(f"LATIN {case(base)} LETTER {base[0].upper()} WITH {words}")
            except KeyError:
                pass
    for script in ("GREEK", "CYRILLIC"):
        for suffix, words in (("tonos", " WITH TONOS"), ("dieresis", " WITH DIALYTIKA"), ("cyrillic", ""), ("", "")):
            stem = base[: len(base) - len(suffix)] if suffix and base.endswith(suffix) else base if not suffix else ""
            if stem:
                try:
                    return unicodedata.lookup(f"{script} {case(stem)} LETTER {stem.upper()}{words}")
                except KeyError:
                    pass
    return None


def parse_cmap(data: bytes, most: int = 10_000) -> dict[int, str]:
    """Codes to text of a ToUnicode map: single characters, ranges, ranges with lists."""
    out: dict[int, str] = {}
    p, stack = Parser(data), []
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    while True:
        try:
            v = p.value()
        except EOFError:
            return out
        if not isinstance(v, Keyword):
            stack.append(v)
            continue
        if v == b"endbfchar":
            items = [x for x in stack if isinstance(x, bytes)]
            for a, b in zip(items[::2], items[1::2]):
                out[int.from_bytes(a, "big")] = text(b)
        elif v == b"endbfrange":
            items = [x for x in stack if isinstance(x, (bytes, list))]
            for a, b, c in zip(items[::3], items[1::3], items[2::3]):
                if isinstance(a, list) or isinstance(b, list):
                    continue
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                if hi < lo or hi - lo >= most:
                    continue
                if isinstance(c, list):
                    for i, x in enumerate(c[: hi - lo + 1]):
                        if isinstance(x, bytes):
                            out[lo + i] = text(x)
                else:
                    n = int.from_bytes(c, "big")
                    for i in range(hi - lo + 1):
                        out[lo + i] = text((n + i).to_bytes(len(c), "big"))
        stack = []


class Font:
    """What a page's font resource says: text and width of every code."""

    def __init__(self, doc, resource: dict, name: str):
        get = lambda d, k, default=None: default if (v := doc.resolve(d.get(k))) is None else v
        self.name = name
        self.subtype = str(get(resource, "Subtype", ""))
        self.base = str(get(resource, "BaseFont", name))
        self.two_byte = self.subtype == "Type0"
        inner = resource
        if self.two_byte:
            kids = get(resource, "DescendantFonts", [])
            inner = doc.resolve(kids[0]) if kids else {}
            inner = inner if isinstance(inner, dict) else {}
        descriptor = get(inner, "FontDescriptor", {})
        descriptor = descriptor if isinstance(descriptor, dict) else {}
        self.flags = int(get(descriptor, "Flags", 0) or 0)
        self.stem_v = get(descriptor, "StemV")
        self.explicit_weight = get(descriptor, "FontWeight")
        self.first = int(get(inner, "FirstChar", 0) or 0)
        low = self.base.lower()
        mono = bool(self.flags & 1) or "courier" in low or "mono" in low
        self.default = float(get(inner, "DW", 1000)) if self.two_byte else float(get(descriptor, "MissingWidth", 0) or (600 if mono else 500 if self.flags & 2 else 550))
        self.widths: dict[int, float] = {}
        if self.two_byte:
            self._wide(doc, get(inner, "W", []))
        else:
            self.widths = {self.first + i: float(w) for i, w in enumerate(map(doc.resolve, get(resource, "Widths", []))) if isinstance(w, (int, float))}
        self.cmap: dict[int, str] = {}
        to_unicode = get(resource, "ToUnicode")
        if hasattr(to_unicode, "raw"):
            try:
                self.cmap = parse_cmap(doc.stream_data(to_unicode))
            except ValueError:
                pass
        self.encoding_name, self.encoding = self._encoding(doc, get(resource, "Encoding"))
        self.symbols = SYMBOL if "symbol" in low else DINGBATS if "dingbat" in low else None

    def _wide(self, doc, w) -> None:
        i = 0
        while i + 1 < len(w):
            a, b = doc.resolve(w[i]), doc.resolve(w[i + 1])
            if isinstance(b, list):
                self.widths |= {a + k: float(doc.resolve(x)) for k, x in enumerate(b)}
                i += 2
            elif i + 2 < len(w):
                self.widths |= {k: float(doc.resolve(w[i + 2])) for k in range(a, min(b, a + 65535) + 1)}
                i += 3
            else:
                break

    def _encoding(self, doc, e) -> tuple[str, dict[int, str]]:
        if isinstance(e, Name):
            if e.startswith("Identity"):
                return "Identity", {}
            return str(e), ENCODINGS.get(e, STANDARD)
        if isinstance(e, dict):
            table, code = dict(ENCODINGS.get(doc.resolve(e.get("BaseEncoding")), STANDARD)), 0
            for x in map(doc.resolve, doc.resolve(e.get("Differences")) or []):
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    if (t := glyph_text(x)) is not None:
                        table[code] = t
                    code += 1
            return "Custom", table
        return "Standard", STANDARD

    def text(self, code: int) -> str | None:
        """ToUnicode, then symbol tables, then the encoding, then the code as a character."""
        if (t := self.cmap.get(code)) and t != "�":
            return t
        if self.symbols and code in self.symbols:
            return self.symbols[code]
        if code in self.encoding:
            return self.encoding[code]
        return None if self.two_byte and not self.cmap and not self.encoding_name == "Identity" else fallback(code)

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default)

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.two_byte else list(raw)

    @property
    def weight(self) -> int:
        if isinstance(self.explicit_weight, (int, float)) and self.explicit_weight:
            return int(self.explicit_weight)
        low = self.base.lower()
        if self.flags & (1 << 18):
            return 700
        for pattern, weight in (("black|heavy", 900), ("(ultra|extra)-?bold", 800), ("semi-?bold|demi", 600), ("bold", 700), ("medium", 500), ("(ultra|extra)-?light", 200), ("thin|hairline", 100), ("light", 300)):
            if re.search(pattern, low):
                return weight
        stem = self.stem_v if isinstance(self.stem_v, (int, float)) else 0
        return 700 if stem > 110 else 500 if stem >= 80 else 400

    @property
    def italic(self) -> bool:
        return bool(self.flags & 64) or bool(re.search("italic|oblique", self.base.lower()))


def fallback(code: int) -> str | None:
    """A code without a mapping: the Windows punctuation from 128 to 159, else printable code points as they are."""
    if 0x80 <= code < 0xA0:
        return WIN_ANSI.get(code)
    if code < 32 or 0xD800 <= code < 0xE000 or code > 0x10FFFF or code == 0x7F:
        return None
    return chr(code)
