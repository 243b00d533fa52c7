"""The reader on files made from scratch: bytes in, objects, text and features out; no Spark."""

import base64
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.pdf import crypto, filters, fonts, images, samples
from folioflow.pdf.document import Document
from folioflow.pdf.objects import Keyword, Name, Parser, PdfError, Ref, text_string, tokens
from folioflow.pdf.replay import ARITY, Replay, invertible, multiply, operators, rgb, valid


def text(data: bytes, page: int = 0) -> list[str]:
    d = Document(data)
    return [s["text"] for s in Replay(d, d.pages()[page][1]).run().spans]


@pytest.mark.parametrize("raw,value", [
    (b"12", 12), (b"+5", 5), (b"-.5", -0.5), (b"5.", 5.0), (b"true", True), (b"null", None), (b"/A#20b", Name("A b")), (b"<48 6>", b"H`"), (b"(a\\(b\\)\\n\\101(c))", b"a(b)\nA(c)"), (b"(x\\\ny)", b"xy"), (b"(\\q)", b"\\q"),
    (b"[1 2 3 0 R (s)]", [1, 2, Ref(3, 0), b"s"]), (b"<< /A 1 /B [2] % c\n /C << /D /E >> >>", {"A": 1, "B": [2], "C": {"D": "E"}}), (b"[1 2", [1, 2]), (b"<< /A 1", {"A": 1}), (b"7 0 R", Ref(7, 0)),
])
def test_parse(raw, value):
    assert Parser(raw).value() == value


def test_tokens():
    assert tokens(b"/N 1 2.5 (s) <41> [x] << >> % note\ntrue") == [("name", "N"), ("integer", "1"), ("real", "2.5"), ("string", "s"), ("hex", "41"), ("bracket", "["), ("keyword", "x"), ("bracket", "]"), ("bracket", "<<"), ("bracket", ">>"), ("keyword", "true")]


def test_stream_with_wrong_length():
    v = Parser(b"<< /Length 3 >>\nstream\nhello\nendstream").object()
    assert v.raw == b"hello"


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_filters_give_back_what_was_encoded(data):
    assert filters.decode(zlib.compress(data), ["FlateDecode"]) == data
    assert filters.decode(data.hex().encode() + b">", ["ASCIIHexDecode"]) == data
    assert filters.decode(base64.a85encode(data) + b"~>", ["A85"]) == data
    runs = b"".join(bytes((0, b)) for b in data) + b"\x80"
    assert filters.decode(runs, ["RunLengthDecode"]) == data
    assert filters.decode(base64.a85encode(zlib.compress(data)), ["ASCII85Decode", "FlateDecode"]) == data


@given(st.binary(max_size=2000))
@settings(max_examples=30, deadline=None)
def test_any_bytes_are_a_file_or_an_error(data):
    try:
        d = Document(b"%PDF-1.4\n" + data)
        for _, page in d.pages():
            Replay(d, page).run()
    except PdfError:
        pass


def lzw_encode(data: bytes) -> bytes:
    out, bits, n, width = 0, 0, 0, 9
    table, word = {bytes((i,)): i for i in range(256)}, b""
    codes = [(256, 9)]
    size = 258
    for b in data:
        c = word + bytes((b,))
        if c in table:
            word = c
            continue
        codes.append((table[word], width))
        table[c] = size
        size += 1
        width = 9 if size < 511 + 1 - 0 and size + 0 < 512 else 10 if size < 1024 else 11
        word = bytes((b,))
    if word:
        codes.append((table[word], width))
    codes.append((257, width))
    for code, w in codes:
        bits = (bits << w) | code
        n += w
    pad = -n % 8
    return (bits << pad).to_bytes((n + pad) // 8, "big")


def test_lzw():
    assert filters.lzw(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    assert filters.lzw(lzw_encode(b"abcabcabcabc")) == b"abcabcabcabc"


def test_flate_recovers_what_it_can():
    data = b"BT (some text) Tj ET " * 50
    z = zlib.compress(data)
    assert filters.flate(z[2:]) == data and filters.flate(z[2:-4]) == data
    assert data.startswith(filters.flate(z[: len(z) // 2])) and filters.flate(b"xyz" + z) == data


def test_bombs_are_refused():
    with pytest.raises(PdfError):
        filters.decode(zlib.compress(b"\0" * (200 << 20)), ["FlateDecode"])
    with pytest.raises(PdfError):
        filters.decode(b"", ["Unknown"])


def test_png_predictors():
    rng, rows, above, packed = random.Random(1), [], [0] * 6, b""
    for tag in range(5):
        row = [rng.randrange(256) for _ in range(6)]
        left, corner = [0] * 3 + row[:3], [0] * 3 + above[:3]
        guess = []
        for a, b, c in zip(left, above, corner):
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            guess.append([0, a, b, (a + b) // 2, near][tag])
        packed += bytes([tag] + [(x - g) & 255 for x, g in zip(row, guess)])
        rows.append(bytes(row))
        above = row
    assert filters.predict(packed, {"Predictor": 15, "Colors": 3, "Columns": 2}) == b"".join(rows)
    assert filters.predict(bytes([1, 2, 3, 1, 1, 1]), {"Predictor": 2, "Colors": 1, "Columns": 3}) == bytes([1, 3, 6, 1, 2, 3])


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    sealed = crypto.aes_encrypt(key, bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), iv)
    assert sealed[16:32].hex() == "7649abac8119b246cee98e9b12e9197d"
    assert crypto.aes_decrypt(key, sealed).hex() == "6bc1bee22e409f96e93d7e117393172a"


@pytest.mark.parametrize("aes", [False, True])
def test_encryption(aes):
    assert text(samples.encrypted(aes)) == ["Secret text"]
    locked = samples.encrypted(aes, b"user")
    for password in ("user", "owner"):
        d = Document(locked, password)
        assert [s["text"] for s in Replay(d, d.pages()[0][1]).run().spans] == ["Secret text"]
    with pytest.raises(PdfError) as e:
        Document(locked, "wrong")
    assert e.value.kind == "WrongPassword"


@pytest.mark.parametrize("revision", [5, 6])
def test_encryption_256(revision):
    assert text(samples.encrypted_256(revision)) == ["Strong secret"]
    locked = samples.encrypted_256(revision, b"user")
    for password in ("user", "owner"):
        d = Document(locked, password)
        assert d.security.algorithm == "AES-256" and [s["text"] for s in Replay(d, d.pages()[0][1]).run().spans] == ["Strong secret"]
    with pytest.raises(PdfError):
        Document(locked)


def test_texts():
    assert text(samples.simple()) == ["Title 1", "Hello World", "See https://example.org/x."]
    assert text(samples.kerned()) == ["Hello", " ", "World", "next", "(x)"]
    assert text(samples.mapped()) == ["Hfiabc", "é€ﬁ"]
    assert text(samples.xref_stream()) == ["Compressed objects"]
    assert text(samples.damaged(), 1)[0] == "Title 2"
    assert text(samples.pictures()) == ["inside a form"]
    assert text(samples.empty()) == []


def test_positions_and_widths():
    d = Document(samples.mapped())
    first = Replay(d, d.pages()[0][1]).run().spans[0]
    assert (first["x"], first["y"]) == (72, 700) and first["width"] == pytest.approx((600 + 700 + 3 * 250) / 100) and first["font_weight"] == 700
    d = Document(samples.pictures())
    assert [(s["x"], s["y"]) for s in Replay(d, d.pages()[0][1]).run().spans] == [(105, 205)]
    assert [(s["x"], s["y"]) for s in Replay(d, d.pages()[0][1], use_ctm=False).run().spans] == [(5, 5)]


def test_characters_split_ligatures():
    d = Document(samples.mapped())
    assert "".join(c["char"] for c in Replay(d, d.pages()[0][1], want_chars=True).run().chars) == "Hfiabcé€fi"


def test_recovery_is_off_when_strict():
    with pytest.raises(PdfError):
        Document(samples.damaged(), strict=True)
    with pytest.raises(PdfError):
        Document(b"nothing")


def test_features():
    d = Document(samples.form())
    assert {f["full_name"]: (f["field_type"], f["value_text"]) for f in d.form_fields()} == {"person.name": ("Text", "Ada | L"), "person.agree": ("Button", "Yes"), "colours": ("Choice", "red, blue")}
    d = Document(samples.linked())
    assert [(o["title"], o["depth"], o["dest_page"]) for o in d.outline()] == [("One", 0, 0), ("Ü", 1, 1), ("Two", 0, 1)]
    assert [a["uri"] for a in d.annotations()] == ["https://example.org", None] * 2
    d = Document(samples.tagged())
    assert [(e["struct_type"], e["mcid"], e["page"]) for e in d.structure() if e["mcid"] is not None] == [("H1", 0, 0), ("P", 1, 0)]
    d = Document(samples.pictures())
    raw, jpeg = d.images(d.pages()[0][1])
    assert raw["data"] == bytes(range(12)) and jpeg["kind"] == "jpeg" and jpeg["data"].startswith(b"\xff\xd8")
    assert images.to_png(raw).startswith(b"\x89PNG") and images.to_png({**raw, "data": b""}) is None


def test_circles_of_references_end():
    w, root = samples.document([b"BT ET"], objects={100: "101 0 R", 101: "100 0 R", 102: "<< /A 103 0 R >>", 103: "<< /B 102 0 R >>"})
    d = Document(w.save(root))
    assert d.load(100) == Ref(101, 0) and d.resolve(Ref(100, 0)) is None
    assert {(102, 103), (103, 102)} <= set(d.references())


def test_operators():
    assert [op for op, _ in operators(b"q 1 0 0 1 5 5 cm BI /W 1 /H 1 ID \xff\x00 EI \x01junk Q (x) Tj")] == ["q", "cm", "BI", "Q", "Tj"]
    assert valid("Tf", [Name("F"), 1]) and not valid("Tf", [1]) and not valid("xx", []) and len(ARITY) >= 60
    assert multiply((1, 0, 0, 1, 2, 3), (2, 0, 0, 2, 0, 0)) == (2, 0, 0, 2, 4, 6) and invertible((1, 0, 0, 1, 0, 0)) and not invertible((0, 0, 0, 0, 1, 1))
    assert rgb([0.5]) == (0.5, 0.5, 0.5) and rgb([0, 0, 0, 1]) == (0, 0, 0) and isinstance(Keyword(b"q"), bytes)


def test_fonts():
    assert [fonts.glyph_text(n) for n in ("A", "eacute", "Ccaron", "alpha", "Omega", "uni20AC", "u1F600", "f_i", "five", "germandbls", "nosuch")] == ["A", "é", "Č", "α", "Ω", "€", "😀", "fi", "5", "ß", None]
    assert fonts.parse_cmap(b"1 beginbfrange <20> <22> [<0041> <0042> <00660066>] endbfrange 1 beginbfchar <05> <D835DC00> endbfchar") == {32: "A", 33: "B", 34: "ff", 5: "\U0001d400"}
    assert fonts.WIN_ANSI[0x80] == "€" and fonts.MAC_ROMAN[0x8E] == "é" and fonts.STANDARD[0xAE] == "ﬁ" and fonts.SYMBOL[0x61] == "α"
    assert text_string(b"\xfe\xff\x00\xdc") == "Ü" and text_string(b"a\x80") == "a•"
