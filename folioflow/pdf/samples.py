"""Small PDF files made from scratch, one for each feature of the reader; for tests and the smoke query."""

from __future__ import annotations

import hashlib
import os
import zlib

from folioflow.pdf.crypto import PAD, Security, aes_encrypt, rc4, strong_hash


class Writer:
    def __init__(self):
        self.objects: dict[int, bytes] = {}

    def add(self, body: bytes | str, num: int | None = None) -> int:
        num = num or len(self.objects) + 1
        self.objects[num] = body.encode("latin-1") if isinstance(body, str) else body
        return num

    def stream(self, data: bytes, entries: str = "", num: int | None = None, flate: bool = True) -> int:
        raw = zlib.compress(data) if flate else data
        return self.add(b"<< /Length %d %s%s >>\nstream\n" % (len(raw), b"/Filter /FlateDecode " if flate else b"", entries.encode("latin-1")) + raw + b"\nendstream", num)

    def save(self, root: int, extra: str = "", xref: bool = True) -> bytes:
        out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        for num, body in sorted(self.objects.items()):
            offsets[num] = len(out)
            out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
        start, size = len(out), max(self.objects) + 1
        if xref:
            out += b"xref\n0 %d\n0000000000 65535 f \n" % size
            for num in range(1, size):
                out += b"%010d 00000 n \n" % offsets[num] if num in offsets else b"0000000000 00000 f \n"
        out += f"trailer\n<< /Size {size} /Root {root} 0 R {extra} >>\nstartxref\n{start}\n%%EOF\n".encode("latin-1")
        return bytes(out)


FONT = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
BOLD = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>"


def document(contents: list[bytes], *, catalog: str = "", page: str = "", objects: dict[int, bytes | str] | None = None, resources: str = "") -> tuple[Writer, int]:
    """Objects 1 catalog, 2 pages, 3 and 4 fonts, then a page and its content in turn; own ones from 100 on."""
    w, n = Writer(), len(contents)
    w.add(f"<< /Type /Catalog /Pages 2 0 R {catalog} >>", 1)
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(n))
    w.add(f"<< /Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> {resources} >> >>", 2)
    w.add(FONT, 3)
    w.add(BOLD, 4)
    for i, data in enumerate(contents):
        w.add(f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R {page} >>", 10 + 2 * i)
        w.stream(data, num=11 + 2 * i)
    for num, body in (objects or {}).items():
        w.add(body, num)
    return w, 1


def text_page(lines: list[str], size: int = 12, bold_first: bool = True) -> bytes:
    out = ["BT"]
    for i, line in enumerate(lines):
        shown = line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
        first = bold_first and i == 0
        out.append(f"/{'F2' if first else 'F1'} {24 if first else size} Tf 1 0 0 1 72 {720 - 20 * i} Tm ({shown}) Tj")
    return ("\n".join(out) + "\nET").encode("latin-1")


def simple(pages: int = 1) -> bytes:
    w, root = document([text_page([f"Title {i + 1}", "Hello World", "See https://example.org/x."]) for i in range(pages)])
    return w.save(root)


def kerned() -> bytes:
    w, root = document([b"BT /F1 10 Tf 72 700 Td [(He) 20 (llo) -300 (Wor) 10 (ld)] TJ 0 -14 Td (next) ' T* (\\050x\\051) Tj ET"])
    return w.save(root)


def xref_stream() -> bytes:
    """Objects in an object stream, found by a cross reference stream with a PNG predictor."""
    members = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [10 0 R] /Count 1 /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>", 3: FONT.encode(), 10: b"<< /Type /Page /Parent 2 0 R /Contents 11 0 R >>"}
    head, body = "", b""
    for num, data in members.items():
        head += f"{num} {len(body)} "
        body += data + b" "
    out, offsets = bytearray(b"%PDF-1.5\n"), {}

    def put(num, entries, data):
        raw = zlib.compress(data)
        offsets[num] = len(out)
        out.extend(b"%d 0 obj\n<< /Length %d /Filter /FlateDecode %s >>\nstream\n" % (num, len(raw), entries.encode()) + raw + b"\nendstream\nendobj\n")

    put(20, f"/Type /ObjStm /N {len(members)} /First {len(head)}", head.encode() + body)
    put(11, "", b"BT /F1 12 Tf 72 700 Td (Compressed objects) Tj ET")
    rows = [bytes(4)] * 22
    for i, num in enumerate(members):
        rows[num] = bytes((2, 0, 20, i))
    for num in (20, 11):
        rows[num] = bytes((1,)) + offsets[num].to_bytes(2, "big") + b"\0"
    rows[21] = bytes((1,)) + len(out).to_bytes(2, "big") + b"\0"
    above, packed = bytes(4), b""
    for row in rows:
        packed += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above))
        above = row
    start = len(out)
    put(21, "/Type /XRef /Size 22 /W [1 2 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>", packed)
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


def damaged() -> bytes:
    data = simple(2)
    return data[: data.rindex(b"xref\n0")] + b"xref\n0 9\ngarbage\nstartxref\n99999999\n%%EOF"


def tagged() -> bytes:
    content = b"/P << /MCID 1 >> BDC BT /F1 12 Tf 72 700 Td (second) Tj ET EMC /H1 << /MCID 0 >> BDC BT /F2 18 Tf 72 650 Td (first) Tj ET EMC BT /F1 9 Tf 72 60 Td (loose) Tj ET"
    objects = {
        100: "<< /Type /StructTreeRoot /K [101 0 R] /RoleMap << /Titel /H1 >> >>",
        101: "<< /Type /StructElem /S /Document /K [102 0 R 103 0 R] >>",
        102: "<< /Type /StructElem /S /Titel /Pg 10 0 R /K 0 >>",
        103: "<< /Type /StructElem /S /P /Pg 10 0 R /K [<< /Type /MCR /MCID 1 >>] >>",
    }
    w, root = document([content], catalog="/StructTreeRoot 100 0 R /MarkInfo << /Marked true >>", objects=objects)
    return w.save(root)


def form() -> bytes:
    objects = {
        100: "<< /Fields [101 0 R 104 0 R] >>",
        101: "<< /T (person) /Kids [102 0 R 103 0 R] >>",
        102: "<< /T (name) /FT /Tx /V (Ada | L) /TU (full name) /Rect [10 10 90 30] >>",
        103: "<< /T (agree) /FT /Btn /V /Yes /Rect [10 40 20 50] >>",
        104: "<< /T (colours) /FT /Ch /V [(red) (blue)] /Rect [0 0 1 1] >>",
    }
    w, root = document([text_page(["Form"])], catalog="/AcroForm 100 0 R", objects=objects)
    return w.save(root)


def linked() -> bytes:
    objects = {
        100: "<< /First 101 0 R /Last 103 0 R /Count 3 >>",
        101: "<< /Title (One) /Dest [10 0 R /Fit] /First 102 0 R /Next 103 0 R >>",
        102: "<< /Title <FEFF00DC> /A << /S /GoTo /D [12 0 R /XYZ 0 0 0] >> /Parent 101 0 R >>",
        103: "<< /Title (Two) /Dest (chapter2) /Prev 101 0 R >>",
        104: "<< /Names [(chapter2) [12 0 R /Fit]] >>",
        105: "<< /Type /Annot /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (https://example.org) >> >>",
        106: "<< /Type /Annot /Subtype /Text /Rect [5 6 7 8] /Contents (note) /T (me) /CreationDate (D:20240101120000Z) >>",
    }
    w, root = document([text_page(["A"]), text_page(["B"])], catalog="/Outlines 100 0 R /Names << /Dests 104 0 R >>", page="/Annots [105 0 R 106 0 R]", objects=objects)
    return w.save(root)


def pictures() -> bytes:
    w, root = document([b"q 10 0 0 10 0 0 cm /I1 Do Q q /I2 Do Q /X1 Do"], resources="/XObject << /I1 100 0 R /I2 101 0 R /X1 102 0 R >>")
    w.stream(bytes(range(12)), "/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB", 100)
    w.stream(b"\xff\xd8fake jpeg\xff\xd9", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /DCTDecode", 101, flate=False)
    w.stream(b"BT /F1 8 Tf 5 5 Td (inside a form) Tj ET", "/Type /XObject /Subtype /Form /BBox [0 0 100 100] /Matrix [1 0 0 1 100 200] /Resources << /Font << /F1 3 0 R >> >>", 102)
    return w.save(root)


def mapped() -> bytes:
    cmap = b"/CIDInit /ProcSet findresource begin 2 beginbfchar <0001> <0048> <0002> <00660069> endbfchar 1 beginbfrange <0003> <0005> <0061> endbfrange end"
    objects: dict[int, bytes | str] = {
        100: "<< /Type /Font /Subtype /Type0 /BaseFont /Abc-Bold /Encoding /Identity-H /DescendantFonts [101 0 R] /ToUnicode 102 0 R >>",
        101: "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Abc-Bold /DW 500 /W [1 [600 700] 3 5 250] >>",
        102: b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream",
        103: "<< /Type /Font /Subtype /Type1 /BaseFont /Own /Encoding << /Differences [65 /eacute /uni20AC /fi] >> >>",
    }
    w, root = document([b"BT /F3 10 Tf 72 700 Td <00010002000300040005> Tj /F4 10 Tf 0 -20 Td (ABC) Tj ET"], objects=objects)
    w.objects[2] = w.objects[2].replace(b"/F2 4 0 R", b"/F2 4 0 R /F3 100 0 R /F4 103 0 R")
    return w.save(root)


def ruled() -> bytes:
    w, root = document([b"72 500 m 540 500 l S [4 2] 0 d 72 495 m 540 495 l S 72 300 m 72 400 l S 100 100 200 50 re S " + text_page(["Ruled"])])
    return w.save(root)


def encrypted(aes: bool, password: bytes = b"", owner: bytes = b"owner") -> bytes:
    """RC4 of 128 bits (V2, R3) or AES-128 (V4, R4)."""
    file_id, permissions = b"0123456789abcdef", -44
    key = hashlib.md5((owner + PAD)[:32]).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    o = (password + PAD)[:32]
    for i in range(20):
        o = rc4(bytes(b ^ i for b in key), o)
    entries = {"V": 4 if aes else 2, "R": 4 if aes else 3, "Length": 128, "P": permissions, "O": o, "U": b""}
    if aes:
        entries |= {"StmF": "StdCF", "StrF": "StdCF", "CF": {"StdCF": {"CFM": "AESV2"}}}
    s = Security.__new__(Security)
    s.v, s.r, s.permissions, s.o, s.n, s.metadata, s.id, s.aes, s.identity = entries["V"], entries["R"], permissions, o, 16, True, file_id, aes, False
    s.key = s._derive(password)
    u = (s.user_entry(s.key) + bytes(16))[:32]
    w, root = document([b""])
    content = text_page(["Secret text"])

    def seal(num: int, data: bytes) -> bytes:
        own = hashlib.md5(s.key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if aes else b"")).digest()
        return aes_encrypt(own, data, bytes(range(16))) if aes else rc4(own, data)

    w.stream(seal(11, content), num=11, flate=False)
    cf = "/StmF /StdCF /StrF /StdCF /CF << /StdCF << /CFM /AESV2 /Length 16 >> >>" if aes else ""
    w.add(f"<< /Filter /Standard /V {entries['V']} /R {entries['R']} /Length 128 /P {permissions} /O <{o.hex()}> /U <{u.hex()}> {cf} >>", 100)
    return w.save(root, f"/Encrypt 100 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")


def encrypted_256(revision: int = 6, password: bytes = b"", owner: bytes = b"owner") -> bytes:
    """AES-256, revision 5 or 6."""
    key = hashlib.sha256(b"file key").digest()
    wrap = lambda k: aes_encrypt(k, key, bytes(16), pad=False)[16:]
    u = strong_hash(password, b"validate", b"", revision) + b"validate" + b"key salt"
    ue = wrap(strong_hash(password, b"key salt", b"", revision))
    o = strong_hash(owner, b"VALIDATE", u, revision) + b"VALIDATE" + b"KEY SALT"
    oe = wrap(strong_hash(owner, b"KEY SALT", u, revision))
    w, root = document([b""])
    w.stream(aes_encrypt(key, text_page(["Strong secret"]), bytes(range(16))), num=11, flate=False)
    cf = "/StmF /StdCF /StrF /StdCF /CF << /StdCF << /CFM /AESV3 /Length 32 >> >>"
    w.add(f"<< /Filter /Standard /V 5 /R {revision} /Length 256 /P -44 /O <{o.hex()}> /U <{u.hex()}> /OE <{oe.hex()}> /UE <{ue.hex()}> {cf} >>", 100)
    return w.save(root, "/Encrypt 100 0 R")


def empty() -> bytes:
    w = Writer()
    w.add("<< /Type /Catalog /Pages 2 0 R >>", 1)
    w.add("<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 2)
    w.add("<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] >>", 3)
    return w.save(1)


ALL = {
    "plain/simple.pdf": lambda: simple(), "plain/three_pages.pdf": lambda: simple(3), "plain/empty.pdf": empty, "text/kerned.pdf": kerned, "text/mapped.pdf": mapped, "text/tagged.pdf": tagged,
    "structure/xref_stream.pdf": xref_stream, "structure/damaged.pdf": damaged, "features/form.pdf": form, "features/linked.pdf": linked, "features/pictures.pdf": pictures, "features/ruled.pdf": ruled,
    "secured/rc4.pdf": lambda: encrypted(False), "secured/aes.pdf": lambda: encrypted(True), "secured/strong.pdf": lambda: encrypted_256(), "secured/locked.pdf": lambda: encrypted(False, b"user"), "broken/not_a_pdf.pdf": lambda: b"no header here",
}


def write_all(folder: str) -> str:
    for name, make in ALL.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(make())
    return folder
