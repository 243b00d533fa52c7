"""One file's objects: cross references (or a scan for objects), pages, and what hangs on them."""

from __future__ import annotations

import re

from folioflow.pdf import filters
from folioflow.pdf.crypto import Security
from folioflow.pdf.fonts import Font
from folioflow.pdf.objects import Keyword, Name, Parser, PdfError, Ref, Stream, text_string

MAX_PAGES_DEPTH = 50
MAX_XREF_CHAIN = 100
MAX_ENTRIES = 1_000_000
_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?=[\x00\t\n\x0c\r <\[(/+\-.0-9a-z%])")
_BOX = ("MediaBox", "CropBox", "Rotate", "Resources")


def header(data: bytes) -> tuple[int, int]:
    m = re.search(rb"%PDF-(\d)\.(\d)", data[:1024])
    if not m:
        raise PdfError("InvalidHeader")
    return int(m.group(1)), int(m.group(2))


class Document:
    """Lazily parsed; objects are kept once read. `strict` turns recovery off."""

    def __init__(self, data: bytes, password: str | bytes = b"", strict: bool = False):
        self.data = data
        self.version = header(data)
        self.objects: dict[int, object] = {}
        self.loading: set[int] = set()
        self.xref: dict[int, tuple] = {}  # num -> ("n", offset, gen) | ("c", stream, index) | ("f", 0, gen)
        self.trailer: dict = {}
        self.sections = 0
        self.rebuilt = False
        try:
            self._read_xref(self._start())
            broken = len(self.xref) < 5 and not isinstance(self.resolve(self.trailer.get("Root")), dict)
        except (PdfError, EOFError, ValueError, IndexError, KeyError, TypeError):
            broken = True
        if broken or "Root" not in self.trailer:
            if strict:
                raise PdfError("InvalidXref")
            self._rebuild()
        self.security: Security | None = None
        encrypt = self.trailer.get("Encrypt")
        if encrypt is not None:
            ids = self.resolve(self.trailer.get("ID")) or [b""]
            self.encrypt_ref = encrypt if isinstance(encrypt, Ref) else None
            table = self._deep(encrypt)
            self.objects.clear()
            self.security = Security(table, self.resolve(ids[0]) or b"", password.encode() if isinstance(password, str) else password)

    # --- cross references ---

    def _start(self) -> int:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        if at < 0:
            raise PdfError("InvalidXref", "no startxref")
        v = Parser(self.data, at + 9).value()
        if not isinstance(v, int) or not 0 <= v < len(self.data):
            raise PdfError("InvalidXref")
        return v

    def _read_xref(self, start: int) -> None:
        queue, seen = [start], set()
        while queue and len(seen) < MAX_XREF_CHAIN:
            at = queue.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            p = Parser(self.data, at)
            p.skip()
            trailer = self._table(p) if self.data[p.pos : p.pos + 4] == b"xref" else self._xref_stream(p)
            self.sections += 1
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            queue += [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(x, int)]

    def _table(self, p: Parser) -> dict:
        p.pos += 4
        while True:
            first = p.value()
            if first == b"trailer" and isinstance(first, Keyword):
                t = p.value()
                return t if isinstance(t, dict) else {}
            count = p.value()
            if not isinstance(first, int) or not isinstance(count, int) or count > MAX_ENTRIES:
                raise PdfError("InvalidXref")
            for num in range(first, first + count):
                p.skip()
                m = re.compile(rb"(\d{1,10})[ ]+(\d{1,5})[ ]+([nf])").match(self.data, p.pos)
                if m:
                    p.pos = m.end()
                    self.xref.setdefault(num, (m.group(3).decode(), int(m.group(1)), int(m.group(2))))
                else:  # a malformed line is a free entry
                    if self.data[p.pos : p.pos + 7] == b"trailer":
                        break
                    end = self.data.find(b"\n", p.pos)
                    p.pos = len(self.data) if end < 0 else end + 1
                    self.xref.setdefault(num, ("f", 0, 65535))

    def _xref_stream(self, p: Parser) -> dict:
        num, gen, word = p.value(), p.value(), p.value()
        if not isinstance(num, int) or word != b"obj":
            raise PdfError("InvalidXref")
        s = p.object()
        if not isinstance(s, Stream):
            raise PdfError("InvalidXref")
        raw = self._decoded(s.dict, s.raw)
        widths = [int(w) for w in s.dict["W"]]
        index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
        at, size = 0, sum(widths)
        for first, count in zip(index[::2], index[1::2]):
            for n in range(first, first + min(count, MAX_ENTRIES)):
                row = raw[at : at + size]
                if len(row) < size:
                    break
                at += size
                a = int.from_bytes(row[: widths[0]], "big") if widths[0] else 1
                b = int.from_bytes(row[widths[0] : widths[0] + widths[1]], "big")
                c = int.from_bytes(row[widths[0] + widths[1] :], "big")
                self.xref.setdefault(n, {0: ("f", b, c), 1: ("n", b, c), 2: ("c", b, c)}.get(a, ("f", 0, 0)))
        return s.dict

    def _rebuild(self) -> None:
        """Finds objects by their headers; the last of a number counts. Then a trailer, or a catalog to make one."""
        self.rebuilt = True
        self.xref = {int(m.group(1)): ("n", m.start(), int(m.group(2))) for m in _OBJ.finditer(self.data)}
        self.objects.clear()
        self.trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Parser(self.data, m.end()).value()
            except (EOFError, PdfError):
                continue
            if isinstance(t, dict):
                self.trailer |= {k: v for k, v in t.items() if v is not None}
        for num in list(self.xref):  # members of object streams, and catalogs of files without a trailer
            v = self.load(num)
            if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm" and "Encrypt" not in self.trailer:
                try:
                    for n in self._members(v, num):
                        self.xref.setdefault(n, ("c", num, 0))
                except (PdfError, ValueError, EOFError, TypeError):
                    pass
            if isinstance(v, Stream) and v.dict.get("Type") == "XRef":
                for k in ("Root", "Encrypt", "ID", "Info"):
                    if k in v.dict:
                        self.trailer.setdefault(k, v.dict[k])
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            root = next((n for n in self.xref if isinstance(v := self.load(n), dict) and v.get("Type") == "Catalog"), None)
            if root is None:
                raise PdfError("InvalidPdf", "no catalog")
            self.trailer["Root"] = Ref(root, 0)

    # --- objects ---

    def load(self, num: int):
        if num in self.objects:
            return self.objects[num]
        if num in self.loading:
            return None  # a circle of references
        self.loading.add(num)
        try:
            v = self._load(num)
        except (PdfError, EOFError, ValueError, IndexError, TypeError):
            v = None
        finally:
            self.loading.discard(num)
        self.objects[num] = v
        return v

    def _load(self, num: int):
        entry = self.xref.get(num)
        if entry is None or (entry[0] == "f" and num > 10):
            return None if entry else self._scan(num)
        if entry[0] == "c":
            s = self.load(entry[1])
            if not isinstance(s, Stream):
                return None
            for n, v in self._members(s, entry[1]).items():
                if self.xref.get(n, ("c", entry[1]))[:2] == ("c", entry[1]):
                    self.objects.setdefault(n, v)
            return self.objects.get(num)
        v = self._at(entry[1], num) if entry[0] == "n" else None
        if v is None and not self.rebuilt:
            for m in _OBJ.finditer(self.data, max(0, entry[1] - 100), min(len(self.data), entry[1] + 64)):
                if int(m.group(1)) == num:
                    return self._parse(m.end(), num, int(m.group(2)))
            return self._scan(num)
        return v[0] if v is not None else None

    def _at(self, offset: int, num: int):
        m = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj").match(self.data, offset)
        if not m or int(m.group(1)) != num:
            return None
        return (self._parse(m.end(), num, int(m.group(2))),)

    def _scan(self, num: int):
        last = None
        for m in re.finditer(rb"(?<![0-9])%d[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj" % num, self.data):
            last = m
        return self._parse(last.end(), num, int(last.group(1))) if last else None

    def _parse(self, pos: int, num: int, gen: int):
        v = Parser(self.data, pos).object(lambda n: n if isinstance(n, int) else self.resolve(n) if isinstance(n, Ref) else None)
        if isinstance(v, Keyword):
            return None
        if isinstance(v, Stream):
            v.owner = Ref(num, gen)
        if getattr(self, "security", None) and not (self.encrypt_ref and num == self.encrypt_ref.num):
            v = self._decrypt(v, num, gen)
        return v

    def _decrypt(self, v, num: int, gen: int):
        if isinstance(v, bytes):
            return self.security.decrypt(v, num, gen)
        if isinstance(v, list):
            return [self._decrypt(x, num, gen) for x in v]
        if isinstance(v, dict):
            return {k: self._decrypt(x, num, gen) for k, x in v.items()}
        if isinstance(v, Stream):
            if v.dict.get("Type") != "XRef":
                v.dict = self._decrypt(v.dict, num, gen)
                v.raw = self.security.decrypt(v.raw, num, gen)
        return v

    def _members(self, s: Stream, num: int) -> dict[int, object]:
        data, n, first = self.stream_data(s), int(self.resolve(s.dict["N"])), int(self.resolve(s.dict["First"]))
        if n > MAX_ENTRIES or first > 10_000_000:
            raise PdfError("InvalidObjectStream")
        p, pairs = Parser(data), []
        for _ in range(n):
            try:
                pairs.append((p.value(), p.value()))
            except EOFError:
                break
        out = {}
        for number, offset in pairs:
            try:
                out[number] = Parser(data, first + offset).value()
            except (EOFError, PdfError, TypeError, ValueError):
                continue
        return out

    def resolve(self, v):
        for _ in range(100):
            if not isinstance(v, Ref):
                return v
            v = self.load(v.num)
        return None

    def _deep(self, v, depth: int = 0):
        v = self.resolve(v)
        if depth > 8:
            return None
        if isinstance(v, dict):
            return {k: self._deep(x, depth + 1) for k, x in v.items()}
        return [self._deep(x, depth + 1) for x in v] if isinstance(v, list) else v

    def _decoded(self, d: dict, raw: bytes) -> bytes:
        names = self.resolve(d.get("Filter", d.get("F"))) or []
        names = [names] if isinstance(names, Name) else [self.resolve(n) for n in names]
        params = self.resolve(d.get("DecodeParms", d.get("DP"))) or []
        params = [params] if isinstance(params, dict) else [self.resolve(p) for p in params]
        params = [{k: self.resolve(x) for k, x in p.items()} if isinstance(p, dict) else {} for p in params]
        return filters.decode(raw, names, params)

    def stream_data(self, s: Stream) -> bytes:
        return self._decoded(s.dict, s.raw)

    def filter_names(self, s: Stream) -> list[str]:
        names = self.resolve(s.dict.get("Filter")) or []
        return [str(names)] if isinstance(names, Name) else [str(self.resolve(n)) for n in names]

    # --- pages ---

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        return root if isinstance(root, dict) else {}

    def pages(self) -> list[tuple[int | None, dict]]:
        """(object number, page with inherited attributes); the nearest ancestor's value counts."""
        if hasattr(self, "_pages"):
            return self._pages
        out: list[tuple[int | None, dict]] = []
        seen: set[int] = set()

        def walk(ref, inherited: dict, depth: int):
            node = self.resolve(ref)
            num = ref.num if isinstance(ref, Ref) else None
            if not isinstance(node, dict) or depth > MAX_PAGES_DEPTH or num in seen:
                return
            if num is not None:
                seen.add(num)
            own = inherited | {k: node[k] for k in _BOX if k in node}
            if "Kids" in node and node.get("Type") != "Page":
                for kid in self.resolve(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append((num, own | node))

        walk(self.catalog.get("Pages"), {}, 0)
        if not out:
            for num in sorted(self.xref):
                v = self.load(num)
                if isinstance(v, dict) and v.get("Type") == "Page":
                    out.append((num, v))
        self._pages = out
        return out

    def page_of(self, ref) -> int | None:
        if isinstance(ref, int):
            return ref
        return next((i for i, (num, _) in enumerate(self.pages()) if isinstance(ref, Ref) and num == ref.num), None)

    def content(self, page: dict) -> bytes:
        c = self.resolve(page.get("Contents"))
        parts = [self.resolve(x) for x in c] if isinstance(c, list) else [c]
        out = []
        for s in parts:
            if isinstance(s, Stream):
                try:
                    out.append(self.stream_data(s))
                except PdfError:
                    continue
        return b"\n".join(out)

    def fonts(self, resources) -> dict[str, Font]:
        table = self.resolve((self.resolve(resources) or {}).get("Font")) or {}
        out = {}
        for name, ref in table.items():
            key = ("font", ref) if isinstance(ref, Ref) else None
            if key and key in self.__dict__.setdefault("_fonts", {}):
                out[name] = self._fonts[key]
                continue
            d = self.resolve(ref)
            if isinstance(d, dict):
                out[name] = Font(self, d, name)
                if key:
                    self._fonts[key] = out[name]
        return out

    def box(self, page: dict) -> list[float]:
        b = [self.resolve(x) for x in self.resolve(page.get("MediaBox")) or []]
        return [float(x) for x in b] if len(b) == 4 and all(isinstance(x, (int, float)) for x in b) else [0.0, 0.0, 612.0, 792.0]

    # --- what hangs on the catalog ---

    def destination(self, d) -> tuple[str | None, int | None, str | None]:
        """(kind, page, name) of a destination: explicit, named, or a dictionary's."""
        d = self.resolve(d)
        if isinstance(d, dict):
            d = self.resolve(d.get("D"))
        if isinstance(d, list) and d:
            return "page", self.page_of(d[0]), str(self.resolve(d[1])) if len(d) > 1 else None
        if isinstance(d, (bytes, Name)):
            name = text_string(d) if isinstance(d, bytes) else str(d)
            target = self._named(d)
            return "named", self.page_of(target[0]) if isinstance(target, list) and target else None, name
        return None, None, None

    def _named(self, name):
        old = self.resolve(self.catalog.get("Dests"))
        if isinstance(old, dict) and str(name) in old:
            v = self.resolve(old[str(name)])
            return self.resolve(v.get("D")) if isinstance(v, dict) else v
        names = self.resolve(self.catalog.get("Names"))
        tree = self.resolve(names.get("Dests")) if isinstance(names, dict) else None
        queue, steps = [tree], 0
        while queue and steps < 10_000:
            node, steps = self.resolve(queue.pop()), steps + 1
            if not isinstance(node, dict):
                continue
            pairs = self.resolve(node.get("Names")) or []
            for k, v in zip(pairs[::2], pairs[1::2]):
                if self.resolve(k) == name:
                    v = self.resolve(v)
                    return self.resolve(v.get("D")) if isinstance(v, dict) else v
            queue += self.resolve(node.get("Kids")) or []
        return None

    def outline(self) -> list[dict]:
        out, seen = [], set()

        def walk(ref, path: list[int]):
            i = 0
            while ref is not None and len(path) < 50:
                if isinstance(ref, Ref):
                    if ref.num in seen:
                        return
                    seen.add(ref.num)
                item = self.resolve(ref)
                if not isinstance(item, dict):
                    return
                title = self.resolve(item.get("Title"))
                target = item.get("Dest") if "Dest" in item else (self.resolve(item.get("A")) or {}).get("D")
                kind, page, name = self.destination(target)
                out.append({"node_path": [*path, i], "depth": len(path), "title": text_string(title) if isinstance(title, bytes) else "", "dest_kind": kind, "dest_page": page, "dest_name": name})
                walk(item.get("First"), [*path, i])
                ref, i = item.get("Next"), i + 1

        walk((self.resolve(self.catalog.get("Outlines")) or {}).get("First"), [])
        return out

    def annotations(self) -> list[dict]:
        out = []
        text = lambda v: text_string(v) if isinstance(v, bytes) else None
        for number, (_, page) in enumerate(self.pages()):
            for ref in self.resolve(page.get("Annots")) or []:
                a = self.resolve(ref)
                if not isinstance(a, dict):
                    continue
                action = self.resolve(a.get("A"))
                action = action if isinstance(action, dict) else {}
                kind = self.resolve(action.get("S"))
                dest = self.destination(a["Dest"] if "Dest" in a else action.get("D"))
                rect = [self.resolve(x) for x in self.resolve(a.get("Rect")) or []]
                out.append({
                    "page_no": number, "subtype": str(self.resolve(a.get("Subtype")) or ""), "contents": text(self.resolve(a.get("Contents"))), "author": text(self.resolve(a.get("T"))),
                    "created": text(self.resolve(a.get("CreationDate"))), "modified": text(self.resolve(a.get("M"))), "rect": [float(x) for x in rect if isinstance(x, (int, float))],
                    "action": str(kind) if kind else None, "uri": text(self.resolve(action.get("URI"))), "dest_kind": dest[0], "dest_page": dest[1], "dest_name": dest[2],
                })
        return out

    def form_fields(self) -> list[dict]:
        out = []
        form = self.resolve(self.catalog.get("AcroForm"))
        form = form if isinstance(form, dict) else {}

        def walk(ref, prefix: str, inherited: dict, depth: int):
            f = self.resolve(ref)
            if not isinstance(f, dict) or depth > 50:
                return
            name = self.resolve(f.get("T"))
            name = text_string(name) if isinstance(name, bytes) else ""
            full = f"{prefix}.{name}" if prefix and name else prefix or name
            own = inherited | {k: f[k] for k in ("FT", "V", "Ff") if k in f}
            kids = self.resolve(f.get("Kids")) or []
            named = [k for k in kids if isinstance(d := self.resolve(k), dict) and "T" in d]
            for kid in named:
                walk(kid, full, own, depth + 1)
            if ("FT" in own and not named) or "FT" in f:
                kind = {"Tx": "Text", "Btn": "Button", "Ch": "Choice", "Sig": "Signature"}.get(self.resolve(own.get("FT")), "Unknown")
                v = self.resolve(own.get("V"))
                shown, many, what = None, None, "none"
                if isinstance(v, bytes):
                    shown, what = text_string(v), "text"
                elif isinstance(v, Name):
                    shown, what = str(v), "boolean" if kind == "Button" else "name"
                elif isinstance(v, list):
                    many, what = [text_string(x) if isinstance(x, bytes) else str(x) for x in map(self.resolve, v)], "array"
                    shown = ", ".join(many)
                tip = self.resolve(f.get("TU"))
                rect = [self.resolve(x) for x in self.resolve(f.get("Rect")) or []]
                out.append({"full_name": full, "name": name, "field_type": kind, "value_kind": what, "value_text": shown, "value_list": many, "tooltip": text_string(tip) if isinstance(tip, bytes) else None, "bounds": [float(x) for x in rect if isinstance(x, (int, float))]})

        for ref in self.resolve(form.get("Fields")) or []:
            walk(ref, "", {}, 0)
        return out

    def structure(self) -> list[dict]:
        """Elements and marked contents of the structure tree, depth first; /Pg is resolved, roles are mapped."""
        root = self.resolve(self.catalog.get("StructTreeRoot"))
        if not isinstance(root, dict):
            return []
        roles = self.resolve(root.get("RoleMap")) or {}
        out: list[dict] = []

        def walk(node, path: list[int], page: int | None, kind: str | None, depth: int):
            node_ = self.resolve(node)
            if depth > 100:
                return
            if isinstance(node_, int):
                out.append({"path": path, "struct_type": kind, "mcid": node_, "page": page})
            elif isinstance(node_, dict):
                page = self.page_of(node_["Pg"]) if "Pg" in node_ else page
                if node_.get("Type") == "MCR" or ("MCID" in node_ and "S" not in node_):
                    out.append({"path": path, "struct_type": kind, "mcid": self.resolve(node_.get("MCID")), "page": page})
                elif "S" in node_:
                    s = str(self.resolve(node_["S"]))
                    s = str(self.resolve(roles.get(s, Name(s))))
                    out.append({"path": path, "struct_type": s, "mcid": None, "page": page})
                    kids(node_.get("K"), path, page, s, depth)
            elif isinstance(node_, list):
                kids(node_, path, page, kind, depth)

        def kids(k, path, page, kind, depth):
            k = self.resolve(k)
            for i, kid in enumerate(k if isinstance(k, list) else [] if k is None else [k]):
                walk(kid, [*path, i], page, kind, depth + 1)

        kids(root.get("K"), [], None, None, 0)
        return out

    def references(self) -> list[tuple[int, int]]:
        """(src, dst) of all references between objects, but for /Parent and /Prev links that go back by design."""
        out = []
        for num in sorted(self.xref):
            stack = [(self.load(num), 0)]
            while stack:
                v, depth = stack.pop()
                if isinstance(v, Ref):
                    out.append((num, v.num))
                elif isinstance(v, Stream):
                    stack.append((v.dict, depth))
                elif isinstance(v, dict) and depth < 100:
                    stack += [(x, depth + 1) for k, x in v.items() if k not in ("Parent", "P", "Prev", "Pg")]
                elif isinstance(v, list) and depth < 100:
                    stack += [(x, depth + 1) for x in v]
        return out

    def images(self, page: dict) -> list[dict]:
        """Image XObjects of a page by name, forms included: JPEG bytes as they are, else decoded samples."""
        out, seen = [], set()

        def walk(resources, prefix: str, depth: int):
            table = self.resolve((self.resolve(resources) or {}).get("XObject")) or {}
            for name in sorted(table):
                ref = table[name]
                if isinstance(ref, Ref):
                    if ref.num in seen:
                        continue
                    seen.add(ref.num)
                s = self.resolve(ref)
                if not isinstance(s, Stream):
                    continue
                if s.dict.get("Subtype") == "Form" and depth < 20:
                    walk(s.dict.get("Resources"), f"{prefix}{name}/", depth + 1)
                elif s.dict.get("Subtype") == "Image":
                    names = self.filter_names(s)
                    kind = "jpeg" if "DCTDecode" in names else "jpx" if "JPXDecode" in names else "fax" if "CCITTFaxDecode" in names else "jbig2" if "JBIG2Decode" in names else "raw"
                    try:
                        data, error = self.stream_data(s), None
                    except PdfError as e:
                        data, error = b"", e.kind
                    number = lambda k, d=0: v if isinstance(v := self.resolve(s.dict.get(k)), int) else d  # noqa: B023, E731
                    out.append({"name": prefix + name, "width": number("Width"), "height": number("Height"), "bpc": number("BitsPerComponent", 8), "color_space": self.color_space(s.dict.get("ColorSpace")), "kind": kind, "data": data, "error": error})

        walk(page.get("Resources"), "", 0)
        return out

    def color_space(self, v) -> str | None:
        v = self.resolve(v)
        if isinstance(v, Name):
            return {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}.get(v, str(v))
        return str(self.resolve(v[0])) if isinstance(v, list) and v else None
