"""PDF files as tables. Each table is one pass of Arrow-batched parsing over `binaryFile` rows, nothing is shuffled.

Parsing never loses a file: every failure is a row of the meta table, with its kind and message.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType, _parse_datatype_string

from folioflow.pdf.document import Document
from folioflow.pdf.objects import Ref, Stream, tokens
from folioflow.pdf.replay import Replay, operators

MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")


def read_pdfs(spark: SparkSession, path: str, *, categories: list[str] | None = None, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, path, category, length, content) of all files below `path`; the category is the first folder below it.

    A category filter narrows the paths that are listed, so other folders are never opened.
    """
    paths = [f"{path.rstrip('/')}/{c}" for c in categories] if categories else [path]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
    return _with_ids(files, path)


def stream_pdfs(spark: SparkSession, path: str, *, glob: str = "*.pdf", files_per_trigger: int = 100) -> DataFrame:
    """The same rows for files as they arrive (Structured Streaming)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return _with_ids(files, path)


def category_of(path: Column, base: str) -> Column:
    base = base.split("://")[-1].removeprefix("file:").rstrip("/")
    rest = F.element_at(F.split(path, F.lit("\\Q" + base + "/\\E"), 2), -1)
    return F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).otherwise(F.lit(""))


def _with_ids(files: DataFrame, path: str) -> DataFrame:
    return files.select(F.xxhash64("path").alias("doc_id"), "path", category_of(F.col("path"), path).alias("category"), "length", "content")


def _table(schema: str, rows: Callable[[Document], list[tuple]]):
    """A reader `files -> DataFrame` with doc_id before the columns of `schema`, filled from `rows(document)`."""

    def read(files: DataFrame, *, password: str = "", mode: str = "PERMISSIVE", **options) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        full = "doc_id long, " + schema
        arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in _parse_datatype_string(full).fields])

        def run(batches):
            for batch in batches:
                for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                    try:
                        found = rows(Document(content.as_py() or b"", password, strict=mode == "FAILFAST"), **options)
                    except Exception:
                        if mode == "FAILFAST":
                            raise
                        continue  # the meta table has the error
                    for at in range(0, len(found), 10_000):
                        columns = list(zip(*found[at : at + 10_000]))
                        part = columns and [pa.array([doc_id] * len(columns[0]), pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]]
                        if part:
                            yield pa.RecordBatch.from_arrays(part, schema=arrow)

        return files.select("doc_id", "content").mapInArrow(run, full)

    return read


def _arrow(kind) -> pa.DataType:
    name = kind.typeName()
    if name == "array":
        return pa.list_(_arrow(kind.elementType))
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}[name]


def _spans(doc: Document, use_ctm: bool = True, space_threshold: float = -120.0, page_no: int | None = None):
    out = []
    for number, (_, page) in enumerate(doc.pages()):
        if page_no is not None and number != page_no:
            continue
        for s in Replay(doc, page, use_ctm=use_ctm, space_threshold=space_threshold).run().spans:
            out.append((number, s["sequence"], s["text"], s["x"], s["y"], s["width"], s["height"], s["font_name"], s["font_size"], s["font_weight"], s["font_weight"] >= 600, s["italic"], list(map(float, s["color"])), s["mcid"]))
    return out


def _chars(doc: Document, use_ctm: bool = True):
    out = []
    for number, (_, page) in enumerate(doc.pages()):
        for i, c in enumerate(Replay(doc, page, use_ctm=use_ctm, want_chars=True).run().chars):
            out.append((number, i, c["char"], c["x"], c["y"], c["width"], c["height"], c["font_name"], c["font_size"], c["font_weight"], c["font_weight"] >= 600, c["mcid"]))
    return out


def _ops(doc: Document):
    out = []
    for number, (_, page) in enumerate(doc.pages()):
        for i, (op, args) in enumerate(operators(doc.content(page))):
            numbers = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
            name = next((str(a) for a in args if isinstance(a, str)), None)
            text = next((a for a in args if isinstance(a, bytes)), None)
            if text is None and op == "TJ" and args and isinstance(args[0], list):
                text = b"".join(x for x in args[0] if isinstance(x, bytes))
            out.append((number, i, op, len(args), numbers, name, text))
    return out


def _fonts(doc: Document):
    out = []
    for number, (_, page) in enumerate(doc.pages()):
        for name, f in sorted(doc.fonts(page.get("Resources")).items()):
            out.append((number, name, f.base, f.subtype, f.encoding_name, f.flags, f.weight, f.italic, f.first, f.default, len(f.widths), len(f.cmap)))
    return out


def _rules(doc: Document):
    out = []
    for number, (_, page) in enumerate(doc.pages()):
        width = doc.box(page)[2] - doc.box(page)[0]
        for r in Replay(doc, page).run().rules:
            flat, upright = abs(r["y1"] - r["y0"]) < 1, abs(r["x1"] - r["x0"]) < 1
            length = max(r["x1"] - r["x0"], r["y1"] - r["y0"])
            out.append((number, r["x0"], r["y0"], r["x1"], r["y1"], r["y0"], "horizontal" if flat else "vertical" if upright else "other", length, flat and length > 0.3 * width, r["dashed"], r["dotted"]))
    return out


def _pages(doc: Document):
    out = []
    for number, (num, page) in enumerate(doc.pages()):
        rotate = doc.resolve(page.get("Rotate"))
        out.append((number, num, [float(v) for v in doc.box(page)], rotate if isinstance(rotate, int) else 0, "Contents" in page, len(doc.content(page))))
    return out


def _objects(doc: Document):
    out = []
    for num in sorted(doc.xref):
        v = doc.load(num)
        d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
        kind = "stream" if isinstance(v, Stream) else "null" if v is None else {dict: "dictionary", list: "array", bytes: "string", bool: "boolean", int: "integer", float: "real", Ref: "reference"}.get(type(v), "name")
        out.append((num, doc.xref[num][2] if doc.xref[num][0] == "n" else 0, kind, str(d["Type"]) if isinstance(d.get("Type"), str) else None, str(d["Subtype"]) if isinstance(d.get("Subtype"), str) else None, len(v.raw) if isinstance(v, Stream) else None, doc.filter_names(v) if isinstance(v, Stream) else None))
    return out


_keys = lambda items, *names: [tuple(i[n] for n in names) for i in items]

spans = _table("page int, sequence int, text string, x double, y double, width double, height double, font_name string, font_size double, font_weight int, bold boolean, italic boolean, color array<double>, mcid int", _spans)
chars = _table("page int, sequence int, char string, x double, y double, width double, height double, font_name string, font_size double, font_weight int, bold boolean, mcid int", _chars)
content_ops = _table("page int, op_seq int, op string, operands int, nums array<double>, name string, text binary", _ops)
fonts = _table("page int, name string, base_font string, subtype string, encoding string, flags int, weight int, italic boolean, first_char int, default_width double, widths int, mapped int", _fonts)
rules = _table("page int, x0 double, y0 double, x1 double, y1 double, y double, direction string, length double, significant boolean, dashed boolean, dotted boolean", _rules)
pages = _table("page int, obj_num int, media_box array<double>, rotate int, has_contents boolean, content_bytes int", _pages)
xref = _table("obj_num int, type string, offset long, gen int, in_use boolean", lambda doc: [(n, e[0], int(e[1]), int(e[2]), e[0] != "f") for n, e in sorted(doc.xref.items())])
objects = _table("obj_num int, gen int, kind string, type string, subtype string, stream_bytes int, filters array<string>", _objects)
references = _table("src long, dst long", lambda doc: doc.references())
outline = _table("node_path array<int>, depth int, title string, dest_kind string, dest_page int, dest_name string", lambda doc: _keys(doc.outline(), "node_path", "depth", "title", "dest_kind", "dest_page", "dest_name"))
annotations = _table(
    "page int, subtype string, contents string, author string, created string, modified string, rect array<double>, action string, uri string, dest_kind string, dest_page int, dest_name string",
    lambda doc: _keys(doc.annotations(), "page_no", "subtype", "contents", "author", "created", "modified", "rect", "action", "uri", "dest_kind", "dest_page", "dest_name"),
)
form_fields = _table(
    "full_name string, name string, field_type string, value_kind string, value_text string, value_list array<string>, tooltip string, bounds array<double>",
    lambda doc: _keys(doc.form_fields(), "full_name", "name", "field_type", "value_kind", "value_text", "value_list", "tooltip", "bounds"),
)
struct_elems = _table("path array<int>, struct_type string, mcid int, page int", lambda doc: _keys(doc.structure(), "path", "struct_type", "mcid", "page"))
images = _table(
    "page int, img_no int, name string, width int, height int, bpc int, color_space string, kind string, data binary, error string",
    lambda doc: [(n, i, *(im[k] for k in ("name", "width", "height", "bpc", "color_space", "kind", "data", "error"))) for n, (_, p) in enumerate(doc.pages()) for i, im in enumerate(doc.images(p))],
)


def meta(files: DataFrame, *, password: str = "") -> DataFrame:
    """A row for every file, readable or not: version, pages, encryption, recovery, time, error."""
    schema = "doc_id long, success boolean, version string, page_count int, objects int, rebuilt boolean, encrypted boolean, algorithm string, permissions int, tagged boolean, seconds double, error_kind string, error_msg string"
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in _parse_datatype_string(schema).fields])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                began = time.perf_counter()
                try:
                    d = Document(content.as_py() or b"", password)
                    s = d.security
                    rows.append((doc_id, True, f"{d.version[0]}.{d.version[1]}", len(d.pages()), len(d.xref), d.rebuilt, s is not None, s and s.algorithm, s and s.permissions, "StructTreeRoot" in d.catalog, time.perf_counter() - began, None, None))
                except Exception as e:
                    rows.append((doc_id, False, None, None, None, None, None, None, None, None, time.perf_counter() - began, getattr(e, "kind", type(e).__name__), str(e)[:500]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.select("doc_id", "content").mapInArrow(run, schema)


RAW_FLAGS = ("/FontDescriptor", "/Encrypt", "/AcroForm", "/Outlines", "/StructTreeRoot", "/ObjStm", "/XRef", "/Linearized", "/EmbeddedFile", "/JavaScript", "/Annots", "/Image")


def raw_features(files: DataFrame) -> DataFrame:
    """Keyword flags of the raw bytes and the set of filters they name, without parsing."""
    text = F.decode("content", "ISO-8859-1")
    flags = [F.contains(text, F.lit(k)).alias("has_" + k[1:].lower()) for k in RAW_FLAGS]
    return files.select("doc_id", *flags, F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"/(\w+Decode)\b")))).alias("filters"))


@F.udtf(returnType=StructType().add("position", IntegerType()).add("kind", StringType()).add("text", StringType()))
class PdfTokens:
    """Tokens of a byte string, for SQL: SELECT * FROM pdf_tokens(x'...')."""

    def eval(self, data: bytes):
        for i, (kind, text) in enumerate(tokens(bytes(data or b""))):
            yield i, kind, text


@F.udtf(returnType=StructType().add("op_seq", IntegerType()).add("op", StringType()).add("operands", IntegerType()))
class ContentOps:
    def eval(self, data: bytes):
        for i, (op, args) in enumerate(operators(bytes(data or b""))):
            yield i, op, len(args)


@F.udtf(returnType=StructType().add("obj_num", IntegerType()).add("value", StringType()))
class ObjectStream:
    """Members of a decoded object stream: (data, n, first)."""

    def eval(self, data: bytes, n: int, first: int):
        from folioflow.pdf.objects import Parser

        p, pairs = Parser(bytes(data)), []
        for _ in range(n):
            pairs.append((p.value(), p.value()))
        for num, offset in pairs:
            yield num, repr(Parser(bytes(data), first + offset).value())


@F.arrow_udf(BinaryType())
def pdf_decode(data: pa.Array, filters: pa.Array) -> pa.Array:
    """Bytes through a list of filters; null where they can't be decoded."""
    from folioflow.pdf.filters import decode

    out = []
    for d, names in zip(data.to_pylist(), filters.to_pylist()):
        try:
            out.append(None if d is None else decode(d, names or []))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.binary())


def register(spark: SparkSession) -> None:
    """pdf_tokens, content_ops, objstm and pdf_decode for SQL."""
    spark.udtf.register("pdf_tokens", PdfTokens)
    spark.udtf.register("content_ops", ContentOps)
    spark.udtf.register("objstm", ObjectStream)
    spark.udf.register("pdf_decode", pdf_decode)
