"""The reader and its renderers over sample files made from scratch, and decoders over the driver's texts."""

from __future__ import annotations

import tempfile
import zlib
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioflow.corpus import Corpus
from folioflow.pdf import samples
from folioflow.sources import pdf
from folioflow.streaming import ingest


def scratch(spark, what: str) -> str:
    """A new folder that executors share: below spark.checkpoint.dir where that names a mounted one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    path = urlparse(base).path if base and urlparse(base).scheme in ("", "file") else None
    return tempfile.mkdtemp(prefix=f"folioflow-{what}-", dir=path)


def _corpus(spark, **options) -> Corpus:
    return Corpus(spark, samples.write_all(scratch(spark, "samples")), **options)


def _named(corpus: Corpus, df):
    names = corpus.files.select("doc_id", F.substring_index("path", "/", -1).alias("file"))
    return df.join(names, "doc_id").drop("doc_id")


def _query(make):
    def run(spark, sf_dir):
        corpus = _corpus(spark)
        return _named(corpus, make(corpus))

    return run


def filters_roundtrip(spark, sf_dir):
    """Texts through hexadecimal and deflate filters and back."""

    @F.arrow_udf(BinaryType())
    def deflated(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else zlib.compress(d, 1) for d in data.to_pylist()], pa.binary())

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = F.concat(F.hex(deflated(F.encode("text", "UTF-8"))), F.lit(">"))
    back = pdf.pdf_decode(F.encode(packed, "UTF-8"), F.array(F.lit("ASCIIHexDecode"), F.lit("FlateDecode")))
    return docs.select("doc_id", (F.decode(back, "UTF-8") == F.col("text")).alias("same"))


def stream_windows(spark, sf_dir):
    folder = scratch(spark, "stream")
    ingest.run_once(ingest.windowed_report(ingest.read_events(spark, sf_dir)), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def stream_files(spark, sf_dir):
    folder = scratch(spark, "files")
    ingest.ingest_spans(spark, samples.write_all(f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("page").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("files"))


QUERIES = {
    "pdf_meta": _query(lambda c: pdf.meta(c.files).drop("seconds", "error_msg", "objects")),
    "pdf_spans": _query(lambda c: c.raw_spans().select("doc_id", "page", "sequence", "text", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("width", 2).alias("width"), "font_name", "font_weight", "mcid")),
    "pdf_chars": _query(lambda c: pdf.chars(c.files).groupBy("doc_id", "page").agg(F.count("*").alias("n"))),
    "pdf_content_ops": _query(lambda c: pdf.content_ops(c.files).groupBy("doc_id", "op").agg(F.count("*").alias("n"))),
    "pdf_text": _query(lambda c: c.extract_text()),
    "pdf_markdown": _query(lambda c: c.to_markdown_all()),
    "pdf_html": _query(lambda c: c.to_html_all()),
    "pdf_structured": _query(lambda c: c.structured().select("doc_id", "page", "element", "type", "level", "text")),
    "pdf_fonts": _query(lambda c: pdf.fonts(c.files)),
    "pdf_forms": _query(lambda c: pdf.form_fields(c.files).select("doc_id", "full_name", "field_type", "value_text", "tooltip")),
    "pdf_form_tables": _query(lambda c: c.form_markdown()),
    "pdf_outline": _query(lambda c: pdf.outline(c.files).select("doc_id", "depth", "title", "dest_kind", "dest_page")),
    "pdf_annotations": _query(lambda c: pdf.annotations(c.files).select("doc_id", "page", "subtype", "contents", "uri")),
    "pdf_struct_elems": _query(lambda c: pdf.struct_elems(c.files).select("doc_id", "struct_type", "mcid", "page")),
    "pdf_images": _query(lambda c: pdf.images(c.files).select("doc_id", "page", "name", "width", "height", "color_space", "kind", F.length("data").alias("bytes"))),
    "pdf_rules": _query(lambda c: pdf.rules(c.files).groupBy("doc_id", "direction", "significant", "dashed").agg(F.count("*").alias("n"))),
    "pdf_xref": _query(lambda c: pdf.xref(c.files).groupBy("doc_id", "type").agg(F.count("*").alias("n"))),
    "pdf_objects": _query(lambda c: pdf.objects(c.files).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))),
    "pdf_raw_features": _query(lambda c: pdf.raw_features(c.files).select("doc_id", "has_encrypt", "has_acroform", "has_outlines", "has_structtreeroot", "has_objstm", F.array_join("filters", ",").alias("filters"))),
    "filters_roundtrip": filters_roundtrip,
    "stream_windows": stream_windows,
    "stream_files": stream_files,
}

_TITLE = lambda n: f"'Title {n}' || chr(10) || 'Hello World' || chr(10) || 'See https://example.org/x.'"
ORACLES = {
    "pdf_meta": """SELECT * FROM (VALUES ('simple.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL), ('three_pages.pdf', true, '1.7', 3, false, false, NULL, NULL, false, NULL), ('empty.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL),
      ('kerned.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL), ('mapped.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL), ('tagged.pdf', true, '1.7', 1, false, false, NULL, NULL, true, NULL),
      ('xref_stream.pdf', true, '1.5', 1, false, false, NULL, NULL, false, NULL), ('damaged.pdf', true, '1.7', 2, true, false, NULL, NULL, false, NULL), ('form.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL),
      ('linked.pdf', true, '1.7', 2, false, false, NULL, NULL, false, NULL), ('pictures.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL), ('ruled.pdf', true, '1.7', 1, false, false, NULL, NULL, false, NULL),
      ('rc4.pdf', true, '1.7', 1, false, true, 'RC4-128', -44, false, NULL), ('aes.pdf', true, '1.7', 1, false, true, 'AES-128', -44, false, NULL), ('strong.pdf', true, '1.7', 1, false, true, 'AES-256', -44, false, NULL), ('locked.pdf', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'WrongPassword'),
      ('not_a_pdf.pdf', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'InvalidHeader')) t(file, success, version, page_count, rebuilt, encrypted, algorithm, permissions, tagged, error_kind)""",
    "pdf_text": f"""SELECT * FROM (VALUES ('simple.pdf', 0, {_TITLE(1)}), ('three_pages.pdf', 0, {_TITLE(1)}), ('three_pages.pdf', 1, {_TITLE(2)}), ('three_pages.pdf', 2, {_TITLE(3)}), ('damaged.pdf', 0, {_TITLE(1)}), ('damaged.pdf', 1, {_TITLE(2)}),
      ('kerned.pdf', 0, 'Hello World' || chr(10) || 'next'), ('mapped.pdf', 0, 'Hfiabc' || chr(10) || chr(10) || 'é€ﬁ'), ('tagged.pdf', 0, 'first' || chr(10) || chr(10) || 'second' || chr(10) || chr(10) || chr(10) || 'loose'),
      ('xref_stream.pdf', 0, 'Compressed objects'), ('form.pdf', 0, 'Form'), ('linked.pdf', 0, 'A'), ('linked.pdf', 1, 'B'), ('pictures.pdf', 0, 'inside a form'), ('ruled.pdf', 0, 'Ruled'), ('rc4.pdf', 0, 'Secret text'), ('aes.pdf', 0, 'Secret text'), ('strong.pdf', 0, 'Strong secret')) t(file, page, text)""",
    "pdf_forms": "SELECT * FROM (VALUES ('form.pdf', 'person.name', 'Text', 'Ada | L', 'full name'), ('form.pdf', 'person.agree', 'Button', 'Yes', NULL), ('form.pdf', 'colours', 'Choice', 'red, blue', NULL)) t(file, full_name, field_type, value_text, tooltip)",
    "pdf_outline": "SELECT * FROM (VALUES ('linked.pdf', 0, 'One', 'page', 0), ('linked.pdf', 1, 'Ü', 'page', 1), ('linked.pdf', 0, 'Two', 'named', 1)) t(file, depth, title, dest_kind, dest_page)",
    "pdf_annotations": "SELECT * FROM (VALUES ('linked.pdf', 0, 'Link', NULL, 'https://example.org'), ('linked.pdf', 0, 'Text', 'note', NULL), ('linked.pdf', 1, 'Link', NULL, 'https://example.org'), ('linked.pdf', 1, 'Text', 'note', NULL)) t(file, page, subtype, contents, uri)",
    "pdf_struct_elems": "SELECT * FROM (VALUES ('tagged.pdf', 'Document', NULL, NULL), ('tagged.pdf', 'H1', NULL, 0), ('tagged.pdf', 'H1', 0, 0), ('tagged.pdf', 'P', NULL, 0), ('tagged.pdf', 'P', 1, 0)) t(file, struct_type, mcid, page)",
    "pdf_images": "SELECT * FROM (VALUES ('pictures.pdf', 0, 'I1', 2, 2, 'DeviceRGB', 'raw', 12), ('pictures.pdf', 0, 'I2', 1, 1, 'DeviceGray', 'jpeg', 13)) t(file, page, name, width, height, color_space, kind, bytes)",
    "filters_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
