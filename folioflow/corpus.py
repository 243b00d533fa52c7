"""The corpus object: all files below a path, their text, Markdown and HTML as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import __version__
from folioflow.functions import text as T
from folioflow.operators import cluster, fold, order, render
from folioflow.sources import pdf

K = ["doc_id", "page"]


class Corpus:
    """Lazy: every method plans, none runs. `page` narrows a per-page method to one page.

    `merge` joins adjacent spans of a line; `columns` reads column by column.
    """

    def __init__(self, spark: SparkSession, path: str, *, password: str = "", categories: list[str] | None = None, merge: bool = True, columns: bool = False, use_ctm: bool = True):
        self.spark, self.path, self.password, self.merge, self.columns, self.use_ctm = spark, path, password, merge, columns, use_ctm
        self.files = pdf.read_pdfs(spark, path, categories=categories)

    def __repr__(self) -> str:
        return f"Corpus({self.path!r})"

    @staticmethod
    def version() -> str:
        return __version__

    def meta(self) -> DataFrame:
        return self.files.select("doc_id", "path", "category", "length").join(pdf.meta(self.files, password=self.password), "doc_id")

    def page_count(self) -> DataFrame:
        return pdf.meta(self.files, password=self.password).where("success").select("doc_id", "page_count")

    def raw_spans(self) -> DataFrame:
        return pdf.spans(self.files, password=self.password, use_ctm=self.use_ctm)

    def spans(self, page: int | None = None) -> DataFrame:
        """Spans in reading order (`rank`), overlapping ones once, adjacent ones merged."""
        rows = pdf.spans(self.files, password=self.password, use_ctm=self.use_ctm, page_no=page)
        kept = fold.dedup_overlapping(rows)
        merged = cluster.merge_spans(kept) if self.merge else kept
        return (order.by_columns if self.columns else order.simple)(merged)

    def has_structure_tree(self) -> DataFrame:
        return pdf.struct_elems(self.files, password=self.password).select("doc_id").distinct()

    def structure_order(self) -> DataFrame:
        """(doc_id, page, mcid, ord): marked contents in the order of the structure tree."""
        from pyspark.sql import Window

        marked = pdf.struct_elems(self.files, password=self.password).where("mcid IS NOT NULL")
        ranked = marked.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")))
        return ranked.groupBy("doc_id", "page", "mcid").agg(F.min("ord").alias("ord"))

    def extract_text(self, page: int | None = None) -> DataFrame:
        """(doc_id, page, text): tagged pages in structure order, others by position, cleaned."""
        rows = fold.dedup_overlapping(pdf.spans(self.files, password=self.password, use_ctm=self.use_ctm, page_no=page))
        tagged = self.structure_order()
        # contents of one structure element keep together; a tagged page is ordered by elements first
        structured = order.by_structure(rows.join(tagged.select(*K).distinct(), K, "left_semi"), tagged)
        plain = rows.join(tagged.select(*K).distinct(), K, "left_anti")
        plain = order.simple(cluster.merge_spans(plain) if self.merge else plain)
        common = [*K, "rank", "text", "x", "y", "width", "font_size"]
        both = structured.select(*common).unionByName(plain.select(*common))
        return cluster.page_text(both).withColumn("text", T.cleanup_plain("text"))

    to_plain_text = extract_text

    def to_markdown(self, page: int | None = None) -> DataFrame:
        return render.markdown_pages(self.spans(page))

    def to_html(self, page: int | None = None, *, preserve_layout: bool = False) -> DataFrame:
        return render.html_pages(self.spans(page), preserve_layout=preserve_layout)

    def to_plain_text_all(self) -> DataFrame:
        return render.document_text(self.extract_text(), "text", "text")

    def to_markdown_all(self) -> DataFrame:
        return render.document_text(self.to_markdown(), "markdown", "markdown")

    def to_html_all(self, *, preserve_layout: bool = False) -> DataFrame:
        return render.document_text(self.to_html(preserve_layout=preserve_layout), "html", "html")

    def structured(self) -> DataFrame:
        lines = cluster.aggregate_blocks(cluster.lines_of(self.spans(), K, 2.0), [*K, "line"], " ")
        return render.structured_elements(lines)

    def form_markdown(self) -> DataFrame:
        return render.form_tables(pdf.form_fields(self.files, password=self.password))

    def export(self, rendered: DataFrame, folder: str, text: str = "text") -> None:
        """Writes one text value a document below category=... folders."""
        named = rendered.join(self.files.select("doc_id", "category", "path"), "doc_id")
        named.select("category", "path", F.col(text).alias("text")).write.partitionBy("category").parquet(folder)

    def export_files(self, rendered: DataFrame, folder: str, text: str = "text", suffix: str = "txt") -> DataFrame:
        """Writes one file a document, <category>/<name>.<suffix>; returns (doc_id, file). Tasks write their own."""
        named = rendered.join(self.files.select("doc_id", "category", "path"), "doc_id")
        return write_texts(named.select("doc_id", "category", "path", F.col(text).alias("text")), folder, suffix)

    def export_images(self, folder: str) -> DataFrame:
        """Writes images as files img_001.jpg or .png below the document's folder; returns (doc_id, file). Tasks write their own."""
        return write_images(pdf.images(self.files, password=self.password), folder)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    import pyarrow as pa
    from pyarrow import fs as pafs

    from folioflow.pdf.images import to_png

    def run(batches):
        filesystem, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            ids, files = [], []
            for r in batch.to_pylist():
                data = r["data"] if r["kind"] in ("jpeg", "jpx") else to_png(r)
                if not data:
                    continue
                name = f"{r['doc_id']}/page_{r['page'] + 1:04d}_img_{r['img_no'] + 1:03d}.{ {'jpeg': 'jpg', 'jpx': 'jp2'}.get(r['kind'], 'png')}"
                filesystem.create_dir(f"{root}/{r['doc_id']}", recursive=True)
                with filesystem.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
                ids.append(r["doc_id"])
                files.append(name)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "file": pa.array(files, pa.string())})

    return images.mapInArrow(run, "doc_id long, file string")


def write_texts(rows: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Files of (doc_id, category, path, text); a task that runs again writes the same file again."""
    import pyarrow as pa
    from pyarrow import fs as pafs

    def run(batches):
        filesystem, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            files = []
            for r in batch.to_pylist():
                place = f"{r['category']}/" if r["category"] else ""
                name = f"{place}{r['path'].rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{suffix}"
                filesystem.create_dir(f"{root}/{place}", recursive=True)
                with filesystem.open_output_stream(f"{root}/{name}") as out:
                    out.write((r["text"] or "").encode())
                files.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.string())], names=["doc_id", "file"])

    return rows.mapInArrow(run, "doc_id long, file string")


def stamped(name: str, suffix: str, when=None) -> str:
    """`name` with the time, for outputs that must not overwrite one another."""
    from datetime import datetime

    return f"{name}_{(when or datetime.now()).strftime('%Y%m%d_%H%M%S')}.{suffix}"
