"""Pages and documents as Markdown, HTML, plain text and structured elements, from lines or spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import order
from folioflow.operators.cluster import aggregate_blocks, merge_fragments, paragraphs
from folioflow.operators.connect import anchored_lines
from folioflow.operators.layout import heading_class, heading_level

KEYS = ("doc_id", "page")


def _joined(df: DataFrame, keys, order: str, what: Column, separator: str, name: str) -> DataFrame:
    listed = df.select(*keys, F.struct(F.col(order).alias("o"), what.alias("t")).alias("s")).groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("l"))
    return listed.select(*keys, F.array_join(F.col("l.t"), separator).alias(name))


def markdown_pages(spans: DataFrame, keys=KEYS, *, links: bool = True, tolerance: float = 2.0) -> DataFrame:
    """(keys, markdown): fragments of words joined, lines from the top, headings by size and weight, bold runs marked, links, cleanup.

    A bold run gets no marks where they would stand inside a word or between a closing bracket and a sign.
    """
    keys = list(keys)
    rows = anchored_lines(merge_fragments(order.markdown(spans, keys, upward=True), keys), keys, tolerance)
    w = Window.partitionBy(*keys, "line").orderBy("x", "sequence")
    run = rows.withColumn("__new", F.coalesce(F.lag("bold").over(w) != F.col("bold"), F.lit(True)).cast("int")).withColumn("run", F.sum("__new").over(w)).drop("__new")
    runs = aggregate_blocks(run, [*keys, "line", "run"], " ")
    kind = heading_class("font_size", "bold")
    level = heading_level(kind)
    by_run = Window.partitionBy(*keys, "line").orderBy("run")
    runs = runs.withColumn("__left", F.when(F.lag("run").over(by_run).isNotNull(), F.lit(" "))).withColumn("__right", F.when(F.lead("run").over(by_run).isNotNull(), F.lit(" ")))
    allowed = T.bold_marker_allowed(F.col("__left"), F.left("text", F.lit(1))) & T.bold_marker_allowed(F.right("text", F.lit(1)), F.col("__right"))
    marked = F.when(level.isNotNull() | ~F.col("bold") | (F.trim("text") == "") | ~allowed, F.col("text")).otherwise(F.concat(F.lit("**"), "text", F.lit("**")))
    lines = runs.select(*keys, "line", "run", level.alias("level"), marked.alias("t"))
    text = lines.groupBy(*keys, "line").agg(F.sort_array(F.collect_list(F.struct("run", "t"))).alias("l"), F.min("level").alias("level"))
    whole = F.array_join(F.col("l.t"), " ")
    whole = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), whole, F.lit("\n"))).otherwise(whole)
    return shown_markdown(_joined(text, keys, "line", whole, "\n", "markdown"), links=links)


def shown_markdown(page: DataFrame, *, links: bool = True) -> DataFrame:
    """Pages of lines with their links, cleaned."""
    shown = T.dash_spacing("markdown")
    return page.withColumn("markdown", T.cleanup_markdown(T.markdown_links(shown) if links else shown))


def markdown_from_chars(chars: DataFrame, keys=KEYS, **options) -> DataFrame:
    """(keys, markdown) of a table of characters: words by the page's own spacing, then as for spans."""
    from folioflow.operators.cluster import adaptive_words

    return markdown_pages(adaptive_words(chars, keys).drop("line", "word", "n"), keys, **options)


def html_pages(spans: DataFrame, keys=KEYS, *, preserve_layout: bool = False, page_height: float = 792.0) -> DataFrame:
    """(keys, html): headings and paragraphs in reading order, or every span at its place."""
    return layout_html(spans, keys, page_height) if preserve_layout else semantic_html(spans, keys)


def semantic_html(spans: DataFrame, keys=KEYS) -> DataFrame:
    """A heading or paragraph for the spans that stand within 5 in height and 2 in size of the paragraph's first, top first."""
    keys = list(keys)
    blocks = paragraphs(order.html(spans, keys), keys)
    listed = blocks.groupBy(*keys, "par").agg(F.sort_array(F.collect_list(F.struct("rank", "before", "text"))).alias("l"), F.min_by("font_size", "rank").alias("size"), F.min_by("bold", "rank").alias("bold"))
    level = heading_level(heading_class("size", "bold"))
    body = F.array_join(F.transform("l", lambda t: F.concat(t["before"], t["text"])), "")
    return _joined(listed, keys, "par", _html_block(level, F.col("bold"), body), "\n", "html")


def _html_block(level: Column, bold: Column, body: Column) -> Column:
    tag, body = F.coalesce(F.concat(F.lit("h"), level.cast("string")), F.lit("p")), T.linkify_html(body)
    marked = F.when(level.isNull() & bold, F.concat(F.lit("<strong>"), body, F.lit("</strong>"))).otherwise(body)
    return F.concat(F.lit("<"), tag, F.lit(">"), marked, F.lit("</"), tag, F.lit(">"))


def html_of_blocks(pages: DataFrame) -> DataFrame:
    """`blocks` (level, bold, body), in order, as `html`."""
    shown = F.transform("blocks", lambda b: _html_block(b["level"], b["bold"], b["body"]))
    return pages.withColumn("html", F.array_join(shown, "\n")).drop("blocks")


def formatted_chars(chars: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, markdown) of characters by rounded position: a blank for a gap of more than 2 and a quarter of the width before it, runs of bold
    characters of a word between marks."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("__y"), "__x", "sequence", *(["i"] if "i" in chars.columns else []))
    rows = chars.withColumn("__y", F.round("y").cast("long")).withColumn("__x", F.round("x").cast("long"))
    newline = F.coalesce(F.lag("__y").over(w) != F.col("__y"), F.lit(False))
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    blank = ~newline & F.coalesce(gap > F.greatest(F.lit(2.0), 0.25 * F.lag("width").over(w)), F.lit(False))
    other = F.coalesce(F.lag("bold").over(w) != F.col("bold"), F.lit(False))
    rows = rows.withColumn("__before", F.when(newline, F.lit("\n")).when(blank, F.lit(" ")).otherwise(F.lit(""))).withColumn("__new", (newline | blank | other).cast("int")).withColumn("__n", F.row_number().over(w))
    runs = rows.withColumn("__run", F.sum("__new").over(w)).groupBy(*keys, "__run").agg(F.sort_array(F.collect_list(F.struct("__n", "char"))).alias("l"), F.min_by("__before", "__n").alias("before"), F.bool_or("bold").alias("bold"))
    text = F.array_join(F.col("l.char"), "")
    return _joined(runs, keys, "__run", F.concat("before", F.when(F.col("bold"), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)), "", "markdown")


def layout_html(spans: DataFrame, keys=KEYS, page_height: float = 792.0) -> DataFrame:
    number = lambda c: F.format_string("%.1f", c)
    top = F.lit(page_height) - F.col("y") - F.col("height")
    weight = F.when(F.col("bold"), F.lit(";font-weight:bold")).otherwise(F.lit(""))
    box = F.concat(F.lit('<span style="position:absolute;left:'), number(F.col("x")), F.lit("pt;top:"), number(top), F.lit("pt;font-size:"), number(F.col("font_size")), F.lit("pt"), weight, F.lit('">'), T.escape_html("text"), F.lit("</span>"))
    return _joined(spans, list(keys), "sequence", box, "\n", "html")


def document_text(pages: DataFrame, text: str, kind: str = "text", key: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc_id, text): pages in order with the separator of `kind`: markdown, text or html."""
    shown = F.col(text)
    if kind == "html":
        shown = F.concat(F.lit('<div class="page" data-page="'), (F.col(page) + 1).cast("string"), F.lit('">\n'), shown, F.lit("\n</div>"))
    return _joined(pages, [key], page, shown, {"markdown": "\n\n---\n\n", "text": "\n\n---\n\n", "html": "\n"}[kind], "text")


# --- structured elements ------------------------------------------------------------------------


def structured_elements(blocks: DataFrame, keys=KEYS, *, min_header: float = 14.0, levels: int = 6, right_margin: float = 100.0) -> DataFrame:
    """One row an element in reading order (column `line`): type header, list or paragraph; list items of one kind in a row
    are one list. A header's level is the rank of its size among the page's header sizes."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("line")
    rows = blocks.withColumn("text", F.trim("text")).withColumn("marker", T.list_marker("text"))
    size_rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.floor("font_size"))))
    rows = rows.withColumn("level", F.when((F.col("font_size") >= min_header) & (size_rank <= levels), size_rank))
    kind = F.when(F.col("marker").isNotNull(), "list").when(F.col("level").isNotNull(), "header").otherwise("paragraph")
    rows = rows.withColumn("type", kind)
    same_list = (F.col("type") == "list") & (F.lag("type").over(w) == "list") & (F.lag(F.col("marker.ordered")).over(w) == F.col("marker.ordered"))
    rows = rows.withColumn("element", F.sum(F.when(F.coalesce(same_list, F.lit(False)), 0).otherwise(1)).over(w))
    width = F.col("x") + F.col("width") + right_margin
    center = F.col("x") + F.col("width") / 2
    alignment = F.when(F.abs(center - width / 2) < 20, "center").when(F.col("x") > width * 0.6, "right").otherwise("left")
    item = F.expr("trim(cast(substring(encode(text, 'UTF-8'), coalesce(marker.length, 0) + 1) as string))")
    style = F.struct(F.col("font_size"), F.col("font_name"), F.col("bold"), (F.lower("font_name").rlike("italic|oblique")).alias("italic"))
    return rows.groupBy(*keys, "element").agg(
        F.first("type").alias("type"), F.min("level").alias("level"), F.bool_or("marker.ordered").alias("ordered"),
        F.sort_array(F.collect_list(F.struct("line", item.alias("text")))).alias("__items"),
        F.first("text").alias("text"), F.first(style).alias("style"), F.first(alignment).alias("alignment"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"),
    ).select(
        *keys, "element", "type", F.when(F.col("type") == "header", F.col("level")).alias("level"),
        F.when(F.col("type") != "list", F.col("text")).alias("text"), F.when(F.col("type") == "list", F.col("ordered")).alias("ordered"),
        F.when(F.col("type") == "list", F.col("__items.text")).alias("items"), F.when(F.col("type") == "paragraph", F.col("alignment")).alias("alignment"), "style",
        F.array("x0", "y0", "x1", "y1").alias("bbox"),
    )


def structured_counts(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a document: elements by type, list items, whether any is bold or italic."""
    count = lambda t: F.count_if(F.col("type") == t)
    return elements.groupBy(key).agg(
        F.count("*").alias("elements"), count("header").alias("headers"), count("paragraph").alias("paragraphs"), count("list").alias("lists"),
        F.sum(F.coalesce(F.size("items"), F.lit(0)) * (F.col("type") == "list").cast("int")).alias("list_items"), F.bool_or("style.bold").alias("any_bold"), F.bool_or("style.italic").alias("any_italic"),
    )


def structured_json(elements: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, json): the page's elements as one pretty JSON array."""
    listed = elements.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("element", "type", "level", "text", "ordered", "items", "alignment", "bbox"))).alias("l"))
    return listed.select(*keys, F.to_json("l", {"pretty": "true"}).alias("json"))


def structured_text(elements: DataFrame, keys=KEYS) -> DataFrame:
    """Plain text of a structured page: headers and paragraphs as blocks, list items with their mark."""
    mark = lambda i: F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    items = F.array_join(F.transform("items", lambda t, i: F.concat(mark(i), t)), "\n")
    return _joined(elements, list(keys), "element", F.coalesce(items, "text"), "\n\n", "text")


def table_markdown(cells: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, markdown) of cells (keys, row, col, text): a pipe table whose first row is the head; absent cells are blank."""
    keys = list(keys)
    shape = cells.groupBy(*keys).agg(F.max("col").alias("last"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col").alias("k"), T.escape_cell("text").alias("v")))).alias("m"), F.max("row").alias("rows"))
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    cols = F.sequence(F.lit(0), F.col("last"))
    row = lambda r: line(F.transform(cols, lambda c: F.coalesce(F.try_element_at("m", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))))
    rows = F.transform(F.sequence(F.lit(0), F.col("rows")), row)
    rule = line(F.transform(cols, lambda c: F.lit("---")))
    return shape.select(*keys, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows))), "\n").alias("markdown"))


def form_tables(fields: DataFrame) -> DataFrame:
    """(doc_id, markdown): a document's form fields as a table for each field type."""
    row = F.concat(F.lit("| "), T.escape_cell("full_name"), F.lit(" | "), T.escape_cell(F.coalesce("value_text", F.lit(""))), F.lit(" |"))
    listed = fields.groupBy("doc_id", "field_type").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    block = F.concat(F.lit("### "), F.col("field_type"), F.lit("\n\n| Field | Value |\n|---|---|\n"), F.col("rows"))
    return _joined(listed, ["doc_id"], "field_type", block, "\n\n", "markdown").withColumn("markdown", F.concat(F.lit("## Form Fields\n\n"), "markdown"))


def rules_markdown(rules: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, markdown): a page's thinned rules (column length, dashed, dotted), top first: `---`, dashes or dots, 80 at most."""
    n = F.least(F.lit(80), F.greatest(F.lit(3), (F.col("length") / 6).cast("int")))
    shown = F.when(F.col("dotted"), F.repeat(F.lit("."), n)).when(F.col("dashed"), F.repeat(F.lit("- "), (n / 2).cast("int"))).otherwise(F.lit("---"))
    return _joined(rules.withColumn("__o", -F.col("y")), list(keys), "__o", shown, "\n", "markdown")
