"""Grouping of characters into words, words into lines, spans into text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions.text import needs_space
from folioflow.operators import connect
from folioflow.operators.fold import fold, merge_groups

KEYS = ("doc_id", "page")


def explode_chars(spans: DataFrame) -> DataFrame:
    """Characters of spans, each with an equal share of the width; control characters go."""
    each = F.split("text", "")
    rows = spans.where(F.length("text") > 0).select("*", F.posexplode(each).alias("i", "char")).where(~F.col("char").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]") & (F.col("char") != ""))
    step = F.col("width") / F.length("text")
    return rows.withColumn("x", F.col("x") + F.col("i") * step).withColumn("width", step).drop("text")


def lines_of(df: DataFrame, keys=KEYS, tolerance: float = 5.0) -> DataFrame:
    """Adds `line`, from 0: islands of y, top first, where neighbours differ by at most `tolerance`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "sequence")
    start = F.coalesce(F.lag("y").over(w) - F.col("y") > tolerance, F.lit(True)).cast("int")
    return df.withColumn("__s", start).withColumn("line", (F.sum("__s").over(w) - 1).cast("int")).drop("__s")


def islands(df: DataFrame, keys, gap: Column, most: float, name: str) -> DataFrame:
    """Adds `name`: islands along x within the keys where `gap` to the row before is at most `most`."""
    w = Window.partitionBy(*keys).orderBy("x", "sequence")
    return df.withColumn("__s", F.coalesce(gap > most, F.lit(True)).cast("int")).withColumn(name, (F.sum("__s").over(w) - 1).cast("int")).drop("__s")


def words(chars: DataFrame, keys=KEYS, eps: float = 8.0, line_share: float = 0.5) -> DataFrame:
    """Characters to words: what is connected by centres at most `eps` apart on one line. One row a word."""
    placed = connect.char_clusters(chars, keys, eps, line_share)
    return aggregate_blocks(placed.withColumnRenamed("char", "text"), [*keys, "word"], "")


def adaptive_words(chars: DataFrame, keys=KEYS, share: float = 0.8) -> DataFrame:
    """As words, with `share` of the page's median character width as the reach."""
    from folioflow.operators.layout import weighted_upper_median

    keys = list(keys)
    medians = weighted_upper_median(chars.withColumn("__n", F.lit(1)), keys, "width", "__n", "__median")
    wide = chars.join(medians, keys).withColumn("__eps", F.greatest(share * F.col("__median"), F.col("__median") + 1e-6))
    placed = connect.char_clusters(wide, keys, eps_column="__eps").drop("__median", "__eps")
    return aggregate_blocks(placed.withColumnRenamed("char", "text"), [*keys, "word"], "")


def text_lines(words_: DataFrame, keys=KEYS, tolerance: float = 5.0, most: float = 50.0) -> DataFrame:
    """Words to lines: what is connected by heights at most `tolerance` and nearest edges less than `most` apart. One row a line."""
    return aggregate_blocks(connect.word_clusters(words_, keys, tolerance, most), [*keys, "line"], " ")


def char_blocks(chars: DataFrame, keys=KEYS) -> DataFrame:
    """Characters of one rounded height to blocks: a gap wider than 2 and a quarter of the block's mean width parts them. One row a block."""

    def step(state, y, x, width):
        joins = state is not None and state[0] == y and x - state[1] <= max(2.0, 0.25 * state[2] / state[3])
        number = 0 if state is None else state[4] + (not joins)
        return (y, x + width, (state[2] if joins else 0.0) + width, (state[3] if joins else 0) + 1, number), number

    rows = chars.withColumn("__y", F.round("y").cast("long")).withColumn("__x", F.col("x").cast("double")).withColumn("__w", F.col("width").cast("double"))
    placed = fold(rows, list(keys), [F.desc("__y"), F.round("x"), "__x", "sequence"], ["__y", "__x", "__w"], step, "block bigint").drop("__y", "__x", "__w")
    return aggregate_blocks(placed.withColumnRenamed("char", "text"), [*keys, "block"], "")


def merge_fragments(spans: DataFrame, keys=KEYS, share: float = 0.18) -> DataFrame:
    """Neighbours in Markdown order (`rank`) as one block: of one line (less than 2 apart), font, weight and size (less than half a point apart),
    with a gap of less than `share` of the size, neither of them blank. One row a block."""

    def step(state, y, x, width, font, size, bold, blank):
        joins = state is not None and abs(state[0] - y) < 2.0 and state[2] == font and abs(state[3] - size) < 0.5 and state[4] == bold and not state[5] and not blank and x - state[1] < share * state[3]
        number = 0 if state is None else state[6] + (not joins)
        return ((state[0], x + width, *state[2:6], number) if joins else (y, x + width, font, size, bold, blank, number)), number

    rows = spans.select(*spans.columns, *[F.col(c).cast("double").alias(f"__{c}") for c in ("y", "x", "width", "font_size")], (F.trim("text") == "").alias("__blank"))
    placed = fold(rows, list(keys), ["rank"], ["__y", "__x", "__width", "font_name", "__font_size", "bold", "__blank"], step, "block bigint").drop("__y", "__x", "__width", "__font_size", "__blank")
    first = placed.groupBy(*keys, "block").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("__t"), F.min_by("x", "rank").alias("x"), F.min_by("y", "rank").alias("y"), F.max_by(F.col("x") + F.col("width"), "rank").alias("__x1"), F.min_by("height", "rank").alias("height"),
        F.min_by("font_size", "rank").alias("font_size"), F.min_by("font_name", "rank").alias("font_name"), F.min_by("bold", "rank").alias("bold"), F.min("sequence").alias("sequence"), F.count("*").alias("n"),
    )
    return first.withColumn("text", F.array_join(F.col("__t.text"), "")).withColumn("width", F.col("__x1") - F.col("x")).drop("__t", "__x1")


def paragraphs(spans: DataFrame, keys=KEYS) -> DataFrame:
    """Adds `par` and `before` (a blank or nothing): spans in order (`rank`) less than 5 in height and 2 in size from the first of their paragraph."""

    def step(state, y, x, width, size, text):
        joins = state is not None and abs(y - state[0]) < 5.0 and abs(size - state[1]) < 2.0
        number = 0 if state is None else state[4] + (not joins)
        blank = joins and x - state[2] > 1.0 and not state[3] and not text.startswith(" ")
        right = max(state[2], x + width) if joins else x + width
        return ((state[0], state[1], right, text.endswith(" ") if text else state[3], number) if joins else (y, size, right, text.endswith(" "), number)), number, " " if blank else ""

    rows = spans.select(*spans.columns, *[F.col(c).cast("double").alias(f"__{c}") for c in ("y", "x", "width", "font_size")])
    return fold(rows, list(keys), ["rank"], ["__y", "__x", "__width", "__font_size", "text"], step, "par bigint, before string").drop("__y", "__x", "__width", "__font_size")


def aggregate_blocks(df: DataFrame, keys, separator: str) -> DataFrame:
    """One row a group: text in order of x, bounding box, mean size, most frequent font (the smallest name on ties),
    any bold, the mcid if all have the same."""
    listed = F.sort_array(F.collect_list(F.struct("x", "sequence", "text")))
    has = set(df.columns)
    out = df.groupBy(*keys).agg(
        listed.alias("__t"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("__x1"), F.max(F.col("y") + F.col("height")).alias("__y1"),
        F.avg("font_size").alias("font_size"),
        *([F.mode("font_name", True).alias("font_name")] if "font_name" in has else []),
        *([F.bool_or("bold").alias("bold")] if "bold" in has else []),
        *([F.when(F.count_if(F.col("mcid").isNull()) == 0, F.when(F.min("mcid") == F.max("mcid"), F.min("mcid"))).alias("mcid")] if "mcid" in has else []),
        F.min("sequence").alias("sequence"), F.count("*").alias("n"),
    )
    return out.withColumn("text", F.array_join(F.col("__t.text"), separator)).withColumn("width", F.col("__x1") - F.col("x")).withColumn("height", F.col("__y1") - F.col("y")).drop("__t", "__x1", "__y1")


def merge_spans(spans: DataFrame, keys=KEYS) -> DataFrame:
    """Adjacent spans of a line as one; a blank where the gap or the letters call for it."""
    keys = list(keys)
    grouped = merge_groups(spans, keys)
    w = Window.partitionBy(*keys, "group_no").orderBy("x", "sequence")
    wide = (F.col("gap") > 0.25 * F.col("font_size")) | (F.col("gap") > 0.1)
    blank = F.col("gap").isNotNull() & (wide | needs_space(F.lag("text").over(w), F.col("text")))
    pieces = grouped.withColumn("text", F.when(blank, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return aggregate_blocks(pieces, [*keys, "group_no"], "")


def bold_runs(spans: DataFrame, keys=("doc_id", "page", "line")) -> DataFrame:
    """Runs of equal boldness in a line: one row a run with its text."""
    w = Window.partitionBy(*keys).orderBy("x", "sequence")
    rows = spans.withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "bold").orderBy("x", "sequence")))
    listed = rows.groupBy(*keys, "bold", "run").agg(F.sort_array(F.collect_list(F.struct("x", "sequence", "text"))).alias("t"))
    return listed.select(*keys, "bold", F.col("t")[0]["x"].alias("x"), F.array_join(F.col("t.text"), " ").alias("text"))


def separators(spans: DataFrame, keys=KEYS) -> DataFrame:
    """Adds `before`: what stands before a span in the page's text. dy > 2 gives one to three newlines by line height,
    else a blank for a gap between a quarter of and five sizes on a line; else nothing."""
    w = Window.partitionBy(*keys).orderBy("rank")
    dy = F.abs(F.lag("y").over(w) - F.col("y"))
    size = F.greatest(F.lag("font_size").over(w), F.col("font_size"))
    newlines = F.greatest(F.lit(1), F.least(F.lit(3), F.round(dy / (1.2 * F.greatest(size, F.lit(10.0)))).cast("int")))
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    blank = (gap > 0.25 * F.col("font_size")) & (gap < 5 * F.col("font_size")) & (dy <= 0.3 * F.col("font_size"))
    return spans.withColumn("before", F.when(dy > 2, F.repeat(F.lit("\n"), newlines)).when(blank, F.lit(" ")).otherwise(F.lit("")))


def page_text(spans: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, text): ordered spans (column rank) with separators between them."""
    listed = separators(spans, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "before", "text"))).alias("t"))
    return listed.select(*keys, F.array_join(F.transform("t", lambda s: F.concat(s["before"], s["text"])), "").alias("text"))


def merged_box(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.withColumn("r", G.rect("x", "y", "width", "height")).groupBy(*keys).agg(G.union_all(F.col("r")).alias("box"))


def aligned_pairs(df: DataFrame, keys=KEYS, tolerance: float = 2.0, reach: float = 12.0) -> DataFrame:
    """Pairs (a, b) of a page whose y differ by less than `tolerance` and whose horizontal gap is in [0, reach).

    A band join: both coordinates are bucketed, so a span meets neighbours alone.
    """
    keys = list(keys)
    cell = df.select(*keys, "sequence", "x", "y", "width", F.floor(F.col("y") / tolerance).alias("ky"), F.floor((F.col("x") + F.col("width")) / reach).alias("kx"))
    right = df.select(*keys, F.col("sequence").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / reach).alias("bx"))
    near = right.withColumn("ky", F.explode(F.array(*[F.floor(F.col("oy") / tolerance) + d for d in (-1, 0, 1)]))).withColumn("kx", F.explode(F.array(F.col("bx") - 1, F.col("bx"))))
    gap = F.col("ox") - F.col("x") - F.col("width")
    return cell.join(near, [*keys, "ky", "kx"]).where((F.abs(F.col("y") - F.col("oy")) < tolerance) & (gap >= 0) & (gap < reach) & (F.col("sequence") != F.col("other"))).select(*keys, "sequence", "other", gap.alias("gap"))
