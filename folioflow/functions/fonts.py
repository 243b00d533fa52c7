"""Fonts as columns: weight, style, ToUnicode maps, permission bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name parts and the weight they stand for; the first that a name holds counts.
WEIGHT_WORDS = (("black|heavy|ultra-?bold|extra-?bold", None), ("semi-?bold|demi", 600), ("bold", 700), ("medium", 500), ("ultra-?light|extra-?light", 200), ("thin|hairline", 100), ("light", 300))


def font_weight(name: Column, flags: Column, stem_v: Column, explicit: Column | None = None) -> Column:
    """100 to 900: an explicit weight, else the force-bold bit, else the name, else the stem width, else 400."""
    low = F.lower(name)
    by_name = F.when(low.rlike("black|heavy"), 900).when(low.rlike("ultra-?bold|extra-?bold"), 800)
    for pattern, weight in WEIGHT_WORDS[1:]:
        by_name = by_name.when(low.rlike(pattern), weight)
    by_stem = F.when(stem_v > 110, 700).when(stem_v >= 80, 500)
    forced = F.when(flags.bitwiseAND(1 << 18) != 0, 700)
    parts = [forced, by_name, by_stem, F.lit(400)]
    return F.coalesce(*([explicit] if explicit is not None else []), *parts).cast("int")


def is_bold(weight: Column) -> Column:
    return weight >= 600


def is_italic(name: Column, flags: Column) -> Column:
    return F.lower(name).rlike("italic|oblique") | (flags.bitwiseAND(64) != 0)


def is_symbolic(name: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(4) != 0) | F.lower(name).rlike("symbol|zapf|dingbat|wingding")


PERMISSIONS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill_forms": 256, "accessibility": 512, "assemble": 1024, "print_high_quality": 2048}


def permissions(p: Column) -> dict[str, Column]:
    return {name: p.bitwiseAND(bit) != 0 for name, bit in PERMISSIONS.items()}


def glyph_width(widths: Column, code: Column, first_char: Column, default: Column) -> Column:
    return F.coalesce(F.get(widths, code - first_char), default)


def _text(hex_: Column) -> Column:
    return F.decode(F.unhex(hex_), "UTF-16BE")


def parse_cmaps(df: DataFrame, key: str, cmap: str, most: int = 10_000) -> DataFrame:
    """(key, code, unicode) of ToUnicode maps: single characters, ranges and ranges with lists, in SQL alone."""
    blocks = lambda name: F.explode(F.regexp_extract_all(cmap, F.lit(rf"(?s)begin{name}(.*?)end{name}"), F.lit(1)))
    number = lambda h: F.conv(h, 16, 10).cast("int")
    hex_ = r"<\s*([0-9A-Fa-f]+)\s*>"
    chars = df.select(key, blocks("bfchar").alias("b")).select(key, F.explode(F.arrays_zip(F.regexp_extract_all("b", F.lit(rf"{hex_}\s*{hex_}"), F.lit(1)).alias("c"), F.regexp_extract_all("b", F.lit(rf"{hex_}\s*{hex_}"), F.lit(2)).alias("u"))).alias("p"))
    singles = chars.select(key, number(F.col("p.c")).alias("code"), _text(F.col("p.u")).alias("unicode"))
    ranges = df.select(key, blocks("bfrange").alias("b")).select(key, F.explode(F.regexp_extract_all("b", F.lit(rf"({hex_}\s*{hex_}\s*(?:<[^>]*>|\[[^\]]*\]))"), F.lit(1))).alias("r"))
    parts = ranges.select(key, "r", number(F.regexp_extract("r", hex_, 1)).alias("lo"), number(F.regexp_extract("r", rf"{hex_}\s*{hex_}", 2)).alias("hi"))
    parts = parts.where((F.col("hi") >= F.col("lo")) & (F.col("hi") - F.col("lo") < most))
    first = F.regexp_extract("r", rf"{hex_}\s*$", 1)
    last_unit = F.conv(F.right(first, F.lit(4)), 16, 10).cast("int")
    step = parts.where(~F.contains("r", F.lit("["))).withColumn("first", first).withColumn("unit", last_unit).select(key, "first", "unit", "lo", F.explode(F.sequence("lo", "hi")).alias("code"))
    shifted = F.concat(F.expr("left(first, greatest(length(first) - 4, 0))"), F.lpad(F.hex(F.col("unit") + F.col("code") - F.col("lo")), 4, "0"))
    runs = step.select(key, "code", _text(shifted).alias("unicode"))
    listed = parts.where(F.contains("r", F.lit("["))).select(key, "lo", "hi", F.posexplode(F.regexp_extract_all(F.regexp_extract("r", r"\[([^\]]*)\]", 1), F.lit(hex_), F.lit(1))).alias("i", "u"))
    lists = listed.where(F.col("lo") + F.col("i") <= F.col("hi")).select(key, (F.col("lo") + F.col("i")).alias("code"), _text(F.col("u")).alias("unicode"))
    return singles.unionByName(runs).unionByName(lists)
