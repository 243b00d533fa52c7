"""Mixing sources to target weights.

Per source the size of all its documents is summed (partial sums before the shuffle, so a
source with a third of all rows costs nothing extra). The sources, in code point order with
null last, take the weights in turn; each gets its share of the whole, but not more than
`most` times its own size, and what is cut off goes to the others by weight. The ratio of
target to size is the source's repetition rate: every document is emitted floor(rate) times
and once more if its draw, a hash of its id and the seed, is below a bound. The fraction itself as the bound
misses the target by chance, by a third where a source has 50 documents. So the bound is set where the words
drawn come nearest the fraction's share (it differs from the fraction by that chance alone), first for
the documents of more words than their source's mean, then for the others, which make up for what those left.
The bounds come from histograms of the draws and from the draws in one of 65,536 parts of each, so no
source is sorted as a whole.

Edge cases: a null text and an empty one have size 0; a source of size 0 has target 0 and
rate 0; null is a source of its own; repeated rows draw the same number; a null id draws
by its text; an empty table gives an empty result. Further columns pass through,
columns of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD_PATTERN, read_table, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(doc_id: str | Column, seed: int, text: str | Column = "text") -> Column:
    """A number from 0 to 2^32 - 1 from the md5 of id (or text, without one) and seed; the same on every run and engine."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.col(text) if isinstance(text, str) else text
    key = F.when(doc_id.isNotNull(), doc_id.cast("string")).otherwise(F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size): weighted shares under caps.

    The level t with sum(min(weight * t, cap)) = total is found by sorting the sources by
    cap / weight: the first so many are at their cap, the rest get weight * t. One row per
    source goes through the unpartitioned windows, which stream.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("below", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(everything) - (F.sum("weight").over(order) - F.col("weight")))
        .withColumn("total", F.sum("source_size").over(everything))
        # with the sources before this one at their caps, is this one above its own?
        .withColumn("fits", (F.col("total") - F.col("below")) * F.col("weight") < F.col("cap") * F.col("left"))
    )
    first = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = levels.withColumn("at", F.first(F.when(F.col("fits"), F.struct("below", "left")), ignorenulls=True).over(first))
    share = (F.col("total") - F.col("at.below")) * F.col("weight") / F.col("at.left")
    return chosen.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).cast("double").alias("target"))


PART = 1 << 16  # draws of one part of the histogram


def _bounds(draws: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, bound, words): draws up to `bound` have `words`, as near as can be to the source's `need`.

    The part of the histogram in which the running sum passes the need is found from one row for each part, and the draws
    of that part alone are put in order.
    """
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = draws.groupBy("source", F.floor(F.col("u") / PART).alias("part")).agg(F.sum("size").alias("words"))
    summed = parts.withColumn("upto", F.sum("words").over(up_to))
    named = needs.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    passed = summed.join(named, same).where("upto > need").groupBy("source").agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("before"))).alias("p"), F.first("need").alias("need"))
    at = passed.select(F.col("source").alias("__source"), F.col("p.part").alias("__part"), F.col("p.before").alias("before"), "need")
    inside = draws.join(at, same & (F.floor(F.col("u") / PART) == F.col("__part"))).groupBy("source", "u", "before", "need").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumn("upto", F.col("before") + F.sum("words").over(order)).where("upto > need")
    first = placed.groupBy("source").agg(F.min(F.struct("u", "upto", "words")).alias("f"), F.first("need").alias("need"))
    over = F.col("f.upto") - F.col("need") < F.col("need") - (F.col("f.upto") - F.col("f.words"))
    found = first.select(F.col("source").alias("__source"), F.when(over, F.col("f.u")).otherwise(F.col("f.u") - 1).alias("bound"), F.when(over, F.col("f.upto")).otherwise(F.col("f.upto") - F.col("f.words")).alias("words"))
    whole = draws.groupBy("source").agg(F.sum("size").alias("all"))  # what a source without a passing part takes
    return found.join(whole, same, "right").select("source", F.coalesce("bound", F.lit(1 << 32)).alias("bound"), F.coalesce("words", "all").alias("words"))


def source_bounds(draws: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, n, whole, extra, large, small): whole copies, whether more are drawn, bounds of the draws of large and small documents."""
    n = draws.groupBy(F.col("source").alias("__source")).agg(F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = written(targets.join(n, F.col("source").eqNullSafe(F.col("__source"))).select("source", "source_size", "target", "n", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")), "rates")
    named = rates.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    marked = draws.join(named.select("__source", "source_size", "n"), same).select("source", "u", "size", (F.col("size") * F.col("n") > F.col("source_size")).alias("large"))
    large, small = marked.where("large"), marked.where("NOT large")
    sums = large.groupBy("source").agg(F.sum("size").alias("all"))
    first = written(_bounds(large, sums.join(named, same).select("source", (F.col("part") * F.col("all")).alias("need"))), "large")
    taken = first.select("source", F.col("bound").alias("large"), F.col("words").alias("done"))
    open_ = written(rates.withColumnRenamed("source", "__source").join(taken, same, "left").select(F.col("__source").alias("source"), "source_size", "target", "n", "whole", "part", F.coalesce("large", F.lit(-1)).alias("large"), F.coalesce("done", F.lit(0)).alias("done")), "open")
    rest = _bounds(small, open_.select("source", (F.col("target") - F.col("whole") * F.col("source_size") - F.col("done")).alias("need"))).select(F.col("source").alias("__source"), F.col("bound").alias("small"))
    return open_.join(rest, same, "left").select("source", "source_size", "target", "n", "whole", (F.col("part") > 0).alias("extra"), "large", F.coalesce("small", F.lit(-1)).alias("small"))


def mix(docs: DataFrame, *, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, most=MOST, seed=SEED) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken; the table of sources is joined by equality."""
    own = ("size", "source_size", "target", "copies", "taken", "__source", "__u")
    sized = docs.drop(*[c for c in own if c not in (text, source, doc_id)]).withColumn("size", word_count(text)).withColumn("__u", draw(doc_id, seed, text))
    draws = written(sized.select(F.col(source).alias("source"), F.col("__u").alias("u"), "size"), "draws")
    targets = source_targets(draws.select("source", "size"), weights, most)
    bounds = written(source_bounds(draws, targets), "bounds").withColumnRenamed("source", "__source")
    bound = F.when(F.col("size") * F.col("n") > F.col("source_size"), F.col("large")).otherwise(F.col("small"))
    return (
        sized.join(bounds, sized[source].eqNullSafe(F.col("__source")))
        .withColumn("copies", (F.col("whole") + (F.col("extra") & (F.col("__u") <= bound)).cast("long")).cast("long"))
        .withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
        .drop("__source", "__u", "n", "whole", "extra", "large", "small")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`."""
    rows = mix(docs, **options)
    return rows.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def op10_mix_sources(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_sql(docs: str = "documents") -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM by_source
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM ranked
), levels AS (
  SELECT *, (sum(cap) OVER (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)) - cap AS below,
    (sum(weight) OVER ()) - ((sum(weight) OVER (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)) - weight) AS left_,
    sum(source_size) OVER () AS total
  FROM weighed
), place AS (
  SELECT min(cap / weight) AS least, count(*) AS n FROM levels WHERE (total - below) * weight < cap * left_
), start AS (
  SELECT l.below, l.left_, l.total, l.cap / l.weight AS ratio, l.rank FROM levels l
  WHERE (l.total - l.below) * l.weight < l.cap * l.left_ ORDER BY l.cap / l.weight, l.rank LIMIT 1
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN s.rank IS NOT NULL AND (l.cap / l.weight > s.ratio OR (l.cap / l.weight = s.ratio AND l.rank >= s.rank))
      THEN CAST((l.total - s.below) * l.weight AS DOUBLE) / CAST(s.left_ AS DOUBLE) ELSE CAST(l.cap AS DOUBLE) END AS target
  FROM levels l LEFT JOIN start s ON true
), rates AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || md5(coalesce(d.text, ''))) || ':17'), 1, 8) AS BIGINT) AS u,
    d.size * count(*) OVER (PARTITION BY d.source) > t.source_size AS large
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), draws AS (
  SELECT source, large, u, CAST(sum(size) AS BIGINT) AS words, any_value(rate) AS rate, any_value(target) AS target, any_value(source_size) AS source_size
  FROM rates GROUP BY source, large, u
), runs AS (
  SELECT *, sum(words) OVER (PARTITION BY source, large ORDER BY u) AS upto, sum(words) OVER (PARTITION BY source, large) AS whole FROM draws
), large_first AS (
  SELECT source, (rate - floor(rate)) * any_value(whole) AS need, any_value(whole) AS whole,
    min(struct_pack(u := u, upto := upto, words := words)) FILTER (upto > (rate - floor(rate)) * whole) AS f
  FROM runs WHERE large GROUP BY source, rate
), large_bound AS (
  SELECT source, CASE WHEN f IS NULL THEN 4294967296 WHEN f.upto - need < need - (f.upto - f.words) THEN f.u ELSE f.u - 1 END AS bound,
    CASE WHEN f IS NULL THEN whole WHEN f.upto - need < need - (f.upto - f.words) THEN f.upto ELSE f.upto - f.words END AS done
  FROM large_first
), small_need AS (
  SELECT r.*, r.target - floor(r.rate) * r.source_size - coalesce(b.done, 0) AS need
  FROM runs r LEFT JOIN large_bound b ON r.source IS NOT DISTINCT FROM b.source WHERE NOT r.large
), small_first AS (
  SELECT source, need, min(struct_pack(u := u, upto := upto, words := words)) FILTER (upto > need) AS f FROM small_need GROUP BY source, need
), small_bound AS (
  SELECT source, CASE WHEN f IS NULL THEN 4294967296 WHEN f.upto - need < need - (f.upto - f.words) THEN f.u ELSE f.u - 1 END AS bound FROM small_first
), drawn AS (
  SELECT r.*, floor(r.rate) + CASE WHEN r.rate > floor(r.rate) AND r.u <= CASE WHEN r.large THEN b.bound ELSE s.bound END THEN 1 ELSE 0 END AS copies
  FROM rates r LEFT JOIN large_bound b ON r.source IS NOT DISTINCT FROM b.source LEFT JOIN small_bound s ON r.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM drawn"""


QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLES = {"op10_mix_sources": mix_sql()}
