"""Corpus reports: per-file rows summed by category and version, comparisons, benchmarks, feature coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import escape_html


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percent, 0 where there is nothing."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), digits)


def _success(ok: str) -> list[Column]:
    good = F.count_if(ok)
    return [F.count("*").alias("total"), good.alias("ok"), F.count_if(~F.col(ok)).alias("failed"), rate(good, F.count("*")).alias("rate")]


def summary(rows: DataFrame, ok: str, *averages: str) -> DataFrame:
    """One row: counts, success rate and averages (0 for no rows)."""
    return rows.agg(*_success(ok), *[F.round(F.coalesce(F.avg(a), F.lit(0.0)), 4).alias(f"avg_{a}") for a in averages])


def by_category(rows: DataFrame, category: str, ok: str) -> DataFrame:
    return rows.groupBy(category).agg(*_success(ok))


def totals_and_categories(rows: DataFrame, category: str, ok: str, value: str) -> DataFrame:
    """A row for all files (null category, is_total) and one for each category."""
    sets = rows.groupingSets([[], [F.col(category)]], F.col(category))
    return sets.agg(F.grouping(category).cast("boolean").alias("is_total"), *_success(ok), F.round(F.avg(value), 4).alias(f"avg_{value}"))


def by_version(rows: DataFrame, version: str) -> DataFrame:
    return rows.where(F.col(version).isNotNull()).groupBy(version).agg(F.count("*").alias("files"))


def feature_coverage(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(feature, files, percent) of boolean columns; one pass, then unpivoted."""
    counted = rows.agg(F.count("*").alias("__n"), *[F.count_if(f).alias(f) for f in flags])
    return counted.unpivot("__n", flags, "feature", "files").select("feature", "files", rate(F.col("files"), F.col("__n")).alias("percent"))


def index_percentiles(rows: DataFrame, by: str, value: str, shares=(0.5, 0.9, 0.95)) -> DataFrame:
    """Values at index int(n * share) of the sorted values, by rank and count; the group is sorted by a window, not collected."""
    w = Window.partitionBy(by)
    ranked = rows.where(F.col(value).isNotNull()).select(by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    return ranked.groupBy(by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == at(q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares])


def slowest(rows: DataFrame, value: str, k: int = 10, tie: str = "event_id") -> DataFrame:
    return rows.orderBy(F.desc(value), tie).limit(k)


def quality_class(ratio: Column, similarity: Column) -> Column:
    close = F.abs(ratio - 1)
    return (
        F.when((close < 0.05) & (similarity > 0.95), "EXCELLENT").when((close < 0.15) & (similarity > 0.8), "GOOD").when((close < 0.3) & (similarity > 0.6), "FAIR").otherwise("POOR")
    )


def distribution(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n, percent): counts by class with their share of all."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def compare_outputs(ours: DataFrame, theirs: DataFrame, key: str, size: str, category: str) -> DataFrame:
    """By category: files in both, mean and median size ratio, sums, and size classes."""
    both = ours.select(key, category, F.col(size).alias("a")).join(theirs.select(key, F.col(size).alias("b")), key)
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    rows = both.withColumn("ratio", ratio)
    return rows.groupBy(category).agg(
        F.count("*").alias("files"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.median("ratio"), 6).alias("median_ratio"), F.sum("a").alias("ours"), F.sum("b").alias("theirs"),
        F.count_if(F.col("ratio") < 0.8).alias("smaller"), F.count_if(F.col("ratio").between(0.8, 1.2)).alias("similar"), F.count_if(F.col("ratio") > 1.2).alias("larger"),
    )


def merge_results(old: DataFrame, new: DataFrame, library: str) -> DataFrame:
    """All new rows and the old ones of libraries that the new ones don't name."""
    return old.join(new.select(library).distinct(), library, "left_anti").unionByName(new)


def failures(rows: DataFrame, error: str) -> DataFrame:
    return rows.where(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("files")).orderBy(F.desc("files"), error)


def html_report(rows: DataFrame, title: str, order: str) -> DataFrame:
    """One row, one column `html`: a small table as a page. For reports of a few rows."""
    cells = lambda tag: F.concat(*[F.concat(F.lit(f"<{tag}>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(f"</{tag}>")) for c in rows.columns])
    listed = rows.select(F.struct(F.col(order).alias("o"), F.concat(F.lit("<tr>"), cells("td"), F.lit("</tr>")).alias("t")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("l"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in rows.columns) + "</tr>"
    return listed.select(F.concat(F.lit(f"<html><head><title>{title}</title></head><body><table>{head}"), F.array_join(F.col("l.t"), ""), F.lit("</table></body></html>")).alias("html"))


# --- graphs of object references ------------------------------------------------------------


def reference_cycles(spark, edges: DataFrame, *, depth: int = 100) -> DataFrame:
    """(doc_id, src): objects that a chain of references leads back to, by a recursive query along distinct pairs."""
    edges.select("doc_id", "src", "dst").distinct().createOrReplaceTempView("__refs")
    return spark.sql(f"""
      WITH RECURSIVE walk(doc_id, src, dst, n) MAX RECURSION LEVEL {depth + 1} AS (
        SELECT doc_id, src, dst, 1 FROM __refs
        UNION ALL
        SELECT w.doc_id, w.src, r.dst, w.n + 1 FROM walk w JOIN __refs r ON r.doc_id = w.doc_id AND r.src = w.dst WHERE w.dst <> w.src AND w.n < {depth})
      SELECT DISTINCT doc_id, src FROM walk WHERE src = dst""")
