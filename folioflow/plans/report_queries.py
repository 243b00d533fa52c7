"""Corpus reports and lookup-table operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import fonts as Fn
from folioflow.functions import text as T
from folioflow.operators import reports as R


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark, sf_dir):
    """Documents as files: ok by label (unlabelled counts as ok), the source as category, the language as version."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("category"), F.col("lang").alias("version"), F.coalesce(F.col("quality") == 1, F.lit(True)).alias("ok"), "n_chars", "text")


ROWS = "WITH rows_ AS (SELECT d.doc_id, d.source AS category, d.lang AS version, coalesce(l.quality = 1, true) AS ok, d.n_chars, d.text FROM documents d LEFT JOIN labels l USING (doc_id))"
SUCCESS = "count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) * 100.0 / count(*), 4) AS rate"


def report_summary(spark, sf_dir):
    return R.summary(_rows(spark, sf_dir), "ok", "n_chars")


def category_report(spark, sf_dir):
    return R.by_category(_rows(spark, sf_dir), "category", "ok")


def version_report(spark, sf_dir):
    return R.by_version(_rows(spark, sf_dir), "version")


def totals(spark, sf_dir):
    return R.totals_and_categories(_rows(spark, sf_dir), "category", "ok", "n_chars")


def content_report(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.groupBy("category").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.char_length("text")).alias("chars"), F.count_distinct("version").alias("versions"))


def feature_coverage(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(*[f.alias(n) for n, f in T.regression_flags("text").items()])
    return R.feature_coverage(rows, rows.columns)


def percentiles(spark, sf_dir):
    return R.index_percentiles(_t(spark, sf_dir, "events"), "event_type", "value")


def top_slowest(spark, sf_dir):
    return R.slowest(_t(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value")


def outliers(spark, sf_dir):
    return R.slowest(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "n_chars", 5, "doc_id")


def _cleaned(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    size = F.length(F.regexp_replace("text", r"[^a-z\n ]", "")).cast("long")
    return docs.select("doc_id", "source", F.length("text").cast("long").alias("size")), docs.select("doc_id", size.alias("size"))


def output_comparison(spark, sf_dir):
    ours, theirs = _cleaned(spark, sf_dir)
    return R.compare_outputs(ours, theirs, "doc_id", "size", "source")


def quality_distribution(spark, sf_dir):
    ours, theirs = _cleaned(spark, sf_dir)
    both = ours.join(theirs.withColumnRenamed("size", "b"), "doc_id")
    kinds = both.select(R.quality_class(F.col("size") / F.greatest("b", F.lit(1)), F.lit(1.0) - (F.col("doc_id") % 10) / 20).alias("class"))
    return R.distribution(kinds, "class")


def merged_results(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("source IN ('src1', 'src2')").withColumn("n_chars", F.col("n_chars") * 2)
    return R.merge_results(docs, new, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def failure_groups(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(F.when(~F.col("ok"), F.concat(F.lit("low quality in "), "version")).alias("error"))
    return R.failures(rows, "error")


def html_report(spark, sf_dir):
    return R.html_report(R.by_version(_rows(spark, sf_dir), "version"), "Versions", "version")


def order_report(spark, sf_dir):
    """Orders by priority: how many are open, value by status, customers of each segment."""
    orders, customer = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.round(F.sum("o_totalprice"), 2).alias("value"))


CMAPS = [
    (1, "2 beginbfchar\n<0041> <0061>\n<0042> <D835DC00>\nendbfchar\n1 beginbfrange\n<0050> <0053> <0070>\nendbfrange"),
    (2, "1 beginbfrange\n<20> <22> [<0041> <0042> <00660066>]\nendbfrange"),
]


def cmap_parse(spark, sf_dir):
    cmaps = spark.createDataFrame(CMAPS, "font int, cmap string")
    return Fn.parse_cmaps(cmaps, "font", "cmap")


CMAP_SQL = "SELECT * FROM (VALUES (1, 65, 'a'), (1, 66, chr(119808)), (1, 80, 'p'), (1, 81, 'q'), (1, 82, 'r'), (1, 83, 's'), (2, 32, 'A'), (2, 33, 'B'), (2, 34, 'ff')) t(font, code, unicode)"


def _fonts(spark, sf_dir):
    """Font rows made from parts: names, flags and stems."""
    part = _t(spark, sf_dir, "part")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Times-Bold", "Arial-Black", "Foo-Light", "Bar-SemiBold", "Baz-Italic", "Qux", "Symbol"))), (F.col("p_partkey") % 7 + 1).cast("int")), F.lit(""))
    return part.select("p_partkey", name.alias("base_font"), F.when(F.col("p_size") % 5 == 0, 262144 + 4).otherwise(F.when(F.col("p_size") % 3 == 0, 64).otherwise(32)).alias("flags"), (F.col("p_size") * 3.0).alias("stem_v"))


def weight_class(spark, sf_dir):
    f = _fonts(spark, sf_dir)
    weight = Fn.font_weight(F.col("base_font"), F.col("flags"), F.col("stem_v"))
    return f.select(F.col("base_font"), weight.alias("weight"), Fn.is_bold(weight).alias("bold"), Fn.is_italic(F.col("base_font"), F.col("flags")).alias("italic"), Fn.is_symbolic(F.col("base_font"), F.col("flags")).alias("symbolic")).groupBy("base_font", "weight", "bold", "italic", "symbolic").agg(F.count("*").alias("n"))


WEIGHT_SQL = """
WITH f AS (SELECT ['Times-Bold', 'Arial-Black', 'Foo-Light', 'Bar-SemiBold', 'Baz-Italic', 'Qux', 'Symbol'][p_partkey % 7 + 1] AS base_font, CASE WHEN p_size % 5 = 0 THEN 262148 WHEN p_size % 3 = 0 THEN 64 ELSE 32 END AS flags, p_size * 3.0 AS stem_v FROM part),
w AS (SELECT *, CASE WHEN (flags & 262144) <> 0 THEN 700 WHEN base_font = 'Arial-Black' THEN 900 WHEN base_font = 'Bar-SemiBold' THEN 600 WHEN base_font = 'Times-Bold' THEN 700 WHEN base_font = 'Foo-Light' THEN 300 WHEN stem_v > 110 THEN 700 WHEN stem_v >= 80 THEN 500 ELSE 400 END AS weight FROM f)
SELECT base_font, weight, weight >= 600 AS bold, base_font = 'Baz-Italic' OR (flags & 64) <> 0 AS italic, (flags & 4) <> 0 OR base_font = 'Symbol' AS symbolic, count(*) AS n FROM w GROUP BY ALL"""


def permissions(spark, sf_dir):
    """Permission bits of integers made from keys."""
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") * 37 % 4096).cast("int").alias("p"))
    bits = Fn.permissions(F.col("p"))
    return p.agg(*[F.count_if(c).alias(n) for n, c in bits.items()])


def cycle_report(spark, sf_dir):
    """References made from suppliers: chains of five, every third one closed to a ring."""
    s = _t(spark, sf_dir, "supplier").select((F.floor(F.col("s_suppkey") / 5)).cast("long").alias("doc_id"), (F.col("s_suppkey") % 5).cast("long").alias("src"))
    chain = s.where("src < 4").withColumn("dst", F.col("src") + 1)
    ring = s.where("src = 4 AND doc_id % 3 = 0").withColumn("dst", F.lit(1).cast("long"))
    return R.reference_cycles(spark, chain.unionByName(ring), depth=12)


CYCLE_SQL = """
WITH RECURSIVE s AS (SELECT CAST(s_suppkey // 5 AS BIGINT) AS doc_id, CAST(s_suppkey % 5 AS BIGINT) AS src FROM supplier),
e AS (SELECT doc_id, src, src + 1 AS dst FROM s WHERE src < 4 UNION ALL SELECT doc_id, src, 1 FROM s WHERE src = 4 AND doc_id % 3 = 0),
w(doc_id, src, dst) AS (SELECT doc_id, src, dst FROM e UNION SELECT w.doc_id, w.src, e.dst FROM w JOIN e ON e.doc_id = w.doc_id AND e.src = w.dst)
SELECT DISTINCT doc_id, src FROM w WHERE src = dst"""

_FLAGS = ("too_short", "replacement_chars", "control_chars", "blank_runs", "many_blanks", "many_newlines", "trailing_blanks", "newline_runs", "mojibake")
from folioflow.plans.text_queries import FLAGS_SQL  # noqa: E402

QUERIES = {
    "report_summary": report_summary,
    "category_report": category_report,
    "version_report": version_report,
    "totals": totals,
    "content_report": content_report,
    "feature_coverage": feature_coverage,
    "percentiles": percentiles,
    "top_slowest": top_slowest,
    "outliers": outliers,
    "output_comparison": output_comparison,
    "quality_distribution": quality_distribution,
    "merged_results": merged_results,
    "failure_groups": failure_groups,
    "html_report": html_report,
    "order_report": order_report,
    "cmap_parse": cmap_parse,
    "weight_class": weight_class,
    "permissions": permissions,
    "cycle_report": cycle_report,
}
_SIZES = "WITH c AS (SELECT doc_id, source, length(text) AS a, length(regexp_replace(text, '[^a-z\\n ]', '', 'g')) AS b FROM documents), r AS (SELECT *, CASE WHEN b > 0 THEN a / b ELSE 0 END AS ratio FROM c)"
ORACLES = {
    "report_summary": f"{ROWS} SELECT {SUCCESS}, round(avg(n_chars), 4) AS avg_n_chars FROM rows_",
    "category_report": f"{ROWS} SELECT category, {SUCCESS} FROM rows_ GROUP BY category",
    "version_report": f"{ROWS} SELECT version, count(*) AS files FROM rows_ WHERE version IS NOT NULL GROUP BY version",
    "totals": f"{ROWS} SELECT category, grouping(category) = 1 AS is_total, {SUCCESS}, round(avg(n_chars), 4) AS avg_n_chars FROM rows_ GROUP BY GROUPING SETS ((), (category))",
    "content_report": f"{ROWS} SELECT category, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT version) AS versions FROM rows_ GROUP BY category",
    "feature_coverage": f"WITH f AS ({FLAGS_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER ({n}) AS files, round(count(*) FILTER ({n}) * 100.0 / count(*), 4) AS percent FROM f" for n in _FLAGS),
    "percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, "
    + ", ".join(f"max(value) FILTER (i = least(floor(n * {q}), n - 1)) AS p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.95, 95)))
    + " FROM r GROUP BY event_type",
    "top_slowest": "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10",
    "outliers": "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5",
    "output_comparison": _SIZES
    + " SELECT source, count(*) AS files, round(avg(ratio), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio, CAST(sum(a) AS BIGINT) AS ours, CAST(sum(b) AS BIGINT) AS theirs, count(*) FILTER (ratio < 0.8) AS smaller, count(*) FILTER (ratio BETWEEN 0.8 AND 1.2) AS similar, count(*) FILTER (ratio > 1.2) AS larger FROM r GROUP BY source",
    "quality_distribution": _SIZES
    + ", k AS (SELECT abs(a / greatest(b, 1) - 1) AS d, 1.0 - (doc_id % 10) / 20 AS s FROM c), q AS (SELECT CASE WHEN d < 0.05 AND s > 0.95 THEN 'EXCELLENT' WHEN d < 0.15 AND s > 0.8 THEN 'GOOD' WHEN d < 0.3 AND s > 0.6 THEN 'FAIR' ELSE 'POOR' END AS class FROM k) SELECT class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM q GROUP BY class",
    "merged_results": "WITH n AS (SELECT doc_id, source, n_chars * 2 AS n_chars FROM documents WHERE source IN ('src1', 'src2')), m AS (SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT * FROM n) SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM m GROUP BY source",
    "failure_groups": f"{ROWS} SELECT 'low quality in ' || version AS error, count(*) AS files FROM rows_ WHERE NOT ok GROUP BY version",
    "html_report": f"{ROWS}, v AS (SELECT version, count(*) AS files FROM rows_ WHERE version IS NOT NULL GROUP BY version) SELECT '<html><head><title>Versions</title></head><body><table><tr><th>version</th><th>files</th></tr>' || string_agg('<tr><td>' || version || '</td><td>' || files || '</td></tr>', '' ORDER BY version) || '</table></body></html>' AS html FROM v",
    "order_report": "SELECT o_orderpriority, c_mktsegment, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "cmap_parse": CMAP_SQL,
    "weight_class": WEIGHT_SQL,
    "permissions": "WITH p AS (SELECT p_partkey * 37 % 4096 AS p FROM part) SELECT " + ", ".join(f"count(*) FILTER ((p & {b}) <> 0) AS {n}" for n, b in (("print", 4), ("modify", 8), ("copy", 16), ("annotate", 32), ("fill_forms", 256), ("accessibility", 512), ("assemble", 1024), ("print_high_quality", 2048))) + " FROM p",
    "cycle_report": CYCLE_SQL,
}
