"""The text operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T

#: Texts of `documents` with page furniture around them, so that every pattern has work.
FURNITURE = "concat('Page ', doc_id, chr(10), '  - ', doc_id % 90, ' -', chr(10), text, chr(10), '[', doc_id, ']', chr(10), chr(10), chr(10), chr(10), '42', chr(10), '-- ---', chr(10), '======', chr(10), 'the the  End ')"
URLS = "concat(text, chr(10), 'See https://example.org/a', doc_id, '?x=1, or write to a.b', doc_id, '@mail.example.org. pp. 12 – 15 and 3 –4, 5— 6 <b>\"R&D\"</b> it''s')"


def _docs(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(expression):
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.expr(expression).alias("text"))


furnished, linked = _with(FURNITURE), _with(URLS)
ARTIFACT_SQL = "t"
for _p in (r"(?m)^Page\s+\d+\s*$", r"(?m)^\s*-\s*\d+\s*-\s*$", r"(?m)^\s*[\[(]\d+[\])]\s*$", r"(?m)^\s*\d{1,3}\s*$", r"(?m)^[\s\-]{5,}$", r"(?m)^[\s=]{5,}$"):
    ARTIFACT_SQL = f"regexp_replace({ARTIFACT_SQL}, '{_p}', '', 'g')"
SPACES_SQL = r"""regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)),
  lambda x: repeat(' ', CAST(strlen(x) - strlen(regexp_replace(x, '^\s+', '')) AS BIGINT)) || regexp_replace(regexp_replace(x, '^\s+', ''), ' {2,}', ' ', 'g')), chr(10)), '^\n+', '')"""
NEWLINES = lambda x: rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10) || chr(10), 'g')"
ESCAPE = "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _over(source, expression, name="result"):
    """A query that applies one column function to all texts of a source."""
    return lambda spark, sf_dir: source(spark, sf_dir).select("doc_id", expression("text").alias(name))


def _sql(source: str, expression: str, name="result", table="documents", key="doc_id") -> str:
    return f"SELECT {key}, {expression} AS {name} FROM (SELECT {key}, {source} AS t FROM {table})"


def content_score_by_lang(spark, sf_dir):
    return _docs(spark, sf_dir).select("lang", T.content_score("text").alias("score")).groupBy("lang").agg(
        F.count("*").alias("total"), F.count_if(F.col("score") >= 50).alias("good"), F.sum("score").alias("points"),
        F.round(F.count_if(F.col("score") >= 50) * 100.0 / F.count("*"), 4).alias("rate"),
    )


SCORE_SQL = r"""(CASE WHEN length(text) >= 1000 THEN 25 ELSE 0 END + CASE WHEN NOT contains(text, chr(65533)) THEN 25 ELSE 0 END
  + CASE WHEN regexp_matches(text, 'https?://') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 25 ELSE 0 END)"""


def conversations_plain(spark, sf_dir):
    rows = _docs(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.cleanup_plain(F.expr("concat('  ', text, '  x   y', chr(10), chr(10), chr(10), chr(10), chr(10))")).alias("result"))


def list_markers(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    marked = F.concat(F.element_at(F.array(*map(F.lit, ("• ", "- ", "(a) ", "12. ", "iv) ", "", "abcde. "))), (F.col("n") % 7 + 1).cast("int")), "line")
    found = lines.select("doc_id", "n", T.list_marker(marked).alias("m")).where("m IS NOT NULL")
    return found.groupBy("doc_id").agg(F.count_if("m.ordered").alias("ordered"), F.count_if(~F.col("m.ordered")).alias("bullets"), F.sum("m.length").alias("bytes"))


LISTS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
m AS (SELECT doc_id, ['• ', '- ', '(a) ', '12. ', 'iv) ', '', 'abcde. '][n % 7 + 1] || line AS t FROM l),
f AS (SELECT doc_id, regexp_extract(t, '^([•\-*◦▪►])', 1) AS b, regexp_extract(t, '^(\([0-9A-Za-z]*\))', 1) AS p, regexp_extract(t, '^([0-9a-z]{1,4}[.)])', 1) AS d FROM m)
SELECT doc_id, CAST(count(*) FILTER (b = '') AS BIGINT) AS ordered, CAST(count(*) FILTER (b <> '') AS BIGINT) AS bullets,
  CAST(sum(CASE WHEN b <> '' THEN strlen(b) WHEN p <> '' THEN strlen(p) ELSE strlen(d) END) AS BIGINT) AS bytes
FROM f WHERE b <> '' OR p <> '' OR d <> '' GROUP BY doc_id"""


def uppercase_report(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.uppercase_ratio("text"), 9).alias("ratio"), T.mostly_uppercase(F.upper("text")).alias("title_case"))


def markdown_structure(spark, sf_dir):
    text = F.expr("concat('# ', text, chr(10), chr(10), '- **b** [l](u)', chr(10), '| a | b |', chr(10), '```', chr(10), '```')")
    return _docs(spark, sf_dir).select("doc_id", *[c.cast("long").alias(n) for n, c in T.markdown_structure(text).items()])


STRUCTURE_SQL = r"""SELECT doc_id, len(regexp_extract_all(t, '(?m)^#+[ \t]')) AS headings, len(regexp_extract_all(t, '(?m)^[ \t]*[-*+][ \t]')) AS lists,
  len(regexp_extract_all(t, '\*\*[^*]+\*\*')) AS bold, len(regexp_extract_all(t, '\*[^*]+\*')) AS italic, len(regexp_extract_all(t, '\[[^\]]+\]\([^)]+\)')) AS links,
  len(regexp_extract_all(t, '```')) // 2 AS code_blocks, len(regexp_extract_all(t, '(?m)^\|')) AS table_rows,
  len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: trim(translate(p, chr(10) || chr(9) || chr(13), '   ')) <> '')) AS paragraphs
FROM (SELECT doc_id, '# ' || text || chr(10) || chr(10) || '- **b** [l](u)' || chr(10) || '| a | b |' || chr(10) || '```' || chr(10) || '```' AS t FROM documents)"""


def feature_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("t"))
    rows = rows.unionByName(_docs(spark, sf_dir).select((F.col("doc_id") + 10_000_000).alias("id"), F.concat("text", F.lit("\n| ** --- <br> Form Fields")).alias("t")))
    return rows.select("id", *[(c if n.startswith("has") else c.cast("long")).alias(n) for n, c in T.feature_counts("t").items()])


FEATURES_SQL = r"""SELECT id, len(regexp_extract_all(t, '<br>')) AS br_tags, len(regexp_extract_all(t, '\*\*')) AS bold_marks, len(regexp_extract_all(t, '---')) AS rules,
  len(regexp_extract_all(t, '\n\|')) AS table_rows, contains(t, 'Form Fields') AS has_form_fields, len(regexp_extract_all(t, '[a-z]{3}[A-Z][a-z]{4}[a-z]{2}[A-Z]')) AS garbled
FROM (SELECT page_id AS id, html AS t FROM pages UNION ALL SELECT doc_id + 10000000, text || chr(10) || '| ** --- <br> Form Fields' FROM documents)"""


def ligature_patterns(spark, sf_dir):
    text = F.expr("concat(text, ' financial fnancial offcial difcult α π', 'ﬁ')")
    return _docs(spark, sf_dir).select("doc_id", *[c.cast("long").alias(n) for n, c in T.ligature_report(text).items()], F.length(T.expand_ligatures(text)).cast("long").alias("expanded"))


_sum = lambda ps: " + ".join(f"len(regexp_extract_all(lower(t), '{p}'))" for p in ps)
LIGATURE_SQL = (
    rf"SELECT doc_id, {_sum([chr(92) + 'b' + p for p in T.CORRUPTED])} AS corrupted, {_sum([chr(92) + 'b' + p for p in T.INTACT])} AS intact, {_sum(T.SYMBOLS.values())} AS symbols, "
    "length(replace(t, chr(64257), 'fi')) AS expanded FROM (SELECT doc_id, text || ' financial fnancial offcial difcult α π' || chr(64257) AS t FROM documents)"
)


def regression_flags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in T.regression_flags("text").items()])


FLAGS_SQL = r"""SELECT doc_id, length(text) < 100 AS too_short, contains(text, chr(65533)) AS replacement_chars,
  len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) > 0 AS control_chars, len(regexp_extract_all(text, ' {3,}')) >= 10 AS blank_runs,
  len(regexp_extract_all(text, ' ')) > 0.3 * length(text) AS many_blanks, len(regexp_extract_all(text, '\n')) > 0.15 * length(text) AS many_newlines,
  len(regexp_extract_all(text, '(?m) $')) >= 0.1 * len(string_split(text, chr(10))) AS trailing_blanks, len(regexp_extract_all(text, '\n{3,}')) >= 20 AS newline_runs,
  len(regexp_extract_all(text, 'Ã[\x{0080}-\x{00bf}]|â€')) > 0 AS mojibake FROM documents"""


def text_stats(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lower(F.trim(F.substring("text", 1, 20))).alias("head"), T.split_letters("text").cast("long").alias("split_words"),
    )


STATS_SQL = r"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
  lower(trim(substring(text, 1, 20))) AS head, len(regexp_extract_all(' ' || text || ' ', '(?:^|[^A-Za-z])[A-Za-z](?: [A-Za-z]){3,}(?:[^A-Za-z]|$)')) AS split_words FROM documents"""


def dedup_words(spark, sf_dir):
    return furnished(spark, sf_dir).select("doc_id", T.drop_repeated_words("text").alias("result"))


DEDUP_SQL = rf"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS n
  FROM (SELECT doc_id, {FURNITURE} AS t FROM documents)),
k AS (SELECT *, regexp_matches(w, '^[\p{{L}}\p{{N}}_]') AND length(w) >= 4 AS word FROM p),
g AS (SELECT *, lag(CASE WHEN word THEN lower(w) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k)
SELECT doc_id, string_agg(w, '' ORDER BY n) FILTER (NOT (word AND coalesce(lower(w) = before, false))) AS result FROM g GROUP BY doc_id"""


def similarity_pairs(spark, sf_dir):
    """Lines of benchmark passages against the documents' lines that begin with the same eight words."""
    lead = lambda t: F.array_join(F.slice(F.split(F.lower(t), r"\s+"), 1, 8), " ")
    lines = lambda name, key, text: _docs(spark, sf_dir, name).select(key, F.explode(F.split("text", "\n")).alias(text)).where(F.length(text) > 40)
    items = lines("benchmark", "item_id", "a").withColumn("k", F.xxhash64(lead("a")))
    docs = lines("documents", "doc_id", "b").withColumn("k", F.xxhash64(lead("b")))
    pairs = items.join(docs, "k").groupBy("item_id", "doc_id", "a", "b").agg(F.count("*").alias("times"))
    return pairs.select("item_id", "doc_id", "times", F.round(T.similarity("a", "b"), 6).alias("ratio"))


QUERIES = {
    "content_score_by_lang": content_score_by_lang,
    "normalize_newlines": _over(furnished, T.normalize_newlines),
    "page_artifacts": _over(furnished, T.remove_page_artifacts),
    "cleanup_markdown": _over(furnished, T.cleanup_markdown),
    "horizontal_ws": _over(furnished, T.normalize_spaces),
    "cleanup_plain": conversations_plain,
    "merge_bold": _over(_with("concat('**', text, '** **x**')"), T.merge_bold),
    "dedup_words": dedup_words,
    "md_links": _over(linked, T.markdown_links),
    "md_links_guarded": _over(_with("concat('[https://example.org/a] https://example.org/a https://example.org/b', doc_id, ' x@y.org')"), lambda t: T.markdown_links(t, guard=True)),
    "dash_spacing": _over(linked, T.dash_spacing),
    "html_escape": _over(linked, T.escape_html),
    "html_linkify": _over(linked, T.linkify_html),
    "list_markers": list_markers,
    "uppercase_ratio": uppercase_report,
    "md_structure": markdown_structure,
    "feature_counts": feature_counts,
    "ligature_patterns": ligature_patterns,
    "regression_flags": regression_flags,
    "text_stats": text_stats,
    "table_cells": _over(linked, T.escape_cell),
    "control_chars": _over(_with("concat(text, chr(7), 'x', chr(9), chr(31))"), T.strip_controls),
    "similarity_pairs": similarity_pairs,
}

ORACLES = {
    "content_score_by_lang": f"SELECT lang, count(*) AS total, count(*) FILTER ({SCORE_SQL} >= 50) AS good, CAST(sum({SCORE_SQL}) AS BIGINT) AS points, round(count(*) FILTER ({SCORE_SQL} >= 50) * 100.0 / count(*), 4) AS rate FROM documents GROUP BY lang",
    "normalize_newlines": _sql(FURNITURE, NEWLINES("t")),
    "page_artifacts": _sql(FURNITURE, ARTIFACT_SQL),
    "cleanup_markdown": _sql(FURNITURE, NEWLINES(ARTIFACT_SQL)),
    "horizontal_ws": _sql(FURNITURE, SPACES_SQL),
    "cleanup_plain": f"SELECT conv_id, turn, {NEWLINES(SPACES_SQL)} AS result FROM (SELECT conv_id, turn, concat('  ', text, '  x   y', chr(10), chr(10), chr(10), chr(10), chr(10)) AS t FROM conversations)",
    "merge_bold": _sql("concat('**', text, '** **x**')", "replace(t, '** **', ' ')"),
    "dedup_words": DEDUP_SQL,
    "md_links": _sql(URLS, rf"regexp_replace(regexp_replace(t, '(https?://[^\s<>\[\]]*[^\s<>\[\].,!?;:])', '[\1](\1)', 'g'), '{T.EMAIL}', '[\1](mailto:\1)', 'g')"),
    "md_links_guarded": "SELECT doc_id, '[https://example.org/a] https://example.org/a [https://example.org/b' || doc_id || '](https://example.org/b' || doc_id || ') [x@y.org](mailto:x@y.org)' AS result FROM documents",
    "dash_spacing": _sql(URLS, r"regexp_replace(regexp_replace(t, '(\d)\s+(–|—)(\d)', '\1\2\3', 'g'), '(\d)(–|—)\s+(\d)', '\1\2\3', 'g')"),
    "html_escape": _sql(URLS, ESCAPE),
    "html_linkify": _sql(URLS, rf"""regexp_replace(regexp_replace({ESCAPE}, '(https?://[^\s<>()]+)', '<a href="\1">\1</a>', 'g'), '{T.EMAIL}', '<a href="mailto:\1">\1</a>', 'g')"""),
    "list_markers": LISTS_SQL,
    "uppercase_ratio": r"""SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}')) ELSE 0.0 END, 9) AS ratio,
      coalesce(len(regexp_extract_all(upper(text), '\p{Lu}')) / nullif(len(regexp_extract_all(upper(text), '\p{L}')), 0), 0) > 0.7 AS title_case FROM documents""",
    "md_structure": STRUCTURE_SQL,
    "feature_counts": FEATURES_SQL,
    "ligature_patterns": LIGATURE_SQL,
    "regression_flags": FLAGS_SQL,
    "text_stats": STATS_SQL,
    "table_cells": _sql(URLS, r"replace(replace(t, '|', '\|'), chr(10), ' ')"),
    "control_chars": _sql("concat(text, chr(7), 'x', chr(9), chr(31))", r"regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')"),
}
