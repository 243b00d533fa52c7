"""Queries over whole documents keep words and characters in their task; functions of a page against the operators on tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import cluster, connect, fold, layout, order, paged, render
from folioflow.plans import catalogue
from tests.test_queries import SPAN

#: Queries that shuffle texts of documents at most.
FLOWING = [
    "order_two_columns",
    "anchored_lines",
    "adaptive_xy_cut",
    "span_columns",
    "order_structure_dropped",
    "order_columns",
    "html_layout",
    "bold_runs",
    "order_graph",
    "words_to_lines",
    "dedup_spans",
    "paragraphs",
    "order_adaptive",
    "merge_spans",
    "xy_cut",
    "smoothed_profile",
    "best_valley",
    "projection_profile",
    "html_page",
    "formatted_chars",
    "char_explode",
    "aligned_pairs",
    "md_chars",
    "merge_fragments",
    "md_page",
    "char_words_euclid",
    "char_words",
    "char_blocks",
]


@pytest.mark.parametrize("name", FLOWING)
def test_words_are_neither_shuffled_nor_sorted(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and not re.search("Sort|Window|Generate|Aggregate", plan)


def some_rows(seed: int, n: int = 70) -> list[tuple]:
    """Rows of a page, two columns, uneven lines, some in one place, some blank or empty."""
    rng, rows = random.Random(seed), []
    texts = ["word", "Camel", "x", "", " ", "42", "ab ", " cd", "Üml", "https://a.b/c", "long-word-of-more", "日本", "(a)", "A&B"]
    for k in range(n):
        text, size = rng.choice(texts), rng.choice((12.0, 12.0, 12.0, 11.8, 24.0))
        x, y = rng.choice((0, 0, 330)) + rng.randrange(0, 500) / 2, 700 - 7.0 * rng.randrange(12) + rng.choice((0, 0, 0.4, 1.5))
        rows.append((1, 0, k, text, float(x), y, rng.choice((6.0, 6.0, 5.0)) * len(text), size, size, rng.random() < 0.2, rng.choice(("A", "A", "B-Bold"))))
    return rows


def page_of(rows: list[tuple]) -> paged.Page:
    names = ["doc_id", "page", "sequence", "text", "x", "y", "width", "height", "font_size", "bold", "font_name"]
    columns = {n: list(c) for n, c in zip(names, zip(*rows))}
    return paged.Page(**{n: c if n in ("text", "font_name") else np.array(c) for n, c in columns.items() if n not in ("doc_id", "page")})


def ranked(df):
    return [r.sequence for r in df.orderBy("rank").collect()]


def sequences(p, index):
    return p.sequence[index].tolist()


def regions_of(df, column):
    return [r[column] for r in df.orderBy("sequence").collect()]


def chars_with(find):
    def texts(p):
        c = paged.explode_chars(p)
        return sorted(paged.grouped_texts(c, find(c))[0])

    return texts


def block_texts(p):
    return sorted(paged.grouped_texts(*paged.char_blocks(paged.explode_chars(p)))[0])


def lines_by_sequence(p, line):
    return [k for _, k in sorted(zip(p.sequence.tolist(), line.tolist()))]


def boxes(rows):
    return sorted((r.text, r.sequence, r.x, r.y, r.width, r.height, round(r.font_size, 6), r.bold, r.font_name) for r in rows)


def page_boxes(p):
    return sorted(zip(p.text, *(getattr(p, n).round(6).tolist() if n == "font_size" else getattr(p, n).tolist() for n in ("sequence", "x", "y", "width", "height", "font_size", "bold")), p.font_name))


KEYS = ["doc_id", "page"]
LISTED = [(1, 0, m, 10 - m) for m in (1, 2, 3, 4)]


def by_structure(df):
    with_mcid = df.withColumn("mcid", F.when(F.col("sequence") % 7 > 0, F.col("sequence") % 7).cast("int"))
    return ranked(order.by_structure(with_mcid, df.sparkSession.createDataFrame(LISTED, "doc_id long, page long, mcid int, ord int"), drop_unlisted=True))


def html_page(spark, p):
    rows = [(b["level"], b["bold"], b["body"]) for b in paged.html_blocks(p)]
    return render.html_of_blocks(spark.createDataFrame([(1, rows)], "page int, blocks array<struct<level: int, bold: boolean, body: string>>")).first().html


#: On the table, on the page.
CASES = {
    "words": (lambda df: sorted(r.text for r in cluster.words(cluster.explode_chars(df)).collect()), chars_with(paged.words)),
    "words_euclid": (lambda df: sorted(r.text for r in cluster.aggregate_blocks(connect.char_clusters_euclid(cluster.explode_chars(df)).withColumnRenamed("char", "text"), [*KEYS, "word"], "").collect()), chars_with(paged.words_euclid)),
    "char_blocks": (lambda df: sorted(r.text for r in cluster.char_blocks(cluster.explode_chars(df)).collect()), block_texts),
    "adaptive_words": (lambda df: boxes(cluster.adaptive_words(cluster.explode_chars(df)).collect()), lambda p: page_boxes(paged.adaptive_words(paged.explode_chars(p)))),
    "merge_fragments": (lambda df: boxes(cluster.merge_fragments(order.markdown(df, upward=True)).collect()), lambda p: page_boxes(paged.merge_fragments(p.take(paged.by_height(p, upward=True))))),
    "formatted_chars": (lambda df: render.formatted_chars(cluster.explode_chars(df)).first().markdown, paged.formatted_chars),
    "aligned_pairs": (lambda df: sorted((r.sequence, r.other, r.gap) for r in cluster.aligned_pairs(df).collect()), lambda p: sorted((sequences(p, i), sequences(p, j), gap) for i, j, gap in zip(*paged.aligned_pairs(p)))),
    "chars": (lambda df: [(r.sequence, r.char) for r in order.chars(cluster.explode_chars(df)).orderBy("rank").collect()], lambda p: [(int(c.sequence[k]), chr(c.code[k])) for c in [paged.explode_chars(p)] for k in paged.by_height(c, rounded=True)]),
    "simple": (lambda df: ranked(order.simple(df)), lambda p: sequences(p, paged.by_height(p, rounded=True))),
    "columns": (lambda df: ranked(order.by_columns(df)), lambda p: sequences(p, paged.by_columns(p))),
    "adaptive": (lambda df: ranked(order.adaptive(df)), lambda p: sequences(p, paged.adaptive(p))),
    "precedence": (lambda df: ranked(order.precedence(df)), lambda p: sequences(p, paged.precedence(p))),
    "two_columns": (lambda df: [(r.sequence, r.two_columns, r.confidence) for r in order.two_columns(df).orderBy("rank").collect()], lambda p: [(s, two, c) for index, two, c in [paged.two_columns(p)] for s in sequences(p, index)]),
    "structure": (by_structure, lambda p: sequences(p, paged.by_structure(p, np.ma.masked_equal(p.sequence % 7, 0), {m: o for _, _, m, o in LISTED}, drop_unlisted=True))),
    "span_columns": (lambda df: [(r.left, r.right) for r in order.span_columns(df).orderBy("col").collect()], lambda p: [*zip(paged.span_columns(p), paged.span_columns(p)[1:])]),
    "projection": (lambda df: [(r.bin, pytest.approx(r.density)) for r in layout.projection_profile(df).orderBy("bin").collect()], lambda p: [*zip(*map(np.ndarray.tolist, paged.projection_profile(p)))]),
    "smooth": (lambda df: [pytest.approx(r.density) for r in layout.smooth(layout.projection_profile(df, axis="y")).orderBy("bin").collect()], lambda p: paged.smooth(*paged.projection_profile(p, axis="y")).tolist()),
    "xy_cut": (lambda df: regions_of(layout.xy_cut(df), "region"), paged.xy_cut),
    "adaptive_xy_cut": (lambda df: regions_of(layout.adaptive_xy_cut(df), "region"), paged.adaptive_xy_cut),
    "merge_spans": (lambda df: sorted((r.text, r.x, pytest.approx(r.x + r.width)) for r in cluster.merge_spans(df).collect()), lambda p: sorted(paged.merge_spans(p))),
    "paragraphs": (lambda df: [(r.par, r.before) for r in cluster.paragraphs(order.html(df)).orderBy("rank").collect()], lambda p: [*zip(*paged.paragraphs(p.take(paged.by_height(p))))]),
    "dedup": (lambda df: sorted(r.sequence for r in fold.dedup_overlapping(df).collect()), lambda p: sorted(sequences(p, paged.dedup_overlapping(p)))),
    "text_lines": (lambda df: [r.text for r in cluster.text_lines(df).orderBy("line").collect()], lambda p: [" ".join(t) for t in paged.text_lines(p)]),
    "anchored_lines": (lambda df: regions_of(connect.anchored_lines(df), "line"), lambda p: lines_by_sequence(*paged.anchored_lines(p))),
    "bold_runs": (lambda df: sorted((r.bold, r.text) for r in cluster.bold_runs(cluster.lines_of(df, KEYS, 2.0)).collect()), lambda p: sorted((b, " ".join(t)) for b, t in paged.bold_runs(*paged.lines_of(p, 2.0)))),
    "layout_html": (lambda df: render.layout_html(df).first().html, paged.layout_html),
}


@pytest.mark.parametrize("name", CASES)
def test_a_page_is_read_as_a_table(spark, name):
    on_table, on_page = CASES[name]
    rows = some_rows(1)
    assert on_table(spark.createDataFrame(rows, SPAN)) == on_page(page_of(rows))


def test_a_page_is_rendered_as_a_table(spark):
    for seed in (1, 2):
        rows = some_rows(seed)
        df, p = spark.createDataFrame(rows, SPAN), page_of(rows)
        lines = spark.createDataFrame([(paged.markdown_lines(p),)], "markdown string")
        assert render.shown_markdown(lines).first().markdown == render.markdown_pages(df).first().markdown
        assert html_page(spark, p) == render.semantic_html(df).first().html


def test_pairs_are_all_pairs_in_reach():
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 400, 300) / 2, rng.integers(0, 60, 300) / 2, rng.integers(0, 20, 300) / 2
    at = np.arange(300)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    found = [p for p in zip(*map(np.ndarray.tolist, connect.near_pairs(x, y, 8.0, 5.0))) if dy[p] <= 5.0]
    assert len(found) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset(p) for p in zip(*map(np.ndarray.tolist, np.nonzero((dx <= 8) & (dy <= 5)))) if p[0] != p[1]}
    gap = x[None, :] - (x + w)[:, None]
    found = {p for p in zip(*map(np.ndarray.tolist, connect.follow_pairs(x + w, x, y, 0.0, 12.0, 2.0))) if dy[p] <= 2.0 and 0 <= gap[p] < 12}
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero((gap >= 0) & (gap < 12) & (dy <= 2) & (at[:, None] != at)))))


def test_pairs_of_a_long_line_follow_its_length():
    n = 20_000
    x, y = 12.0 * np.arange(n), np.full(n, 700.0)
    assert (connect.word_roots(x, y, np.full(n, 6.0), 5.0, 50.0) == 0).all()
    assert len(connect.follow_pairs(x + 6, x, y, -50.0, 50.0, 5.0)[0]) < 10 * n
    assert len(connect.near_pairs(x, y, 12.0, 6.0)[0]) == n - 1


def test_variance_at_a_limit_is_summed_as_in_sql():
    """Words by line whose variance of heights is 500 exactly; DuckDB's var_pop stays a little below with one, four and eight threads."""
    y = 792.0 - 14.0 * np.repeat(np.arange(5), [4, 3, 2, 1, 4])
    assert paged.variance(y, (500,)) < 500 and paged.variance(y, (100,)) == 500


def test_tables_are_found_with_one_sort(spark):
    rng = random.Random(5)
    rows = [(d, 0, 100.0 * rng.randrange(4) + rng.choice((0, 3)), 20.0 * rng.randrange(4), 80.0, 12.0) for d in range(400) for _ in range(rng.randrange(1, 12))]
    found = layout.aligned_tables(spark.createDataFrame(rows, "doc_id long, page long, x double, y double, width double, height double"), columns=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort") == 1 and "Window" not in plan
    expected = []
    for d in range(400):
        cells = [r[2:4] for r in rows if r[0] == d]
        near = lambda axis, tolerance: [sum(_linked(sorted({q[axis] for q in cells}), p[axis], q[axis], tolerance) for q in cells) for p in cells]  # noqa: E731, B023
        kept = [p for p, nx, ny in zip(cells, near(0, 5.0), near(1, 3.0)) if nx >= 2 and ny >= 2]
        ys, xs = _count(sorted({p[1] for p in kept}), sorted({q[1] for q in cells}), 3.0), _count(sorted({p[0] for p in kept}), sorted({q[0] for q in cells}), 5.0)
        if ys >= 2 and xs >= 2 and len(kept) >= 4:
            expected.append((d, ys, xs, len(kept), min(p[0] for p in kept), max(p[0] for p in kept) + 80 - min(p[0] for p in kept)))
    assert sorted((r.doc_id, r.num_rows, r.num_cols, r.cells, r.x, r.width) for r in found.collect()) == expected


def _linked(values, a, b, tolerance):
    between = [v for v in values if min(a, b) <= v <= max(a, b)]
    return all(q - p <= tolerance for p, q in zip(between, between[1:]))


def _count(kept, values, tolerance):
    return sum(1 for k, v in enumerate(kept) if not k or not _linked(values, kept[k - 1], v, tolerance))
