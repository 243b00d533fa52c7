"""Every query with an oracle against DuckDB, the others for rows; and properties of operators on small frames."""

import pytest
from pyspark.sql import functions as F

from folioflow.corpus import Corpus, stamped, write_images
from folioflow.functions import text as T
from folioflow.operators import cluster, connect, fold, layout, order, render
from folioflow.pdf import samples
from folioflow.plans import catalogue
from folioflow.sources import pdf
from tests.conftest import same_rows

SPAN = "doc_id long, page long, sequence long, text string, x double, y double, width double, height double, font_size double, bold boolean, font_name string"


def spans(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, float(x), float(y), float(w), 12.0, float(s), b, "F-Bold" if b else "F") for i, (t, x, y, w, s, b) in enumerate(rows)], SPAN)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, sf_dir, duck, name):
    same_rows(catalogue.queries()[name](spark, sf_dir), duck.sql(catalogue.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_cleanups_are_idempotent(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for f in (T.normalize_newlines, T.cleanup_plain, T.strip_controls):
        assert docs.where(f(f("text")) != f("text")).count() == 0


def test_orders_ignore_the_input_order(spark):
    rows = [(f"w{i}", (i * 37) % 500, 700 - 14 * (i % 9), 20, 12, False) for i in range(60)]
    df = spans(spark, rows)
    for make in (order.simple, order.markdown, order.by_columns, order.precedence):
        key = lambda d: [r.sequence for r in make(d).orderBy("rank").collect()]  # noqa: B023, E731
        assert key(df) == key(df.orderBy(F.rand(1)).repartition(5))


def test_columns_are_read_one_after_the_other(spark):
    rows = [(f"{side}{i}", x, 700 - 20 * i, 150, 12, False) for i in range(5) for side, x in (("l", 72), ("r", 350))]
    out = [r.text for r in order.by_columns(spans(spark, rows)).orderBy("rank").collect()]
    assert out == [f"l{i}" for i in range(5)] + [f"r{i}" for i in range(5)]
    regions = {r.text: r.region for r in layout.xy_cut(spans(spark, rows)).collect()}
    assert all(regions[f"l{i}"] < regions[f"r{j}"] for i in range(5) for j in range(5))


def test_dedup_compares_with_the_last_kept(spark):
    rows = [("a", 0, 700, 5, 12, False), ("b", 1.5, 700, 5, 12, False), ("c", 3, 700, 5, 12, False), ("d", 3.5, 690, 5, 12, False)]
    assert [r.text for r in fold.dedup_overlapping(spans(spark, rows)).orderBy("sequence").collect()] == ["a", "c", "d"]


def test_merge_blanks(spark):
    rows = [("Fig", 0, 700, 20, 12, False), ("1", 20, 700, 5, 12, False), ("then", 25.05, 700, 20, 12, False), ("far", 100, 700, 20, 12, False)]
    assert [r.text for r in cluster.merge_spans(spans(spark, rows)).orderBy("x").collect()] == ["Fig 1 then", "far"]


def test_markdown_and_html(spark):
    rows = [("Title", 72, 700, 60, 24, True), ("bold", 72, 660, 30, 12, True), ("plain https://a.b/c.", 110, 660, 90, 12, False)]
    assert render.markdown_pages(spans(spark, rows)).first().markdown == "# Title\n\n**bold** plain [https://a.b/c](https://a.b/c)."
    assert render.html_pages(spans(spark, rows)).first().html == '<h1>Title</h1>\n<p><strong>bold plain <a href="https://a.b/c.">https://a.b/c.</a></strong></p>'


def test_structured(spark):
    rows = [("Head", 72, 700, 60, 18, True), ("- one", 72, 680, 30, 12, False), ("- two", 72, 660, 30, 12, False), ("1. num", 72, 640, 30, 12, False), ("text", 72, 620, 30, 12, False)]
    blocks = cluster.aggregate_blocks(cluster.lines_of(spans(spark, rows), ["doc_id", "page"], 2.0), ["doc_id", "page", "line"], " ")
    out = render.structured_elements(blocks).orderBy("element").collect()
    assert [(r.type, r.level, r.text, r["items"], r.ordered) for r in out] == [("header", 1, "Head", None, None), ("list", None, None, ["one", "two"], False), ("list", None, None, ["num"], True), ("paragraph", None, "text", None, None)]


def test_modes_and_categories(spark, tmp_path):
    folder = samples.write_all(str(tmp_path))
    corpus = Corpus(spark, folder)
    assert {r.category for r in corpus.files.select("category").distinct().collect()} == {"plain", "text", "structure", "features", "secured", "broken"}
    assert Corpus(spark, folder, categories=["plain"]).files.count() == 3
    assert corpus.meta().where("NOT success").count() == 2
    assert corpus.meta().where("path LIKE '%damaged%' AND rebuilt").count() == 1
    assert corpus.extract_text(1).select("doc_id").distinct().count() == 3
    with pytest.raises(Exception):
        pdf.spans(corpus.files, mode="FAILFAST").count()
    files = write_images(pdf.images(corpus.files), str(tmp_path / "out")).collect()
    assert len(files) == 2 and all((tmp_path / "out" / r.file).stat().st_size > 0 for r in files)
    corpus.export(corpus.to_markdown_all(), str(tmp_path / "md"))
    assert (tmp_path / "md" / "category=plain").is_dir()


def test_sql_functions(spark):
    pdf.register(spark)
    assert [r.kind for r in spark.sql("SELECT * FROM pdf_tokens(encode('/A 1 (b)', 'UTF-8')) ORDER BY position").collect()] == ["name", "integer", "string"]
    assert spark.sql("SELECT decode(pdf_decode(encode('4142>', 'UTF-8'), array('ASCIIHexDecode')), 'UTF-8') AS t").first().t == "AB"
    assert spark.sql("SELECT count(*) AS n FROM content_ops(encode('q Q BT ET', 'UTF-8'))").first().n == 4
    assert [r.value for r in spark.sql("SELECT * FROM objstm(encode('1 0 2 2 5 (x)', 'UTF-8'), 2, 8)").collect()] == ["5", "b'x'"]


def test_the_rest_stands_without_the_training_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for file in root.rglob("*.py"):
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), file


def test_precedence_of_staggered_baselines(spark):
    rows = [(1, 0, k, y, x, n) for k, (y, x, n) in enumerate([(101.0, 100.0, "b"), (97.0, 10.0, "c"), (104.0, 50.0, "a"), (60.0, 9.0, "e"), (61.0, 5.0, "d")])]
    rows += [(2, 0, k, 500.0 - 3 * k, float(k % 2), str(k)) for k in range(30)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, sequence long, y double, x double, name string")
    got = {i: [r.name for r in order.precedence(blocks).where(f"doc_id = {i}").orderBy("rank").collect()] for i in (1, 2)}
    assert got[1] == ["a", "c", "b", "d", "e"]
    at = {int(n): k for k, n in enumerate(got[2])}
    assert sorted(at) == list(range(30)) and all(at[a] < at[b] for a in range(30) for b in range(a + 2, 30))


def test_words_hold_together_on_uneven_ground(spark):
    rows = [(c, 6 * i, 700 + (0.5 if i == 1 else 0), 6, 12, False) for i, c in enumerate("Hello")] + [("x", 60, 700, 6, 12, False)]
    out = cluster.words(spans(spark, rows).withColumnRenamed("text", "char")).orderBy("x").collect()
    assert [r.text for r in out] == ["Hello", "x"]


def test_char_clusters_grow_from_the_first(spark):
    import random

    rng = random.Random(4)
    rows = [(chr(97 + i % 26), rng.randrange(0, 120), rng.randrange(600, 640), 6, rng.choice((8, 12, 30)), False) for i in range(120)]
    cluster_of, at = {}, [(x + 3, y + 6, s) for _, x, y, _, s, _ in rows]
    for seed in range(len(rows)):
        if seed not in cluster_of:
            cluster_of[seed], todo = seed, [seed]
            while todo:
                cx, cy, size = at[todo.pop()]
                for k, (ox, oy, _) in enumerate(at):
                    if k not in cluster_of and abs(cx - ox) <= 8 and abs(cy - oy) < 0.5 * size:
                        cluster_of[k] = seed
                        todo.append(k)
    got = connect.char_clusters(spans(spark, rows).withColumnRenamed("text", "char")).collect()
    found = {}
    for r in got:
        found.setdefault(r.word, set()).add(r.sequence)
    expected = {}
    for k, seed in cluster_of.items():
        expected.setdefault(seed, set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_lines_are_anchored_to_their_first_row(spark):
    rows = [(f"w{i}", 10 * i, 700 - 1.9 * i, 6, 12, False) for i in range(10)]
    out = {r.sequence: r.line for r in connect.anchored_lines(spans(spark, rows)).collect()}
    assert [out[i] for i in range(10)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_analysis_of_columns_by_the_pages_profile(spark):
    rows = [(f"{side}{i}", x, 700 - 20 * i, 150, 12, False) for i in range(5) for side, x in (("l", 72), ("r", 350))]
    regions = {r.text: r.region for r in layout.adaptive_xy_cut(spans(spark, rows)).collect()}
    assert set(regions) == {r[0] for r in rows}


def test_one_file_a_document(spark, tmp_path):
    from datetime import datetime

    samples.write_all(str(tmp_path / "in"))
    c = Corpus(spark, str(tmp_path / "in"))
    out = c.export_files(c.to_plain_text_all(), str(tmp_path / "out")).collect()
    files = {r.file for r in out}
    assert any(f.endswith("simple.txt") for f in files) and all((tmp_path / "out" / f).exists() for f in files)
    assert "Hello World" in (tmp_path / "out" / next(f for f in files if f.endswith("simple.txt"))).read_text()
    assert stamped("report", "json", datetime(2024, 5, 6, 7, 8, 9)) == "report_20240506_070809.json"
