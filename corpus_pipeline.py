"""The corpus pipeline: language, passages, near duplicates, mix and packing, each stage a table.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of `documents`; each result is written as Parquet to the shared folder
(spark.checkpoint.dir) and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import aside, read_table, written
from folioflow.llm.jaccard import ngram_join
from folioflow.llm.langid import held_out, identify, train
from folioflow.llm.lines import dedup_lines
from folioflow.llm.mixing import mixed
from folioflow.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (`und`), null ones included, and those between two languages."""
    free, back = aside(docs, {"lang_pred", "score", "ambiguous", "held_out"})
    model = train(free.where(~held_out()).select("doc_id", "text", "lang"))
    seen = identify(free, model).where("lang_pred <> 'und' AND NOT ambiguous")
    return seen.withColumnsRenamed(back).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat; a document that consists of such passages alone goes."""
    free, back = aside(docs, {"n_lines", "removed_lines", "kept"})
    rest = dedup_lines(free).where("kept")
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rest.drop("n_lines", "removed_lines", "kept").withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id stays; of rows repeated with one id, one."""
    others = written(ngram_join(docs).where("doc_id <> component_id").select("doc_id").distinct(), "others")
    return docs.join(others, "doc_id", "left_anti").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document comes as often as it is taken."""
    free, back = aside(docs, {"size", "source_size", "target", "copies", "taken"})
    return mixed(free).withColumnsRenamed(back).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("passages", passages),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]

#: Tokenization and n-gram links aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
