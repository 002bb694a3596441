"""From raw documents to token ids: the stages of the training-data pipeline, each one operator of crawlframe.llm.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. Rows are told
apart by id and text: rows that repeat both share their fate in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm import classify, decontaminate, linedup, neardup, sentencepiece
from crawlframe.llm.text import unshare
from crawlframe.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, f"pipeline-{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _without(spark: SparkSession, docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the (doc_id, text_key) rows of ``gone`` (written first, so that a small table is broadcast)."""
    gone = _written(spark, gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), name)
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected; a null ``lang`` becomes the predicted one."""
    unshare()  # every stage: the one before has been written
    model = classify.fit(docs, "text", "lang", classify.LANGUAGE)
    kept = classify.language(docs, model).where("not rejected")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut cross-site boilerplate lines; a document of nothing else goes. ``n_chars`` follows the text."""
    unshare()
    cut = linedup.remove_spread_lines(docs, by_words=linedup.BY_WORDS)
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    return cut.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                                      .otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component (five words, similarity 0.8)."""
    unshare()
    found = neardup.near_duplicates(docs, shingle=5, percent=80)
    return _without(spark, docs, found.where("not kept"), "copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    unshare()
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(spark, docs, found.where("leaked"), "leaks")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    unshare()
    encoded = sentencepiece.encode_rows(docs.select("doc_id", "lang", "source", "text"), units=150_000)  # earlier stages hold memory
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _written(spark, stage(spark, docs, sf_dir), name)
    return docs
