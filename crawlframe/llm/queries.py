"""The registered queries of the operators in this subpackage (op1_ to op13_) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm import (
    ann, classify, decontaminate, exactdup, extract, linedup, neardup, pitman_yor, sentencepiece, spelling, tokenpairs, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return (sentencepiece.encode_rows(docs)
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.size("best_ids").cast("long").alias("n_best"),
                    "best_ids", "best_score", "exact"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(classify.bucket_of("doc_id", 5) != 0)
    learn = docs.join(F.broadcast(classify.sampled_labels(labels, "doc_id", "quality")), "doc_id")
    model = classify.fit(learn, "text", "quality", classify.QUALITY)
    return (classify.quality(docs, model, 1)
            .select("doc_id", (classify.bucket_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"), classify.bucket_of("doc_id", 7) == 2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, _table(spark, sf_dir, "benchmark")).where("leaked").drop("text_key", "leaked")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    records = warc.read_archives(spark, manifest, with_payload=False)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page("refers_to").alias("refers_to"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linedup.remove_spread_lines(docs, by_words=linedup.BY_WORDS).drop("source")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = classify.fit(docs.where(classify.bucket_of("doc_id", 3) != 1), "text", "lang", classify.LANGUAGE)
    return (classify.language(docs.drop("lang"), model)
            .select("doc_id", (classify.bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_table(spark, sf_dir, "documents"), typo_every=199)
    return spelling.variants(words)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.duplicates(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpairs.alignment(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_extraction": op8_extraction,
    "op9_language_id": op9_language_id,
    "op10_nearest": op10_nearest,
    "op11_spelling": op11_spelling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op5_near_duplicates": neardup.oracle_sql(),
    "op6_warc": warc.oracle_sql(),
    "op7_line_dedup": linedup.oracle_sql_by_words(),
    "op11_spelling": spelling.oracle_sql(),
    "op12_exact_dedup": exactdup.oracle_sql(),
}
