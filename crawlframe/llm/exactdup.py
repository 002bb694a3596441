"""Exact dedup (12) with a heavy-hitter split, in DataFrame functions alone.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``; the SHA-256 of what is left
stands for the text. Of equal texts the row with the most code points stays, then the one with the smallest id.

1. Misra-Gries counters (Spark's mergeable frequent-items sketch) over the digests, one sketch per task, merged in two
   levels. A digest with more than about a thousandth of the rows can't be missed.
2. The at most ``HEAVY`` candidates are verified: exact row counts and winners by an aggregate that leaves each task at
   most one row per candidate.
3. The winners are broadcast (their number is bounded by ``HEAVY``, whatever the input), so a digest that holds a
   third of all rows is decided map-side and never shuffled.
4. All other digests go through an ordinary aggregate and join on the digest.

Text is read once; later steps read a table of (id, digest, length) in the shared checkpoint folder.

Defined results: a null text counts as empty; null ids come after all others, so a null ``keep_id`` means that no row of
the group has an id; of rows that repeat an id with an equally long equal text exactly one is ``kept`` (the first of the
written table). An empty table gives an empty result. Other columns are ignored, whatever their names; the id column
must not be named like a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.components import _written

HEAVY = 1000  # digests that may be broadcast: the bound of that table
COUNTERS = 8192  # Misra-Gries counters per sketch; a count is at most 3.5 rows in COUNTERS off
BRANCHES = 64  # sketches are merged in this many groups, then those in one
SPACES = " \t\n\x0b\x0c\r"


def digest(text) -> Column:
    """Lower-case hex SHA-256 of a text without white space (null: of the empty text)."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary"), 256)


def _order(length, id_, row) -> Column:
    """Smallest for the row that stays."""
    return F.struct((-length).alias("shorter"), id_.isNull().alias("no_id"), id_.alias("id"), row.alias("row"))


def frequent(digests: DataFrame, column: str = "text_sha256") -> DataFrame:
    """(hash) of at most ``HEAVY`` digests: all that hold more than about a thousandth of the rows, and perhaps others."""
    hashed = digests.select(F.xxhash64(column).alias("hash"), (F.spark_partition_id() % BRANCHES).alias("branch"))
    sketches = hashed.groupBy("branch").agg(F.expr(f"approx_top_k_accumulate(hash, {COUNTERS})").alias("sketch"))
    # one group, but none for an empty table, of which the function can't make a sketch
    merged = sketches.groupBy(F.floor(F.col("branch") / BRANCHES)).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    found = F.expr(f"approx_top_k_estimate(sketch, {HEAVY})")
    return merged.select(F.explode(found).alias("top")).select(F.col("top.item").alias("hash"))


def _groups(rows: DataFrame) -> DataFrame:
    best = F.min(_order(F.col("length"), F.col("id"), F.col("row"))).alias("best")
    return (rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best)
            .select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with their group's winner, the broadcast winners); columns id, length, row, text_sha256, group_size, keep_id, keep_row."""
    rows = _written(docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).alias("length"),
        F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("text_sha256")), "exactdup-digests")
    candidates = F.broadcast(_written(frequent(rows), "exactdup-candidates"))
    maybe = rows.join(candidates, F.xxhash64("text_sha256") == F.col("hash"), "left_semi")
    heavy = _written(_groups(maybe).where("group_size > 1"), "exactdup-heavy")
    light = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    judged = rows.join(F.broadcast(heavy), "text_sha256").unionByName(light.join(_groups(light), "text_sha256"))
    return judged, heavy


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    if id_col in ("keep_id", "group_size", "kept", "text_sha256"):
        raise ValueError(f"the id column must not be named {id_col}")
    judged, _ = _judged(docs, id_col, text_col)
    return judged.select(F.col("id").alias(id_col), "keep_id", "group_size",
                         (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent texts go map-side, before anything is shuffled.
    """
    judged, heavy = _judged(docs, id_col, text_col)
    stays = judged.where("row = keep_row").select("id", F.col("length").alias("n"), F.col("text_sha256").alias("digest"))
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_key"), digest(F.col(text_col)).alias("own_digest"),
                         F.length(F.coalesce(text_col, F.lit(""))).alias("own_n"))
    winners = heavy.select(F.col("text_sha256").alias("heavy_digest"), F.col("keep_id").alias("heavy_id"))
    marked = marked.join(F.broadcast(winners), F.col("own_digest") == F.col("heavy_digest"), "left")
    marked = marked.where(F.col("heavy_digest").isNull() | F.col("doc_key").eqNullSafe(F.col("heavy_id")))
    same = (F.col("own_digest") == F.col("digest")) & F.col("doc_key").eqNullSafe(F.col("id")) & (F.col("own_n") == F.col("n"))
    return marked.join(stays, same, "left_semi").dropDuplicates(["own_digest"]).select("doc.*")


def oracle_sql() -> str:
    """``duplicates`` over ``documents`` in DuckDB."""
    return r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)"""
