"""Quality classifier (2) and language ID (9): supervised subword embeddings fitted on a bounded sample.

The classifier itself is in :mod:`crawlframe.llm.subword`. Here are the Spark
parts: the sample of labelled rows, and scoring of all rows. The broadcast
model has ``buckets x classes`` floats, a bound that does not depend on the data.

Defined results: a null text counts as empty; a text without words is scored
by the bias of the model (class frequencies); repeated rows get equal scores;
rows with a null label or null text are never learned from; with no labelled
row at all, or only one class, every probability is equal for all rows. Output
columns replace input columns of the same name; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm import subword, text
from crawlframe.llm.components import _written

SAMPLE_PER_CLASS = 600
SAMPLE_BYTES_PER_CLASS = 4 << 20

QUALITY = subword.Params(repeat_weight=8)
LANGUAGE = subword.Params()


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(df: DataFrame, text_col: str, label_col: str, per_class: int = SAMPLE_PER_CLASS,
                    bytes_per_class: int = SAMPLE_BYTES_PER_CLASS) -> tuple[list, list]:
    """At most ``per_class`` distinct texts and ``bytes_per_class`` bytes of each label, in order of a hash of the text.

    Rows far down that order are dropped by their hash before anything is shuffled, so the sample costs a scan and
    a few thousand rows, whatever the table's size; the labels are a small set (they become classes).
    """
    rows = (df.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
            .where("text is not null and label is not null"))
    counts = rows.groupBy("label").count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("label") == F.lit(r["label"]), F.lit(min(1.0, 4 * per_class / r["count"]))).otherwise(share)
    order = Window.partitionBy("label").orderBy("hash", "text")
    rows = (rows.withColumn("hash", F.xxhash64("text"))
            .where(F.col("hash") / 2.0**64 + 0.5 <= share)
            .groupBy("label", "hash").agg(F.min("text").alias("text"))
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class)
            .withColumn("size", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .where((F.col("n") == 1) | (F.col("size") <= bytes_per_class))
            .select("text", "label").toArrow())
    rows = rows.sort_by([("label", "ascending"), ("text", "ascending")])
    return rows["text"].to_pylist(), rows["label"].to_pylist()


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """At most ``4 * per_class`` ids of each label, in order of a hash of the id: to be joined with texts.

    The written table has a row bound that does not depend on the data, so it may be broadcast.
    """
    order = Window.partitionBy(label_col).orderBy(F.xxhash64(id_col), id_col)
    rows = labels.select(id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).distinct()
    return _written(rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 4 * per_class).drop("_n"), "labels")


def fit(df: DataFrame, text_col: str, label_col: str, params: subword.Params = subword.Params(),
        per_class: int = SAMPLE_PER_CLASS, bytes_per_class: int = SAMPLE_BYTES_PER_CLASS) -> subword.Model:
    """Train on the bounded sample of labelled rows."""
    return subword.train(*labelled_sample(df, text_col, label_col, per_class, bytes_per_class), params)


def with_probabilities(df: DataFrame, model: subword.Model, text_col: str = "text", out: str = "probabilities") -> DataFrame:
    """Add an array column with the probability of each class of ``model.classes`` for the whole text."""
    shared = text.share(df.sparkSession, model)
    text.bound_batches(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([text.plain(column)], names=["t"])
        parts = [subword.probabilities(s.column(0), shared.value) for s in text.slices(batch, "t")]
        prob = np.concatenate(parts) if parts else np.zeros((0, len(shared.value.classes)))
        text.release()
        offsets = np.arange(len(prob) + 1, dtype=np.int32) * prob.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(prob.ravel()))

    # marked non-deterministic so that a filter on the result does not compute it a second time
    return df.withColumn(out, score.asNondeterministic()(F.col(text_col)))


def quality(df: DataFrame, model: subword.Model, good, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (probability of class ``good``) and ``predicted`` (1 if score >= ``threshold``).

    A model that never saw ``good`` scores 0, one that saw nothing else 1; one fitted on nothing 0.5.
    """
    if model.classes == [None]:
        scored = df.withColumn("score", F.lit(0.5))
    elif good not in model.classes:
        scored = df.withColumn("score", F.lit(0.0))
    else:
        name = text.free_name(df, "_probabilities")
        scored = (with_probabilities(df, model, text_col, name)
                  .withColumn("score", F.col(name)[model.classes.index(good)]).drop(name))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def language(df: DataFrame, model: subword.Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every row if no language was
    learned. Else ``lang_pred`` is the likeliest language, the first by name of equals, and the row is rejected if its
    probability is below ``model.reject_below``.
    """
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model.classes == [None]:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    names = F.array(*[F.lit(c) for c in model.classes])
    found, letters = text.free_name(df, "_probabilities"), text.free_name(df, "_lettered")
    best = F.array_max(found)
    return (with_probabilities(df, model, text_col, found)
            .withColumn(letters, lettered)
            .withColumn("lang_pred", F.when(F.col(letters), F.element_at(
                names, F.array_position(found, best).cast("int"))).otherwise("und"))
            .withColumn("score", F.when(F.col(letters), best).otherwise(0.0))
            .withColumn("rejected", ~F.col(letters) | (F.col("score") < model.reject_below))
            .drop(found, letters))
