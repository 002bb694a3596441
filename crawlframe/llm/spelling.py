"""Spelling variant grouping (11): near words by one-edit neighbourhoods over a reduced alphabet.

Two words are near if exactly one inserted, deleted or replaced code point makes one the other.

1. Letters are hashed to a few symbols. A reduced word is a 64-bit polynomial of its symbols.
2. Every word generates the full one-edit neighbourhood of its reduced word: each deletion, replacement and insertion
   of a symbol, and the reduced word itself (an edit between letters of one symbol leaves no trace). Equal results of
   different edits are generated once, at their leftmost place.
3. The neighbourhoods are joined with the reduced words of the vocabulary, and each candidate is verified on the two
   original strings, so neither symbols nor hashes can change the result.

The number of symbols is the least of ``SYMBOLS`` with which a word shares its reduced form with at most ``CROWD`` words
on average. The squares of all bucket sizes then add up to at most ``CROWD`` times the vocabulary, however alike
the words are: the join stays in proportion. With the last number of symbols, each letter up to U+00FF has its own.

A word's form is its near word with the largest count (of equals the first in code-point order), if that is at least
``ratio`` times the word's own count. Following forms from a word ends at its root; counts grow at each step, so the
chain is short, and it is followed by doubling.

Defined results: null words and counts take no part; a word listed twice counts as one with the counts added; an empty
table gives an empty one. Words may have any length: a task holds at most ``EMIT`` neighbours at a time. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.components import _written
from crawlframe.llm.text import bound_batches, slices
from crawlframe.plans.sqlgen import crc32 as crc32_sql

SYMBOLS = (4, 8, 16, 32, 256)
CROWD = 4
EMIT = 1 << 18
LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
               typo_every: int = 0) -> DataFrame:
    """(word, n): runs of letters of ``docs`` with A-Z lower-cased, of at least ``min_length`` code points and ``min_count`` occurrences.

    ``typo_every``: where it divides h, the CRC-32 of ``<id>:<run>``, the run loses its code point h modulo its length
    (reproducible misspellings, for trials). A null text has no words; a null id reads as the empty string.
    """
    lower = F.translate(text_col, UPPER, LOWER)
    # a shorter run never gets long enough again
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if typo_every:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _symbols(points: np.ndarray, symbols: int) -> np.ndarray:
    """Symbol (from 1) of each code point."""
    if symbols < 256:
        points = (points.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(11)
    return points.astype(np.uint64) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2 to the 64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)


def _by_length(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, matrix of their symbols) for each length that occurs."""
    joined = "".join(words.to_pylist())
    s = _symbols(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), symbols)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, s[first[at][:, None] + np.arange(n)]


def _keys(words: pa.Array, symbols: int) -> np.ndarray:
    """64-bit number of each reduced word."""
    out = np.zeros(len(words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at, s in _by_length(words, symbols):
            out[at] = (s * _powers(s.shape[1])[:-1][::-1]).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def _neighbours(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``words``, key) of every reduced string at most one edit from the reduced word, each once, in parts."""
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at, all_s in _by_length(words, symbols):
            n = all_s.shape[1]
            power = _powers(n + 1)
            rows = max(1, EMIT // ((2 * n + 1) * symbols + n + 1))
            step = max(1, EMIT // (2 * symbols + 1))
            for k in range(0, len(at), rows):
                s, place = all_s[k:k + rows], at[k:k + rows]
                scaled = s * power[:n][::-1]
                before = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(scaled, axis=1, dtype=np.uint64)], axis=1)
                after = before[:, -1:] - before  # after[i]: the part from letter i on; before[i]: the part up to it, at its places
                yield place, before[:, -1]
                for i in range(0, n + 1, step):
                    j = min(i + step, n + 1)
                    own = slice(i, min(j, n))
                    same_before = np.zeros((len(s), j - i), np.uint64)  # the letter before each place, none before the first
                    same_before[:, int(i == 0):] = s[:, max(i, 1) - 1:j - 1]
                    # the part before a place moves down by one place (deletion) or up by one (insertion)
                    down = _shifted(s, own.start, own.stop, power, n, -1)
                    keep = s[:, own] != same_before[:, :own.stop - own.start]
                    yield _flat(place, down + after[:, own.start + 1:own.stop + 1], keep)
                    put = before[:, own, None] + every * power[n - 1 - np.arange(own.start, own.stop)][None, :, None] + after[:, own.start + 1:own.stop + 1, None]
                    yield _flat(place, put, every != s[:, own, None])
                    up = _shifted(s, i, j, power, n, 1)
                    into = up[:, :, None] + every * power[n - np.arange(i, j)][None, :, None] + after[:, i:j, None]
                    yield _flat(place, into, every != same_before[:, :, None])


def _shifted(s: np.ndarray, i: int, j: int, power: np.ndarray, n: int, by: int) -> np.ndarray:
    """For places i to j, the part before them in a word that has ``by`` letters more."""
    scaled = s * (power[:n][::-1] * _BASE if by > 0 else np.r_[power[:n - 1][::-1], np.uint64(0)])
    sums = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(scaled, axis=1, dtype=np.uint64)], axis=1)
    return sums[:, i:j]


def _flat(place: np.ndarray, keys: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.broadcast_to(place.reshape(-1, *[1] * (keys.ndim - 1)), keys.shape)
    return row[keep], keys[keep]


def _with_keys(words: DataFrame, symbols: int) -> DataFrame:
    """(key, id): the reduced word of each word."""
    bound_batches(words.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "word"):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(part.column("word"), symbols)), part.column("id")], names=["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def _probes(words: DataFrame, symbols: int) -> DataFrame:
    """(key, id): the neighbourhood of each reduced word; the words themselves would repeat in every row."""
    bound_batches(words.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "word"):
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for place, keys in _neighbours(part.column("word"), symbols):
                    for k in range(0, len(keys), EMIT):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + EMIT].view(np.int64)), pa.array(ids[place[k:k + EMIT]])], names=["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def symbols_for(words: DataFrame) -> int:
    """The least number of symbols that leaves at most ``CROWD`` words to a word's reduced form, on average."""
    for symbols in SYMBOLS[:-1]:
        sizes = _with_keys(words, symbols).groupBy("key").agg(F.count("*").cast("double").alias("size"))
        met = sizes.agg(F.sum(F.col("size") * F.col("size")) / F.sum("size")).first()[0]
        if met is None or met <= CROWD:
            return symbols
    return SYMBOLS[-1]


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, near, near_n) of all words (id, word, n; ids distinct) that are one edit apart, in both directions."""
    spread = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    symbols = symbols or symbols_for(spread)
    reduced = _with_keys(spread, symbols).withColumnRenamed("id", "near_id")
    candidates = _probes(spread, symbols).join(reduced, "key").where("id != near_id").select("id", "near_id").distinct()
    other = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = candidates.join(words.select("id", "word"), "id").join(other, "near_id")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form, both not null, without cycles)."""
    links = _written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("end"))
        moved = links.join(onward, F.col("root") == F.col("via"), "left")
        moved = moved.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        links = _written(moved, "spelling-roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def variants(words: DataFrame, ratio: int = 5, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the table ``words`` (word, n)."""
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = _written(words.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_pairs(words, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    counted = -F.col("best.less") >= ratio * F.col("n")
    judged = _written(joined.select(
        "word", F.when(counted, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(counted, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(min_length: int = 6, min_count: int = 5, typo_every: int = 199, ratio: int = 5) -> str:
    """``variants`` of the ``vocabulary`` of ``documents`` in DuckDB, by shared deletions."""
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
r AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS c FROM t WHERE length(run) >= {min_length} GROUP BY ALL),
h AS (SELECT run, c, {crc32_sql('named')} AS h FROM r),
v AS (SELECT CASE WHEN h % {typo_every} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= {min_length} GROUP BY word HAVING sum(c) >= {min_count}),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word
      UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
b AS (SELECT p.word, count(*) AS n_near, max(w.n) AS best_n, arg_min(p.near, (-w.n, p.near)) AS best FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT w.word, CASE WHEN best_n >= {ratio} * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near,
             CASE WHEN best_n >= {ratio} * n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
      UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root AND f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e USING (word)"""
