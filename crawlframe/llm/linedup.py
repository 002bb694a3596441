"""Line dedup (7) by distinct-site spread, in DataFrame functions alone.

A line (trimmed of spaces, at least ``min_words`` words) is boilerplate if it
occurs on at least ``min_sites`` distinct sites. With ``by_words`` every
non-blank line counts, and the sites it needs fall with its length: pairs of
(words from which on, sites).

1. One HyperLogLog sketch of the sites per line hash, merged by aggregation: a
   line that is everywhere costs one sketch per task, however many rows it has.
2. Estimates farther from the threshold than the sketch's error decide at once;
   lines near it get their exact distinct count.
3. All occurrences of boilerplate go, but for the first one (smallest id, then
   text hash, then position) if ``keep_first``, so that no content is lost.

Only line hashes and positions are shuffled until the documents that lose lines
are joined with their positions.

Defined results: a null text stays null with no lines; null sites count as no
site; rows that repeat an id and text get equal results; lines are told apart
by a 64-bit hash; a document whose every line goes keeps its row with the empty
text (``n_removed`` tells); blank lines and lines shorter than the rule's least
words are never removed. Other columns pass through, whatever their names; columns ``n_lines`` and ``n_removed`` of the
input give way to the result's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.components import _written

LG_K = 12
BY_WORDS = ((1, 10), (3, 5), (10, 4), (20, 3), (50, 2))
ERRORS = 5  # standard errors of the sketch on either side of the threshold that are counted exactly


Rule = tuple[tuple[int, int], ...]  # (words from which on, sites), ascending by words


def _lines(docs: DataFrame, text_col: str, rule: Rule, *columns: Column) -> DataFrame:
    """(columns, pos, line hash, sites needed) of each line that may be boilerplate."""
    least = rule[0][0]
    words = r"\S" + r"\s+\S+" * (least - 2) + r"\s+\S" if least > 1 else r"\S"
    need = F.lit(rule[0][1])
    for n, sites in rule[1:]:
        need = F.when(F.regexp_count("line", F.lit(r"\S+")) >= n, sites).otherwise(need)
    return (docs.select(*columns, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
            .withColumn("line", F.trim("line")).where(F.col("line").rlike(words))
            .withColumn("h", F.xxhash64("line")).withColumn("need", need).drop("line"))


def spread_lines(docs: DataFrame, site_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(h) of every line that occurs on as many distinct sites as a line of its length needs."""
    lines = _lines(docs, text_col, rule, F.col(site_col).alias("site"))
    sketched = (lines.groupBy("h").agg(F.count("*").alias("n"), F.min("need").alias("need"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"))
                .where(F.col("n") >= F.col("need")).select("h", "need", F.hll_sketch_estimate("sites").alias("estimate")))
    margin = F.greatest(F.lit(1), F.ceil(ERRORS * F.col("need") / 2 ** (LG_K / 2)))
    sketched = _written(sketched.where(F.col("estimate") >= F.col("need") - margin), "linedup-spread")
    near = F.col("estimate") <= F.col("need") + margin
    exact = (lines.drop("need").join(sketched.where(near).select("h", "need"), "h").groupBy("h", "need")
             .agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= F.col("need")).select("h"))
    return sketched.where(~near).select("h").union(exact)


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                        min_sites: int = 5, min_words: int = 3, keep_first: bool = True, by_words: Rule | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text_col``; adds ``n_lines`` and ``n_removed``.
    ``by_words`` (such as ``BY_WORDS``) takes the place of ``min_sites`` and ``min_words``."""
    rule = tuple(sorted(by_words)) if by_words else ((min_words, min_sites),)
    spread = _written(spread_lines(docs, site_col, text_col, rule), "linedup-boilerplate")
    placed = _lines(docs, text_col, rule, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key")).drop("need")
    placed = placed.join(spread, "h")
    if keep_first:
        at = F.struct("id", "text_key", "pos")
        first = _written(placed.groupBy("h").agg(F.min(at).alias("first")), "linedup-first")
        placed = placed.join(first, "h").where(~at.eqNullSafe(F.col("first")))
    cut = _written(placed.groupBy("id", "text_key").agg(F.collect_set("pos").alias("cut")), "linedup-cut")
    # the input's columns stay inside a struct, so none can clash with a helper
    rows = docs.select(F.struct("*").alias("d"), F.xxhash64(text_col).alias("key")).alias("r")
    own = F.col("r.d")
    joined = rows.join(cut.alias("c"), own[id_col].eqNullSafe(F.col("c.id")) & (F.col("r.key") == F.col("c.text_key")), "left")
    lines = F.split(own[text_col], "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("c.cut"))
    text = (F.when(F.col("c.cut").isNull(), own[text_col])
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")))
    n_lines = F.when(own[text_col].isNull(), 0).otherwise(F.size(lines))
    out = [(text if c == text_col else own[c]).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*out, n_lines.alias("n_lines"), F.coalesce(F.size("c.cut"), F.lit(0)).alias("n_removed"))


def oracle_sql(min_sites: int = 5, min_words: int = 3) -> str:
    """The same over ``documents`` in DuckDB, with exact counts."""
    words = r"\S" + r"\s+\S+" * (min_words - 2) + r"\s+\S"
    return rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(raw, ' ') AS line, regexp_matches(trim(raw, ' '), '{words}') AS long_enough FROM l),
s AS (SELECT line, arg_min(doc_id, (doc_id, pos)) AS d, arg_min(pos, (doc_id, pos)) AS p FROM k WHERE long_enough
      GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT k.*, s.d IS NOT NULL AND NOT (s.d = k.doc_id AND s.p = k.pos) AS gone
      FROM k LEFT JOIN s ON k.long_enough AND k.line = s.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL"""


def oracle_sql_by_words(rule: Rule = BY_WORDS) -> str:
    """The rule by length over ``documents`` in DuckDB, with exact counts."""
    need = "CASE " + " ".join(f"WHEN words >= {n} THEN {sites}" for n, sites in sorted(rule, reverse=True)) + " END"
    return rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(raw, ' ') AS line, len(regexp_extract_all(trim(raw, ' '), '\S+')) AS words FROM l),
s AS (SELECT line, arg_min(doc_id, (doc_id, pos)) AS d, arg_min(pos, (doc_id, pos)) AS p FROM k WHERE words > 0
      GROUP BY line, words HAVING count(DISTINCT source) >= {need}),
m AS (SELECT k.*, s.d IS NOT NULL AND NOT (s.d = k.doc_id AND s.p = k.pos) AS gone FROM k LEFT JOIN s ON k.line = s.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL"""
