"""Benchmark decontamination (4): BM25 index of test items, block-max WAND, question and answer overlap.

* Items are cut into chunks of at most ``CHUNK`` words, and an index of their BM25 impacts is kept with every impact
  divided by the chunk's own score (its score for itself as query), so one threshold serves all chunks.
* Every text is cut into passages of ``PASSAGE`` words every ``STRIDE`` words: a copied chunk lies whole in one of
  them and scores at least 1 there. Each passage is a query of its distinct words.
* Chunks are put into at most ``GROUPS`` groups, and a term has its largest impact in each. A passage whose words'
  largest impacts sum to less than the threshold in every group can reach no chunk and is passed over (WAND's bound,
  taken for all passages of a batch at once); the others run block-max WAND, which returns all chunks at or above the
  threshold.
* A retrieved item is a leak if enough of the 3-word sequences of both its question and its answer stand in the text;
  a part of one or two words is one sequence of that length.

Words are white-space separated, lower-cased, with everything but letters and digits removed; a word without any is
skipped. The answer is what follows a marker ``answer:`` or ``a:`` on its own, else the last sentence, else the last
fifth of the words.

Equal items are one entry, whatever their number. Entries are indexed in shards of bounded index size, each built by
one Spark task and broadcast for one pass over the texts; document frequencies and mean length are those of all
entries. The ids of a found entry are joined back.

Defined results: null or empty texts and items match nothing, an empty benchmark gives no rows; repeated rows give
repeated results; items that share an id are separate entries under that id.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm import text
from crawlframe.llm.components import _written

CHUNK, PASSAGE, STRIDE = 64, 96, 32  # PASSAGE >= CHUNK + STRIDE - 1
K1, B = 1.2, 0.75
BLOCK = 16
GROUPS = 64
GRAM = 3
SHARD_BYTES = 16 << 20  # of an index, as estimated
ENTRY_BYTES = GROUPS * 4 + 128  # of an index, per word of an item: largest impacts by group, posting, hash


def normal_words(words: pa.Array) -> pa.Array:
    """Lower-cased letters and digits of each word (possibly none)."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{N}]+", ""))


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every normal word of the texts, and the distinct normal words by code."""
    row, code, words = text.tokens(texts)
    coded = normal_words(words).dictionary_encode()
    full = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    own = coded.indices.to_numpy(zero_copy_only=False)[code] if len(code) else code
    keep = full[own] if len(own) else np.zeros(0, dtype=bool)
    return row[keep], own[keep], coded.dictionary


def question_and_answer(item: str) -> tuple[str, str]:
    mark = list(re.finditer(r"(?i)(?:^|\s)(?:answer|a)\s*:", item))
    if mark and item[: mark[-1].start()].strip() and item[mark[-1].end():].strip():
        return item[: mark[-1].start()], item[mark[-1].end():]
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)", item.rstrip())]
    if ends and re.search(r"\w", item[ends[-1]:]) and re.search(r"\w", item[: ends[-1]]):
        return item[: ends[-1]], item[ends[-1]:]
    words = item.split()
    cut = len(words) - max(1, len(words) // 5) if len(words) > 1 else 0
    return " ".join(words[:cut]), " ".join(words[cut:])


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the ``n``-word sequences of a word hash sequence (the whole sequence if shorter)."""
    n = min(n, len(h))
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    out = text.mix(h[: len(h) - n + 1], n)
    for j in range(1, n):
        with np.errstate(over="ignore"):
            out = text.mix(out + h[j: len(h) - n + 1 + j], n)
    return out


def _hashes(part: str) -> np.ndarray:
    _, code, words = sequences(pa.array([part]))
    return text.hash_words(words)[code] if len(code) else np.zeros(0, dtype=np.uint64)


def _part(part: str) -> tuple[int, np.ndarray]:
    """Words per sequence of a question or answer, and the hashes of its distinct sequences."""
    h = _hashes(part)
    return min(GRAM, len(h)), np.unique(grams(h))


@dataclass
class Index:
    terms: pa.Array
    first: list  # postings of term t: first[t] to first[t + 1], ascending by chunk
    chunk: list
    impact: list
    block_last: list  # per term: last chunk and largest impact of each block of BLOCK postings
    block_top: list
    top: list  # largest impact per term
    group_top: np.ndarray  # largest impact per term and group of chunks
    item_of: np.ndarray  # item position by chunk
    item_ids: list
    question: list  # (words per sequence, hashes)
    answer: list


def build(items: list[tuple], df: dict[str, int], n_chunks: int, mean: float) -> Index:
    """Index of (id, text) items with the given document frequencies, chunk count and mean chunk length."""
    rows, lengths, item_of, question, answer = [], [], [], [], []
    for k, (_, item) in enumerate(items):
        q, a = question_and_answer(item)
        question.append(_part(q))
        answer.append(_part(a))
        for words in chunks(item):
            for w, tf in pd.Series(words).value_counts().items():
                rows.append((w, len(lengths), tf))
            lengths.append(len(words))
            item_of.append(k)
    post = pd.DataFrame(rows, columns=["term", "chunk", "tf"]).sort_values(["term", "chunk"], kind="stable")
    freq = post["term"].map(df).to_numpy(dtype=float)
    size = np.array(lengths, dtype=float)[post["chunk"].to_numpy(dtype=np.int64)] if len(post) else np.zeros(0)
    tf = post["tf"].to_numpy(dtype=float)
    impact = np.log1p((n_chunks - freq + 0.5) / (freq + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1e-9)))
    chunk = post["chunk"].to_numpy(dtype=np.int64)
    own = np.bincount(chunk, weights=impact, minlength=len(lengths))
    impact = impact / own[chunk] if len(chunk) else impact
    terms, first = np.unique(post["term"].to_numpy(dtype=object), return_index=True) if len(post) else (np.zeros(0, object), np.zeros(0, int))
    first = np.r_[first, len(post)]
    last, most = [], []
    for a, b in zip(first[:-1], first[1:]):
        starts = np.arange(a, b, BLOCK)
        last.append(chunk[np.minimum(starts + BLOCK, b) - 1].tolist())
        most.append(np.maximum.reduceat(impact[:b], starts).tolist())
    top = [max(m) for m in most]
    group_top = np.zeros((len(terms), GROUPS), dtype=np.float32)
    if len(terms):
        np.maximum.at(group_top, (np.repeat(np.arange(len(terms)), np.diff(first)), chunk * GROUPS // len(lengths)), impact.astype(np.float32) + 1e-6)
    return Index(pa.array(terms.tolist(), pa.string()), first.tolist(), chunk.tolist(), impact.tolist(), last, most, top, group_top, np.array(item_of), [i for i, _ in items],
                 question, answer)


def chunks(item: str) -> list[list[str]]:
    """The item's normal words in runs of near-equal length, at most ``CHUNK`` each."""
    _, code, words = sequences(pa.array([item]))
    if len(code) == 0:
        return []
    own = np.array(words.to_pylist(), dtype=object)[code]
    return [list(x) for x in np.array_split(own, -(-len(own) // CHUNK))]


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All (chunk, score) with score >= threshold for a query of distinct terms, by block-max WAND."""
    slack = threshold - 1e-9
    lists = [[index.first[t], index.first[t + 1], t] for t in terms.tolist()]
    found = []
    while True:
        lists = [x for x in lists if x[0] < x[1]]
        lists.sort(key=lambda x: index.chunk[x[0]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += index.top[x[2]]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            return found
        target = index.chunk[lists[pivot][0]]
        while pivot + 1 < len(lists) and index.chunk[lists[pivot + 1][0]] == target:
            pivot += 1
        bound, nearest = 0.0, float("inf")  # largest impacts of the blocks that would hold the target
        for x in lists[: pivot + 1]:
            last = index.block_last[x[2]]
            k = bisect_left(last, target)
            if k < len(last):
                bound += index.block_top[x[2]][k]
                nearest = min(nearest, last[k])
        if bound < slack:  # no chunk up to the end of the nearest block, or before the next list begins, can do
            goal = nearest + 1
            if pivot + 1 < len(lists):
                goal = min(goal, index.chunk[lists[pivot + 1][0]])
            goal = max(goal, target + 1)
            score = None
        else:
            goal, score = target, 0.0
        for x in lists[: pivot + 1]:
            x[0] = bisect_left(index.chunk, goal, x[0], x[1])
            if score is not None and x[0] < x[1] and index.chunk[x[0]] == target:
                score += index.impact[x[0]]
                x[0] += 1
        if score is not None and score >= slack:
            found.append((target, score))


def search(index: Index, texts: pa.Array, threshold: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item position, best score, question overlap, answer overlap) of every retrieved item of each text."""
    row, code, words = sequences(texts)
    if len(code) == 0 or len(index.terms) == 0:
        return []
    term_of = pc.fill_null(pc.index_in(words, value_set=index.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.searchsorted(row, np.arange(len(texts)))
    block = (np.arange(len(row)) - begin[row]) // STRIDE
    n_blocks = np.bincount(row, minlength=len(texts))
    n_blocks = -(-n_blocks // STRIDE)
    block_start = np.cumsum(n_blocks) - n_blocks
    term = term_of[code]
    at = np.flatnonzero(term >= 0)
    # distinct (block, term), then the sum of their largest impacts over the blocks of a passage
    pair = np.unique((block_start[row[at]] + block[at]) * len(index.terms) + term[at])
    own_block, own_term = pair // len(index.terms), pair % len(index.terms)
    spare = PASSAGE // STRIDE
    edge = np.searchsorted(own_block, np.arange(int(n_blocks.sum()) + spare + 1))
    block_row = np.repeat(np.arange(len(texts)), n_blocks)
    total = np.zeros((len(block_row) + spare, GROUPS), dtype=np.float32)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        total[some] = np.add.reduceat(index.group_top[own_term], edge[some], axis=0)
    bound = total[: len(block_row)].copy()
    for j in range(1, spare):
        same = np.r_[block_row[j:], np.full(min(j, len(block_row)), -1)] == block_row
        bound[same] += total[j: len(block_row) + j][same]
    bound = bound.max(axis=1)
    best: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(bound >= threshold - 1e-9):
        r = block_row[k]
        end = min(k + PASSAGE // STRIDE, block_start[r] + n_blocks[r])
        query = np.unique(own_term[edge[k]: edge[end]])
        if index.group_top[query].sum(axis=0).max() < threshold - 1e-9:
            continue
        for c, score in wand(index, query, threshold):
            key = (int(r), int(index.item_of[c]))
            best[key] = max(best.get(key, 0.0), score)
    out, hashes, held = [], None, (-1, None, {})
    for (r, item), score in sorted(best.items()):
        if hashes is None:
            hashes = text.hash_words(words)
        if held[0] != r:
            end = begin[r + 1] if r + 1 < len(texts) else len(row)
            held = (r, hashes[code[begin[r]:end]], {})
        for n, _ in (index.question[item], index.answer[item]):
            if n not in held[2]:
                held[2][n] = grams(held[1], n)
        q, a = (float(np.isin(g, held[2][n]).mean()) if len(g) else 1.0 for n, g in (index.question[item], index.answer[item]))
        out.append((r, item, score, q, a))
    return out


_FOUND = T.ArrayType(T.StructType([
    T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))


def _searcher(shared, threshold: float):
    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        out: list[list] = []
        for part in text.slices(pa.record_batch([text.plain(texts)], names=["t"]), "t", 1 << 20):
            rows: list[list] = [[] for _ in range(part.num_rows)]
            for r, item, score, q, a in search(shared.value, part.column(0), threshold):
                rows[r].append({"item": shared.value.item_ids[item], "score": score, "question_overlap": q, "answer_overlap": a})
            out += rows
        text.release()
        return pa.array(out, pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64()),
                                                 ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])))

    return run.asNondeterministic()  # or the filter on its result would search again


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _chunks(items: pa.Array) -> pa.Array:
    return pa.array([chunks(x) for x in text.plain(items).to_pylist()], pa.list_(pa.list_(pa.string())))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.7, overlap: float = 0.7,
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every retrieved (document, item): doc_id, text_key (xxhash64 of the text), item_id, score (BM25 over the
    chunk's own), question_overlap, answer_overlap, and whether it is ``leaked`` (both overlaps >= ``overlap``)."""
    spark = docs.sparkSession
    text.bound_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item is not null")
    # equal items are one entry of the index; their ids are joined back at the end
    texts = items.select("item").distinct().withColumn("chunks", _chunks("item")).where(F.size("chunks") > 0)
    texts = _written(texts.withColumn("key", F.monotonically_increasing_id()), "leaks-items")
    keyed = items.join(texts.select("key", "item"), "item").select("key", "item_id")
    terms = texts.select("key", F.explode("chunks").alias("c")).select("key", F.explode(F.array_distinct("c")).alias("term"))
    size = F.sum(F.octet_length("item") + F.size(F.flatten("chunks")) * ENTRY_BYTES)  # of the index, as if no two items shared a term
    sums = texts.agg(size, F.sum(F.size("chunks")), F.sum(F.size(F.flatten("chunks")))).first()
    shards = max(1, -(-int(sums[0] or 0) // shard_bytes))
    df = terms.groupBy("term").agg(F.count("*").alias("n"))
    freqs = terms.distinct().join(df, "term").groupBy("key").agg(F.collect_list(F.struct("term", "n")).alias("freqs"))
    n_chunks, mean = int(sums[1] or 0), (sums[2] or 0) / (sums[1] or 1)

    def packed(shard: pa.Table) -> pa.Table:
        rows = sorted(shard.to_pylist(), key=lambda r: r["item"])
        freq = {f["term"]: f["n"] for r in rows for f in r["freqs"]}
        index = pickle.dumps(build([(r["key"], r["item"]) for r in rows], freq, n_chunks, mean))
        return pa.table({"shard": shard["shard"].slice(0, 1), "index": pa.array([index], pa.binary())})

    own = texts.join(freqs, "key").select(F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"), "key", "item", "freqs")
    indexes = _written(own.groupBy("shard").applyInArrow(packed, "shard long, index binary"), "leaks-index")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("t"))
    out = None
    for shard in range(shards):
        blob = indexes.where(F.col("shard") == shard).first()
        shared = text.share(spark, pickle.loads(blob["index"]) if blob else build([], {}, 0, 0))
        found = (base.withColumn("found", _searcher(shared, threshold)("t")).drop("t")
                 .where(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("f")))
        out = found if out is None else out.unionByName(found)
    out = out.join(keyed, F.col("f.item") == F.col("key")).select(
        "doc_id", "text_key", "item_id", "f.score", "f.question_overlap", "f.answer_overlap")
    return out.withColumn("leaked", (F.col("question_overlap") >= overlap) & (F.col("answer_overlap") >= overlap))

