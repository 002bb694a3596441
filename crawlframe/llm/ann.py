"""Approximate nearest neighbours (10): multiprobe p-stable hashing with exact reranking by inner product.

Largest inner product becomes least Euclidean distance by one more coordinate:
with M the largest norm, x -> (x / M, sqrt(1 - |x|^2 / M^2)), q -> (q / |q|, 0).
Each of ``TABLES`` tables hashes by ``HASHES`` Gaussian (2-stable) projections,
shifted and cut into cells of ``WIDTH``; a bucket is a cell of the grid.

A query visits, in each table, the occupied buckets in order of the squared
distance from its projections to the bucket (the success estimate of perturbed
buckets), until it has visited ``probes`` buckets and buckets with
``LEAST_SEEN`` vectors in all. ``probes`` is the least number that finds
``target`` of the true neighbours of at most ``SAMPLE`` sample queries, which
are compared with every vector.

The index is the table (bucket, block, vector): buckets are dealt out in blocks
of about ``BLOCK`` vectors, and queries of large query sets in blocks as well,
so no bucket is one task's. Every block pair is scored exactly and yields at
most k candidates per query, so no candidate pairs are written out. As all
vectors are scaled into the unit ball, the occupied buckets of a table number
at most (2 * |projection| / WIDTH + 2) ** HASHES whatever the data's size; the
directory of buckets and counts is broadcast under that bound.

Defined results: vectors that are null, zero, or hold null or non-finite
components, take no part, nor do rows without id or of another dimension than
the most frequent one (the larger of equals); rows that repeat an id count once
(the least vector of it); ties go to the smaller id; no valid row gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.components import _written
from crawlframe.llm.text import mix

TABLES, HASHES, WIDTH = 4, 3, 1.2
SAMPLE, LEAST_SEEN = 64, 200
BLOCK, QUERY_BLOCK = 8192, 4096
_OFFSET, _BASE = 1 << 16, 1 << 17  # cell numbers as digits of a 64-bit key; far beyond any projection of a unit vector


class Hashes:
    """The projections of all tables, for a given dimension and largest norm."""

    def __init__(self, dim: int, norm: float, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, hashes))
        self.b = rng.random((tables, hashes))
        self.norm, self.width = norm, width

    def place(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of cells (tables x rows x hashes)."""
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        if query:
            x = np.hstack([vectors / size, np.zeros_like(size)])
        else:
            x = np.hstack([vectors / self.norm, np.sqrt(np.maximum(0, 1 - (size / self.norm) ** 2))])
        return np.einsum("rd,tdh->trh", x, self.a) / self.width + self.b[:, None, :]

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """Bucket keys (tables x rows) of cells; the table is part of the key."""
        key = np.arange(cells.shape[0], dtype=np.int64)[:, None] * np.ones(cells.shape[1], dtype=np.int64)
        for h in range(cells.shape[2]):
            key = key * _BASE + (cells[:, :, h].astype(np.int64) + _OFFSET)
        return key


class Directory:
    """Occupied buckets per table with their sizes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tables: int, hashes: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        cells, rest = [], self.keys.copy()
        for _ in range(hashes):
            cells.append(rest % _BASE - _OFFSET)
            rest //= _BASE
        self.cells, self.table = np.stack(cells[::-1], axis=1), rest
        self.span = [np.flatnonzero(self.table == t) for t in range(tables)]

    def ranked(self, place: np.ndarray, t: int) -> np.ndarray:
        """Buckets of table ``t`` from the likeliest to the least likely for one query's projections."""
        own = self.span[t]
        low = self.cells[own] - place
        gap = np.where(low > 0, low, np.where(low + 1 < 0, low + 1, 0))
        return own[np.argsort((gap**2).sum(axis=1), kind="stable")]

    def blocks(self, at: np.ndarray) -> np.ndarray:
        return -(-self.counts[at] // BLOCK)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else 0)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): one row per id that takes part, vectors in double precision."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where("vec_id is not null and v is not null").where(finite).where(F.exists("v", lambda x: x != 0))
            .groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = _written(rows, "ann-vectors")
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("v") == (dim["dim"] if dim else 0))


def _top(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int):
    """Per query the k best of ``base`` but itself: (row of base, score), best first, ties by id.

    A matrix product preselects; scores are then computed pair by pair, so that equal vectors score equally.
    """
    product = queries @ base.T
    product[query_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * max(1.0, np.abs(base).max(initial=0) * np.abs(queries).max(initial=0) * base.shape[1])
    for q in range(len(queries)):
        row = product[q]
        if len(row) > k:
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack)
        else:
            near = np.arange(len(row))
        near = near[row[near] > -np.inf]
        score = (base[near] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        yield q, near[best], score[best]


def probes_needed(rows: DataFrame, sample: DataFrame, hashes: Hashes, directory: Directory, k: int, target: float) -> int:
    """Least number of buckets per table that finds ``target`` of the sample's true neighbours."""
    held = sample.toArrow().combine_chunks()
    if held.num_rows == 0:
        return 1
    ids, queries = held["vec_id"].to_numpy(), _matrix(held["v"].combine_chunks())
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def scan(batches):
        ids, queries = shared.value
        for batch in batches:
            base, own = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            if len(own) == 0:
                continue
            key = Hashes.keys(np.floor(hashes.place(base, False)))
            out = [(ids[q], own[r], s, key[:, r].tolist()) for q, near, score in _top(queries, ids, base, own, k) for r, s in zip(near, score)]
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                   pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                                  names=["query_id", "vec_id", "score", "keys"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = (rows.mapInArrow(scan, "query_id long, vec_id long, score double, keys array<long>")
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query_id", "keys").collect())
    place = dict(zip(ids.tolist(), np.swapaxes(hashes.place(queries, True), 0, 1)))
    tables = len(directory.span)
    rank = {}
    for q in {r["query_id"] for r in true}:
        for t in range(tables):
            at = directory.ranked(place[q][t], t)
            rank[q, t] = dict(zip(directory.keys[at].tolist(), range(1, len(at) + 1)))
    needed = np.sort([min(rank[r["query_id"], t][r["keys"][t]] for t in range(tables)) for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            target: float = 0.95, probes: int | None = None) -> DataFrame:
    """Per query (rows for which ``is_query``, an expression on the long column ``vec_id``, holds) its k nearest found:
    query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    facts = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"), F.max(F.size("v")).alias("dim")).first()
    if facts["dim"] is None:
        return empty
    hashes = Hashes(facts["dim"], float(np.sqrt(facts["square"])))

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                key = Hashes.keys(np.floor(hashes.place(_matrix(batch.column("v")), False)))
                yield pa.record_batch([batch.column("vec_id"), _lists(key.T), batch.column("v")], names=["vec_id", "keys", "v"])

    index = _written(rows.mapInArrow(keyed, "vec_id long, keys array<long>, v array<double>"), "ann-index")
    counts = index.select(F.explode("keys").alias("key")).groupBy("key").count().toArrow()
    directory = Directory(counts["key"].to_numpy(), counts["count"].to_numpy(), TABLES, HASHES)
    queries = rows.where(is_query)
    if probes is None:
        order = F.xxhash64("vec_id")
        probes = probes_needed(rows, queries.orderBy(order, "vec_id").limit(SAMPLE), hashes, directory, k, target)
    shared = spark.sparkContext.broadcast(directory)
    occupied = min(len(s) for s in directory.span)
    query_blocks = max(1, -(-int(queries.count() * min(1.0, 4 * probes / occupied)) // QUERY_BLOCK))

    def visits(batches):
        held = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            place = hashes.place(_matrix(batch.column("v")), True)
            row, at = [], []
            for q in range(batch.num_rows):
                for t in range(len(held.span)):
                    ranked = held.ranked(place[t, q], t)
                    enough = int(np.searchsorted(np.cumsum(held.counts[ranked]), LEAST_SEEN)) + 1
                    chosen = ranked[: max(probes, enough)]
                    row.append(np.full(len(chosen), q))
                    at.append(chosen)
            row, at = np.concatenate(row), np.concatenate(at)
            blocks = held.blocks(at)
            row, at = np.repeat(row, blocks), np.repeat(at, blocks)
            block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            for start in range(0, len(row), 20_000):  # vectors are repeated per bucket: yield them in pieces
                part = slice(start, start + 20_000)
                taken = batch.take(pa.array(row[part]))
                yield pa.record_batch([pa.array(held.keys[at[part]]), pa.array(block[part].astype(np.int32)), taken.column("vec_id"),
                                       taken.column("v")], names=["key", "block", "vec_id", "v"])

    def dealt(batches):
        held = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = _matrix_of_keys(batch.column("keys"))
            for t in range(keys.shape[1]):
                at = np.searchsorted(held.keys, keys[:, t])
                block = mix(batch.column("vec_id").to_numpy().astype(np.uint64), 5) % held.blocks(at).astype(np.uint64)
                yield pa.record_batch([pa.array(keys[:, t]), pa.array(block.astype(np.int32)), batch.column("vec_id"), batch.column("v")],
                                      names=["key", "block", "vec_id", "v"])

    schema = "key long, block int, vec_id long, v array<double>"
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    asked = queries.mapInArrow(visits, schema).withColumn("part", own_block)
    stored = index.mapInArrow(dealt, schema)
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def score(key, asked: pa.Table, stored: pa.Table) -> pa.Table:
        out_q, out_ids, out_scores = [], [], []
        if asked.num_rows and stored.num_rows:
            ids, q_ids = stored["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            base, q = _matrix(stored["v"].combine_chunks()), _matrix(asked["v"].combine_chunks())
            for start in range(0, len(q), 512):
                for i, near, scores in _top(q[start:start + 512], q_ids[start:start + 512], base, ids, k):
                    if len(near):
                        out_q.append(q_ids[start + i])
                        out_ids.append(ids[near])
                        out_scores.append(scores)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64())),
                         "scores": pa.array(out_scores, pa.list_(pa.float64()))})

    group = ["key", "block", "part"]
    found = asked.groupBy(*group).cogroup(stored.groupBy(*group)).applyInArrow(score, "query_id long, ids array<long>, scores array<double>")
    best = (found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
            .groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix_of_keys(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
