import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def brute(x, ids, query, k):
    s = (x * x[ids.index(query)]).sum(axis=1)
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], float(s[i])) for i in order]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_exact_scores(spark, scale, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x = x * rng.uniform(0.2, 3, (1200, 1)).astype(np.float32) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(1200))
    got = {}
    for r in ann.nearest(frame(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x)]), F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 1200, 20)) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    hits = 0
    for q, found in got.items():
        want = brute(x.astype(np.float64), ids, q, 10)
        hits += len({v for v, _ in want} & {v for v, _ in found.values()})
        assert all(s == pytest.approx(float(x[v].astype(np.float64) @ x[q].astype(np.float64)), abs=1e-12) for v, s in found.values())
    assert hits / (10 * len(got)) >= 0.9


def test_few_rows_ties_and_invalid_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, [-1.0, 0.0], 0), (3, [-1.0, 0.0], 1),
            (20, [0.0, 1.0], 0), (40, [0.0, 0.0], 0), (41, None, 0), (42, [nan, 1.0], 0), (43, [inf, 1.0], 0), (44, [None, 1.0], 0),
            (45, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0], 0)]
    got = [tuple(r) for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (0, 4, 3, -1.0),
                   (20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 0, 0.0), (20, 4, 3, 0.0)]


def test_many_equal_vectors_keep_the_smallest_ids(spark):
    rows = [(i, [0.6, 0.8, 0.0], 0) for i in range(1, 300)] + [(0, [0.6, 0.8, 0.1], 0)]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def test_no_rows(spark):
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0)]), F.col("vec_id") % 20 == 0).count() == 0
