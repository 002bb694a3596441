import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.llm import pitman_yor as py


def made(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.7)) % 500}" for _ in range(4000)]
    return [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 80)))) for k in range(n)]


def test_counts_and_base_score(spark, documents):
    rows = made() + [(100, None), (101, ""), (102, "NEW Words\x0bonly"), (102, "NEW Words\x0bonly"), (None, "w1 w2")]
    got = py.score(documents(rows), F.col("doc_id") >= 50).collect()
    assert len(got) == len(rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = {(d, t): [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if w] + [None] for d, t in rows}
    count = Counter(w for d, t in rows if d is None or d < 50 for w in split[d, t])
    n, v = sum(count.values()), len(count)
    want = {(d, len(split[d, t]), sum(count[w] > 0 for w in split[d, t]),
             round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split[d, t]), 6)) for d, t in rows}
    assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got} == want
    assert all(r.train_tokens == n and r.held_out == (r.doc_id is not None and r.doc_id >= 50) for r in got)


def test_learned_bigrams_beat_the_base_on_held_out_text(spark, documents):
    rnd = random.Random(2)
    follow = {w: rnd.sample(range(60), 3) for w in range(60)}

    def walk(n):
        w, out = rnd.randrange(60), []
        for _ in range(n):
            out.append(f"v{w}")
            w = rnd.choice(follow[w])
        return " ".join(out)
    got = py.score(documents([(k, walk(80)) for k in range(80)]), F.col("doc_id") % 4 == 0).collect()
    held = [r for r in got if r.held_out]
    per_token = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    assert per_token > sum(r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.8
    assert per_token < math.log10(1 / 2)  # three equal ways on: the model can't know more


def test_probabilities_of_a_context_sum_to_one(spark, documents):
    """P(w | start) * P(end | w) of one-word texts; with P(end | w) from the same texts repeated, the sum over w is bounded by 1."""
    words = [f"w{k}" for k in range(30)]
    train = [(k, f"{words[k % 30]} {words[(k * 7) % 30]}") for k in range(200)]
    ask = [(1000 + k, w) for k, w in enumerate(words)] + [(2000, ""), (3000, "unknown")]
    got = {r.doc_id: 10**r.score for r in py.score(documents(train + ask), F.col("doc_id") >= 1000).collect() if r.held_out}
    assert all(0 < p <= 1 for p in got.values())
    assert sum(p for d, p in got.items()) <= 1 + 1e-6


def test_root_probabilities_sum_to_one():
    customers, tables = np.array([9, 4, 1, 1]), np.array([3, 2, 1, 1])
    state = {"d_root": 0.6, "v": 4, "root_tables": 7.0, "root_customers": 15.0}
    known = py._root_probability(customers, tables, state, 2.0).sum()
    unknown = py._root_probability(np.array([0]), np.array([0]), state, 2.0)[0]
    assert known + unknown == pytest.approx(1.0)


def test_tables_are_drawn_from_the_conditional_of_the_restaurant():
    """Against a Gibbs chain over explicit tables, which removes and seats one customer at a time."""
    rng = np.random.default_rng(0)
    for d, weight, base, n in ((0.7, 3.0, 0.2, 20), (0.2, 1.0, 0.6, 6), (0.0, 2.0, 0.3, 12)):
        tables, seen = [n], []
        for step in range(60_000):
            k = rng.choice(len(tables), p=np.array(tables) / n)
            tables[k] -= 1
            tables = [x for x in tables if x]
            odds = np.array([*(x - d for x in tables), (weight + d * len(tables)) * base if tables else 1.0])
            k = rng.choice(len(odds), p=odds / odds.sum())
            tables = tables + [1] if k == len(tables) else [x + (i == k) for i, x in enumerate(tables)]
            if step > 2000:
                seen.append(len(tables))
        drawn = py.seat(np.full(40_000, n), np.full(40_000, weight), np.full(40_000, base), d, rng)
        for t in range(1, n + 1):
            assert abs((drawn == t).mean() - (np.array(seen) == t).mean()) < 0.025


def test_seats_of_very_frequent_dishes():
    rng = np.random.default_rng(0)
    d, weight, base, n = 0.7, 3.0, 0.2, 200

    def one():
        t = 1
        for j in range(1, n):
            p = (weight + d * t) * base
            t += rng.random() < p / (p + j - d * t)
        return t
    slow = np.mean([one() for _ in range(2000)])
    fast = py.seat(np.full(4000, n), np.full(4000, weight), np.full(4000, base), d, rng)
    assert fast.min() >= 1 and fast.max() <= n and abs(fast.mean() - slow) < 0.8
    huge = py.seat(np.array([10**9, 1, 0]), np.full(3, 1.0), np.full(3, 1e-3), 0.5, rng)
    assert 1 <= huge[0] < 10**7 and huge[1:].tolist() == [1, 0]


def test_packed_lists():
    for a in ([], [0], [3, 1, 70000], [2**40]):
        x = np.array(a, dtype=np.int64)
        assert py._large(py._small(x)).tolist() == a and py._numbers(py._ascending_or_not(x)).tolist() == a
    h = np.array([0, 2**64 - 1, 0x0123456789ABCDEF], dtype=np.uint64)
    assert py._of_six(py._six(h)).tolist() == (h >> np.uint64(16)).tolist()


def test_no_rows(spark, documents):
    assert py.score(documents([]), F.lit(False)).count() == 0
    got = py.score(documents([(1, "a b")]), F.lit(True)).collect()[0]
    assert (got.base_score, got.n_known, got.train_tokens) == (0.0, 0, 0) and got.score == pytest.approx(0.0, abs=1e-6)
