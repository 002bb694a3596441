import random

import numpy as np
import pyarrow as pa

from crawlframe.llm import neardup
from crawlframe.llm.components import connected_components


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        comp = min(ids) if ids and sets[i] else d
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=repr)


def variants(n_groups, copies, length, seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n_groups):
        base = [rnd.choice(vocab) for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, length // 6)):
                own[rnd.randrange(length)] = rnd.choice(vocab)
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force_with_a_large_group(spark, documents):
    rows = variants(6, 6, 60, 1) + [(1000 + i, t) for i, t in variants(1, 120, 80, 2)]
    rows += [(5000, rows[3][1]), (5001, None), (5002, ""), (5003, " \t\n"), (5004, "One"), (5005, "ONE\n"), (5006, "one two"),
             (None, rows[5][1]), (5007, "Éé x " * 30), (5008, "éé x " * 30)]
    for size in (2, 5):
        got = neardup.near_duplicates(documents(rows), shingle=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, size, 80)


def test_small_blocks_give_the_same_components(spark, documents, monkeypatch):
    rows = variants(1, 90, 50, 3)
    monkeypatch.setattr(neardup, "REST_ITEMS", 300)
    monkeypatch.setattr(neardup, "ALL_ITEMS", 700)
    got = neardup.near_duplicates(documents(rows), shingle=2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2, 80)


def test_repeated_rows_extra_columns_and_empty_table(spark, documents):
    df = documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z")]).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "cls")
    got = neardup.near_duplicates(df, shingle=5).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert neardup.near_duplicates(documents([]), shingle=5).count() == 0


def test_every_coordinate_fills_and_agreement_estimates_similarity():
    rnd = np.random.default_rng(0)
    pool = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    sets = [np.unique(pool[:k]) for k in (1, 2, 5, 900)] + [np.unique(pool[100:1000])]
    sk = neardup.sketches(sets)
    assert (sk != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    agree = (sk[3] == sk[4]).mean()
    assert abs(agree - 800 / 1000) < 0.15
    assert (neardup.sketches([np.zeros(0, np.uint64)]) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_long_text_is_read_whole():
    long = "a " * 200_000 + "end of text"
    (only,) = neardup.shingle_sets(pa.array([long]), 2)
    assert len(only) == 4  # (a a), (a end), (end of), (of text)


def test_connected_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected_components(links.limit(0)).count() == 0
