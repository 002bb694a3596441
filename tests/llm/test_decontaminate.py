import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crawlframe.llm import decontaminate as dc


def made_items(n=40, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{int(k ** 1.5)}" for k in range(300)]
    return [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 150))) + ". " + " ".join(rnd.choice(vocab) for _ in range(6)) + ".")
            for i in range(n)]


def index_of(items):
    chunks = [c for _, t in items for c in dc.chunks(t)]
    df = Counter(w for c in chunks for w in set(c))
    return dc.build(items, df, len(chunks), sum(map(len, chunks)) / len(chunks)), chunks


def test_wand_returns_exactly_the_chunks_above_the_threshold():
    index, chunks = index_of(made_items())
    dense = np.zeros((len(index.terms), len(chunks)))
    for t in range(len(index.terms)):
        dense[t, index.chunk[index.first[t]:index.first[t + 1]]] = index.impact[index.first[t]:index.first[t + 1]]
    rnd = random.Random(0)
    for _ in range(300):
        query = np.array(sorted(rnd.sample(range(len(index.terms)), rnd.randint(0, len(index.terms)))), dtype=int)
        threshold = rnd.choice([0.05, 0.2, 0.5])
        score = dense[query].sum(axis=0)
        want = [(int(c), pytest.approx(score[c])) for c in np.flatnonzero(score >= threshold - 1e-9)]
        assert dc.wand(index, query, threshold) == want


def test_passage_bound_loses_nothing():
    items = made_items()
    index, chunks = index_of(items)
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(rnd.choice(items)[1].split()) for _ in range(rnd.randint(0, 400))) for _ in range(30)]
    found = {(r, i) for r, i, *_ in dc.search(index, pa.array(texts), 0.3)}
    terms = {w: k for k, w in enumerate(index.terms.to_pylist())}
    want = set()
    for r, t in enumerate(texts):
        words = [w.strip(".") for w in t.split()]
        for start in range(0, len(words), dc.STRIDE):
            query = np.array(sorted({terms[w] for w in words[start:start + dc.PASSAGE] if w in terms}), dtype=int)
            want |= {(r, int(index.item_of[c])) for c, _ in dc.wand(index, query, 0.3)}
    assert found == want


def test_planted_items_are_found_and_clean_texts_left_alone(spark, documents):
    items = made_items()
    rnd = random.Random(5)
    other = lambda n: " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))
    rows, want = [], set()
    for k, (i, t) in enumerate(items):
        rows.append((k, other(rnd.randint(0, 300)) + " " + (t.upper().replace(" ", ",  ") if k % 2 else t) + " " + other(40), "en", "s"))
        want.add((k, i))
    rows += [(100 + k, other(200), "en", "s") for k in range(20)] + [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1][:60])]
    want.add((None, 0))
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (902, "...")], "item_id long, text string")
    for shard_bytes in (dc.SHARD_BYTES, 4000):
        got = dc.matches(documents(rows), bench, shard_bytes=shard_bytes).where("leaked").collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_planted_short_questions_and_answers_are_found(spark, documents):
    long = " ".join(f"w{k}" for k in range(12))
    items = [(1, f"{long} one? Answer: 42"), (2, f"{long} two? Forty two."), (3, f"Why? {long} three"), (4, f"Why so? {long} four"),
             (5, f"{long} five? Answer: Ñ."), (6, "Who? Him.")]
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(i, f"{other} {t} {other}") for i, t in items] + [(10, f"{other} {long} one? Answer: 43"), (11, f"{long} two? Two forty."), (12, "42")]
    want = {(i, i) for i, _ in items}
    for shard_bytes in (dc.SHARD_BYTES, 100):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in dc.matches(documents(rows), bench, shard_bytes=shard_bytes).where("leaked").collect()}
        assert want <= got and not {d for d, _ in got} & {12}
        assert (10, 1) not in got and (11, 2) not in got


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(documents([(1, "a b c")]), bench).count() == 0
    full = spark.createDataFrame([(1, "some question here. its answer")], "item_id long, text string")
    assert dc.matches(documents([]), full).count() == 0


def test_question_and_answer():
    assert dc.question_and_answer("What is it? It is that.") == ("What is it?", " It is that.")
    assert dc.question_and_answer("How? Answer: so") == ("How?", " so")
    assert dc.question_and_answer("one two three four five six") == ("one two three four five", "six")
    assert dc.question_and_answer("one") == ("", "one")


def test_ids_of_items_are_joined_back(spark, documents):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    items = [("", f"{words(1)}. {words(2)}."), ("k\x01z", f"{words(3)}. {words(4)}."), (None, f"{words(5)}. {words(6)}."),
             ("b", f"{words(3)}. {words(4)}."), ("b", f"{words(3)}. {words(4)}."), ("null text", None), ("empty", "")]
    docs = documents([(k, f"before {t} after") for k, (_, t) in enumerate(items[:3])] + [(9, words(9))])
    for shard_bytes in (16 << 20, 20_000):
        found = dc.matches(docs, spark.createDataFrame(items, "item_id string, text string"), shard_bytes=shard_bytes)
        got = sorted(((r.doc_id, r.item_id) for r in found.where("leaked").collect()), key=repr)
        assert got == sorted([(0, ""), (1, "k\x01z"), (1, "b"), (1, "b"), (2, None)], key=repr)
