import random

import numpy as np
import pyarrow as pa
import pytest

from crawlframe.llm import classify, subword


def made(n=240, seed=0):
    rnd = random.Random(seed)
    parts = {"aa": ["ba", "lo", "mi", "ne"], "zz": ["schu", "gro", "pfe", "üß"]}
    rows = []
    for k in range(n):
        lang = rnd.choice(["aa", "zz"])
        rows.append((k, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(2, 60))), lang))
    return rows


def test_language_on_held_out_rows(spark, documents):
    rows = made() + [(900, None, "aa"), (901, "", "zz"), (902, "12 !? 34", "aa"), (903, "balo mine balo", None)]
    df = documents(rows)
    model = classify.fit(df.where("doc_id % 3 != 1"), "text", "lang")
    got = {r.doc_id: r for r in classify.language(df.drop("lang"), model).collect()}
    held = [(got[d].lang_pred, lang) for d, _, lang in rows[:240] if d % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(got[d].lang_pred == "und" and got[d].score == 0 and got[d].rejected for d in (900, 901, 902))
    assert got[903].lang_pred == "aa" and 0 <= got[903].score <= 1
    assert np.mean([got[d].rejected for d, *_ in rows[:240]]) < 0.02


def test_quality_learns_repetition(spark, documents):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(k, " ".join(word() for _ in range(40)), "1") if k % 2 else (k, " ".join(w for w in [word() for _ in range(8)] for _ in range(5)), "0")
            for k in range(300)]
    model = classify.fit(documents(rows[:200]), "text", "lang", classify.QUALITY)
    got = {r.doc_id: r for r in classify.quality(documents(rows[200:]), model, "1").collect()}
    assert np.mean([got[d].predicted == int(y) for d, _, y in rows[200:]]) > 0.95
    assert all((r.score >= 0.3) == bool(r.predicted) for r in got.values())


def test_models_fitted_on_nothing_or_one_class(spark, documents):
    df = documents([(1, "some text", None), (2, None, "aa")])
    none = classify.fit(df, "text", "lang")
    assert [r.score for r in classify.quality(df, none, "aa").collect()] == [0.5, 0.5]
    assert [r.lang_pred for r in classify.language(df, none).collect()] == ["und", "und"]
    one = classify.fit(documents([(1, "x", "aa")]), "text", "lang")
    assert [r.score for r in classify.quality(df, one, "aa").collect()] == [1.0, 1.0]
    assert classify.quality(documents([]), one, "aa").count() == 0


def test_sample_is_bounded_and_distinct(spark, documents):
    rows = [(k, f"text {k % 50}", "aa" if k % 2 else "zz") for k in range(400)]
    texts, labels = classify.labelled_sample(documents(rows), "text", "lang", per_class=10)
    assert len(texts) <= 20 and len(set(zip(texts, labels))) == len(texts) and set(labels) == {"aa", "zz"}
    assert len(classify.labelled_sample(documents(rows), "text", "lang", 10, bytes_per_class=1)[0]) == 2


def test_scores_equal_the_definition():
    """Vectorised scoring against one feature after the other."""
    texts = ["ab ab ab cde", "", "é<x> y", "a" * 3000, None]
    p = subword.Params(buckets=997, repeat_weight=3)
    rng = np.random.default_rng(0)
    m = subword.Model([0, 1], rng.normal(size=(997, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32), p, temperature=1.5)
    got = subword.probabilities(pa.array(texts, pa.string()), m)
    for t, row in zip(texts, got):
        words = (t or "").split()
        total, size = np.zeros(2), 0.0
        for k, w in enumerate(words):
            _, buckets = subword.word_features(pa.array([w]), p)
            assert len(buckets) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in range(p.min_n, p.max_n + 1))
            total += m.table[buckets].astype(float).sum(axis=0)
            size += len(buckets)
            if k and words[k - 1] == w:
                total += 3 * m.table[0].astype(float)
                size += 3
        z = np.exp((total / max(size, 1) + m.bias) / 1.5)
        assert row == pytest.approx(z / z.sum(), rel=1e-6)
