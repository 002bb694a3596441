import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crawlframe.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio):
    out = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = [form, n, len(others), words[form] if form else None]
    for w in out:
        end = w
        while out[end][0]:
            end = out[end][0]
        out[w].insert(1, end)
    return {w: tuple(v) for w, v in out.items()}


def mistyped(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1:], word[:i] + rng.choice(letters) + word[i + 1:]]) or "a"


def made(rng, letters, stems=40):
    words = {}
    for _ in range(stems):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
        for _ in range(rng.randrange(1, 8)):
            words[w] = rng.choice([1, 4, 5, 5, 25, 26, 130, 4000])
            w = mistyped(rng, w, letters)
    return words


def table(spark, words):
    return spark.createDataFrame(list(words), "word string, n long").repartition(3)


@pytest.mark.parametrize("letters, symbols", [("abc", 4), ("abcdefghijklmnopqrstuvwxyzàáÿ", 8), ("ab", 256), ("xyzé\U0001f600", None)])
def test_matches_brute_force(spark, letters, symbols):
    words = made(random.Random(len(letters)), letters)
    got = spelling.variants(table(spark, words.items()), 5, symbols).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(words, 5) and len(got) == len(words)


def test_neighbourhood_is_complete_and_without_repeats(monkeypatch):
    monkeypatch.setattr(spelling, "EMIT", 16)  # also words that need several parts
    rng = random.Random(3)
    for symbols in (4, 8):
        by_symbol = {int(spelling._symbols(np.array([c]), symbols)[0]): chr(c) for c in range(97, 400)}
        for _ in range(60):
            word = "".join(rng.choice("aabcdef") for _ in range(rng.randrange(1, 9)))
            word = "".join(by_symbol[int(s)] for s in spelling._symbols(np.array([*map(ord, word)]), symbols))
            want = {word} | {word[:i] + x + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for x in ("", *by_symbol.values()) if j <= len(word)}
            keys = np.concatenate([k for _, k in spelling._neighbours(pa.array([word]), symbols)]).view(np.int64).tolist()
            assert len(keys) == len(set(keys)) and set(keys) == set(spelling._keys(pa.array(sorted(want)), symbols).tolist())


def test_symbols_grow_until_reduced_words_are_rare(spark):
    alike = [(f"{x}{y}{z}word", 5) for x in "abcdefghijklmnopqrstuvwxyz" for y in "abcdefghijklmnopqrstuvwxyz" for z in "abcdefgh"]
    numbered = lambda words: table(spark, words).selectExpr("monotonically_increasing_id() id", "word", "n")
    assert spelling.symbols_for(numbered(alike)) > spelling.SYMBOLS[0]
    assert spelling.symbols_for(numbered(alike[:3])) == spelling.SYMBOLS[0]


def test_vocabulary_counts_runs_with_their_misspellings(spark, documents):
    rng = random.Random(9)
    pool = ["Straße", "straÉe", "Überall", "überall", "wording", "WORDING", "tiny", "÷signs×", "co-operate", "x" * 3000]
    rows = [(k if k % 9 else None, " ".join(rng.choice(pool) for _ in range(30)) if k % 7 else rng.choice([None, "", "a1b2"])) for k in range(60)]
    want = {}
    for d, t, in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 5 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in spelling.vocabulary(documents(rows), min_count=3, typo_every=5).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3} and any(len(w) > 2000 for w in got)


def test_odd_tables(spark):
    got = spelling.variants(table(spark, [("worked", 9), (None, 5), ("void", None), ("worked", 11), ("wrked", 4), ("wrkd", 1), ("q" * 40000, 7), ("q" * 40001, 70)])).collect()
    assert {r.word[:8]: (r.form and r.form[:8], r.root[:8], r.n, r.n_near, r.form_n) for r in got if len(r.word) != 40000} == {
        "worked": (None, "worked", 20, 1, None), "wrked": ("worked", "worked", 4, 2, 20), "wrkd": (None, "wrkd", 1, 1, None), "q" * 8: (None, "q" * 8, 70, 1, None)}
    assert [(len(r.form), r.form_n) for r in got if len(r.word) == 40000] == [(40001, 70)]
    empty = spark.createDataFrame([], "word string, n long, key string, near string")
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, 1)


def test_chain_of_forms_ends_at_one_root(spark):
    chain = [("abcdef" + "gh" * k, 6 ** (12 - k)) for k in range(12)]
    steps = [(w + "g", 6 ** (12 - k) // 3) for k, (w, _) in enumerate(chain)]
    words = dict(chain + steps)
    got = spelling.variants(table(spark, words.items()), 2).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(words, 2)
    assert len({r.root for r in got}) == 1
