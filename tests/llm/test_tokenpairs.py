import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from crawlframe.llm import tokenpairs

A_PATH, B_PATH = tokenpairs.default_paths()


@pytest.fixture(scope="module")
def pair():
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        return tokenpairs.Pair(a.read(), b.read(), 5)


def whole(pair, texts):
    """By both libraries over whole texts: per text its groups of ids and all links, found from byte ranges."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    out = []
    for t in texts:
        ids = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        raw = [[pair.a_bytes[i] for i in ids[0]], [pair.b_bytes[i] for i in ids[1]]]
        if not t or any(b"".join(x) != b" " + t.encode() for x in raw):
            out.append(([], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in raw]
        both = set(ends[0]) & set(ends[1])
        groups, links = [], []
        for end in sorted(both):
            start = max((x for x in both if x < end), default=0)
            groups.append("|".join(",".join(str(i) for i, e in zip(own, at) if start < e <= end) for own, at in zip(ids, ends)))
        for x, e in zip(ids[0], ends[0]):
            s = e - len(pair.a_bytes[x])
            links += [(x, y) for y, f in zip(ids[1], ends[1]) if f - len(pair.b_bytes[y]) < e and s < f]
        out.append((groups, links))
    return out


def brute(pair, rows):
    found = whole(pair, [r[1] for r in rows])
    counts = Counter(link for _, links in found for link in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (d, *_), (groups, links) in zip(rows, found):
        text = ";".join(groups)
        sides = [g.split("|") for g in groups]
        out.append((d, sum(len(a.split(",")) for a, _ in sides), sum(len(b.split(",")) for _, b in sides), len(groups), len(links),
                    sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, {(a, b, n, n == top[b]) for (a, b), n in counts.items()}


def made(n=60):
    rng = random.Random(2)
    pool = ["the", "Überraschung", "don't", "cross-tokenizer", "naïve", "日本語", "🙂🙃", "x1y2", "<s>", "<|endoftext|>", "</s>", "<0x0A>", "1234567",
            "line\nend", "line\n", "\nstart", "\t", "", "…", "a b", "　", "pneumonoultramicroscopic", "don", "'s", "'s's", "\x85", "\x1c", "\x00"]
    rows = [(k, " ".join(rng.choice(pool[:17] if k % 3 else pool) for _ in range(rng.randrange(40)))) for k in range(n)]
    return rows + [(900, None), (901, ""), (902, " "), (903, "▁"), (904, "a ▁b"), (905, "z" * 5000), (906, "  two  spaces  "), (907, "\n\n a\n \n b"),
                   (908, "the " * 3000), (909, "tail\n\n the"), (None, "no id"), (910, "same"), (910, "same"), (911, "the end\n"), (912, "\r\n \r\n the")]


@pytest.mark.parametrize("radix, run_links", [(1, 10 ** 6), (7, 300)])
def test_matches_brute_force(spark, documents, pair, radix, run_links):
    rows = made()
    want, counts = brute(pair, rows)
    found = tokenpairs.Alignment(documents(rows), radix=radix, run_links=run_links)
    got = [tuple(r) for r in found.documents().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {tuple(r) for r in found.pair_counts().collect()} == counts


def test_units_equal_whole_texts(pair):
    rows = made(400)
    texts = [t for _, t in rows]
    counts, groups, _, row, keys = pair.align(pa.array(texts, pa.string()))
    want = whole(pair, texts)
    assert [str(g, "ascii") for g in groups] == [";".join(g) for g, _ in want] and counts[:, 3].tolist() == [len(x) for _, x in want]
    assert [sorted(keys[row == k].tolist()) for k in range(len(rows))] == [sorted(pair.key(a, b) for a, b in x) for _, x in want]


def test_byte_alphabet_is_the_vocabularys(pair):
    single = {b for b in pair.a_bytes.values() if len(b) == 1}
    assert len(single) == 256 and len(tokenpairs.byte_alphabet()) == 256


def test_packing_and_merging(monkeypatch):
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.int64), np.arange(300), rng.integers(0, 2 ** 40, 50)]
    assert all((x == y).all() for x, y in zip(arrays, tokenpairs.unpack(tokenpairs.pack(*arrays))))
    monkeypatch.setattr(tokenpairs, "FAN", 3)
    monkeypatch.setattr(tokenpairs, "BLOCK", 4)
    merger, want = tokenpairs.Merger(), Counter()
    for _ in range(40):
        keys = np.unique(rng.integers(0, 200, rng.integers(0, 60)))
        counts = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        merger.add(tokenpairs.pack(tokenpairs._deltas(keys), counts))
    keys, counts = merger.total()
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys) > 0).all()
    assert tokenpairs.merge([])[0].tolist() == []


def test_groups_as_text_clashing_columns_and_empty_table(spark, documents, pair):
    rows = made(12)
    docs = documents(rows).withColumnRenamed("lang", "run").withColumnRenamed("source", "ids").withColumnRenamed("n_chars", "n_best")
    got = {(r.doc_id, r.groups) for r in tokenpairs.alignment(docs, with_groups=True).collect()}
    assert got == {(d, ";".join(g)) for (d, *_), (g, _) in zip(rows, whole(pair, [t for _, t in rows]))}
    assert tokenpairs.alignment(documents([])).collect() == []
