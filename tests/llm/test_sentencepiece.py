import math
import random

import pyarrow as pa
import pytest
import sentencepiece as library
from sentencepiece import sentencepiece_model_pb2

from crawlframe.llm import sentencepiece as sp


@pytest.fixture(scope="module")
def model():
    with open(sp.default_model(), "rb") as f:
        return f.read()


def texts():
    rnd = random.Random(4)
    letters = "abeé  \n\t🙂中ß▁12%$thinger"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    return made + [" " * k + "x" for k in range(40)] + ["a" * k for k in range(40)] + ["", " ", "\n", "the thing " * 3000]


def test_merged_ids_equal_the_library(model):
    own, lib = sp.Segmenter(model), library.SentencePieceProcessor(model_proto=model)
    ids, _, _, exact = own.encode(pa.array(texts()))
    for t, i, e in zip(texts(), ids.to_pylist(), exact):
        assert i == lib.encode(t), repr(t)
        assert own.decode(i) == lib.decode(i)
        assert bool(e) == (own.decode(i) == t)
        assert "▁" in t or e


def unigram(model):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = sp.UNIGRAM
    rnd = random.Random(1)
    for p in proto.pieces:
        if p.type == sp.NORMAL:
            p.score = -math.log(2 - max(p.score, -40000)) - rnd.random() * 1e-3  # no ties
    return proto.SerializeToString()


def test_best_path_equals_the_library_for_a_unigram_model(model):
    changed = unigram(model)
    own, lib = sp.Segmenter(changed), library.SentencePieceProcessor(model_proto=changed)
    plain = [t for t in texts() if len(t) < 100 and not {"\n", "\t"} & set(t) and len(set(t)) > 2 and "  " not in t]
    ids, n, score, _ = own.encode(pa.array(plain))
    for t, i, k in zip(plain, ids.to_pylist(), n.to_pylist()):
        assert i == k == lib.encode(t), repr(t)
    by_scores = sp.Segmenter(changed, by="scores").encode(pa.array(plain))[0].to_pylist()
    assert by_scores == ids.to_pylist()


def test_best_score_is_the_maximum_over_all_segmentations(model):
    own = sp.Segmenter(unigram(model))

    def best(unit):
        if not unit:
            return 0.0
        options = [own.scores[own.ids[unit[:k]]] + best(unit[k:]) for k in range(1, len(unit) + 1) if unit[:k] in own.ids]
        return max(options, default=-math.inf)
    for word in ("thing", "eres", "unter", "ation", "xqz"):
        assert own.segment(sp.MARK + word)[2] == pytest.approx(best(sp.MARK + word))


def test_best_ids_are_the_path_of_the_best_score(model):
    """The BPE model's Viterbi path: its pieces spell the unit, and their scores add up to the maximum."""
    own = sp.Segmenter(model)
    plain = [t for t in texts() if t and "▁" not in t]
    ids, best, score, exact = own.encode(pa.array(plain))
    for t, b, total in zip(plain, best.to_pylist(), score):
        assert own.decode(b) == t
        assert sum(own.unknown_score if i in set(own.bytes.values()) else own.scores[i] for i in b) <= total + 1e-6 * abs(total) or "🙂" in t
    by_scores = sp.Segmenter(model, by="scores").encode(pa.array(plain))
    assert by_scores[0].to_pylist() == best.to_pylist() == by_scores[1].to_pylist()
    assert any(i != b for i, b in zip(ids.to_pylist(), best.to_pylist())) and exact.all()


def test_store_that_overflows_changes_nothing(model):
    whole = sp.Segmenter(model).encode(pa.array(texts()))
    own = sp.Segmenter(model, units=40)
    parts = [own.encode(pa.array(texts()[k:k + 97])) for k in range(0, len(texts()), 97)]
    assert [x for p in parts for x in p[0].to_pylist()] == whole[0].to_pylist()
    assert [x for p in parts for x in p[1].to_pylist()] == whole[1].to_pylist()


def test_columns_nulls_and_round_trip(spark, documents):
    df = documents([(1, "Hello  world.\n"), (2, None), (3, ""), (4, "a▁b"), (5, "über 🙂"), (5, "über 🙂")]).withColumnRenamed("lang", "ids")
    rows = df.select("doc_id", "text", sp.encode(spark, "text").alias("e")).select("doc_id", "text", "e.*")
    got = rows.withColumn("back", sp.decode(spark, "ids")).collect()
    for r in got:
        assert r.back == (r.text or "").replace("▁", " ")
        assert r.exact == (r.doc_id != 4)
    assert {r.doc_id: len(r.ids) for r in got}[2] == 0
    whole = sp.encode_rows(df.withColumnRenamed("ids", "lang2")).collect()
    assert sorted((r.doc_id, r.ids, r.exact) for r in whole) == sorted((r.doc_id, r.ids, r.exact) for r in got)
    assert spark.createDataFrame([], "t string").select(sp.encode(spark, "t")).count() == 0
