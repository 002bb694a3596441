import random

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = pipeline._written(spark, stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_stages_filter_and_keep_columns(steps):
    assert [s[0] for s in steps] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, before, after in steps[:-1]:
        assert list(after.columns) == pipeline.COLUMNS
        assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique
    _, before, after = steps[-1]
    assert sorted(after.doc_id) == sorted(before.doc_id) and after.exact.all() and (after.n_tokens == after.ids.map(len)).all()


def test_near_dedup_and_leaks_against_brute_force(steps, spark):
    from tests.llm.test_neardup import brute
    _, before, after = steps[2]
    want = {d for d, _, _, kept in brute(list(zip(before.doc_id, before.text)), 5, 80) if kept}
    assert set(after.doc_id) == want
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _, before, after = steps[3]
    assert set(before.doc_id) - set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if any(i in t for i in items)}


def test_line_dedup_against_brute_force(steps):
    from tests.llm.test_linedup import brute_by_words
    _, before, after = steps[1]
    want = brute_by_words(list(zip(before.doc_id, before.text, before.lang, before.source)))
    kept = dict(zip(after.doc_id, after.text))
    assert kept == {d: t for d, (t, _, removed) in want.items() if not removed or t.strip(" ")}
    assert all(n == len(t) for t, n in zip(after.text, after.n_chars))


def test_stages_survive_odd_rows(spark, documents):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice(["the", "and", "of"]) + rnd.choice("abcdefgh") * 2 for _ in range(30)), "en" if k % 2 else "de", f"s{k % 3}") for k in range(40)]
    rows += [(100, None), (101, ""), (None, "some words without an id here"), (102, rows[0][1], None, None)]
    for table in (rows, []):
        docs = documents(table)
        for name, stage in pipeline.STAGES:
            docs = pipeline._written(spark, stage(spark, docs, SF), f"odd-{name}")
        assert (docs.count() > 0) == bool(table)
