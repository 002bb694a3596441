"""The registered queries without SQL: their contract over a whole small table (values are tested operator by operator)."""

import zlib

import pytest

from crawlframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BARE = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def of(name):
        if name not in done:
            done[name] = QUERIES[name](spark, SF).collect()
        return done[name]

    return of


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_every_query_without_sql_is_checked_here():
    assert BARE == ["op10_nearest", "op13_token_alignment", "op1_sentencepiece", "op2_quality", "op3_lm_scoring", "op4_decontamination", "op8_extraction",
                    "op9_language_id"]


@pytest.mark.parametrize("name", ["op13_token_alignment", "op1_sentencepiece", "op2_quality", "op3_lm_scoring", "op9_language_id"])
def test_one_row_per_document(result, docs, name):
    rows = result(name)
    assert sorted(r.doc_id for r in rows) == sorted(docs)


def test_held_out_rows_and_ranges(result):
    for name, n, k in (("op2_quality", 5, 0), ("op3_lm_scoring", 7, 2), ("op9_language_id", 3, 1)):
        assert all(r.held_out == (rest(r.doc_id, n) == k) for r in result(name))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in result("op2_quality"))
    assert all(0 <= r.score <= 1 for r in result("op9_language_id"))
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in result("op3_lm_scoring"))


def test_encoded_rows(result, docs):
    for r in result("op1_sentencepiece"):
        assert r.n_tokens == len(r.ids) and r.n_best == len(r.best_ids) and r.exact == ("▁" not in (docs[r.doc_id].text or ""))
    for r in result("op13_token_alignment"):
        assert max(r.n_a, r.n_b) <= r.n_links <= r.n_a + r.n_b and r.n_best <= r.n_links <= r.count_sum and (r.n_a > 0) == (len(r.groups_sha256) == 64)


def test_leaked_items_stand_in_their_documents(spark, result, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, r in docs.items() for i, t in items.items() if t and t in (r.text or "")}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in result("op4_decontamination")}


def test_pages_and_neighbours(spark, result):
    pages = {r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()}
    rows = result("op8_extraction")
    assert sorted(r.page_id for r in rows) == sorted(pages) and all(r.n_chars == len(r.text) for r in rows)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    ranks = {}
    for r in result("op10_nearest"):
        assert r.query_id % 20 == 0 and r.query_id != r.vec_id
        ranks.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert all(sorted(v) == sorted(v, key=lambda x: x[1:]) and [x[0] for x in sorted(v)] == list(range(1, min(20, n - 1) + 1)) for v in ranks.values())
