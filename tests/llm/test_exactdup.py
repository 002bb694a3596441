import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crawlframe.llm import exactdup


def brute(rows):
    """{index of row: (keep_id, group_size, digest)} and the kept ids by digest."""
    groups = defaultdict(list)
    for k, (d, t, *_) in enumerate(rows):
        bare = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(t or ""), d is None, d or 0, k))
    out = {}
    for digest, members in groups.items():
        best = min(members)
        for *_, k in members:
            out[k] = (rows[best[3]][0], len(members), digest)
    return out


def check(spark, documents, rows):
    got = exactdup.duplicates(documents(rows)).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(
        ((rows[k][0], *v[:2], v[2]) for k, v in want.items()), key=repr)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {d: [i] for i, _, d in want.values()} == kept
    return got


def test_matches_brute_force_with_a_text_in_a_third_of_the_rows(spark, documents):
    rng = random.Random(5)
    pool = ["", None, " \t", "a b", "ab", "a\x0bb\n", "ÄB", "Ä B", "a b", "the same text " * 40, "thesametext" * 40]
    rows = [(k, rng.choice(pool[-2:] if k % 3 == 0 else pool) if k % 4 else f"own text {k}") for k in range(700)]
    check(spark, documents, rows)


def test_more_groups_than_may_be_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(exactdup, "HEAVY", 3)
    rows = [(k, f"text {k % 50}" + " " * (k % 7)) for k in range(600)] + [(1000 + k, "hot") for k in range(300)]
    check(spark, documents, rows)


def test_sketch_finds_every_frequent_digest(spark, documents):
    rows = [(k, f"hot {k % 5}" if k % 2 else f"own {k}") for k in range(4000)]
    digests = documents(rows, 7).select(exactdup.digest(F.col("text")).alias("text_sha256"))
    found = {r.hash for r in exactdup.frequent(digests).collect()}
    hot = {r.h for r in digests.groupBy("text_sha256").count().where("count > 100").selectExpr("xxhash64(text_sha256) h").collect()}
    assert len(hot) == 5 and hot <= found and len(found) <= exactdup.HEAVY


def test_null_ids_repeated_rows_and_empty_table(spark, documents):
    rows = [(None, "x y"), (None, "x y"), (7, "xy"), (7, "xy"), (3, "xy"), (None, "alone"), (9, None), (9, None), (8, "")]
    check(spark, documents, rows)
    assert exactdup.duplicates(documents([])).collect() == [] and exactdup.deduplicated(documents([])).collect() == []


def test_rows_that_stay_keep_all_columns_also_clashing_ones(spark, documents):
    rows = [(k, f"text {k % 20}" + " " * (k % 3), f"l{k}", f"s{k}") for k in range(90)] + [(500, "hot")] * 40 + [(None, "hot ")]
    docs = documents(rows).withColumnRenamed("lang", "text_sha256").withColumnRenamed("source", "doc").withColumnRenamed("n_chars", "row")
    got = exactdup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text_sha256, r.doc) for r in got.collect()), key=repr) == sorted(
        {(r.doc_id, docs_row[2], docs_row[3]) for r in exactdup.duplicates(documents(rows)).where("kept").collect()
         for docs_row in [next(x + (None,) * (4 - len(x)) for x in rows if x[0] == r.doc_id)]}, key=repr)
    with pytest.raises(ValueError):
        exactdup.duplicates(docs.withColumnRenamed("doc_id", "kept"), "kept")


def test_main_path_is_native_and_broadcasts_only_the_bounded_tables(spark, documents, capsys):
    exactdup.duplicates(documents([(k, f"t{k % 9}") for k in range(99)])).explain()
    plan = capsys.readouterr().out
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas")) and "BroadcastHashJoin" in plan
