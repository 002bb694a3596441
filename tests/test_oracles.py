"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, digest

SF = os.environ.get("CRAWLFRAME_TEST_SF", "/root/testdata/sf0.001")
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, rows)[0] == digest(rel.columns, rel.fetchall())[0]


def test_only_training_data_queries_have_no_oracle():
    """Those have tests of their own, against brute force or held-out rows."""
    from crawlframe.plans.catalog import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_lives_without_the_training_data_part(monkeypatch):
    """Also if only a module that it needs is missing."""
    import importlib
    import sys
    for missing in ("crawlframe.llm", "ahocorasick"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("crawlframe.llm", "corpus_pipeline"))]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, missing, None)  # an import of it fails
            m.delitem(sys.modules, "__spark_entry__")
            entry = importlib.import_module("__spark_entry__")
            assert len(entry.queries()) > 90 and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "host_fp" in df.columns
