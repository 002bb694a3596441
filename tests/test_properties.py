"""Property tests: URL resolution agrees with the standard library on random
relative references; H3 lines round-trip through the parser."""

from urllib.parse import urljoin

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlframe.functions.urls import resolve_url

SEG = st.sampled_from(["g", "h", ".", "..", "", "a;x", "b.c", "%7E"])
REF = st.builds(
    lambda lead, segs, q, f: lead + "/".join(segs) + q + f,
    st.sampled_from(["", "/", "./", "../", "//x.org/", "http:", "https:", "HTTP:", "mailto:", "///", " ", "\t/",
                     " \n./"]),
    st.lists(SEG, min_size=0, max_size=5),
    st.sampled_from(["", "?", "?y=1"]),
    st.sampled_from(["", "#", "#s"]),
)
BASES = ["http://a/b/c/d;p?q", "https://h.org/x/", "http://h.org", "http://h.org/a/b?z#frag", "HTTP://H.org/a//b/"]


@settings(max_examples=15, deadline=None, phases=[Phase.generate])
@given(st.lists(st.tuples(st.sampled_from(BASES), REF), min_size=150, max_size=150))
def test_resolve_agrees_with_urljoin(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, ref string")
    for r in df.select("base", "ref", resolve_url(F.col("base"), F.col("ref")).alias("got")).collect():
        assert r.got == urljoin(r.base, r.ref), (r.base, r.ref)


@settings(max_examples=5, deadline=None, phases=[Phase.generate])
@given(st.lists(st.tuples(st.sampled_from(BASES), REF), min_size=150, max_size=150))
def test_oracle_resolver_agrees(pairs):
    import duckdb

    from crawlframe.plans import sqlgen as sg
    con = duckdb.connect()
    con.execute("CREATE TABLE t(base VARCHAR, ref VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    for base, ref, got in con.sql(f"SELECT base, ref, {sg.resolve('base', 'ref')} FROM t").fetchall():
        assert got == urljoin(base, ref), (base, ref)
