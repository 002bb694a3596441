"""Well-known expansion (T9), hop steps (T12), annotation (T11), paths."""

from pyspark.sql import functions as F

from crawlframe.operators import discovery as D


def test_well_known(spark):
    df = spark.createDataFrame([(u,) for u in ["http://h.org/", "http://h.org/?q=1", "http://h.org/?q=1#top",
                                               "http://h.org/;p=1", "http://h.org", "http://h.org/#top",
                                               "http://h.org//", "http://h.org/a"]], "url string")
    out = D.expand_well_known(df)
    first = {r.via: r.url for r in out.where("ord = 0").collect()}
    assert first == {"http://h.org/": "http://h.org/humans.txt", "http://h.org/?q=1": "http://h.org/humans.txt?q=1",
                     "http://h.org/?q=1#top": "http://h.org/humans.txt?q=1#top",
                     "http://h.org/;p=1": "http://h.org/humans.txt;p=1"}
    assert out.count() == 32 and {r.hop for r in out.collect()} == {"I"}


def test_hop_step(spark):
    rows = [(None, None, None, "v"), ("", None, None, "v"), ("", "I", None, "v"), ("L", None, ["u1"], "v"),
            ("LR", None, ["u1", "u2"], "v")]
    df = spark.createDataFrame(rows, "hop_path string, hop string, redirect_urls array<string>, via string")
    got = [(r.hop_path, r.via) for r in D.extend_hop_path(df).collect()]
    assert got == [("", "v"), ("L", "v"), ("I", "v"), ("LR", "u1"), ("LRR", "u1")]


def test_annotate(spark):
    links = spark.createDataFrame([(1, "http://c/", None)], "page_id long, url string, hop string")
    parents = spark.createDataFrame([(1, "http://p/", "L", "http://s/")], "page_id long, url string, hop_path string, source string")
    r = D.annotate_links(links, parents).first()
    assert (r.hop_path, r.hop, r.via, r.source) == ("L", "L", "http://p/", "http://s/")


def test_paths_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "L"), ("b", "c", "R"), ("c", "a", "L"), ("a", "c", "E"), ("c", "d", "L"),
                                   ("d", "b", "L")], "parent_url string, child_url string, hop string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r.url: (r.depth, r.hop_path, r.via, r.seed) for r in D.discovery_paths(spark, seeds, edges).collect()}
    assert got == {"a": (0, "", None, "a"), "b": (1, "L", "a", "a"), "c": (1, "E", "a", "a"), "d": (2, "EL", "c", "a")}
    assert D.limit_hop_path(D.discovery_paths(spark, seeds, edges), 1).count() == 3


def test_paths_through_a_hub_in_salted_parts(spark):
    from crawlframe.operators.discovery import discovery_paths
    edges = [("s", "hub", "L")] + [("hub", f"c{k}", "E") for k in range(300)] + [(f"c{k}", f"d{k}", None) for k in range(300)]
    e = spark.createDataFrame(edges, "parent_url string, child_url string, hop string")
    seeds = spark.createDataFrame([("s", {"a": 1})], "url string, extra map<string,int>")
    for size in (20, 100_000):
        got = {r.url: (r.depth, r.hop_path, r.via, r.extra) for r in discovery_paths(spark, seeds, e, carry=("extra",), hub_edges=size).collect()}
        assert len(got) == 602 and got["c299"] == (2, "LE", "hub", {"a": 1}) and got["d7"] == (3, "LEL", "c7", {"a": 1})
    assert {r.url for r in discovery_paths(spark, seeds, e, max_hops=1).collect()} == {"s", "hub"}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("crawlframe_")]
