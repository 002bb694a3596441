"""J4 in batches: a stored path table equals one run over all seeds and edges."""

import random

import pytest

from crawlframe.operators import path_store as PS


def brute(seeds, edges, max_hops=None):
    best = {}
    for u, s in seeds:
        if u not in best or s < best[u][3]:
            best[u] = (0, "", None, s)
    level, depth = dict(best), 0
    while level and (max_hops is None or depth < max_hops):
        depth += 1
        cand = {}
        for p, c, h in edges:
            if p in level and c not in best:
                k = (depth, level[p][1] + (h or "L"), p, level[p][3])
                cand[c] = min(cand.get(c, k), k)
        best |= cand
        level = cand
    return {u: v for u, v in best.items()}


def table(spark, seeds, edges):
    return (spark.createDataFrame(seeds, "url string, source string"), spark.createDataFrame(edges, "parent_url string, child_url string, hop string"))


def stored(store):
    rows = PS.read_paths(store).collect()
    assert len({r.url for r in rows}) == len(rows)
    return {r.url: (r.depth, r.hop_path, r.via, r.seed) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_in_any_order_equal_one_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    nodes = [f"u{k}" for k in range(30)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice(["L", "E", "R", None])) for _ in range(60)]
    seeds = [(rng.choice(nodes), f"s{rng.randrange(9)}") for _ in range(4)]
    store = PS.open_paths(spark, str(tmp_path), groups=4)
    cuts = [(seeds[:1], edges[40:]), (seeds[1:2], edges[:25]), (seeds[2:] + seeds[:1], edges[20:45])]
    done = ([], [])
    for k, (s, e) in enumerate(cuts):
        done[0].extend(s), done[1].extend(e)
        assert PS.add_paths(store, *table(spark, s, e), k)
        assert stored(store) == brute(*done)
    assert not PS.add_paths(store, *table(spark, [("u0", "a")], []), 2) and stored(store) == brute(seeds, edges)


def test_a_batch_appends_the_changed_urls_only(spark, tmp_path):
    chain = [(f"c{k}", f"c{k + 1}", "L") for k in range(6)]
    store = PS.open_paths(spark, str(tmp_path), {"launched": "int"}, groups=16)
    seeds = spark.createDataFrame([("c0", 7)], "url string, launched int")
    edges = lambda rows: spark.createDataFrame(rows, "parent_url string, child_url string, hop string")
    PS.add_paths(store, seeds, edges(chain), 0)
    assert {(r.url, r.launched) for r in PS.read_paths(store).collect()} == {(f"c{k}", 7) for k in range(7)}
    before = store.read("paths").count()
    PS.add_paths(store, seeds.limit(0), edges([("c4", "new", "E"), (None, "x", "L"), ("lost", "y", "L")]), 1)
    assert store.read("paths").count() == before + 1  # one URL, whatever the table holds
    PS.add_paths(store, seeds.limit(0), edges([("c0", "c4", "E")]), 2)  # a shorter way: c4 and what hangs on it
    assert {r.url: r.hop_path for r in PS.read_paths(store).collect()} == {
        "c0": "", "c1": "L", "c2": "LL", "c3": "LLL", "c4": "E", "c5": "EL", "c6": "ELL", "new": "EE"}
    assert store.read("paths").count() <= before + 1 + 4
    short = PS.open_paths(spark, str(tmp_path / "short"))
    PS.add_paths(short, seeds, edges(chain), 0, max_hops=2)
    assert set(stored(short)) == {"c0", "c1", "c2"}
