"""J4 as the crawl grows: discovery paths in a store, to which seeds and edges are added batch by batch.

The best path of a URL is the first arrival: the least depth, then hop path, then parent, then seed. A batch recomputes
only URLs whose best path changes: those that a new seed or a new edge of a known parent reaches, and from there on,
round by round, whatever a changed URL links to. A round reads the buckets of the URLs it reaches and appends the
changed ones, so it costs what it changes, not what was ever reached.

A changed parent can only lower a child's (depth, hop path, parent). Of the same three, the seed (and carried columns)
follow the parent, so a child that already hangs on it takes over its new seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks.store import BucketStore, Manifest

ROUNDS = 1 << 20  # rounds that a batch may take: how versions number their changes


def open_paths(spark: SparkSession, root: str, carry: dict[str, str] | None = None, groups: int = 16, spread: int = 1) -> BucketStore:
    """``carry``: further columns of the seeds that ride along (name to type)."""
    carried = "".join(f", {c} {t}" for c, t in (carry or {}).items())
    return BucketStore(spark, root, {"paths": f"url string, depth int, hop_path string, via string, seed string{carried}, change long",
                                     "edges": "url string, child_url string, hop string"}, "url", groups, spread, by_hash=True)


def _columns(store: BucketStore) -> list[str]:
    return [c for c in store.spark.createDataFrame([], store.tables["paths"]).columns if c != "change"]


def _current(store: BucketStore, m: Manifest, buckets: list[int] | None) -> DataFrame:
    """The newest row of each URL."""
    rows = store.read("paths", buckets, m)
    columns = [c for c in _columns(store) if c != "url"]
    newest = rows.groupBy("url").agg(F.max_by(F.struct(*columns), "change").alias("_p"))
    return newest.select("url", *[F.col(f"_p.{c}").alias(c) for c in columns])


def read_paths(store: BucketStore) -> DataFrame:
    """(url, depth, hop_path, via, seed, carried columns) of every URL reached."""
    return _current(store, store.manifest(), None)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "path-round")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def add_paths(store: BucketStore, seeds: DataFrame, edges: DataFrame, batch_id: int, source: str = "crawl", max_hops: int | None = None) -> bool:
    """Add a batch of seeds (url[, source, carried columns]) and edges (parent_url, child_url, hop); false if it is in already."""
    columns = _columns(store)
    rest = [c for c in columns if c not in ("url", "depth", "hop_path", "via", "seed")]
    order = F.struct("depth", "hop_path", "via", "seed")
    values = [c for c in columns if c != "url"]

    def children(of: DataFrame, by: DataFrame) -> DataFrame:
        """What the edges ``by`` (url, child_url, hop) make of the paths ``of``."""
        far = of.join(by, "url").select(F.col("child_url").alias("url"), (F.col("depth") + 1).cast("int").alias("depth"),
                                        F.concat("hop_path", "hop").alias("hop_path"), F.col("url").alias("via"), "seed", *rest)
        return far if max_hops is None else far.where(F.col("depth") <= max_hops)

    def work(m: Manifest) -> dict:
        new_edges = _written(edges.where("parent_url is not null and child_url is not null").select(
            F.col("parent_url").alias("url"), "child_url", F.coalesce("hop", F.lit("L")).alias("hop")).distinct())
        m.tables["edges"] = {**m.tables.get("edges", {}), **store.appended("edges", new_edges, m, distinct=True)}
        begin = F.coalesce(F.col("source"), F.col("url")) if "source" in seeds.columns else F.col("url")
        started = seeds.where("url is not null").select("url", F.lit(0).alias("depth"), F.lit("").alias("hop_path"),
                                                        F.lit(None).cast("string").alias("via"), begin.alias("seed"), *rest)
        reached = started.unionByName(children(_current(store, m, store.touched(new_edges)), new_edges))
        for number in range(ROUNDS):
            best = _written(reached.groupBy("url").agg(F.min_by(F.struct(*values), order).alias("_b")).select("url", "_b"))
            buckets = store.touched(best)
            if not buckets:
                break
            old = _current(store, m, buckets).select("url", F.struct(*values).alias("_o"))
            three = lambda p: F.struct(F.col(f"{p}.depth"), F.col(f"{p}.hop_path"), F.col(f"{p}.via"))
            same = three("_b") == three("_o")
            # of a seed given twice the least stays; elsewhere the parent's seed is followed
            better = F.col("_o").isNull() | (three("_b") < three("_o")) | (same & (F.col("_b.seed") != F.col("_o.seed")) & (
                F.col("_b.via").isNotNull() | (F.col("_b.seed") < F.col("_o.seed"))))
            changed = _written(best.join(old, "url", "left").where(better).select("url", "_b.*", F.lit((m.version + 1) * ROUNDS + number).alias("change")))
            touched = store.touched(changed)
            if not touched:
                break
            m.tables["paths"] = {**m.tables.get("paths", {}), **store.appended("paths", changed, m)}
            reached = children(changed.drop("change"), store.read("edges", touched, m).distinct())
        return {t: m.tables.get(t, {}) for t in ("edges", "paths")}

    return store.update(source, batch_id, work)
