"""Discovery jobs: well-known expansion (T9), seed tagging (T10), link
annotation (T11), hop steps (T12), implied + extracted requests (J3), discovery
paths over a whole crawl (J4) and hop-path limits (X6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.common import col_of
from ..functions.urls import is_homepage
from ..session import scratch_path

# The well-known URIs tried for every crawled homepage, in order.
DEFAULT_WELL_KNOWN_URIS = [
    "/humans.txt",
    "/ads.txt",
    "/sellers.json",
    "/.well-known/security.txt",
    "/.well-known/host-meta",
    "/.well-known/host-meta.json",
    "/.well-known/dat",
    "/.well-known/nodeinfo",
]

_HOMEPAGE_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)/(.*)$"


def expand_well_known(pages: DataFrame, uris=None, url_col: str = "url", keep=()) -> DataFrame:
    """For each homepage emit the well-known URLs (hop ``I``).

    The homepage's params/query (and fragment) stay on each new URL, as when
    only the path is replaced. Output: (*keep, via, url, hop, ord).
    """
    uris = list(DEFAULT_WELL_KNOWN_URIS if uris is None else uris)
    u = F.col(url_col)
    origin = F.regexp_extract(u, _HOMEPAGE_SPLIT, 1)
    rest = F.regexp_extract(u, _HOMEPAGE_SPLIT, 2)
    home = pages.where(is_homepage(u))
    return home.select(*keep, u.alias("via"), origin.alias("_o"), rest.alias("_r"),
                       F.posexplode(F.array(*[F.lit(x) for x in uris])).alias("ord", "_w")) \
        .select(*keep, "via", F.concat("_o", "_w", "_r").alias("url"), F.lit("I").alias("hop"),
                F.col("ord").cast("int").alias("ord"))


def tag_seeds(seeds: DataFrame, url_col: str = "url") -> DataFrame:
    """A seed's ``source`` is its own URL unless already set."""
    src = F.col("source") if "source" in seeds.columns else F.lit(None).cast("string")
    return seeds.withColumn("source", F.coalesce(src, F.col(url_col)))


def annotate_links(links: DataFrame, parents: DataFrame, parent_key: str = "page_id") -> DataFrame:
    """A discovered request inherits the parent's hop path (or ''), ``via`` =
    parent URL, the parent's ``source`` when it has one, and hop ``L`` by default.

    ``links`` carries (parent_key, url, hop?, source?); ``parents`` carries
    (parent_key, url, hop_path?, source?). Join on the parent key.
    """
    p = parents.select(F.col(parent_key),
                       F.col("url").alias("_purl"),
                       (F.col("hop_path") if "hop_path" in parents.columns else F.lit(None).cast("string"))
                       .alias("_php"),
                       (F.col("source") if "source" in parents.columns else F.lit(None).cast("string"))
                       .alias("_psrc"))
    own_hop = F.col("hop") if "hop" in links.columns else F.lit(None).cast("string")
    own_src = F.col("source") if "source" in links.columns else F.lit(None).cast("string")
    keep = [c for c in links.columns if c not in ("hop", "source", "hop_path", "via")]
    return links.join(p, parent_key).select(
        *keep, F.coalesce(F.col("_php"), F.lit("")).alias("hop_path"),
        F.coalesce(own_hop, F.lit("L")).alias("hop"), F.col("_purl").alias("via"),
        F.coalesce(F.col("_psrc"), own_src).alias("source"))


def hop_step(hop_path, hop, redirect_urls, via) -> tuple[Column, Column]:
    """T12 as expressions: (new hop_path, new via)."""
    hp, h, r, v = col_of(hop_path), col_of(hop), col_of(redirect_urls), col_of(via)
    redirected = r.isNotNull() & (F.size(r) > 0)
    new_hp = (F.when(hp.isNull(), F.lit(""))
              .when(redirected, F.concat(hp, F.lit("R")))
              .otherwise(F.concat(hp, F.coalesce(h, F.lit("L")))))
    new_via = F.when(hp.isNotNull() & redirected, F.element_at(r, 1)).otherwise(v)
    return new_hp, new_via


def extend_hop_path(df: DataFrame) -> DataFrame:
    """One hop step per request when its response arrives."""
    redirects = F.col("redirect_urls") if "redirect_urls" in df.columns else F.lit(None).cast("array<string>")
    hop = F.col("hop") if "hop" in df.columns else F.lit(None).cast("string")
    via = F.col("via") if "via" in df.columns else F.lit(None).cast("string")
    hp, v = hop_step(F.col("hop_path"), hop, redirects, via)
    return df.withColumn("hop_path", hp).withColumn("via", v)


def discover(pages: DataFrame, links: DataFrame, id_col: str = "page_id", uris=None) -> DataFrame:
    """Implied (well-known) then extracted requests of each page, annotated.

    ``links`` is the output of ``extract_links``/``resolve_links``. Output
    (page_id, ord, url, hop, hop_path, via, source); ``ord`` puts the implied
    URLs first.
    """
    n = len(DEFAULT_WELL_KNOWN_URIS if uris is None else uris)
    wk = expand_well_known(pages, uris, keep=[id_col]).select(id_col, "ord", "url", "hop")
    ex = links.select(F.col(id_col), (F.col("pos") + n).alias("ord"), F.col("target_url").alias("url"),
                      F.lit(None).cast("string").alias("hop"))
    keep_parent = [c for c in (id_col, "url", "hop_path", "source") if c in pages.columns]
    return annotate_links(wk.unionByName(ex), pages.select(*keep_parent), id_col) \
        .select(id_col, "ord", "url", "hop", "hop_path", "via", "source")


def limit_hop_path(df: DataFrame, max_len: int, hop_col: str = "hop_path") -> DataFrame:
    """Drop requests whose discovery path is longer than ``max_len`` hops."""
    return df.where(F.length(F.col(hop_col)) <= max_len)


HUB_EDGES = 100_000  # edges of one parent per salted part


def discovery_paths(spark: SparkSession, seeds: DataFrame, edges: DataFrame, max_hops: int | None = None,
                    carry=(), hub_edges: int = HUB_EDGES) -> DataFrame:
    """Discovery path of every URL reachable from the seeds (``max_hops`` levels only, if given).

    Breadth-first, one join per hop: frontier x edges, first arrival per child
    by (hop_path, via, seed) through a group-by whose partial aggregate runs
    map-side, minus everything already reached. Edges and paths are tables
    bucketed by URL, so a hop shuffles the frontier and its children only. The edges of a parent with more than ``hub_edges`` of them are cut
    into salted parts in different buckets, and only its own frontier row is
    repeated for each. Every level is a partition of the paths table under the
    shared checkpoint folder, so lineage stays one hop deep; its row count comes
    with the write.

    seeds: (url[, source, *carry]); edges: (parent_url, child_url, hop).
    Output: (url, depth, hop_path, via, seed, *carry). Of one URL's equal
    arrivals any one's carried columns stay.
    """
    root = scratch_path(spark, "paths")
    carry = list(carry)
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffix = root.rstrip("/").rsplit("-", 1)[-1]
    edge_table, path_table = f"crawlframe_edges_{suffix}", f"crawlframe_paths_{suffix}"

    def persist(df: DataFrame, depth: int) -> tuple[DataFrame, int]:
        rows = Observation()
        (df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("depth").bucketBy(n_buckets, "url")
         .option("path", f"{root}/paths").saveAsTable(path_table))
        return spark.table(path_table).where(F.col("depth") == depth).select(*df.columns), rows.get["n"]

    src = F.col("source") if "source" in seeds.columns else F.lit(None).cast("string")
    level = (seeds.select(F.col("url"), F.coalesce(src, F.col("url")).alias("seed"), *carry)
             .groupBy("url").agg(F.min_by(F.struct("seed", *carry), "seed").alias("_s"))
             .select("url", F.lit(0).alias("depth"), F.lit("").alias("hop_path"),
                     F.lit(None).cast("string").alias("via"), F.col("_s.seed").alias("seed"),
                     *[F.col(f"_s.{c}").alias(c) for c in carry]))
    e = edges.select(F.col("parent_url").alias("url"), "child_url", F.coalesce("hop", F.lit("L")).alias("hop"))
    try:
        level, rows = persist(level, 0)
        hubs = e.groupBy("url").count().where(F.col("count") > hub_edges) \
            .select("url", F.ceil(F.col("count") / hub_edges).cast("int").alias("_parts"))
        found = Observation()
        hubs.observe(found, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/hubs")
        hubs = spark.read.schema("url string, _parts int").parquet(f"{root}/hubs")
        salt = F.pmod(F.xxhash64("child_url"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_salt")
        e.join(hubs, "url", "left").select("url", salt, "child_url", "hop").write.mode("overwrite") \
            .bucketBy(n_buckets, "url", "_salt").sortBy("url").option("path", f"{root}/edges").saveAsTable(edge_table)
        e = spark.table(edge_table)
        depth = 0
        while rows and (max_hops is None or depth < max_hops):
            depth += 1
            if found.get["n"]:
                parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt")
                front = level.join(hubs, "url", "left").select(*level.columns, parts)
            else:  # every edge has salt 0
                front = level.withColumn("_salt", F.lit(0))
            cand = front.join(e, ["url", "_salt"]).select(
                F.col("child_url").alias("url"),
                F.struct(F.concat("hop_path", "hop").alias("hop_path"), F.col("url").alias("via"),
                         "seed", *carry).alias("_c"))
            nxt = (cand.groupBy("url").agg(F.min_by("_c", F.struct("_c.hop_path", "_c.via", "_c.seed")).alias("_c"))
                   .join(spark.table(path_table).select("url"), "url", "left_anti")
                   .select("url", F.lit(depth).alias("depth"), "_c.hop_path", "_c.via", "_c.seed",
                           *[F.col(f"_c.{c}").alias(c) for c in carry]))
            level, rows = persist(nxt, depth)
    finally:  # the result reads the files; both tables leave the catalog
        for name in (edge_table, path_table):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.parquet(f"{root}/paths").select(*level.columns)
