"""Capture-store jobs (stretch items named in the prose): capture lookup on or
after a date (X1), SURT prefix scope (X2), digest de-duplication (X3), the
capture index (X4), per-host quotas (X5) and the domain scan report (X8).

Ordered scans per key (X1, X5) are split into range slices of (key, time):
a key holding a third of all rows spans many slices and tasks, and only a
small per-(key, slice) summary is scanned per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import col_of
from ..functions.urls import url_host
from ..session import scratch_path

HEAD = 8
SURT_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)"


def surt_host(host) -> "F.Column":
    """Reversed host labels, comma-joined, ``www.`` dropped: www.a.b.com -> com,b,a."""
    h = F.regexp_replace(F.lower(col_of(host)), r"^www\d*\.", "")
    return F.array_join(F.reverse(F.split(h, r"\.")), ",")


def surt_key(url) -> "F.Column":
    """X4 URL key: ``com,example)/path?query`` (lower-cased, no scheme, no fragment)."""
    rest = F.lower(F.regexp_extract(col_of(url), SURT_PATH_RE, 1))
    return F.concat(surt_host(url_host(url)), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def capture_index(captures: DataFrame, n_parts: int | None = None, url_col: str = "url",
                  ts_col: str = "ts") -> DataFrame:
    """Captures keyed and range-partitioned by (urlkey, ts), sorted within
    each partition: files written from it form one globally sorted index."""
    df = captures.withColumn("urlkey", surt_key(F.col(url_col)))
    df = df.repartitionByRange(n_parts, "urlkey", ts_col) if n_parts else df.repartitionByRange("urlkey", ts_col)
    return df.sortWithinPartitions("urlkey", ts_col)


BLOCK_ROWS = 4096


def write_capture_index(captures: DataFrame, path: str, n_parts: int | None = None, url_col: str = "url", ts_col: str = "ts",
                        block_rows: int = BLOCK_ROWS) -> None:
    """X4 stored: the sorted files, and beside them a sparse index with one row per block of ``block_rows`` captures
    (first and last key, file, place), itself sorted by key."""
    capture_index(captures, n_parts, url_col, ts_col).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/files")
    rows = captures.sparkSession.read.parquet(f"{path}/files").select(
        "urlkey", F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / block_rows).alias("block"))
    blocks = rows.groupBy("file", "block").agg(F.min("urlkey").alias("first_key"), F.max("urlkey").alias("last_key"), F.count("*").alias("n"))
    blocks.repartitionByRange("first_key").sortWithinPartitions("first_key").write.mode("overwrite").parquet(f"{path}/blocks")


def lookup_captures(spark: SparkSession, path: str, key: str | None = None, prefix: str | None = None) -> DataFrame:
    """All captures of one key, or of all keys that begin with a prefix, from a stored index.

    The block index names the files that may hold them; only those are read, and in them only row groups whose key
    range fits.
    """
    if (key is None) == (prefix is None):
        raise ValueError("give a key or a prefix")
    low = prefix if key is None else key
    begins = F.col("first_key").startswith(low) if key is None else F.lit(False)
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("last_key") >= low) & ((F.col("first_key") <= low) | begins))
    files = sorted(r[0] for r in blocks.select("file").distinct().collect())
    if not files:
        return spark.createDataFrame([], spark.read.parquet(f"{path}/files").schema)
    found = spark.read.parquet(*files)
    return found.where(F.col("urlkey") == key) if key is not None else found.where(F.col("urlkey").startswith(prefix))


def scope_filter(urls: DataFrame, prefixes: DataFrame, url_col: str = "url", prefix_col: str = "prefix"):
    """Split URLs into (in_scope, out_of_scope) by SURT-prefix match.

    Plain string-prefix semantics, made an equi-join: each URL key offers its
    prefixes at the lengths of those scope prefixes that begin like it (in
    their first ``HEAD`` characters), and these are joined with the prefix
    table. Null prefixes match nothing, the empty one everything.
    """
    keyed = urls.withColumn("_k", surt_key(F.col(url_col)))
    lengths = prefixes.where(F.col(prefix_col).isNotNull()).groupBy(F.substr(prefix_col, F.lit(1), F.lit(HEAD)).alias("_head")) \
        .agg(F.collect_set(F.length(prefix_col)).alias("_lengths"))
    heads = F.array_distinct(F.array(*[F.substr(F.col("_k"), F.lit(1), F.lit(n)) for n in range(HEAD + 1)]))
    cands = keyed.select("_k").distinct().select("_k", F.explode(heads).alias("_head")).join(lengths, "_head") \
        .select("_k", F.explode("_lengths").alias("_n")).where(F.length("_k") >= F.col("_n")) \
        .select("_k", F.substr("_k", F.lit(1), F.col("_n")).alias("_p"))
    p = prefixes.select(F.col(prefix_col).alias("_p")).distinct()
    hit_keys = cands.join(p, "_p", "left_semi").select("_k").distinct()
    ins = keyed.join(hit_keys, "_k", "left_semi").drop("_k")
    outs = keyed.join(hit_keys, "_k", "left_anti").drop("_k")
    return ins, outs


def dedupe_digests(captures: DataFrame, key_cols=("url", "digest"), order_cols=("ts", "capture_id")) -> DataFrame:
    """The first capture of each (url, digest) is the original; later ones
    are revisits pointing at it. A per-key min (partial aggregate), written as a
    table and joined back: with a plain scan on that side Spark can split a hot
    key's captures over many tasks."""
    keys = list(key_cols)
    path = scratch_path(captures.sparkSession, "first-captures")
    captures.groupBy(*keys).agg(F.min(F.struct(*order_cols)).alias("_first")).write.parquet(path)
    first = captures.sparkSession.read.parquet(path)
    j = captures.join(first, keys)
    is_rev = F.struct(*order_cols) != F.col("_first")
    return j.select(*captures.columns, is_rev.alias("is_revisit"),
                    F.col(f"_first.{order_cols[-1]}").alias(f"original_{order_cols[-1]}")).drop("_first")


def range_slices(df: DataFrame, order_cols: list, n_parts: int | None = None) -> DataFrame:
    """Cut ``df`` into contiguous slices of the (key, order...) sequence.

    ``repartitionByRange`` samples the keys, so one key holding a third of
    the rows is spread over many slices; ``_b`` is the slice number, which
    grows along the order (AQE only ever merges neighbouring slices).

    The range bounds come from a sample seeded per exchange, so two plan
    branches re-deriving the slices could cut differently. The slices are
    therefore computed once and written as a table under the shared
    checkpoint folder; every branch (and every retry) reads the same ids.
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "slices")
    df.repartitionByRange(n, *order_cols).withColumn("_b", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def capture_lookup(requests: DataFrame, captures: DataFrame, key: str = "key", asked: str = "asked",
                   ts: str = "ts", cid: str = "capture_id", n_parts: int | None = None) -> DataFrame:
    """For each (key, asked) the first capture at or after ``asked``; none -> 'fetch'.

    Requests and captures are cut into range slices of (key, time). Inside a
    slice: a running window per (key, slice), latest first. Beyond it: the first
    capture of each (key, slice), scanned per key from the last slice on -- that
    summary has at most one row per slice, so no window ever holds a whole hot
    key and no request is paired with every capture of its key.
    """
    caps = captures.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(cid).alias("_cid"))
    reqs = requests.select(F.col(key).alias("_key"), F.col(asked).alias("_ts"), *[
        F.col(c) for c in requests.columns if c not in (key, asked)])
    extra = [c for c in requests.columns if c not in (key, asked)]
    # captures of the same instant follow each other by id
    cap_rows = caps.select("_key", "_ts", F.lit(1).alias("_kind"), "_cid", F.struct(F.col("_ts").alias("ts"),
                                                                            F.col("_cid").alias("id")).alias("_cap"),
                           *[F.lit(None).alias(c) for c in extra])
    req_rows = reqs.select("_key", "_ts", F.lit(0).alias("_kind"), F.lit(None).cast(cap_rows.schema["_cid"].dataType).alias("_cid"), F.lit(None).cast(cap_rows.schema["_cap"].dataType)
                           .alias("_cap"), *extra)
    u = range_slices(cap_rows.unionByName(req_rows), ["_key", "_ts", "_kind", "_cid"], n_parts)
    # latest first, the last capture so far is the next one in time: a running frame, while one that ends at the last
    # row is aggregated anew for every row. Requests come after captures of the same instant: "on or after" includes it
    w_same = Window.partitionBy("_key", "_b").orderBy(*[F.col(c).desc() for c in ("_ts", "_kind", "_cid")]).rowsBetween(Window.unboundedPreceding, 0)
    same = u.withColumn("_hit", F.last("_cap", ignorenulls=True).over(w_same)).where(F.col("_kind") == 0)
    firsts = u.where(F.col("_kind") == 1).groupBy("_key", "_b").agg(F.min("_cap").alias("_first"))
    req_b = same.select("_key", "_b").distinct().select("_key", "_b", F.lit(0).alias("_kind"),
                                                        F.lit(None).cast(firsts.schema["_first"].dataType).alias("_first"))
    ladder = firsts.select("_key", "_b", F.lit(1).alias("_kind"), "_first").unionByName(req_b)
    w_next = Window.partitionBy("_key").orderBy(F.col("_b").desc(), "_kind").rowsBetween(Window.unboundedPreceding, -1)
    nxt = ladder.withColumn("_next", F.last("_first", ignorenulls=True).over(w_next)).where(F.col("_kind") == 0) \
        .select("_key", "_b", "_next")
    j = same.join(nxt, ["_key", "_b"], "left")
    hit = F.coalesce(F.col("_hit"), F.col("_next"))
    return j.select(F.col("_key").alias(key), F.col("_ts").alias(asked), *extra,
                    hit["ts"].alias("capture_ts"), hit["id"].alias("capture_id"),
                    F.when(hit.isNull(), F.lit("fetch")).otherwise(F.lit("reuse")).alias("action"))


def quota_per_host(df: DataFrame, quota: int, host_col: str = "host", size_col: str = "content_length",
                   ts_col: str = "ts", tie_col: str = "id", n_parts: int | None = None) -> DataFrame:
    """Rows of each host while its running byte total stays within ``quota``.

    A distributed prefix sum: rows are cut into range slices of (host, time);
    running total = bytes of the host's earlier slices (a per-(host, slice)
    sum, scanned per host: at most one row per slice) + the running sum inside
    the (host, slice) window. A hot host spans many slices and many tasks.
    """
    d = range_slices(df, [host_col, ts_col, tie_col], n_parts)
    tot = d.groupBy(host_col, "_b").agg(F.sum(size_col).alias("_t"))
    w_prev = Window.partitionBy(host_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = tot.withColumn("_before", F.coalesce(F.sum("_t").over(w_prev), F.lit(0))).drop("_t")
    w_in = Window.partitionBy(host_col, "_b").orderBy(ts_col, tie_col).rowsBetween(Window.unboundedPreceding, 0)
    run = d.join(before, [host_col, "_b"]).withColumn("running_bytes",
                                                      (F.col("_before") + F.sum(size_col).over(w_in)).cast("bigint"))
    return run.where(F.col("running_bytes") <= quota).drop("_b", "_before")


def domain_scan_report(log: DataFrame, well_known=None, url_col: str = "url", status_col: str = "status_code"):
    """Per host, is it serving pages, and which well-known URIs answered 200."""
    from .discovery import DEFAULT_WELL_KNOWN_URIS
    wk = list(DEFAULT_WELL_KNOWN_URIS if well_known is None else well_known)
    path = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    ok = F.col(status_col) == 200
    return log.groupBy(url_host(F.col(url_col)).alias("host")).agg(
        F.bool_or(ok).alias("serving"),
        F.count_if(ok).alias("n_ok"),
        F.count(F.lit(1)).alias("n_fetched"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok & path.isin(wk), path))), ",").alias("well_known"))
