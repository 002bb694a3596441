"""MinHash near-dedup (5) by fast similarity sketching, banding and exact verification.

Sketch: ``COORDS`` bins; in round i every shingle is thrown into a bin chosen by
that round's hash, and a bin keeps the least value of the first round that hits
it; rounds ``COORDS`` to ``2 * COORDS - 1`` throw all shingles into one bin each,
so every coordinate fills whatever the set's size, and values of equal bins
agree with the Jaccard similarity as probability, with Chernoff-like bounds.

Bands of ``ROWS`` coordinates make buckets. With 32 bands of 4, a pair at
similarity 0.8 shares no bucket with probability 5e-8.

1. Documents with equal sets are one class (an aggregate by a 128-bit digest).
2. In each bucket of classes, every member is compared with two centres; the
   confirmed links give first components.
3. In buckets that still hold several components, the members outside the
   largest one are compared with all members of other components, in blocks of
   bounded size (members outside x all members), each pair in the first bucket
   that it shares. A block returns one link per member and component at most.

Pairs are ruled out before the exact test only by set sizes, or by more
differing bits of a 128-bit sketch than a pair at the threshold has but once in
1e7 times. All links are confirmed on the full sets. Links inside a component
that is already connected need no test, as only components are returned.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm import text
from crawlframe.llm.components import _written, connected_components

COORDS, ROWS = 128, 4
REST_ITEMS, ALL_ITEMS = 1 << 17, 1 << 19  # shingles in the two sides of a block, about
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the ascending distinct 64-bit hashes of its ``size``-word shingles (A-Z lower-cased).

    A text of fewer words has its whole sequence as one shingle; one without words, or null, the empty set.
    """
    row, code, words = text.tokens(texts)
    word = text.hash_words(words)[code]
    count = np.bincount(row, minlength=len(texts))
    start = np.cumsum(count) - count
    rows, hashes = [], []

    def chain(first: np.ndarray, n: int) -> np.ndarray:
        h = text.mix(word[first], n)
        for j in range(1, n):
            with np.errstate(over="ignore"):
                h = text.mix(h + word[first + j], n)
        return h

    full = np.flatnonzero(row[: max(0, len(row) - size + 1)] == row[size - 1:])
    rows.append(row[full])
    hashes.append(chain(full, size))
    for n in range(1, size):
        few = np.flatnonzero(count == n)
        if len(few):
            rows.append(few)
            hashes.append(chain(start[few], n))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(rows, kind="stable")
    rows, hashes = rows[order], hashes[order]
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketches (sets x coords, uint64); rows of empty sets stay at the largest value."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full(len(sets) * coords, _FULL)
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * coords):
        if len(items) == 0:
            break
        h = text.mix(items, 1000 + i)
        bin_ = (h >> np.uint64(40)).astype(np.int64) % coords if i < coords else np.full(len(h), i - coords)
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(out, owner * coords + bin_, value)
        open_ = (out.reshape(-1, coords) == _FULL).any(axis=1)
        keep = open_[owner]
        if not keep.all():
            items, owner = items[keep], owner[keep]
    return out.reshape(-1, coords)


_FEATURES = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits0", T.LongType()),
    T.StructField("bits1", T.LongType())])


def features(column: str, size: int) -> Column:
    """Per text: size of its shingle set, the set's digest, band keys (none if empty) and 128 one-bit coordinates."""

    @F.arrow_udf(_FEATURES)
    def run(texts: pa.Array) -> pa.Array:
        n, cls, bands, bits = [], [], [], []
        for part in text.slices(pa.record_batch([text.plain(texts)], names=["t"]), "t"):
            sets = shingle_sets(part.column(0), size)
            sk = sketches(sets)
            key = text.mix(sk[:, 0::ROWS], 1)
            for j in range(1, ROWS):
                with np.errstate(over="ignore"):
                    key = text.mix(key + sk[:, j::ROWS], j + 1)
            with np.errstate(over="ignore"):
                key = text.mix(key + np.arange(key.shape[1], dtype=np.uint64)[None, :], 99)
            packed = np.packbits((text.mix(sk, 77) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            n += [len(s) for s in sets]
            cls += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bands += [k if f else [] for k, f in zip(key.view(np.int64), full)]
            bits.append(packed)
        bits = np.concatenate(bits) if bits else np.zeros((0, 2), dtype=np.int64)
        text.release()
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
             pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=[f.name for f in _FEATURES])

    return run(F.col(column))


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two packed ascending sets."""
    return pa.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64),
                                        assume_unique=True)) for x, y in zip(a, b)], pa.int64())


def packed_sets(column: str, size: int) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in text.slices(pa.record_batch([text.plain(texts)], names=["t"]), "t"):
            out += [s.tobytes() for s in shingle_sets(part.column(0), size)]
        packed = pa.array(out, pa.binary())
        del out
        text.release()
        return packed

    return run(F.col(column))


def _most_differing_bits(percent: int) -> int:
    """Bits of 128 that a pair at the threshold exceeds with probability below 1e-7 (binomial tail)."""
    p = (1 - percent / 100) / 2
    tail, k = 1.0, -1
    while tail > 1e-7:
        k += 1
        tail -= math.comb(COORDS, k) * p**k * (1 - p) ** (COORDS - k)
    return k


def _plausible(percent: int) -> Column:
    """Rules out pairs whose sizes or sketch bits cannot belong to a link."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    bits = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    return sizes & (bits <= _most_differing_bits(percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("s_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("s_b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", _common("s_a", "s_b"))
    union = (F.octet_length("s_a") + F.octet_length("s_b")) / 8 - F.col("common")
    return joined.where(F.col("common") * 100 >= union * percent).select("a", "b")


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``first`` and are ``size`` long, one after the other."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _block_links(percent: int):
    """Exact comparison of a block's members outside the largest component with its other members."""
    worst = _most_differing_bits(percent)

    def links(block: pa.Table) -> pa.Table:
        rest = block["rest"].to_numpy()
        cls, comp = (np.array(block[c].to_pylist(), dtype=object) for c in ("cls", "comp"))
        bits = np.stack([block["x0"].to_numpy(), block["x1"].to_numpy()], axis=1)
        bands = np.array(block["bands"].to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in block["items"].to_pylist()]
        key = block["key"][0].as_py()
        band = int(np.flatnonzero(bands[0] == key)[0])  # pairs that share an earlier band are compared there
        size = np.array([len(x) for x in sets])
        in_top = block["in_top"].to_numpy()
        others = np.flatnonzero(~rest)
        pool = np.concatenate([sets[i] for i in others]) if len(others) else np.zeros(0, np.uint64)
        first = np.cumsum(size[others]) - size[others]
        found_a, found_b = [], []
        for r in np.flatnonzero(rest):
            n, m = size[r], size[others]
            ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
            ok &= np.bitwise_count((bits[others] ^ bits[r]).view(np.uint64)).sum(axis=1) <= worst
            ok &= ~(bands[others, :band] == bands[r, :band]).any(axis=1)
            ok &= comp[others] != comp[r]
            ok &= in_top[others] | (cls[others] < cls[r])  # two members outside the largest: once
            near = np.flatnonzero(ok)
            if len(near) == 0:
                continue
            items = pool[_ragged(first[near], m[near])]
            at = np.searchsorted(sets[r], items)
            hit = sets[r][np.minimum(at, n - 1)] == items
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(m[near]) - m[near])
            seen = set()
            for k in near[common * 100 >= (n + m[near] - common) * percent]:
                other = others[k]
                if comp[other] not in seen:
                    seen.add(comp[other])
                    found_a.append(max(cls[r], cls[other]))
                    found_b.append(min(cls[r], cls[other]))
        return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. ``component_id`` is the
    smallest id reachable by links, ``kept`` says whether that is the row's own. Null or wordless texts are linked with
    nothing. Null ids: such rows link by their text like others but are never the smallest while another id is in their
    component; among themselves all are kept. Rows that repeat an id and text get equal results; rows that repeat an id
    with other texts are documents of their own that share the id. Other columns are ignored.
    """
    text.bound_batches(docs.sparkSession)
    rows = _written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
                    .withColumn("f", features("t", shingle))
                    .select("doc_id", F.xxhash64("t").alias("text_key"), "f.*"), "neardup-rows")
    classes = _written(rows.where("n_shingles > 0").groupBy("cls").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bits0").alias("x0"),
        F.first("bits1").alias("x1"), F.first("bands").alias("bands"),
        F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key")), "neardup-classes")
    member = classes.select(F.explode("bands").alias("key"), "cls", "n", "x0", "x1")

    # two centres per bucket, each the least under one of two orders of the classes
    def least_by(seed: int) -> Column:
        return F.min_by(F.struct(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("x0").alias("y0"),
                                 F.col("x1").alias("y1")), F.struct(F.xxhash64("cls", F.lit(seed)), "cls"))

    buckets = _written(member.groupBy("key").agg(F.count("*").alias("size"), least_by(1).alias("c1"), least_by(2).alias("c2"))
                       .where("size > 1").drop("size"), "neardup-buckets")
    member = _written(member.join(buckets, "key").withColumnRenamed("n", "n_a"), "neardup-members")
    first = (member.select("cls", "n_a", "x0", "x1", F.explode(F.array("c1", "c2")).alias("c"))
             .select(F.col("cls").alias("a"), "n_a", "x0", "x1", "c.*").where("a != b").where(_plausible(percent))
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # full sets of the classes that share a bucket, computed anew from one text of each: that of the smallest id, so the
    # other copies of a text are not shuffled
    chosen = member.select("cls").distinct().join(classes.select("cls", "text_key", "first_id"), "cls")
    texts = (docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("own_id")).withColumn("own_key", F.xxhash64("t"))
             .join(chosen, (F.col("own_key") == F.col("text_key")) & F.col("own_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["cls"]))
    sets = _written(texts.select("cls", packed_sets("t", shingle).alias("items")), "neardup-sets")
    links = _written(_confirmed(first, sets, percent), "neardup-links")
    label = connected_components(links, "neardup-first")

    placed = _written(member.select("key", "cls", "n_a", "x0", "x1").join(
        label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
        .drop("component"), "neardup-placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n_a").alias("items"))
    largest = parts.groupBy("key").agg(F.max_by(F.struct("comp", "items"), F.struct("m", "comp")).alias("top"),
                                       F.sum("items").alias("items"), F.count("*").alias("parts"))
    # blocks per bucket: of members outside the largest component, and of all members
    largest = _written(largest.where("parts > 1").select(
        "key", F.col("top.comp").alias("top"), F.ceil((F.col("items") - F.col("top.items")) / REST_ITEMS).alias("rest_blocks"),
        F.ceil(F.col("items") / ALL_ITEMS).alias("all_blocks")), "neardup-largest")
    full = classes.select("cls", "bands").join(sets, "cls")
    open_ = _written(placed.join(largest, "key"), "neardup-open").join(full, "cls")
    all_of = F.pmod(F.xxhash64("cls", F.lit(3)), "all_blocks")
    rest_of = F.pmod(F.xxhash64("cls", F.lit(5)), "rest_blocks")

    def dealt(rows: DataFrame, rest: bool) -> DataFrame:
        """One copy of each row for every block of the other side."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks" if rest else "rest_blocks") - 1))
        rows = rows.withColumn("other", other).withColumns(
            {"rest_block": rest_of, "all_block": F.col("other")} if rest else {"rest_block": F.col("other"), "all_block": all_of})
        return rows.select("key", "rest_block", "all_block", F.lit(rest).alias("rest"), (F.col("comp") == F.col("top")).alias("in_top"),
                           "cls", "comp", "x0", "x1", "bands", "items")

    blocks = dealt(open_.where("comp != top"), True).union(dealt(open_, False))
    more = _written(blocks.groupBy("key", "rest_block", "all_block").applyInArrow(_block_links(percent), "a binary, b binary"), "neardup-more")
    # the first components stand for their links
    label = connected_components(more.union(label.select(F.col("node").alias("a"), F.col("component").alias("b"))), "neardup-all")

    # smallest id of each component; then the few classes that changed are joined back to the rows
    placed = classes.select("cls", "first_id").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cls"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = _written(placed.join(least, "component").select("cls", "component_id"), "neardup-found")
    out = rows.select("doc_id", "text_key", "n_shingles", "cls").join(found, "cls", "left")
    return (out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "text_key", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def oracle_sql(percent: int = 80) -> str:
    """Components over two-word shingles of ``documents`` in DuckDB, by all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
                                 ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sn a JOIN sn b
        ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""
