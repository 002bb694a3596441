"""Cross-tokenizer alignment (13): which tokens of two tokenizers cover the same bytes, and how often corpus-wide.

Tokenizer A is a byte-level BPE, B a SentencePiece model; both encode a space and the text. The byte offsets at which
tokens of both end cut a text into groups; an A and a B token whose byte ranges overlap are linked.

The counting is external, in three passes over tables in the shared checkpoint folder:

1. Every task aligns its texts and keeps (pair, document, links) records. When ``run_links`` links have come together,
   they are sorted side-major (by B id, then A id) and spilled as one zstd run: the run's pairs with their counts, cut
   into radix partitions of the B id, and the run's records, which stay with the run.
2. The segments of a radix partition are merged by a heap, ``FAN`` at a time in levels, and equal pairs added up. As
   the order is side-major, all pairs of a B id stand together, which gives its largest count.
3. Each partition's totals stream past the segments again: every segment gets the counts of its pairs back, and each
   run turns its records and these counts into the sums of its documents, all of which it holds whole.

A pair is one entry per run, however many documents it occurs in, so no pair or B id can be hot; the records themselves
are read once, by run. A task holds one run, or the distinct pairs of a radix partition and ``FAN`` segments.

Texts are cut before each space that stands alone: neither tokenizer has tokens across it, so words are encoded and
aligned once while a task remembers them. Texts with runs of white space at a word's start are encoded whole.

Defined results: a text that is null or empty, or whose joined A or B bytes differ from space and text (it holds a
literal U+2581, or characters that a model without byte pieces doesn't know), has no tokens: zeros and an empty
``groups_sha256``, also in rows with a null id. Rows that repeat an id are counted each. Links of a B id whose count
equals the largest of that B id are best, ties included. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm import text
from crawlframe.llm.components import _written

RUN_LINKS = 6_000_000  # links of a run; bounds a task's memory only
RUN_DOCS = 100_000
CHUNK = 1 << 20  # records in one row of a run
FAN = 64  # segments merged at once
BLOCK = 1 << 16
CACHED_UNITS, CACHED_LINKS = 400_000, 4_000_000  # bound memory only
MARK = "▁"
# the characters with the White_Space property
_STARTS_WITH_SPACE = r"^[\t-\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^$"


def default_paths() -> tuple[str, str]:
    """Paths of the installed public byte-level BPE and SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Pair:
    """Both tokenizers, the bytes of their tokens, and a store of aligned units."""

    def __init__(self, a_json: bytes, b_model: bytes, radix: int):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        spec = json.loads(a_json)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or not spec["pre_tokenizer"].get("use_regex"):
            raise ValueError("tokenizer A must be a byte-level BPE without normalizer")
        bytes_of = byte_alphabet()
        self.a_bytes = {i: bytes(bytes_of.get(c, 0) for c in t) for t, i in spec["model"]["vocab"].items()}
        b = self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                        b"" if b.is_control(i) or b.is_unknown(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(len(b))]
        pieces = [b.id_to_piece(i) for i in range(len(b)) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        self.by_words = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_bits = max(self.a_bytes).bit_length()
        a_table = [self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)]
        self.a_table, self.b_table = pa.array(a_table, pa.large_binary()), pa.array(self.b_bytes, pa.large_binary())
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (a_table, self.b_bytes))
        self.signs = pa.array([f"{i}{sign}" for n, signs in ((len(a_table), ",|"), (len(self.b_bytes), ",;")) for sign in signs for i in range(n)], pa.large_string())
        self.radix, self.per_radix = radix, -(-len(b) // radix)
        if self.a_bits + (radix * self.per_radix).bit_length() + RUN_DOCS.bit_length() > 63:
            raise ValueError("the vocabularies are too large")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.links, self.facts, self.groups = array("q"), array("q"), []

    def key(self, a, b):
        """Order of a pair: radix partition of the B id, B id, A id."""
        return ((b % self.radix) * self.per_radix + b // self.radix) << self.a_bits | a

    def first_key(self, radix: int) -> int:
        return (radix * self.per_radix) << self.a_bits

    def encode_a(self, short: list[str], long: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, their number per unit) of a space and each unit; short units share calls."""
        ids, counts = [], []
        for at in range(0, len(short), 1000):
            part = [" " + u for u in short[at:at + 1000]]
            own = np.array(self.a.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            stop = np.cumsum(self.a_len[own])
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy(zero_copy_only=False).astype(np.int64))
            last = np.searchsorted(stop, ends)
            if len(stop) and (last < len(stop)).all() and (stop[last] == ends).all():
                ids.append(own)
                counts.append(np.diff(last, prepend=-1))
            else:  # a token across a space: not a tokenizer whose words can share a call
                long_first = [self.a.encode_batch_fast([u], add_special_tokens=False)[0].ids for u in part]
                ids += [np.array(x, dtype=np.int64) for x in long_first]
                counts.append(np.array([len(x) for x in long_first]))
        for u in long:
            ids.append(np.array(self.a.encode_batch_fast([" " + u], add_special_tokens=False)[0].ids, dtype=np.int64))
            counts.append(np.array([len(ids[-1])]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(ids or none), np.concatenate(counts or none)

    def add(self, units: list[str]) -> None:
        """Encode and align units that are not in the store.

        All units lie one after the other on one axis of bytes. Between two neighbouring token ends, of whichever side,
        lies exactly one pair of overlapping tokens: one link. Groups end where tokens of both sides do.
        """
        short = [u for u in units if u and " " not in u and len(u) < 200 and not u[0].isspace()]
        chosen = set(short)
        long = [u for u in units if u not in chosen]
        units = short + long
        if not units:
            return
        for k, u in enumerate(units, len(self.groups)):
            self.number[u] = k
        a, n_a = self.encode_a(short, long)
        b_lists = self.b.encode(units, num_threads=1)
        n_b = np.fromiter(map(len, b_lists), dtype=np.int64, count=len(units))
        b = np.fromiter(chain.from_iterable(b_lists), dtype=np.int64, count=int(n_b.sum()))
        whole = pa.array([" " + u for u in units], pa.large_string())
        size = pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
        own_a, own_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        ok = (size > 1) & (np.bincount(own_a, self.a_len[a], len(units)) == size) & (np.bincount(own_b, self.b_len[b], len(units)) == size)
        bytes_of = _bytes(whole.filter(pa.array(ok)))
        unit_ends = np.cumsum(size[ok])
        for ids, own, table in ((a, own_a, self.a_table), (b, own_b, self.b_table)):  # all of equal length: do they hold the same bytes?
            off = np.flatnonzero(_bytes(table.take(pa.array(ids[ok[own]]))) != bytes_of)
            bad = np.flatnonzero(ok)[np.unique(np.searchsorted(unit_ends, off, "right"))]
            if len(bad):
                keep = np.ones(len(units), dtype=bool)
                keep[bad] = False
                bytes_of = bytes_of[np.repeat(keep[ok], size[ok])]
                ok &= keep
                unit_ends = np.cumsum(size[ok])
        n_a, n_b = n_a * ok, n_b * ok
        a, b = a[ok[own_a]], b[ok[own_b]]
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends, shared = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        keys = self.key(a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)])
        place = np.flatnonzero(ok)
        n_links = np.bincount(place[np.searchsorted(unit_ends, ends)], minlength=len(units))
        n_groups = np.bincount(place[np.searchsorted(unit_ends, shared)], minlength=len(units))
        self.links.frombytes(keys.astype(np.int64).tobytes())
        self.facts.frombytes(np.stack([ok, n_a, n_b, n_groups, n_links], axis=1).astype(np.int64).tobytes())
        # the text of the groups: each side's ids with the sign that stands behind them
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        text_of = np.empty(len(a) + len(b), dtype=np.int64)
        ends_group = lambda g: np.r_[g[1:] != g[:-1], True][:len(g)]
        text_of[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + len(self.a_len) * ends_group(group_a)
        text_of[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * len(self.a_len) + len(self.b_len) * ends_group(group_b)
        strings = self.signs.take(pa.array(text_of))
        data = _bytes(strings).tobytes()
        stop = np.r_[0, np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64))][np.r_[0, np.cumsum(n_a + n_b)]].tolist()
        self.groups += [data[i:j] for i, j in zip(stop, stop[1:])]

    def units(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(row of each unit, distinct units, which of them each is): words, or whole texts where white space runs."""
        row, words = np.arange(len(texts)), texts
        if self.by_words:
            split = pc.split_pattern(texts, " ")
            row, words = pc.list_parent_indices(split).to_numpy(zero_copy_only=False), pc.list_flatten(split)
        coded = words.dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, _STARTS_WITH_SPACE).to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy(zero_copy_only=False)
        rows = np.unique(row[odd[code]]) if self.by_words else row[:0]
        if len(rows):
            keep = ~np.isin(row, rows)
            words = pa.concat_arrays([words.filter(pa.array(keep)), texts.take(pa.array(rows))])
            row = np.concatenate([row[keep], rows])
            order = np.argsort(row, kind="stable")
            row, coded = row[order], words.take(pa.array(order)).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
        return row, coded.dictionary, code

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[memoryview], list[str], np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_groups, n_links), its groups as text and their digest; (row, pair key) of all links."""
        texts = text.plain(texts)
        n = len(texts)
        row, units, code = self.units(texts)
        if len(self.groups) > CACHED_UNITS or len(self.links) > CACHED_LINKS:
            self._forget()
        units = units.to_pylist()
        self.add([u for u in units if u not in self.number])
        place = np.array([self.number[u] for u in units], dtype=np.int64)
        facts = np.array(self.facts, dtype=np.int64).reshape(-1, 5)
        unit = place[code] if len(code) else np.zeros(0, dtype=np.int64)
        whole = np.ones(n, dtype=bool)
        whole[row[facts[unit, 0] == 0]] = False
        keep = whole[row]
        row, unit, code = row[keep], unit[keep], code[keep]
        counts = np.stack([np.bincount(row, facts[unit, k], n) for k in range(1, 5)], axis=1).astype(np.int64)
        size = facts[unit, 4]
        first = (np.cumsum(facts[:, 4]) - facts[:, 4])[unit]
        end = np.cumsum(size)
        at = np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        keys = np.array(self.links, dtype=np.int64)[at]
        # the groups of a row's units stand one after the other, each with a ; behind it
        strings = pa.array([self.groups[k] for k in place.tolist()], pa.large_binary()).take(pa.array(code))
        length = np.bincount(row, pc.binary_length(strings).to_numpy(zero_copy_only=False), n).astype(np.int64)
        data, stop = memoryview(_bytes(strings)), np.cumsum(length).tolist()
        groups = [data[e - s:max(e - 1, e - s)] for e, s in zip(stop, length.tolist())]
        return counts, groups, [hashlib.sha256(g).hexdigest() if len(g) else "" for g in groups], np.repeat(row, size), keys


def _bytes(strings: pa.Array) -> np.ndarray:
    """The bytes of a large_string or large_binary array without nulls, one value after the other."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset:strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers as one zstd frame, each in the narrowest type."""
    parts = []
    for x in arrays:
        kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(t).max)
        parts += [np.array([int(kind[2]), len(x)], dtype="<u8").tobytes(), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, dtype="<u8", count=2, offset=at).tolist()
        out.append(np.frombuffer(raw, dtype=f"<u{width}", count=n, offset=at + 16).astype(np.int64))
        at += 16 + width * n
    return out


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


Run = tuple[np.ndarray, np.ndarray]  # distinct keys, ascending, and their counts


def merge(runs: list[Run]) -> Run:
    """One run of several: a heap holds each run's next key; a block of the least run is joined by all that others have of its range."""
    place, heap = [0] * len(runs), [(int(keys[0]), r) for r, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    out_keys, out_counts = [], []
    while heap:
        parts, cut = [], None
        while heap and (cut is None or heap[0][0] <= cut):
            _, r = heap[0]
            keys, counts = runs[r]
            first = place[r]
            end = min(first + BLOCK, len(keys)) if cut is None else first + int(np.searchsorted(keys[first:], cut, "right"))
            cut = int(keys[end - 1]) if cut is None else cut
            parts.append((keys[first:end], counts[first:end]))
            place[r] = end
            if end < len(keys):
                heapq.heapreplace(heap, (int(keys[end]), r))
            else:
                heapq.heappop(heap)
        if len(parts) == 1:
            keys, counts = parts[0]
        else:
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, counts = keys[start], np.add.reduceat(counts, start)
        out_keys.append(keys)
        out_counts.append(counts)
    if not out_keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_counts)


class Merger:
    """Adds up compressed segments, ``FAN`` at a time, in levels: few are held, and each entry is merged a few times."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.levels: list[list[Run]] = []

    def add(self, blob: bytes) -> None:
        self.waiting.append(blob)
        if len(self.waiting) == FAN:
            self._raise()

    def _raise(self) -> None:
        run, level = merge([_segment(b) for b in self.waiting]), 0
        self.waiting = []
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN:
                return
            run, self.levels[level] = merge(self.levels[level]), []
            level += 1

    def total(self) -> Run:
        return merge([*(r for level in self.levels for r in level), *map(_segment, self.waiting)])


def _segment(blob: bytes) -> Run:
    deltas, counts = unpack(blob)
    return np.cumsum(deltas), counts


def best_of(keys: np.ndarray, counts: np.ndarray, a_bits: int) -> np.ndarray:
    """Whether each pair's count is the largest of its B id (keys ascending, so a B id's pairs stand together)."""
    if not len(keys):
        return np.zeros(0, bool)
    b = keys >> a_bits
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return counts == np.repeat(np.maximum.reduceat(counts, start), np.diff(np.r_[start, len(b)]))


_COUNTED = ("n_a", "n_b", "n_groups", "n_links")
_built: dict[tuple, Pair] = {}


def _pair(shared) -> Pair:
    """The task process's tokenizers of a broadcast, one pair at a time."""
    if shared.value not in _built:
        _built.clear()
        _built[shared.value] = Pair(*shared.value)
    return _built[shared.value]


class _Run:
    """Collects links of whole documents until they fill a run."""

    def __init__(self, pair: Pair, number: int, most: int):
        self.pair, self.number, self.most = pair, number, most
        self.docs, self.links, self.n_docs, self.n_links = [], [], 0, 0

    def add(self, ids: pa.Array, counts, groups, digests, row, keys, with_groups: bool) -> None:
        self.docs.append((ids, counts, [str(g, "ascii") for g in groups] if with_groups else None, digests))
        self.links.append(keys << RUN_DOCS.bit_length() | (row + self.n_docs))
        self.n_docs += len(ids)
        self.n_links += len(keys)

    def full(self) -> bool:
        return self.n_links >= self.most or self.n_docs >= RUN_DOCS // 2

    def rows(self, schema: pa.Schema, with_groups: bool) -> Iterator[pa.RecordBatch]:
        """Segments by radix partition, then the documents, then the records."""
        pair, bits = self.pair, RUN_DOCS.bit_length()
        links = np.concatenate(self.links)
        self.links = []
        links.sort()
        start = np.flatnonzero(np.r_[True, links[1:] != links[:-1]]) if len(links) else np.zeros(0, np.int64)
        n = np.diff(np.r_[start, len(links)])
        links = links[start]
        keys, doc = links >> bits, links & ((1 << bits) - 1)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        pairs, per_pair = keys[first], np.diff(np.r_[first, len(keys)])
        counts = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        edges = np.searchsorted(pairs, [pair.first_key(r) for r in range(pair.radix + 1)])

        def row(place: int, blob: bytes | None = None, docs: dict | None = None) -> pa.RecordBatch:
            values = {"run": self.number, "place": place, "blob": blob, **(docs or {})}
            return pa.RecordBatch.from_pylist([{f.name: values.get(f.name) for f in schema}], schema)

        for r in range(pair.radix):
            own = slice(edges[r], edges[r + 1])
            if edges[r] < edges[r + 1]:
                yield row(r, pack(_deltas(pairs[own]), counts[own]))
        ids = pa.concat_arrays([d[0] for d in self.docs])
        numbers = np.concatenate([d[1] for d in self.docs])
        yield row(pair.radix, None, {
            "ids": ids.to_pylist(), **{c: numbers[:, k].tolist() for k, c in enumerate(_COUNTED)},
            "groups": [g for d in self.docs for g in d[2]] if with_groups else None, "digests": [x for d in self.docs for x in d[3]]})
        which = np.repeat(np.arange(len(pairs)), per_pair)
        for k, at in enumerate(range(0, len(doc), CHUNK)):
            part = slice(at, at + CHUNK)
            yield row(pair.radix + 1 + k, pack(_deltas(which[part]), doc[part], n[part]))


class Alignment:
    """The runs of a table of documents, and what is counted over all of them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
                 b_path: str | None = None, radix: int | None = None, with_groups: bool = False, run_links: int = RUN_LINKS):
        spark = self.spark = docs.sparkSession
        text.bound_batches(spark)
        own_a, own_b = default_paths() if a_path is None or b_path is None else (a_path, b_path)
        with open(a_path or own_a, "rb") as a, open(b_path or own_b, "rb") as b:
            files = a.read(), b.read()
        self.radix = radix or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.pair = Pair(*files, self.radix)
        self.id_type, self.with_groups = docs.schema[id_col].dataType, with_groups
        shared = text.share(spark, (*files, self.radix))
        longs = T.ArrayType(T.LongType())
        self.schema = T.StructType([
            T.StructField("run", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("blob", T.BinaryType()),
            T.StructField("ids", T.ArrayType(self.id_type)), *(T.StructField(c, longs) for c in _COUNTED),
            T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("digests", T.ArrayType(T.StringType()))])
        schema = _arrow(self.schema)

        def spill(batches):
            own, n = _pair(shared), 0
            number = lambda: TaskContext.get().partitionId() << 24 | n  # noqa: E731 - the same in a repeated attempt
            run = _Run(own, number(), run_links)
            for batch in batches:
                for part in text.slices(batch, "text"):
                    for k in range(0, part.num_rows, RUN_DOCS // 4):
                        rows = part.slice(k, RUN_DOCS // 4)
                        run.add(rows.column("id"), *own.align(rows.column("text")), with_groups)
                        if run.full():
                            yield from run.rows(schema, with_groups)
                            n += 1
                            run = _Run(own, number(), run_links)
                            text.release()
            if run.docs:
                yield from run.rows(schema, with_groups)
            own._forget()
            text.release()

        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.runs = _written(texts.mapInArrow(spill, self.schema), "tokenpairs-runs")
        self.id_col = id_col
        shared.unpersist()
        self.totals = _written(self._totals(), "tokenpairs-totals")

    def _by_radix(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.radix, "place").sortWithinPartitions("place", "run")

    def _segments(self) -> DataFrame:
        return self.runs.where(F.col("place") < self.radix).select("place", "run", "blob")

    def _totals(self) -> DataFrame:
        """(place, run -1, blob): of each radix partition its pairs, counts and whether each is its B id's largest."""
        bits = self.pair.a_bits

        def count(batches):
            merger, place = Merger(), None

            def done():
                keys, counts = merger.total()
                best = best_of(keys, counts, bits)
                return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "run": pa.array([-1], pa.int64()),
                                                   "blob": pa.array([pack(_deltas(keys), counts, best.astype(np.int64))], pa.binary())})

            for now, _, blob in _rows(batches, "place", "run", "blob"):
                if place is not None and now != place:
                    yield done()
                    merger = Merger()
                place = now
                merger.add(blob)
            if place is not None:
                yield done()
            text.release()

        return self._by_radix(self._segments()).mapInArrow(count, "place int, run long, blob binary")

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, n, best) of every linked pair of ids."""
        bits, radix, per_radix = self.pair.a_bits, self.radix, self.pair.per_radix

        def read(batches):
            for (blob,) in _rows(batches, "blob"):
                deltas, counts, best = unpack(blob)
                keys = np.cumsum(deltas)
                b = keys >> bits
                a, b = keys & ((1 << bits) - 1), b % per_radix * radix + b // per_radix
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, counts, best.astype(bool))], names=["a_id", "b_id", "n", "best"])

        return self.totals.select("blob").mapInArrow(read, "a_id long, b_id long, n long, best boolean")

    def documents(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups) of every row."""
        radix, with_groups = self.radix, self.with_groups

        def answer(batches):
            totals = None
            for place, run, blob in _rows(batches, "place", "run", "blob"):
                deltas, counts, *best = unpack(blob)
                if run < 0:  # first of its place
                    totals = np.cumsum(deltas), counts, best[0]
                    continue
                at = np.searchsorted(totals[0], np.cumsum(deltas))
                yield pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int64()), "place": pa.array([place], pa.int32()),
                                                  "blob": pa.array([pack(totals[1][at], totals[2][at])], pa.binary())})
            text.release()

        answers = self._by_radix(self.totals.unionByName(self._segments())).mapInArrow(answer, "run long, place int, blob binary")
        runs = self.runs.where(F.col("place") >= radix).unionByName(answers, allowMissingColumns=True)
        out = T.StructType([T.StructField(self.id_col, self.id_type),
                            *(T.StructField(c, T.LongType()) for c in (*_COUNTED, "n_best", "count_sum")),
                            T.StructField("groups_sha256", T.StringType()), *([T.StructField("groups", T.StringType())] if with_groups else [])])
        schema, id_type = _arrow(out), _arrow(out).field(0).type

        def contribute(batches):
            number, counts, best, docs = None, [], [], None

            def done():
                columns = [pa.array(docs["ids"], id_type), *(pa.array(docs[c], pa.int64()) for c in _COUNTED),
                           pa.array(docs["n_best"]), pa.array(docs["count_sum"]), pa.array(docs["digests"], pa.string())]
                return pa.RecordBatch.from_arrays(columns + ([pa.array(docs["groups"], pa.string())] if with_groups else []), schema=schema)

            for batch in batches:
                for k in range(batch.num_rows):
                    run, place = batch.column("run")[k].as_py(), batch.column("place")[k].as_py()
                    if run != number:
                        if docs:
                            yield done()
                        number, counts, best, docs = run, [], [], None
                    if place < radix:
                        x, y = unpack(batch.column("blob")[k].as_py())
                        counts.append(x)
                        best.append(y)
                    elif place == radix:
                        docs = {f: batch.column(f)[k].as_py() for f in ("ids", *_COUNTED, "groups", "digests")}
                        docs |= {f: np.zeros(len(docs["ids"]), np.int64) for f in ("n_best", "count_sum")}
                        counts, best = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, best))
                    else:
                        which, doc, n = unpack(batch.column("blob")[k].as_py())
                        which = np.cumsum(which)  # each row's first number counts from 0
                        np.add.at(docs["count_sum"], doc, n * counts[which])
                        np.add.at(docs["n_best"], doc, n * best[which])
            if docs:
                yield done()
            text.release()

        spread = runs.repartition(radix, "run").sortWithinPartitions("run", "place")
        return spread.mapInArrow(contribute, out)


def _rows(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Sums of every document's alignment; ``options`` as of ``Alignment``."""
    return Alignment(docs, id_col, text_col, **options).documents()
