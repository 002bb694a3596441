"""LM scoring (3): a hierarchical Pitman-Yor bigram model, seated by Gibbs sampling over Spark.

Every word is a context with a restaurant of its own; all of them share the root restaurant as parent, whose base is
uniform over the known words and one unknown. A customer of context u that opens a table for w sends a customer to the
root. P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) * P_root(w), and the root alike over
its own tables; scores use the mean of the probabilities of the last ``SAMPLES`` sweeps.

Work is cut by a hash of the word into shards, each of which holds the words of its hash and their restaurants:

* documents become chunks of token codes (a written table); each chunk sends each shard its distinct pairs and counts;
* a shard adds them up. A pair seen once has one table for certain; the number of tables of every other pair is drawn
  anew in each sweep from its conditional, given the parent's probabilities and the other tables of the restaurant (see
  ``seat``; pairs are drawn in parallel against the totals of the sweep before);
* a sweep is two exchanges of integer lists: table counts per word to the word's shard, which reseats the root, and
  root counts back;
* at the end each shard sends each chunk what it needs for its own words and pairs, and the chunk adds up its texts.

All messages are packed lists, a frequent word or pair is one entry per chunk or shard, and the number of shards
follows the text's size. The followers of one very frequent word stay in one shard, so that shard grows with the
number of chunks, though far slower than the corpus. Only sums pass through the driver.
Words are told apart by 64-bit hashes, as second words of a pair by 48 bits of them.

Discounts are the usual estimate n1 / (n1 + 2 n2) of each level, the strengths are parameters.

Defined results: a null or empty text is one end token; rows that repeat get equal scores; with no training text all
tokens are unknown and have probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm import text
from crawlframe.llm.components import _written

CHUNK_BYTES, SHARD_BYTES = 12 << 20, 6 << 20
BURN_IN, SAMPLES = 1, 2
DRAWN = 64  # customers of a dish whose tables are drawn from their exact conditional
THETA_CONTEXT, THETA_ROOT = 1.0, 10.0
END = np.uint64(0xE7D5A1C39B2F6E41)


def _pack(a: np.ndarray) -> bytes:
    """An integer or float array as compressed bytes (size first)."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), dtype=kind) if size else np.zeros(0, dtype=kind)


def _small(a: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them all."""
    top = int(a.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + _pack(a.astype(kind))


def _large(data: bytes) -> np.ndarray:
    return _unpack(data[1:], f"<u{data[0]}").astype(np.int64)


def _ascending(a: np.ndarray) -> bytes:
    return _small(np.diff(a, prepend=0))


def _six(words: np.ndarray) -> bytes:
    """The upper 48 bits of word hashes, six bytes each."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _of_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _shard(short: np.ndarray, shards: int) -> np.ndarray:
    return (short % np.uint64(shards)).astype(np.int64)


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct word hashes (with the end's), and code and row of each word; tokenized in small slices."""
    hashes, rows, first = [], [], 0
    for piece in text.slices(part, "t"):
        row, code, words = text.tokens(piece.column("t"))
        hashes.append(text.hash_words(words)[code])
        rows.append((row + first).astype(np.int32))
        first += piece.num_rows
    g, code = np.unique(np.concatenate([*hashes, [END]]).astype(np.uint64), return_inverse=True)
    return g, code[:-1], np.concatenate(rows) if rows else np.zeros(0, np.int32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about ``CHUNK_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _chunks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in _gathered(batches):
        for part in text.slices(batch, "t", 2 * CHUNK_BYTES):
            g, code, row = _words(part)
            order = np.lexsort((g, _shard(g >> np.uint64(16), shards)))
            place = np.empty(len(g), dtype=np.int64)
            place[order] = np.arange(len(g))
            end = place[np.searchsorted(g, END)]
            lens = np.bincount(row, minlength=part.num_rows) + 1
            codes = np.full(int(lens.sum()), end)
            is_word = np.ones(len(codes), dtype=bool)
            is_word[np.cumsum(lens) - 1] = False
            codes[is_word] = place[code]
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(codes[np.repeat(train, lens)], minlength=len(g))
            yield pa.record_batch([
                pa.array([(TaskContext.get().partitionId() << 32) + n]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([_small(train)]), pa.array([_small(lens)]), pa.array([_small(codes)]), pa.array([int(end)]),
                pa.array([len(g)]), pa.array([g[order].tobytes()]), pa.array([_small(counts)])], names=[c.split()[0] for c in _CHUNK.split(", ")])
            del g, code, row, codes, is_word, counts
            text.release()
            n += 1


_CHUNK = "chunk long, ids array<long>, train binary, lens binary, codes binary, end long, v long, vocab binary, counts binary"


def _pairs(lens: np.ndarray, codes: np.ndarray, end: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context * v + word), ascending, and the number of each token's pair."""
    before = np.r_[end, codes[:-1]]
    before[np.cumsum(lens) - lens] = end
    return np.unique(before * v + codes, return_inverse=True)


_SENT = "shard long, chunk long, vocab binary, counts binary, runs binary, words binary, seen binary"


def _send_pairs(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            vocab, lens = np.frombuffer(r["vocab"], "<u8"), _large(r["lens"])
            uniq, inverse = _pairs(lens, _large(r["codes"]), r["end"], r["v"])
            train = np.repeat(_large(r["train"]), lens)
            seen = np.bincount(inverse, weights=train, minlength=len(uniq)).astype(np.int64)
            del inverse, train
            counts, word = _large(r["counts"]), vocab[uniq % r["v"]]
            runs = np.bincount(uniq // r["v"], minlength=r["v"])
            at = np.r_[0, np.cumsum(runs)]
            bounds = np.searchsorted(_shard(vocab >> np.uint64(16), shards), np.arange(shards + 1))
            for s in range(shards):
                a, b = bounds[s], bounds[s + 1]
                if a < b:
                    own = slice(at[a], at[b])
                    yield pa.record_batch([pa.array([s]), pa.array([r["chunk"]]), pa.array([vocab[a:b].tobytes()]), pa.array([_small(counts[a:b])]),
                                           pa.array([_small(runs[a:b])]), pa.array([_six(word[own])], pa.binary()), pa.array([_small(seen[own])])],
                                          names=[c.split()[0] for c in _SENT.split(", ")])
            del uniq, word, seen
            text.release()


# rows of a shard: kind, the shard (or chunk) they are for, the shard they are from, packed lists, sums
_ROW = "kind string, shard long, chunk long, source long, a binary, b binary, c binary, d binary, x double, y double"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _rows(rows: list[dict]) -> pa.Table:
    kinds = dict(zip(_NAMES, [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 4, *[pa.float64()] * 2]))
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in kinds.items()})


def _by_word(shard: int, short: np.ndarray, count: np.ndarray, kind: str, shards: int) -> list[dict]:
    """Messages of (distinct ascending word, sum of counts) to the words' shards."""
    words, inverse = np.unique(short, return_inverse=True)
    total = np.bincount(inverse, weights=count, minlength=len(words)).astype(np.int64)
    to = _shard(words, shards)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(shards + 1))
    return [{"kind": kind, "shard": s, "source": shard, "a": _six(words[order[a:b]] << np.uint64(16)), "b": _small(total[order[a:b]])}
            for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]


def _add_up(shards: int):
    """All chunks' words and pairs of one shard -> its state, what each chunk asked for, and first messages."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        shard = rows[0]["shard"]
        slices = [np.frombuffer(r["vocab"], "<u8") for r in rows]
        vocab, inverse = np.unique(np.concatenate(slices), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([_large(r["counts"]) for r in rows]), minlength=len(vocab)).astype(np.int64)
        context = np.repeat(inverse, np.concatenate([_large(r["runs"]) for r in rows]))
        word = np.concatenate([_of_six(r["words"]) for r in rows])
        seen = np.concatenate([_large(r["seen"]) for r in rows])
        with np.errstate(over="ignore"):
            key = text.mix(text.mix(vocab[context]) + word)
        _, first, pair = np.unique(key, return_index=True, return_inverse=True)
        del key
        count = np.bincount(pair, weights=seen, minlength=len(first)).astype(np.int64)
        many = np.flatnonzero(count > 1)
        f = first[many]
        many = many[np.lexsort((word[f], _shard(word[f], shards), context[f]))]  # the order in which chunks hold them
        number = np.full(len(first), -1)
        number[many] = np.arange(len(many))
        status = np.minimum(count, 2)[pair]
        number = number[pair]
        out, at_word, at_pair = [], 0, 0
        for r, own in zip(rows, slices):
            n = len(r["words"]) // 6
            st, nr = status[at_pair:at_pair + n], number[at_pair:at_pair + n]
            out.append({"kind": "asked", "shard": shard, "chunk": r["chunk"], "a": _ascending(inverse[at_word:at_word + len(own)]),
                        "b": _small(st), "c": _ascending_or_not(nr[st == 2])})
            at_word, at_pair = at_word + len(own), at_pair + n
        f, one = first[many], first[count == 1]
        single = np.bincount(context[one], minlength=len(vocab))
        out.append({"kind": "words", "shard": shard, "a": vocab.tobytes(), "b": _small(total), "c": _small(single),
                    "x": float(total.sum()), "y": float((total > 0).sum())})
        out.append({"kind": "pairs", "shard": shard, "a": _small(context[f]), "b": _six(word[f] << np.uint64(16)), "c": _small(count[many]),
                    "x": float(len(one)), "y": float((count == 2).sum())})
        out += _by_word(shard, word[one], np.ones(len(one)), "single", shards)
        out += _by_word(shard, word[f], np.ones(len(f)), "tables", shards)
        del rows, slices, inverse, context, word, seen, first, pair, count, status, number
        text.release()
        return _rows(out)

    return run


def _ascending_or_not(a: np.ndarray) -> bytes:
    """Marked bytes: differences if ascending, else plain."""
    up = len(a) == 0 or bool((np.diff(a) >= 0).all())
    return bytes([up]) + (_ascending(a) if up else _small(a))


def _numbers(data: bytes) -> np.ndarray:
    return np.cumsum(_large(data[1:])) if data[0] else _large(data[1:])


@lru_cache(maxsize=8)
def _arrangements(d: float, most: int) -> np.ndarray:
    """Log of the weighted number of ways to seat c customers at t tables, by (c, t): the generalised Stirling numbers."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def seat(count: np.ndarray, weight: np.ndarray, base: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of ``count`` customers of each dish, drawn given everything else (a blocked Gibbs step).

    ``weight``: theta + d * tables of the restaurant without this dish; ``base``: the parent's probability of the dish.
    Of up to ``DRAWN`` customers the number of tables is drawn from its exact conditional: the product of
    (weight + d k) * base over the tables, times the arrangements of the customers at them. More are seated one after
    the other in blocks of a sixteenth of those seated, where the j-th opens a table with odds (weight + d t) * base to
    (j - 1 - d t); among so many customers the difference is small.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    for c in np.unique(count[(count > 1) & (count <= DRAWN)]).tolist():
        own = np.flatnonzero(count == c)
        ways = _arrangements(d, DRAWN)[c, 1:c + 1]
        for at in range(0, len(own), 1 + (1 << 18) // c):
            part = own[at:at + 1 + (1 << 18) // c]
            log_p = np.cumsum(np.log(weight[part, None] + d * np.arange(c)) + np.log(base[part, None]), axis=1) + ways
            upto = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (upto < (rng.random(len(part)) * upto[:, -1])[:, None]).sum(axis=1)
    j, live = 1, np.flatnonzero(count > DRAWN)
    while len(live):
        step = np.minimum(max(1, j // 16), count[live] - j)
        t = tables[live]
        new = (weight[live] + d * t) * base[live]
        p = new / (new + np.maximum(j - d * t, 1e-12))
        tables[live] = t + rng.binomial(step, np.minimum(p, 1.0))
        j += max(1, j // 16)
        live = live[count[live] > j]
    return tables


def _find(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions of 48-bit words in the shard's ascending hashes."""
    return np.searchsorted(sorted_words, words << np.uint64(16))


def _root(sweep: int, seed: int, theta: float, state: dict):
    """Root customers of a shard's words from all shards' messages, reseated; counts go back to the senders."""
    d, v, others = state["d_root"], state["v"], state["root_tables"]

    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        if own.num_rows == 0:
            return _rows([])
        held = next(r for r in own.to_pylist() if r["kind"] == "words")
        words, shard = np.frombuffer(held["a"], "<u8"), held["shard"]
        alone = {r["kind"]: r for r in own.to_pylist()}.get("alone")
        customers = _large(alone["a"]) if alone else np.zeros(len(words), dtype=np.int64)
        messages = sorted(sent.to_pylist(), key=lambda r: (r["source"], r["kind"]))
        places = [_find(words, _of_six(r["a"])) for r in messages]
        for r, at in zip(messages, places):
            np.add.at(customers, at, _large(r["b"]))
        if d is None:  # the first time: sums for the discount, and the customers of pairs that have one table for good
            alone = np.zeros(len(words), dtype=np.int64)
            for r, at in zip(messages, places):
                if r["kind"] == "single":
                    np.add.at(alone, at, _large(r["b"]))
            return _rows([{"kind": "root", "shard": shard, "x": float((customers == 1).sum()), "y": float((customers == 2).sum())},
                          {"kind": "alone", "shard": shard, "a": _small(alone)}])
        rng = np.random.default_rng([seed, sweep, shard])
        weight = np.full(len(words), theta + d * max(0.0, others - 1))
        tables = seat(customers, weight, np.full(len(words), 1 / (v + 1)), d, rng)
        out = [{"kind": "root", "shard": shard, "a": _small(customers), "b": _small(tables), "x": float(customers.sum()), "y": float(tables.sum())}]
        for r, at in zip(messages, places):
            if r["kind"] == "tables":
                out.append({"kind": "back", "shard": r["source"], "source": shard, "a": r["a"], "b": _small(customers[at]), "c": _small(tables[at])})
        return _rows(out)

    return run


def _root_probability(customers, tables, state: dict, theta: float):
    """P_root of words with these root customers and tables."""
    spare = theta + state["d_root"] * state["root_tables"]
    return (customers - state["d_root"] * tables + spare / (state["v"] + 1)) / (theta + state["root_customers"])


def _contexts(sweep: int, seed: int, theta: float, theta_root: float, state: dict, shards: int):
    """All pairs of a shard with several customers, reseated given the root's probabilities."""

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        held = {r["kind"]: r for r in own.to_pylist() if r["kind"] != "seats"}
        if "pairs" not in held:
            return _rows([])
        shard = held["pairs"]["shard"]
        context, short, count = _large(held["pairs"]["a"]), _of_six(held["pairs"]["b"]), _large(held["pairs"]["c"])
        single, total = _large(held["words"]["c"]), _large(held["words"]["b"])
        old = [r for r in own.to_pylist() if r["kind"] == "seats"]
        tables = _large(old[0]["a"]) if old else np.ones(len(count), dtype=np.int64)
        heard = back.to_pylist()
        words = np.concatenate([np.zeros(0, "<u8"), *[_of_six(r["a"]) for r in heard]])
        p = np.concatenate([np.zeros(0), *[_root_probability(_large(r["b"]), _large(r["c"]), state, theta_root) for r in heard]])
        order = np.argsort(words)
        base = p[order][np.searchsorted(words[order], short)] if len(short) else np.zeros(0)
        d = state["d_context"]
        sums = single + np.bincount(context, weights=tables, minlength=len(total)).astype(np.int64)
        rng = np.random.default_rng([seed, 1000 + sweep, shard])
        tables = seat(count, theta + d * (sums[context] - tables), base, d, rng)
        sums = single + np.bincount(context, weights=tables, minlength=len(total)).astype(np.int64)
        return _rows([{"kind": "seats", "shard": shard, "source": sweep, "a": _small(tables), "b": _small(sums)},
                      *_by_word(shard, short, tables, "tables", shards)])

    return run


def _answers(samples: list[tuple[int, dict]], theta: float, theta_root: float):
    """What each chunk asked one shard for: word counts, and per sample root probability and back-off weight of its words;
    mean numerators of its pairs."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        held = {r["kind"]: r for r in rows if r["kind"] in ("words", "pairs")}
        if "words" not in held:
            return _rows([])
        total, count = _large(held["words"]["b"]), _large(held["pairs"]["c"])
        root, weight, numerator = [], [], np.zeros(len(count))
        one = 0.0
        for sweep, state in samples:
            at = {r["kind"]: r for r in rows if r["kind"] in ("root", "seats") and r["source"] == sweep}
            root.append(_root_probability(_large(at["root"]["a"]), _large(at["root"]["b"]), state, theta_root))
            d = state["d_context"]
            weight.append((theta + d * _large(at["seats"]["b"])) / (theta + total))
            numerator += (count - d * _large(at["seats"]["a"])) / len(samples)
            one = 1 - d
        out = []
        for r in asked.to_pylist():
            words, status = np.cumsum(_large(r["a"])), _large(r["b"])
            value = np.where(status == 1, one, 0.0).astype(np.float32)
            value[status == 2] = numerator[_numbers(r["c"])]
            out.append({"kind": "answer", "chunk": r["chunk"], "shard": r["shard"], "a": _small(total[words]),
                        "b": _pack(np.concatenate([x[words] for x in root]).astype(np.float32)),
                        "c": _pack(np.concatenate([x[words] for x in weight]).astype(np.float32)), "d": _pack(value)})
        return _rows(out)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, theta: float, n_samples: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        r = chunk.to_pylist()[0] if chunk.num_rows else None
        if r is None:
            return pa.table({c.split()[0]: [] for c in _SCORED.split(", ")})
        rows = sorted(answers.to_pylist(), key=lambda x: x["shard"])
        total = np.concatenate([_large(x["a"]) for x in rows])
        root, weight = (np.concatenate([_unpack(x[c], "<f4").reshape(n_samples, -1) for x in rows], axis=1).astype(float) for c in "bc")
        value = np.concatenate([_unpack(x["d"], "<f4") for x in rows]).astype(float)
        lens, codes = _large(r["lens"]), _large(r["codes"])
        uniq, inverse = _pairs(lens, codes, r["end"], r["v"])
        context, word = uniq // r["v"], uniq % r["v"]
        p = value / (theta + total[context])
        for s in range(n_samples):
            p += weight[s][context] * root[s][word] / n_samples
        start = np.cumsum(lens) - lens
        score = np.add.reduceat(np.log10(p)[inverse], start)
        known = np.add.reduceat((total > 0)[codes].astype(np.int64), start)
        base = np.add.reduceat(np.log10((total + 1) / (n + v + 1))[codes], start)
        del rows, root, weight, value, codes, uniq, inverse, context, word, p
        text.release()
        return pa.table({"doc_id": pa.array(r["ids"], pa.int64()), "held_out": pa.array(_large(r["train"]) == 0), "n_tokens": lens,
                         "n_known": known, "train_tokens": np.full(len(lens), n), "base_score": base, "score": score})

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 5,
          burn_in: int = BURN_IN, samples: int = SAMPLES, theta: float = THETA_CONTEXT, theta_root: float = THETA_ROOT) -> DataFrame:
    """Learn from the rows where ``held_out`` is false, score all: see the module's text for the columns' meaning."""
    text.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                       (~F.coalesce(held_out, F.lit(False))).alias("train"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(4, math.ceil(size / SHARD_BYTES))
    chunks = _written(rows.mapInArrow(lambda b: _chunks(b, shards), _CHUNK), "lm-chunks")
    sent = chunks.drop("ids").mapInArrow(lambda b: _send_pairs(b, shards), _SENT)
    first = _written(sent.groupBy("shard").applyInArrow(_add_up(shards), _ROW), "lm-shards")
    words, pairs, single = (first.where(F.col("kind") == k) for k in ("words", "pairs", "single"))
    sums = {r["kind"]: r for r in first.where("kind in ('words', 'pairs')").groupBy("kind").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    if not sums:  # no rows at all
        return docs.sparkSession.createDataFrame([], _SCORED)
    n, v = int(sums["words"]["x"]), int(sums["words"]["y"])

    def discount(once: float, twice: float) -> float:
        return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    state = {"v": v, "d_context": discount(sums["pairs"]["x"], sums["pairs"]["y"]), "d_root": None, "root_tables": 0.0, "root_customers": 0.0}
    tables = first.where("kind = 'tables'")

    def renewed(df: DataFrame) -> DataFrame:
        """The same columns as new attributes: both sides of a cogroup read the same table."""
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    def only(df: DataFrame, *lists: str) -> DataFrame:
        """The rows with these packed lists alone: state is dealt out anew for every exchange."""
        return df.select(*[F.lit(None).cast("binary").alias(c) if c in "abcd" and c not in lists else F.col(c) for c in _NAMES])

    def exchange(own: DataFrame, other: DataFrame, run, name: str) -> DataFrame:
        return _written(own.groupBy("shard").cogroup(renewed(other).groupBy("shard")).applyInArrow(run, _ROW), name)

    def total(root: DataFrame) -> tuple[float, float]:
        return tuple(float(x or 0) for x in root.where("kind = 'root'").agg(F.sum("x"), F.sum("y")).first())

    counts = exchange(only(words, "a"), single.union(tables), _root(0, seed, theta_root, state), "lm-counts")
    state["d_root"] = discount(*total(counts))
    rooted = only(words, "a").union(counts.where("kind = 'alone'"))
    seated = only(words, "b", "c").union(pairs)
    state["root_tables"] = float(v)
    kept, held, seats = [], [], None
    for sweep in range(burn_in + samples):
        root = exchange(rooted, tables, _root(sweep, seed, theta_root, dict(state)), "lm-root")
        state["root_customers"], state["root_tables"] = total(root)
        own = seated if seats is None else seated.union(only(seats, "a"))
        after = exchange(own, root.where("kind = 'back'"), _contexts(sweep, seed, theta, theta_root, dict(state), shards), "lm-seats")
        seats, tables = after.where("kind = 'seats'"), after.where("kind = 'tables'")
        if sweep >= burn_in:
            kept.append((sweep, dict(state)))
            held += [root.where("kind = 'root'").withColumn("source", F.lit(sweep).cast("long")), seats]
    own = only(words, "b").union(only(pairs, "c"))
    for x in held:
        own = own.union(x)
    answers = own.groupBy("shard").cogroup(renewed(first.where("kind = 'asked'")).groupBy("shard")).applyInArrow(_answers(kept, theta, theta_root), _ROW)
    return (chunks.select("chunk", "ids", "train", "lens", "codes", "end", "v").groupBy("chunk")
            .cogroup(answers.select("chunk", "shard", "a", "b", "c", "d").groupBy("chunk")).applyInArrow(_score(n, v, theta, samples), _SCORED))
