"""Averaged hashed subword embeddings with a linear softmax (shared by the quality classifier and language ID).

A word contributes its own hashed feature and those of its character n-grams
(inside ``<word>``); a document is the mean of the learned vectors of all its
features, and a softmax over it gives the class. As the output is linear in
the mean, scoring needs only the product table (buckets x classes), whose size
is fixed by the parameters and not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crawlframe.llm.text import hash_words, mix, slices, tokens


@dataclass
class Params:
    buckets: int = 1 << 17
    dim: int = 16
    min_n: int = 2
    max_n: int = 4
    epochs: int = 5
    batch: int = 32
    rate: float = 0.1
    seed: int = 7
    repeat_weight: float = 0.0  # features' worth of the shared bucket 0, for each word equal to the one before it


@dataclass
class Model:
    classes: list
    table: np.ndarray  # buckets x classes: embeddings times output weights
    bias: np.ndarray
    params: Params = field(default_factory=Params)
    temperature: float = 1.0
    reject_below: float = 0.0


def word_features(words: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of every word; bucket 0 is left free."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    room = np.uint64(p.buckets - 1)
    joined = "<" + "><".join(words.to_pylist()) + ">"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    # '<' and '>' may stand inside a word as well, so word ends come from the lengths
    ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    owner = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
    end = ends[owner]
    owners, buckets = [np.arange(n)], [(mix(hash_words(words), 1) % room).astype(np.int64) + 1]
    h = points.copy()
    at = np.arange(len(points))
    with np.errstate(over="ignore"):
        for size in range(1, p.max_n + 1):
            if size > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + points[size - 1:]
            if size >= p.min_n:
                ok = at[: len(h)] + size <= end[: len(h)]
                owners.append(owner[: len(h)][ok])
                buckets.append((mix(h[ok], size + 1) % room).astype(np.int64) + 1)
    return np.concatenate(owners), np.concatenate(buckets)


def _repeats(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many of its words equal the word before them."""
    same = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=n).astype(float)


def _documents(texts: pa.Array, p: Params) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct buckets and their shares of all its features."""
    row, code, words = tokens(texts)
    owner, bucket = word_features(words, p)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    again = _repeats(row, code, len(texts)) * p.repeat_weight
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        ids, counts = np.unique(code[a:b], return_counts=True)
        if len(ids) == 0:
            out.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)))
            continue
        sizes = first[ids + 1] - first[ids]
        pos = np.repeat(first[ids] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        feats, inverse = np.unique(bucket[pos], return_inverse=True)
        weight = np.bincount(inverse, weights=np.repeat(counts, sizes)).astype(np.float32)
        if again[i]:
            feats, weight = np.r_[0, feats], np.r_[np.float32(again[i]), weight]
        out.append((feats, weight / weight.sum()))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list, p: Params = Params(), calibrate_share: float = 0.1,
          keep_rate: float = 0.999) -> Model:
    """Minibatch SGD with per-weight falling rates over (text, label) pairs.

    The last ``calibrate_share`` of a fixed shuffle is kept out of training: it sets the softmax temperature, and
    ``reject_below`` such that ``keep_rate`` of its correctly classified texts score at least that much (0.5 at most:
    a text that is likelier right than wrong is never rejected).
    No text at all gives a one-class model that scores 0.5.
    """
    classes = sorted(set(labels))
    if len(classes) < 2:
        return Model(classes or [None], np.zeros((p.buckets, max(1, len(classes))), dtype=np.float32),
                     np.zeros(max(1, len(classes)), dtype=np.float32), p)
    rng = np.random.default_rng(p.seed)
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
    docs = [d for part in slices(batch, "t", 1 << 20) for d in _documents(part.column(0), p)]
    y = np.array([classes.index(x) for x in labels])
    order = rng.permutation(len(docs))
    held = order[: int(len(docs) * calibrate_share)] if len(docs) >= 50 else order[:0]
    fit = order[len(held):]
    k = len(classes)
    emb = (rng.random((p.buckets, p.dim), dtype=np.float32) - 0.5) / p.dim
    out = rng.normal(0, 1, (p.dim, k)).astype(np.float32)
    bias = np.zeros(k, dtype=np.float32)
    seen = [np.full(x.shape, 1e-8, dtype=np.float32) for x in (emb, out, bias)]  # squared gradients so far
    for _ in range(p.epochs):
        rng.shuffle(fit)
        for start in range(0, len(fit), p.batch):
            rows = fit[start:start + p.batch]
            sizes = np.array([len(docs[r][0]) for r in rows])
            ids, inverse = np.unique(np.concatenate([docs[r][0] for r in rows]), return_inverse=True)
            share = np.zeros((len(ids), len(rows)), dtype=np.float32)
            share[inverse, np.repeat(np.arange(len(rows)), sizes)] = np.concatenate([docs[r][1] for r in rows])
            vec = share.T @ emb[ids]
            grad = _softmax(vec @ out + bias)
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad = grad.astype(np.float32) / len(rows)
            step = share @ (grad @ out.T)
            seen[0][ids] += step * step
            emb[ids] -= p.rate * step / np.sqrt(seen[0][ids])
            for held_in, so_far, g in ((out, seen[1], vec.T @ grad), (bias, seen[2], grad.sum(axis=0))):
                so_far += g * g
                held_in -= p.rate * g / np.sqrt(so_far)
    model = Model(classes, (emb @ out).astype(np.float32), bias, p)
    if len(held):
        logits = np.stack([(model.table[docs[r][0]] * docs[r][1][:, None]).sum(axis=0) + bias for r in held])
        best = min(np.geomspace(0.5, 20, 60),
                   key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
        model.temperature = float(best)
        prob = _softmax(logits / best)
        right = prob.max(axis=1)[prob.argmax(axis=1) == y[held]]
        if len(right):
            model.reject_below = float(min(np.quantile(right, 1 - keep_rate), 0.5))
    return model


def probabilities(texts: pa.Array, m: Model) -> np.ndarray:
    """Class probabilities (rows x classes, float64) of whole texts; a text without words gets the bias alone."""
    p, k = m.params, len(m.classes)
    row, code, words = tokens(texts)
    total, size = np.zeros((len(texts), k)), np.zeros(len(texts))
    if len(words):
        owner, bucket = word_features(words, p)
        features = np.bincount(owner, minlength=len(words))
        again = _repeats(row, code, len(texts)) * p.repeat_weight
        for c in range(k):
            per_word = np.bincount(owner, weights=m.table[:, c][bucket], minlength=len(words))
            total[:, c] = np.bincount(row, weights=per_word[code], minlength=len(texts)) + again * m.table[0, c]
        size = np.bincount(row, weights=features[code], minlength=len(texts)) + again
    return _softmax((total / np.maximum(size, 1)[:, None] + m.bias) / m.temperature)
