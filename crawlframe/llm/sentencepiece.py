"""SentencePiece encoding and decoding (1) of whole texts.

One pass of an Aho-Corasick automaton over a text lists, by its output links,
every piece that ends at each position; each is relaxed against the best state
of the position where it starts, and the states are followed back from the end.

* Viterbi: the best sum of piece scores to each position and the last piece of its path. The path, ``best_ids``, is the
  encoding of a UNIGRAM model, and of any model with ``by="scores"``.
* Merges: of a BPE model, sums of scores can't give the library's result, as a BPE score is only a merge's rank. In
  the same pass each position keeps the last piece of its prefix's merged segmentation; a piece is accepted if it and
  the piece before it are what merging their joined text yields. A segmentation whose neighbours all pass is the
  merged one, and each prefix has exactly one.

Texts are cut into units that no piece crosses (found from the vocabulary: before a run of word marks, around a line
end, and after a letter if only letters follow one inside pieces) and a task segments a unit once while it is cached.
Unknown characters become their UTF-8 byte pieces, or the unknown id where the model has none.

Defined results: null and empty texts have no ids; a text decodes to itself, except that a literal U+2581 decodes to
a space and characters unknown to a model without byte pieces to its unknown surface (``exact`` is false then). Of
Viterbi paths with equal scores, the one whose last differing piece is longest wins. Repeated rows get equal ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm import text

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the model format
CACHED_UNITS = 500_000  # bounds memory only: about 150 bytes each, and as much for a word
_NEVER = float("-inf")


def default_model() -> str:
    """Path of the installed public 32k model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Segmenter:
    """Encoder and decoder of one model, built from the bytes of a ``.model`` file."""

    def __init__(self, model: bytes, by: str = "model", units: int = CACHED_UNITS):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        if by not in ("model", "scores"):
            raise ValueError("by must be model or scores")
        self.kind = UNIGRAM if by == "scores" else proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.unknown = proto.trainer_spec.unk_id
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10.0  # fixed penalty of the format
        surface = proto.trainer_spec.unk_surface.encode()
        self.surface = [p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER) else bytes([int(p.piece[1:-1], 16)])
                        if p.type == BYTE else surface if p.type == UNKNOWN else b"" for p in proto.pieces]
        self.surfaces = pa.array(self.surface, pa.large_binary())
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i, self.scores[i]))
        self.automaton.make_automaton()
        longer = [p for p in self.ids if len(p) > 1]
        own = "" if any("\n" in p for p in longer) else "\n"  # a line end that no longer piece holds is a unit
        rest = f"{MARK}{own}"
        if any(MARK in p.lstrip(MARK) for p in longer):
            self.unit = None  # pieces cross word starts: each text is one unit
        elif any(x.isalpha() and not y.isalpha() for p in longer for x, y in zip(p, p[1:])):
            self.unit = regex.compile(f"{own + '|' if own else ''}{MARK}+[^{rest}]*|[^{rest}]+")
        else:  # no piece goes on after a letter but with a letter
            self.unit = regex.compile(f"{own + '|' if own else ''}{MARK}+[^{rest}\\p{{L}}]*\\p{{L}}*|[^{rest}\\p{{L}}]+\\p{{L}}*|\\p{{L}}+")
        # a word of letters alone, behind its mark, is then one unit
        self.letters = self.prefix == MARK and self.unit is not None and "\\p{L}" in self.unit.pattern
        self.units = units
        self.known = {p for p in self.ids if len(p) == 1}
        self.follows: dict[int, bool] = {}
        self.length = [len(p) for p in self.pieces]
        self._forget()

    def _forget(self) -> None:
        """Start an empty store: number of each unit, and per number its ids, best ids (flat arrays) and best score."""
        self.number: dict[str, int] = {}
        self.flat, self.size, self.score = array("i"), array("i"), array("d")
        self.best_flat, self.best_size = array("i"), array("i")
        self.words: dict[str, int] = {}  # number of each word, and per number its units
        self.word_flat, self.word_size = array("i"), array("i")

    def _merged(self, joined: str) -> list[str]:
        """Pieces left when the best-scored neighbouring pair (the leftmost of equals) is merged until none can be."""
        parts = list(joined)
        ids, scores = self.ids, self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging yields piece b after piece a (-1: after nothing, or after an unknown character)."""
        key = (a << 32) | b
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) >= 300_000:
                self.follows.clear()
            whole = [self.pieces[b]] if a < 0 else [self.pieces[a], self.pieces[b]]
            ok = self.follows[key] = self._merged("".join(whole)) == whole
        return ok

    def segment(self, unit: str) -> tuple[Sequence[int], Sequence[int], float]:
        """(ids, ids of the best path by scores, its score)."""
        n = len(unit)
        best = [0.0] + [_NEVER] * n
        back: list = [-1] * (n + 1)  # last piece of the best path to each position; -1: unknown character
        merges, follow, known = self.kind == BPE, self._may_follow, self.follows.get
        last: list = [-1] + [None] * n if merges else back  # last piece of the merged segmentation of each prefix
        unknown = set() if self.known.issuperset(unit) else {j for j, c in enumerate(unit, 1) if c not in self.known}
        at = 0

        def pass_unknown(to: int) -> None:  # in text order, as later pieces start from these positions
            nonlocal at
            for j in range(at + 1, to + 1):
                if j in unknown and best[j - 1] + self.unknown_score > best[j]:
                    best[j], back[j] = best[j - 1] + self.unknown_score, -1
                    if last[j] is None:
                        last[j] = -1
            at = max(at, to)

        for end, (size, i, score) in self.automaton.iter(unit):
            end += 1
            if unknown and at < end - 1:
                pass_unknown(end - 1)
            start = end - size
            total = best[start] + score
            if total > best[end]:
                best[end], back[end] = total, i
            if merges and last[end] is None:
                before = last[start]
                if before is not None:
                    ok = known((before << 32) | i)
                    if ok or ok is None and follow(before, i):
                        last[end] = i
        if unknown:
            pass_unknown(n)
            return self._path(unit, last), self._path(unit, back), best[n]
        first = self._pieces_to(n, back)
        return self._pieces_to(n, last) if merges else first, first, best[n]

    def _pieces_to(self, at: int, last: list) -> list[int]:
        """The path without unknown characters."""
        length, out = self.length, []
        while at:
            i = last[at]
            out.append(i)
            at -= length[i]
        out.reverse()
        return out

    def _path(self, unit: str, last: list) -> tuple[int, ...]:
        at, out = len(unit), []
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
                at -= len(self.pieces[i])
                continue
            if self.bytes:
                out += [self.bytes[b] for b in reversed(unit[at - 1].encode())]
            else:  # one unknown id for neighbouring unknown characters
                while at > 1 and last[at - 1] == -1:
                    at -= 1
                out.append(self.unknown)
            at -= 1
        return tuple(reversed(out))

    def _joined(self, ids) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def _numbered(self, unit: str) -> int:
        """Number of a unit that is not in the store yet."""
        ids, best, score = self.segment(unit)
        number = self.number[unit] = len(self.size)
        self.flat.extend(ids)
        self.size.append(len(ids))
        self.best_flat.extend(best)
        self.best_size.append(len(best))
        self.score.append(score)
        return number

    def _word(self, word: str) -> int:
        """Number of a word that is not in the store yet, cut into units."""
        if self.letters and word.isalpha():
            own = [self.prefix + word]
        else:
            marked = self.prefix + word.replace(" ", MARK)
            own = self.unit.findall(marked) if self.unit else [marked] if word else []
        known = self.number.get
        for unit in own:
            number = known(unit)
            self.word_flat.append(self._numbered(unit) if number is None else number)
        number = self.words[word] = len(self.word_size)
        self.word_size.append(len(own))
        return number

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """Per whole text (null: empty) its ids, the ids and score of its best path by scores, and whether its ids decode to it."""
        texts = text.plain(texts)
        if self.unit is None or not self.prefix:
            row, words = np.arange(len(texts)), texts
        else:
            split = pc.split_pattern(texts, " ")  # one mark per word: the dummy one, or the space before it
            words, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
            runs = row[pc.binary_length(words).to_numpy(zero_copy_only=False) == 0]
            marked = np.flatnonzero(pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False))
            runs = np.union1d(runs, marked)
            if len(runs):  # rows with runs of spaces or literal marks, or without text: a word keeps its run
                keep = ~np.isin(row, runs)
                own = [(r, w[1:]) for r in runs.tolist() if texts[r].as_py()
                       for w in re.findall(f"[ {MARK}]+[^ {MARK}]*", " " + texts[r].as_py())]
                row = np.concatenate([row[keep], np.array([r for r, _ in own], dtype=row.dtype)])
                words = pa.concat_arrays([words.filter(pa.array(keep)), pa.array([w for _, w in own], pa.string())])
                order = np.argsort(row, kind="stable")
                row, words = row[order], words.take(pa.array(order))
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.number) > self.units or len(self.words) > self.units * 3 // 2:
            self._forget()
        known, word = self.words.get, []
        for w in coded.dictionary.to_pylist():
            number = known(w)
            word.append(self._word(w) if number is None else number)
        word = np.array(word, dtype=np.int64)
        # words -> units -> ids, as runs of the stored arrays
        per_word = np.array(self.word_size, dtype=np.int64)
        word = word[code] if len(code) else np.zeros(0, dtype=np.int64)
        unit = np.array(self.word_flat, dtype=np.int64)[_runs((np.cumsum(per_word) - per_word)[word], per_word[word])]
        owner = np.repeat(row, per_word[word])

        def ids_of(flat: array, size: array) -> pa.Array:
            size = np.array(size, dtype=np.int64)
            ids = np.array(flat, dtype=np.int32)[_runs((np.cumsum(size) - size)[unit], size[unit])]
            end = np.r_[0, np.cumsum(np.bincount(owner, weights=size[unit], minlength=len(texts)).astype(np.int64))]
            return pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), pa.array(ids))

        ids = ids_of(self.flat, self.size)
        score = np.bincount(owner, weights=np.array(self.score)[unit], minlength=len(texts))
        return ids, ids_of(self.best_flat, self.best_size), score, self._decodes(ids, texts)

    def _decodes(self, ids: pa.Array, texts: pa.Array) -> np.ndarray:
        """Whether each row's ids, decoded, are its text: the bytes of all rows side by side."""
        got = self.surfaces.take(ids.values)
        size = pc.binary_length(got).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = ids.offsets.to_numpy()
        size = np.diff(np.r_[0, np.cumsum(size)][ends])
        texts = texts.cast(pa.large_string())
        if self.prefix:  # of rows with text, the space before it
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        want = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        same = size == want
        left, right = (_bytes(x)[np.repeat(same, n)] if not same.all() else _bytes(x) for x, n in ((got, size), (texts, want)))
        off = np.flatnonzero(left != right)
        same[np.flatnonzero(same)[np.unique(np.searchsorted(np.cumsum(want[same]), off, "right"))]] = False
        return same

    def decode(self, ids: list[int]) -> str:
        out = self._joined(ids).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


def _bytes(values: pa.Array) -> np.ndarray:
    """The bytes of a large_string or large_binary array without nulls, one value after the other."""
    if not len(values) or values.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``first`` and are ``size`` long, one after the other."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)


_built: dict[tuple, Segmenter] = {}


def _segmenter(shared) -> Segmenter:
    """The task process's segmenter of a broadcast (model, by), one at a time."""
    if shared.value not in _built:
        _built.clear()
        _built[shared.value] = Segmenter(*shared.value)
    return _built[shared.value]


def _shared(spark: SparkSession, model_path: str | None, by: str = "model", units: int = CACHED_UNITS):
    text.bound_batches(spark)
    with open(model_path or default_model(), "rb") as f:
        return text.share(spark, (f.read(), by, units))


_ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("best_ids", T.ArrayType(T.IntegerType())),
    T.StructField("best_score", T.DoubleType()), T.StructField("exact", T.BooleanType())])


def encode(spark: SparkSession, column: str, model_path: str | None = None, by: str = "model") -> Column:
    """Struct (ids, best_ids, best_score, exact) of a text column; the model file is read on the driver.

    ``best_ids`` and ``best_score`` are the Viterbi path by scores; ``exact`` says whether the row's ids, decoded, are its text.
    """
    shared = _shared(spark, model_path, by)

    @F.arrow_udf(_ENCODED)
    def run(texts: pa.Array) -> pa.Array:
        own = _segmenter(shared)
        batch = pa.record_batch([text.plain(texts)], names=["t"])
        parts = [own.encode(part.column(0)) for part in [*text.slices(batch, "t", 4 << 20)] or [batch]]
        return pa.StructArray.from_arrays(
            [*(pa.concat_arrays([p[k] for p in parts]) for k in (0, 1)), *(pa.array(np.concatenate([p[k] for p in parts])) for k in (2, 3))],
            names=_ENCODED.fieldNames())

    return run(F.col(column))


def encode_rows(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, model_path: str | None = None,
                by: str = "model", units: int = CACHED_UNITS) -> DataFrame:
    """Columns ``keep`` (all but the text by default) with ids, best_ids, best_score and exact, as ``encode`` gives them.

    ``units``: how many units a task remembers. Rows leave the task in batches of a few MB of text, so ids of many long texts are never held together. Kept columns
    of these four names are left out.
    """
    shared = _shared(df.sparkSession, model_path, by, units)
    names = _ENCODED.fieldNames()
    keep = [c for c in (df.columns if keep is None else keep) if c != text_col and c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + _ENCODED.fields)

    def run(batches):
        own = _segmenter(shared)
        for batch in batches:
            for part in text.slices(batch, "_text"):
                ids, best_ids, *rest = own.encode(part.column("_text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, best_ids, *map(pa.array, rest)], names=[*keep, *names])
            text.release()

    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(spark: SparkSession, column: str, model_path: str | None = None) -> Column:
    """Text of a column of id lists (null for null); ids outside the model fail the job."""
    shared = _shared(spark, model_path)

    @F.arrow_udf(T.StringType())
    def run(ids: pa.Array) -> pa.Array:
        own = _segmenter(shared)
        return pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.string())

    return run(F.col(column))
