"""Byte-level BPE encoding in numpy merge rounds over many words at once.

A batch's texts are split into words by the tokenizer's pattern. The distinct words not met before
become one flat array of symbols. In each round the rank of every adjacent pair is found by binary
search over the sorted pair keys, the lowest rank of each word is taken by a segmented minimum,
and all its places in the word are merged at once (in a run of equal symbols every other one, from
the left). Words without a pair to merge leave the array. Texts are then gathered from their
words' ids. The merge tables, of a size fixed by the vocabulary, are broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts of about so many bytes are encoded together.
SLICE_BYTES = 4 << 20
#: A worker forgets its words when it holds so many, or so many ids of them.
MAX_WORDS = 300_000
MAX_IDS = 8_000_000
_NONE = np.int64(1) << 40


@dataclass
class Merges:
    """Sorted pair keys (left id * 2^32 + right id) with the rank and the id of the merged pair."""

    pattern: str
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: a byte that prints stands for
    itself, the others are numbered from 256."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


@lru_cache(maxsize=4)
def load_merges(path: str, pattern: str) -> Merges:
    """Merge tables of a byte-level BPE vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    keys = (left << 32) | right
    order = np.argsort(keys, kind="stable")
    letters = _byte_letters()
    return Merges(pattern, np.array([vocab[letters[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64)[order])


def default_tokenizer() -> tuple[str, str]:
    """Path and split pattern of the public byte-level tokenizer byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def encode_words(words: list[str], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``words`` in one array, and the offsets of each word in it."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    sym = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(raw)), sizes)
    done_sym, done_word = [], []
    while len(sym):
        inner = word[1:] == word[:-1]
        key = np.where(inner, (sym[:-1] << 32) | sym[1:], -1)
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        found = m.keys[at] == key
        rank = np.append(np.where(found, m.ranks[at], _NONE), _NONE)
        starts = np.flatnonzero(np.concatenate([[True], ~inner]))
        least = np.minimum.reduceat(rank, starts)
        ends = least == _NONE
        length = np.diff(np.append(starts, len(sym)))
        lowest = np.repeat(least, length)
        take = (rank == lowest) & (rank != _NONE)
        places = np.flatnonzero(take)
        if len(places) > 1:
            # Neighbouring places overlap (a run of one symbol): every other one, from the left.
            fresh = np.concatenate([[True], np.diff(places) > 1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(places - places[head]) % 2 == 0]
        sym = sym.copy()
        sym[places] = m.merged[at[places]]
        stay = np.ones(len(sym), bool)
        stay[places + 1] = False
        if ends.any():
            out = np.repeat(ends, length)
            done_sym.append(sym[out])
            done_word.append(word[out])
            stay &= ~out
        sym, word = sym[stay], word[stay]
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    ids = sym[np.argsort(word, kind="stable")].astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])


class Encoder:
    """Encodes texts; keeps the words it has met, up to a bound."""

    def __init__(self, merges: Merges):
        import regex

        self.merges = merges
        self.find = regex.compile(merges.pattern).findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in one array, and how many each text has."""
        if len(self.index) > MAX_WORDS or len(self.ids) > MAX_IDS:
            self.clear()
        index, find, known = self.index, self.find, len(self.index)
        numbers: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = find(t)
                counts[i] = len(own)
                numbers += [index[w] if w in index else index.setdefault(w, len(index)) for w in own]
        if len(index) > known:
            fresh = list(index)[known:] if known else list(index)
            ids, offsets = encode_words(fresh, self.merges)
            self.start = np.concatenate([self.start, offsets[:-1] + len(self.ids)])
            self.size = np.concatenate([self.size, np.diff(offsets)])
            self.ids = np.concatenate([self.ids, ids])
        return np.array(numbers, np.int64), counts

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        numbers, counts = self.words(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[numbers])])[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        numbers, counts = self.words(texts)
        size = self.size[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
        return flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _mapped(df: DataFrame, id_col: str, text_col: str, tokenizer: tuple[str, str] | None, out: T.StructField, make) -> DataFrame:
    path, pattern = tokenizer or default_tokenizer()
    merges = df.sparkSession.sparkContext.broadcast(load_merges(path, pattern))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), make(encoder, part.column(1).to_pylist())], names=[id_col, out.name])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row, in the given tokenizer (path, pattern).

    Null and empty texts give an empty list; special tokens are never added, and text that spells one
    is ordinary text. Texts are encoded whole. Repeated rows and null ids are kept as they are; other
    columns are not read; an empty table gives an empty result. No shuffle.
    """

    def make(encoder: Encoder, texts: list) -> pa.Array:
        ids, offsets = encoder.encode(texts)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return _mapped(df, id_col, text_col, tokenizer, T.StructField("ids", T.ArrayType(T.IntegerType())), make)


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``id_col`` and ``n_tokens`` (bigint), as :func:`token_ids` would give; 0 for null and empty texts."""
    return _mapped(df, id_col, text_col, tokenizer, T.StructField("n_tokens", T.LongType()), lambda e, t: pa.array(e.lengths(t).astype(np.int64)))
