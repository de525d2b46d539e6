"""Near-duplicates over word shingles by T-occurrence search (DivideSkip), and their groups.

A document of n distinct shingles can only be similar to others that share at least ``T = ceil(t n)``
of them. All shingles are put in one global order, rare ones first, by the number of documents that have them. Of a
document's inverted lists the longest, ``T - c`` of them, are *long*: whatever shares T shingles with it shares c of
the remaining *short* ones. Only short lists are built and merged: postings are shuffled by shingle, sorted, joined
list by list, and the occurrences of each pair counted; a pair that occurs c times is a candidate. Candidates then
are probed in the long lists: the shingles of one document by binary search among the sorted shingles of the other,
which gives the exact overlap. Shingles that only one document has are neither shuffled nor merged. No document,
list or pair is capped.

Texts are cut into shingles once, into slices (see :mod:`orbita.llm.exchange`) that stay where they are; how many
documents have a shingle is counted exactly, by ranges of the shingle space. Documents with the very same shingles
are one class: only its representative is searched for. A list longer than HOT_LIST is cut into blocks, and each
pair of blocks is joined under a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbita.functions.runtime import cut, free
from orbita.llm.exchange import Slices, answered, ask, range_bits, slice_numbers

#: Texts of about so many bytes are cut into shingles together.
SLICE_BYTES = 2 << 20
#: A slice holds about so many bytes of shingles, and at most so many documents.
SLICE_SHINGLES, SLICE_DOCUMENTS = 8 << 20, 1 << 15
#: Short lists a similar pair is sure to share (the T - L of DivideSkip).
SHORT_HITS = 2
#: Documents of a block of a list.
HOT_LIST = 4096

_WORD = np.zeros(256, np.uint8)
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = _c + 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of an Arrow string array: row and 48-bit hash, sorted by both.

    A word is a longest run of ASCII letters, digits and underscores, case ignored; a shingle is
    ``width`` words in a row. Nulls and texts of fewer words have none. At most 65,536 rows.
    """
    texts = texts.cast(pa.large_string())
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None:
        return none
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    low = _WORD[data]
    inside = low != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = inside[edge]
    starts = np.flatnonzero(start)
    if not len(starts):
        return none
    at = np.flatnonzero(inside)
    first = np.flatnonzero(start[at])
    lengths = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    words = _mix(np.add.reduceat(low[at].astype(np.uint64) * _powers(int(lengths.max()))[within], first) + lengths.astype(np.uint64))
    row = np.searchsorted(offsets, starts, side="right") - 1
    last = len(words) - width + 1
    if last <= 0:
        return none
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k:last + k]
    ok = row[:last] == row[width - 1:]
    own = np.unique((row[:last][ok].astype(np.uint64) << np.uint64(48)) | (_mix(h[ok]) & _LOW48))
    return (own >> np.uint64(48)).astype(np.int64), own & _LOW48


def _pack(tokens: np.ndarray) -> np.ndarray:
    """48-bit shingles as six bytes each."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _unpack(blob: np.ndarray) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = blob.reshape(-1, 6)
    return out.ravel().view(np.uint64)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Held:
    """What a slice holds: ids, and of each field the number of shingles and the sorted shingles of each document."""

    slice: int
    ids: np.ndarray
    counts: list
    tokens: list

    @staticmethod
    def of(batch: pa.RecordBatch, k: int, fields: int) -> Held:
        whole = lambda name, kind: np.frombuffer(batch.column(name)[k].as_py(), kind)
        return Held(batch.column("slice")[k].as_py(), whole("ids", np.int64), [whole(f"n{i}", np.int32).astype(np.int64) for i in range(fields)], [_unpack(whole(f"tokens{i}", np.uint8)) for i in range(fields)])

    def chosen(self, field: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the documents of the places ``docs``: the number of shingles of each, and all their shingles."""
        n = self.counts[field]
        size = n[docs]
        start = (np.cumsum(n) - n)[docs] - (np.cumsum(size) - size)
        return size, self.tokens[field][np.repeat(start, size) + np.arange(int(size.sum()))]


def _told(batch: pa.RecordBatch, name: str, k: int, field: int) -> np.ndarray:
    """Places of the documents of a field that an answer (``field``, ``doc``) names, in order."""
    cell = batch.column(name)[k]
    if not cell.is_valid:
        return np.zeros(0, np.int64)
    docs = cell.values.field("doc").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.sort(docs[cell.values.field("field").to_numpy(zero_copy_only=False) == field])


def _sliced(df: DataFrame, names: list[str], width: int) -> DataFrame:
    """Slices of the documents: ``slice, ids`` and for each field ``n, tokens``."""
    cols = ["slice", "ids", *[c for i in range(len(names)) for c in (f"n{i}", f"tokens{i}")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        ids: list = []
        parts: list[list] = [[] for _ in names]

        def out() -> pa.RecordBatch:
            arrays = [pa.array([next(numbers)]), pa.array([np.concatenate(ids).tobytes()], pa.binary())]
            for own in parts:
                arrays += [pa.array([np.concatenate([n for n, _ in own]).tobytes()], pa.binary()), pa.array([np.concatenate([t for _, t in own]).tobytes()], pa.binary())]
            ids.clear()
            for own in parts:
                own.clear()
            return pa.RecordBatch.from_arrays(arrays, names=cols)

        for batch in batches:
            for part in _slices(batch):
                if sum(map(len, ids)) + part.num_rows > SLICE_DOCUMENTS or sum(len(t) for own in parts for _, t in own) > SLICE_SHINGLES:
                    yield out()
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for field, own in enumerate(parts):
                    row, tokens = shingles(part.column(field + 1), width)
                    own.append((np.bincount(row, minlength=part.num_rows).astype(np.int32), _pack(tokens)))
        if ids:
            yield out()

    return df.mapInArrow(run, "slice bigint, ids binary, " + ", ".join(f"n{i} binary, tokens{i} binary" for i in range(len(names))))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = min(SLICE_DOCUMENTS, max(1, SLICE_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _ranked(sent: list) -> list:
    """How rare each slice's shingles are: 1 where one document has it, above that 1 + 8 log2 of the number, which never
    falls with the number."""
    keys = np.concatenate([k for k, _ in sent])
    own, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([c for _, c in sent]).astype(np.float64), minlength=len(own))
    rank = np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[at]
    return np.split(rank, np.cumsum([len(k) for k, _ in sent])[:-1])


def _blocks(rank: np.ndarray, size: int) -> np.ndarray:
    """Blocks of ``size`` of a list whose shingle has a rank."""
    return np.ceil(2 ** ((rank.astype(np.float64) - 1) / 8) / size).astype(np.int64)


@dataclass
class _Maps:
    """What is done to slices and pairs, batch by batch."""

    fields: int
    num: int
    den: int

    def sets(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document with shingles two numbers that stand for the set of them."""
        for batch in batches:
            for k in range(batch.num_rows):
                held = Held.of(batch, k, self.fields)
                for field, n in enumerate(held.counts):
                    there = np.flatnonzero(n)
                    if len(there):
                        start = (np.cumsum(n) - n)[there]
                        d1, d2 = (np.add.reduceat(_mix(held.tokens[field] + seed), start).view(np.int64) for seed in (_BASE, _LOW48))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(there), field, np.int32)), pa.array(held.ids[there]), pa.array((held.slice << 16) + there), pa.array(n[there].astype(np.int32)), pa.array(d1), pa.array(d2)],
                            names=["field", "id", "loc", "n", "d1", "d2"],
                        )

    def lists(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All shingles of the documents asked for, sorted."""
        for batch in batches:
            for k in range(batch.num_rows):
                held = Held.of(batch, k, self.fields)
                for field in range(self.fields):
                    docs = _told(batch, "answers", k, field)
                    n, tokens = held.chosen(field, docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(docs), field, np.int32)), pa.array((held.slice << 16) + docs), pa.array(held.ids[docs]), _binary(_pack(tokens), 6 * np.concatenate([[0], np.cumsum(n)]))],
                        names=["field", "loc", "id", "tokens"],
                    )

    def probe(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact overlap of candidates by binary search."""
        for batch in batches:
            step = 1 << 12
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                side = []
                for k in (5, 6):
                    data, offsets = _blobs(part.column(k))
                    sizes = np.diff(offsets) // 6
                    side.append((_unpack(data) | (np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64) << np.uint64(48)), sizes))
                (a, a_sizes), (b, b_sizes) = side
                there = np.searchsorted(b, a)
                hit = b[np.minimum(there, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
                both = np.bincount((a[hit] >> np.uint64(48)).astype(np.int64), minlength=part.num_rows)
                ok = self.den * both >= self.num * (a_sizes + b_sizes - both)
                yield part.select([0, 1, 2, 3, 4]).filter(pa.array(ok))


class Near:
    """The near-duplicates of a table: see :func:`near_pairs` and :func:`near_groups`.

    ``members`` has ``field, id, loc, d1, d2`` of each document that takes part in a field (the two numbers stand for its
    set of shingles); ``representatives`` the one of smallest id of each set, with ``copies``; ``pairs`` all pairs
    of representatives, ``field`` (number), ``a, b`` (locs), ``id_a, id_b``.
    """

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], leave_out: DataFrame | None, width: int, num: int, den: int):
        self.fields, self.num, self.den = fields, num, den
        self.maps = _Maps(len(fields), num, den)
        names = [f"f{i}" for i in range(len(fields))]
        rows = df.where(df[id_col].isNotNull()).select(df[id_col].cast("bigint").alias("id"), *[df[f].cast("string").alias(n) for f, n in zip(fields, names)])
        self.slices = Slices(_sliced(rows, names, width))
        told = self.slices.rows.mapInArrow(self.maps.sets, "field int, id bigint, loc bigint, n int, d1 bigint, d2 bigint")
        if leave_out is not None:
            told = told.join(leave_out.select(leave_out["id"].cast("bigint").alias("id")), "id", "left_anti").select("field", "id", "loc", "n", "d1", "d2")
        self.members = cut(told)
        best = self.members.groupBy("field", "d1", "d2").agg(F.min(F.struct("id", "loc")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
        self.representatives = cut(best.select("field", "d1", "d2", "rep.id", "rep.loc", "copies", "n"))
        self.pairs = self._pairs()

    @staticmethod
    def _places(docs: DataFrame) -> DataFrame:
        return docs.select(F.shiftright("loc", 16).alias("slice"), "field", F.col("loc").bitwiseAND(65535).cast("int").alias("doc"))

    def _pairs(self) -> DataFrame:
        fields, num, den, hot = range(len(self.fields)), self.num, self.den, HOT_LIST
        # What has so few shingles that no other set of them is similar enough needs no search.
        searched = self.representatives.where(F.col("n") >= -(-num // (den - num)))
        total = searched.agg(F.sum("n")).first()[0] or 0
        shift = 48 - range_bits(total, 48)
        slices = self.slices.bring(self._places(searched), "who").where("who IS NOT NULL")

        def send(batch: pa.RecordBatch) -> list:
            held, out = Held.of(batch, 0, len(fields)), []
            for field in fields:
                keys, counts = np.unique(held.chosen(field, _told(batch, "who", 0, field))[1], return_counts=True)
                out.append((field, keys, counts.astype(np.uint64)))
            return out

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The postings of the short lists, a row each."""
            for batch in batches:
                for k in range(batch.num_rows):
                    held, answers = Held.of(batch, k, len(fields)), batch.column("answers")[k].as_py()
                    for field in fields:
                        docs = _told(batch, "who", k, field)
                        n, tokens = held.chosen(field, docs)
                        keys, at = np.unique(tokens, return_inverse=True)
                        rank = answered(answers, field, keys, shift)[at]
                        row = np.repeat(np.arange(len(docs)), n)
                        order = np.lexsort((tokens, rank, row))
                        tokens, rank = tokens[order], rank[order]
                        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        keep = (rank > 1) & (at < np.repeat(n - (num * n + den - 1) // den + SHORT_HITS, n))
                        tokens, at, row, blocks = tokens[keep], at[keep], row[keep], _blocks(rank[keep], hot)
                        loc = (held.slice << 16) + docs[row]
                        own = (_mix(loc.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                        # A list of several blocks sends each posting to every pair of blocks that has its own.
                        again = np.repeat(np.arange(len(own)), blocks)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        own, many = own[again], blocks[again]
                        cell = np.minimum(own, other) * many + np.maximum(own, other)
                        key = (tokens[again] << np.uint64(4)) | np.uint64(field)
                        columns = (key.view(np.int64), cell, np.where(own == other, -1, own), loc[again], n[row][again].astype(np.int32), at[again].astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cell", "block", "loc", "n", "at"])

        ranks = ask(slices, send, 48, total, _ranked)
        postings = self.slices.bring(ranks, to=slices).mapInArrow(post, "token bigint, cell bigint, block bigint, loc bigint, n int, at int")
        x = postings.select("token", "cell", *[F.col(c).alias(f"x_{c}") for c in ("block", "loc", "n", "at")])
        y = postings.select("token", "cell", *[F.col(c).alias(f"y_{c}") for c in ("block", "loc", "n", "at")])
        sizes = F.col("x_n") + F.col("y_n")
        reach = F.least("x_at", "y_at") + 1 + F.least(F.col("x_n") - F.col("x_at") - 1, F.col("y_n") - F.col("y_at") - 1)
        apart = (F.col("x_block") == -1) | (F.col("x_block") != F.col("y_block"))
        met = (
            x.join(y, ["token", "cell"])
            .where((F.col("x_loc") < F.col("y_loc")) & apart & (den * F.least("x_n", "y_n") >= num * F.greatest("x_n", "y_n")) & ((den + num) * reach >= num * sizes))
            .select(F.col("token").bitwiseAND(15).cast("int").alias("field"), F.col("x_loc").alias("a"), F.col("y_loc").alias("b"), F.least(F.lit(SHORT_HITS), F.ceil(F.lit(float(num)) * sizes / (den + num))).cast("int").alias("least"))
        )
        candidates = met.groupBy("field", "a", "b").agg(F.count("*").alias("hits"), F.max("least").alias("least")).where(F.col("hits") >= F.col("least"))
        candidates = cut(candidates.select("field", "a", "b"))
        asked = candidates.select("field", F.explode(F.array("a", "b")).alias("loc")).distinct()
        lists = self.slices.bring(self._places(asked)).where("answers IS NOT NULL").mapInArrow(self.maps.lists, "field int, loc bigint, id bigint, tokens binary").repartition("field", "loc")
        one = candidates.join(lists.select("field", F.col("loc").alias("a"), F.col("id").alias("one"), F.col("tokens").alias("tokens_a")), ["field", "a"])
        two = one.join(lists.select("field", F.col("loc").alias("b"), F.col("id").alias("two"), F.col("tokens").alias("tokens_b")), ["field", "b"])
        two = two.select("field", "a", "b", "one", "two", "tokens_a", "tokens_b")
        found = two.mapInArrow(self.maps.probe, "field int, a bigint, b bigint, one bigint, two bigint")
        return found.select("field", "a", "b", F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"))

    def named(self) -> F.Column:
        return F.element_at(F.array(*[F.lit(f) for f in self.fields]), F.col("field") + 1).alias("field")

    def classes(self) -> DataFrame:
        """``field, id, rep`` of all documents of the sets that more than one document has."""
        many = self.representatives.where("copies > 1").select("field", "d1", "d2", F.col("id").alias("rep"))
        return self.members.join(many, ["field", "d1", "d2"]).select("field", "id", "rep")


def near_pairs(df: DataFrame, id_col: str, fields: list[str], leave_out: DataFrame | None = None, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """All pairs ``field, id_a, id_b`` (id_a < id_b) of rows whose texts in a field share at least
    ``num/den`` of the distinct shingles found in either.

    ``leave_out`` is a table of ids (column ``id``) that form no pair. Null, empty and short texts
    have no shingle and form no pair; null ids neither. Texts are taken whole. Rows
    that repeat an id repeat its pairs with others. Columns but
    the id and the fields are not read. Empty tables give an empty result.

    Shuffled: of each slice its distinct shingles as differences, of each document a few numbers and its short lists,
    and for each candidate pair the shingles of both sides, six bytes each. The result holds every pair, so
    documents with the very same shingles give the square of their number; :func:`near_groups` does not.
    """
    near = Near(df, id_col, fields, leave_out, width, num, den)
    classes = cut(near.classes())
    one, two = (classes.select("field", F.col("rep").alias(f"id_{x}"), F.col("id").alias(f"own_{x}")) for x in "ab")
    apart = near.pairs.join(one, ["field", "id_a"], "left").join(two, ["field", "id_b"], "left").select("field", F.coalesce("own_a", "id_a").alias("x"), F.coalesce("own_b", "id_b").alias("y"))
    same = one.join(two, (one["field"] == two["field"]) & (one["id_a"] == two["id_b"])).where(F.col("own_a") < F.col("own_b")).select(one["field"], F.col("own_a").alias("x"), F.col("own_b").alias("y"))
    return apart.unionByName(same).select(near.named(), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """``id, group_id``: the smallest id of the connected component of every id in ``edges``
    (``a, b`` of one type). Alternating star contraction; each round's edges are checkpointed, and
    the rounds grow with the logarithm of the longest chain. Null ends and loops are left out."""
    now = cut(edges.where((F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        older, now = now, cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        free(older)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def near_groups(df: DataFrame, id_col: str, fields: list[str], leave_out: DataFrame | None = None, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each row of ``df`` and field with a near-duplicate: ``field, id, group_id, links``.

    ``group_id`` is the smallest id of its group (all that hang together by pairs), ``links`` the number of rows it forms a
    pair with. Documents with the very same shingles are joined to their representative only, and only
    representatives are searched and grouped: no link is lost and no square is made. Same treatment of unusual
    input as :func:`near_pairs`.
    """
    near = Near(df, id_col, fields, leave_out, width, num, den)
    pairs = cut(near.pairs)
    key = lambda c: F.concat_ws(":", "field", F.lpad(F.col(c).cast("string"), 20, "0"))
    both = pairs.select("field", F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(pairs.select("field", F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    size = near.representatives.select("field", "id", "copies")
    near_by = both.join(size.select("field", F.col("id").alias("other"), "copies"), ["field", "other"]).groupBy("field", "id").agg(F.sum("copies").alias("near_by"))
    part = lambda c, i: F.element_at(F.split(F.col(c), ":"), i)
    member = components(pairs.select(key("id_a").alias("a"), key("id_b").alias("b")))
    named = member.select(part("id", 1).cast("int").alias("field"), part("id", 2).cast("bigint").alias("id"), part("group_id", 2).cast("bigint").alias("group_id"))
    reps = (
        size.join(near_by, ["field", "id"], "left").join(named, ["field", "id"], "left").where("copies > 1 OR near_by > 0")
        .select("field", F.col("id").alias("rep"), F.coalesce("group_id", "id").alias("group_id"), (F.col("copies") - 1 + F.coalesce("near_by", F.lit(0))).alias("links"), "copies")
    )
    alone = reps.where("copies = 1").select("field", F.col("rep").alias("id"), "group_id", "links")
    many = near.classes().join(reps.where("copies > 1"), ["field", "rep"]).select("field", "id", "group_id", "links")
    return alone.unionByName(many).select(near.named(), "id", "group_id", "links")
