"""Slices of rows that stay where they are, and what all slices together know about their keys.

A table is written once as slices: one row holds thousands of records as sorted arrays. What a step needs to
know about a slice's keys from all other slices is asked for and answered in compressed form: the slice sends
its distinct keys, cut up by ranges of the key space, as differences; one task a range merges what all slices sent
for it; the answers go back by slice. The slices themselves are never shuffled (they lie in buckets by slice
number, the answers are brought to the buckets), nothing passes through the driver, nothing is broadcast, and the
ranges grow in number, not in size, with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbita.functions.runtime import cut_in_place

#: Records of a slice at most; a record's place within its slice takes 16 bits.
SLICE_ROWS = 1 << 16
#: Distinct keys that the slices send for one range, about.
RANGE_KEYS = 1 << 20


def slice_numbers() -> Iterator[int]:
    """Numbers of the slices one task makes; no other task makes the same."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 20
    while True:
        yield at
        at += 1


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes: planes that are all alike cost next to nothing."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(values).to_bytes(4, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_ints(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    planes = np.frombuffer(pa.decompress(blob[5:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.ravel().view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(blob), dtype=np.uint64)


class Slices:
    """A table of slices, written once: column ``slice`` and whatever a slice holds."""

    def __init__(self, table: DataFrame):
        self.rows = cut_in_place(table, "slice")
        self.buckets = self.rows._orbita_buckets

    def bring(self, answers: DataFrame, name: str = "answers", to: DataFrame | None = None) -> DataFrame:
        """The slices (or ``to``, made of them), each with an array ``name`` of the rows of ``answers`` for it; null
        where there are none."""
        own = [c for c in answers.columns if c != "slice"]
        lists = answers.repartition(self.buckets, "slice").groupBy("slice").agg(F.collect_list(F.struct(*own)).alias(name))
        return (self.rows if to is None else to).join(lists.hint("shuffle_hash"), "slice", "left")


def ask(slices: DataFrame, keys_of: Callable[[pa.RecordBatch], list], bits: int, total: int, merge: Callable[[list], list]) -> DataFrame:
    """``slice, field, range, answer``: what ``merge`` makes of the keys all slices sent.

    ``keys_of`` gives of a slice (a batch of its one row) a list of ``(field, keys, counts)``
    with sorted distinct keys below ``2**bits`` and how many records have each. ``total`` is about how many keys
    there are. ``merge`` gets what the slices sent for one range, a list of ``(keys, counts)``, and gives one
    uint8 array for each, as long as its keys. Answers are compressed; see :func:`answered`.
    """
    shift = bits - range_bits(total, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                own = one.column("slice")[0].as_py()
                out: list[tuple] = []
                for field, keys, counts in keys_of(one):
                    for number, a, b in segments(keys, shift):
                        out.append((own, field, number, pack_sorted(keys[a:b]), pack_ints(counts[a:b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["slice", "field", "range", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        sent = [(unpack_sorted(k), unpack_ints(c)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
        told = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in merge(sent)]
        return table.select(["slice", "field", "range"]).append_column("answer", pa.array(told, pa.binary()))

    sent = slices.mapInArrow(send, "slice bigint, field int, range bigint, keys binary, counts binary")
    return sent.groupBy("field", "range").applyInArrow(answer, "slice bigint, field int, range bigint, answer binary")


def range_bits(total: int, bits: int) -> int:
    return min(bits, max(0, total // RANGE_KEYS).bit_length())


def segments(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """Runs of sorted keys that lie in one range: its number, where they begin and end."""
    if len(keys):
        number = keys >> np.uint64(shift)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(keys)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(number[a]), a, b


def answered(answers: list | None, field: int, keys: np.ndarray, shift: int) -> np.ndarray:
    """The answers to a slice's ``keys`` of a field, in their order."""
    out = np.zeros(len(keys), np.uint8)
    told = {a["range"]: a["answer"] for a in answers or [] if a["field"] == field}
    for number, a, b in segments(keys, shift):
        out[a:b] = np.frombuffer(pa.decompress(told[number], decompressed_size=b - a, codec="zstd", asbytes=True), np.uint8)
    return out
