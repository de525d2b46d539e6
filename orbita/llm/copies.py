"""Records that differ in layout only, collapsed by exact grouping of possible repeats.

A record's canonical form is hashed. Every slice of records (see :mod:`orbita.llm.exchange`) makes a Bloom filter
of the hashes it has; filters are merged block by block into one of hashes seen at least once and one of hashes
seen again, which takes every bit that two slices share or one slice has twice. A block covers a range of the hash
space and there are as many blocks as the records need, so the filters never fill up; each slice gets the second
filter back at its own bits only. A hash that is not in it was seen exactly once: its record is a class
of its own. Of all others each slice sends one row per distinct form, with its smallest id and its number of
copies, to be grouped exactly: a form that a third of all records have is as many rows as there are slices.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbita.llm.exchange import SLICE_ROWS, Slices, answered, ask, range_bits, slice_numbers
from orbita.operators.shredding import parse_json

#: Bits of the filters for each record, of which one is set: a record alone is taken for a possible repeat in one of so many cases.
BITS_PER_ROW = 32

_NO_ALNUM = re.compile(r"[^A-Za-z0-9]+")


def _plain(text: str) -> str:
    return _NO_ALNUM.sub("", text).lower()


def json_form(text: str) -> str | None:
    """Canonical form of a text that is one JSON object as a whole, else None.

    Names and single values keep their ASCII letters and digits, case ignored (numbers as they are
    written); fields are sorted; of a name repeated in one object the last counts. Nesting may be of any depth.
    """
    try:
        value = parse_json(text, strict=True)
    except ValueError:
        return None
    return _form(value) if type(value) is dict else None


def _form(value) -> str:
    """Written from the inside out, with a stack: an open value waits until the forms of its parts are there."""
    done: list[str] = []
    todo: list = [(value, False)]
    while todo:
        v, parts_there = todo.pop()
        if type(v) is not dict and type(v) is not list:
            done.append(_plain(v) if isinstance(v, str) else {True: "true", False: "false", None: "null"}[v])
        elif not parts_there:
            todo.append((v, True))
            todo += [(x, False) for x in reversed(v.values() if type(v) is dict else v)]
        else:
            parts = done[len(done) - len(v):]
            del done[len(done) - len(v):]
            done.append("{" + ",".join(sorted(f"{_plain(k)}:{x}" for k, x in zip(v, parts))) + "}" if type(v) is dict else "[" + "".join(x + "," for x in parts) + "]")
    return done[0]


_BLANKS = " \t\r\n"
_DROP = bytes(b for b in range(256) if not chr(b).isalnum() or b > 127)
_LOWER = bytes(range(256)).lower()


def canonical_digest(text: str | None) -> bytes | None:
    """Digest of a source's canonical form; None where it is null or has no ASCII letter or digit.

    Bytes of characters beyond ASCII are all above 127, so letters and digits are kept byte by byte."""
    if text is None:
        return None
    plain = text.encode("utf-8", "replace").translate(_LOWER, _DROP)
    if not plain:
        return None
    if text.lstrip(_BLANKS)[:1] == "{" and (form := json_form(text)) is not None:
        plain = b"{" + form.encode("utf-8", "replace")
    return hashlib.sha256(plain).digest()


def _packed(df: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Slices of the records that take part: ``slice, n, ids, keys``, in order of key and id; a key has 32 bytes."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("keys", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        held: list[pa.Table] = []

        def slices(least: int) -> Iterator[pa.RecordBatch]:
            while sum(t.num_rows for t in held) >= least:
                both = pa.concat_tables(held)
                own, rest = both.slice(0, SLICE_ROWS), both.slice(SLICE_ROWS)
                held[:] = [rest]
                own = own.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks()
                ids = own.column("id").combine_chunks()
                ends = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), pa.array([len(ids)], pa.int32()), pa.ListArray.from_arrays(ends, ids), pa.array([b"".join(own.column("key").to_pylist())], pa.binary())], names=schema.names)

        for batch in batches:
            key = pa.array([canonical_digest(t) for t in batch.column(1).to_pylist()], pa.binary())
            took = key.is_valid()
            held.append(pa.table({"id": batch.column(0).filter(took), "key": key.filter(took)}))
            yield from slices(SLICE_ROWS)
        if held:
            yield from slices(1)

    return df.where(df[id_col].isNotNull() & df[source_col].isNotNull()).select(df[id_col].alias("id"), df[source_col].cast("string").alias("source")).mapInArrow(run, schema)


def _runs(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key of a slice begins, and its hash: the key's first 64 bits."""
    blocks = np.frombuffer(keys, np.uint8).reshape(-1, 32)
    fresh = np.ones(len(blocks), bool)
    fresh[1:] = (blocks[1:] != blocks[:-1]).any(axis=1)
    starts = np.flatnonzero(fresh)
    return starts, np.ascontiguousarray(blocks[starts, :8]).view(">u8").ravel().astype(np.uint64)


def _set_bits(keys: bytes, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: the bits its filter has set, how many records set each, where its keys begin, and the bit of each."""
    starts, hashes = _runs(keys)
    bit = hashes >> np.uint64(64 - bits)
    fresh = np.ones(len(bit), bool)
    fresh[1:] = bit[1:] != bit[:-1]
    return bit[fresh], np.diff(np.append(starts[fresh], n)).astype(np.uint64), starts, np.cumsum(fresh) - 1


def _merged(sent: list) -> list:
    """One block of the filters merged over the slices; of each slice's bits, whether the second filter has them."""
    low = min(int(k[0]) for k, _ in sent)
    once = np.zeros(max(int(k[-1]) for k, _ in sent) - low + 1, bool)
    again = np.zeros(len(once), bool)
    for bits, counts in sent:
        at = (bits - np.uint64(low)).astype(np.int64)
        again[at] |= once[at] | (counts > 1)
        once[at] = True
    return [again[(bits - np.uint64(low)).astype(np.int64)].view(np.uint8) for bits, _ in sent]


def possible_repeats(slices: Slices, kind: T.DataType) -> DataFrame:
    """``slice, run, key, least, n``: of each slice the distinct keys that the second filter has, with their place,
    smallest id and number of records."""
    rows = slices.rows.agg(F.sum("n")).first()[0] or 0
    bits = max(1, rows * BITS_PER_ROW).bit_length()
    shift = bits - range_bits(rows, bits)

    def keys_of(one: pa.RecordBatch) -> list:
        bit, counts, _, _ = _set_bits(one.column("keys")[0].as_py(), one.column("n")[0].as_py(), bits)
        return [(0, bit, counts)]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, n, keys = (batch.column(c)[k].as_py() for c in ("slice", "n", "keys"))
                bit, _, starts, bit_of = _set_bits(keys, n, bits)
                run = np.flatnonzero(answered(batch.column("answers")[k].as_py(), 0, bit, shift)[bit_of])
                if len(run):
                    ids = batch.column("ids")[k].values
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(run), number)), pa.array(run.astype(np.int32)), pa.array([keys[32 * i:32 * i + 32] for i in starts[run].tolist()], pa.binary()),
                            ids.take(pa.array(starts[run])), pa.array(np.diff(np.append(starts, n))[run]),
                        ],
                        names=schema.names,
                    )

    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("run", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("least", kind), T.StructField("n", T.LongType())])
    return slices.bring(ask(slices.rows, keys_of, bits, rows, _merged)).mapInArrow(pick, schema)


def copy_classes(df: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """One row per record that takes part: ``id``, ``first_id`` (smallest id of its class) and
    ``copies`` (rows in the class, 1 for a record alone).

    Sources are equal if they are once all but the ASCII letters and digits is dropped and case is
    ignored; a source that is a JSON object as a whole is compared as a value instead (see
    :func:`json_form`), and never equals one that is not. Null sources, sources without an ASCII
    letter or digit and null ids take no part. Rows that repeat an id count as copies of each other.
    Other columns are not read. Empty tables give an empty result.
    """
    kind = df.schema[id_col].dataType
    slices = Slices(_packed(df, id_col, source_col))
    of_key = Window.partitionBy("key")
    classes = possible_repeats(slices, kind).select("slice", "run", F.min("least").over(of_key).alias("first_id"), F.sum("n").over(of_key).alias("copies"), F.count("*").over(of_key).alias("slices"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("first_id", kind), T.StructField("copies", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, _ = _runs(batch.column("keys")[k].as_py())
                ids = batch.column("ids")[k].values
                sizes = np.diff(np.append(starts, len(ids)))
                first, source, copies = ids, starts.copy(), sizes.astype(np.int64)
                told = batch.column("answers")[k]
                if told.is_valid:
                    told = told.values
                    run = told.field("run").to_numpy(zero_copy_only=False)
                    first = pa.concat_arrays([ids, told.field("first_id")])
                    source[run] = len(ids) + np.arange(len(run))
                    copies[run] = told.field("copies").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([ids, first.take(pa.array(np.repeat(source, sizes))), pa.array(np.repeat(copies, sizes))], names=schema.names)

    # Only forms that more than one slice has need an answer; a slice knows all about the others.
    return slices.bring(classes.where("slices > 1").drop("slices")).mapInArrow(assign, schema)
