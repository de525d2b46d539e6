"""Columnar shredding of deeply nested JSON into flat tables with parent links.

Each document becomes, per path, a column of entries ``(record, repetition level, definition
level, value)``: the repetition level says at which array an entry continues, the definition
level how much of its path is there. An array with nothing in it, or missing within a record that
has it elsewhere, leaves one entry of lower definition level, so that positions of all enclosing
arrays can be told from the levels alone. The table of a repeated ancestor is then rebuilt from
the level sequence of its element column: positions are running counts of one repetition level
since the last smaller one. Scalars directly under an ancestor line up with its element column.

Everything happens inside one map over Arrow batches: no shuffle, no state between batches.
"""

from __future__ import annotations

import contextlib
import gc
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_MISSING = object()
#: Texts of about so many bytes are shredded together; it bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20


class Number(str):
    """A number of a JSON text as it is written, of any length; no string of the text."""


_TOKEN = re.compile(r'''[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|(NaN|-?Infinity))''')
_NAMED = {"true": True, "false": False, "null": None}


def _tokens(text: str, constant_of=Number) -> Iterator:
    """Marks as one-letter strings, values as one-tuples."""
    at, end = 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(at)
        at = found.end()
        mark, string, number, named, constant = found.groups()
        yield mark or (json.loads(string) if string else Number(number) if number else constant_of(constant) if constant else _NAMED[named],)


def _read_deep(text: str, constant=Number):
    """The value of a JSON text nested beyond what the parser can hold: a stack instead of recursion."""
    stack: list = []  # open arrays and objects
    names: list = []  # the name that waits for its value, of each open object
    value, want = _MISSING, "value"
    for token in _tokens(text, constant):
        if want == "end":
            raise ValueError(text[:20])
        done = _MISSING
        if type(token) is tuple:
            if want in ("name", "name or close"):
                if type(token[0]) is not str:
                    raise ValueError("name")
                names[-1], want = token[0], ":"
                continue
            if want not in ("value", "value or close"):
                raise ValueError(want)
            done = token[0]
        elif token in "[{" and want in ("value", "value or close"):
            stack.append([] if token == "[" else {})
            names.append(None)
            want = "value or close" if token == "[" else "name or close"
            continue
        elif token == ":" and want == ":":
            want = "value"
            continue
        elif token == "," and want == "next":
            want = "value" if type(stack[-1]) is list else "name"
            continue
        elif token in "]}" and want in ("next", "value or close", "name or close") and stack and type(stack[-1]) is (list if token == "]" else dict):
            done = stack.pop()
            names.pop()
        else:
            raise ValueError(token)
        if not stack:
            value, want = done, "end"
        else:
            if type(stack[-1]) is list:
                stack[-1].append(done)
            else:
                stack[-1][names[-1]] = done
            want = "next"
    if want != "end":
        raise ValueError("cut off")
    return value


def _refused(name: str):
    raise ValueError(name)


def parse_json(text: str, strict: bool = False):
    """The value of a JSON text, its numbers as written; ValueError where it is not one complete value.
    NaN and the infinities, which many writers write, are numbers unless ``strict``."""
    constant = _refused if strict else Number
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=constant)
    except RecursionError:
        return _read_deep(text, constant)


def read_json(text: str | None):
    """The value of a JSON text; a JSON string that holds JSON is read as its content.

    Anything that is not one complete JSON value (null, empty, cut off) gives ``_MISSING``. Numbers of any
    length and nesting of any depth are read.
    """
    if text is None:
        return _MISSING
    try:
        value = parse_json(text)
        while type(value) is str:
            value = parse_json(value)
    except ValueError:
        return _MISSING
    return value


@dataclass
class LevelColumn:
    """One path of a batch: the last step (a name, ``None`` for an array step) and the column above it."""

    above: LevelColumn | None
    step: str | None
    record: np.ndarray
    rep: np.ndarray
    definition: np.ndarray
    values: list
    max_def: int
    max_rep: int
    leaves: list = dc_field(default_factory=list)

    @property
    def steps(self) -> list:
        out, col = [], self
        while col.above is not None:
            out.append(col.step)
            col = col.above
        return out[::-1]


def shred(docs: list) -> list[LevelColumn]:
    """The element column of every repeated path of ``docs``, each with its scalar leaf columns.

    ``docs`` are parsed values or ``_MISSING``. A record takes part in a path's column if the path
    is there at least once in the record; then all its enclosing elements have an entry.
    """
    out: list[LevelColumn] = []
    there = [i for i, d in enumerate(docs) if d is not _MISSING]
    n = len(there)
    root = LevelColumn(None, None, np.array(there, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32), [docs[i] for i in there], 0, 0)
    stack = [(root, root)]
    while stack:
        col, owner = stack.pop()
        kinds = set(map(type, col.values))
        if list in kinds:
            child = _enter_array(col)
            out.append(child)
            stack.append((child, child))
        if dict in kinds:
            names: dict = {}
            for v in col.values:
                if type(v) is dict:
                    names.update(dict.fromkeys(v))
            for name in names:
                stack.append((_enter_field(col, name), owner))
        if kinds - {dict, list, object}:
            owner.leaves.append(col)
    root.leaves.clear()
    return out


def _enter_field(col: LevelColumn, name: str) -> LevelColumn:
    values = [v.get(name, _MISSING) if type(v) is dict else _MISSING for v in col.values]
    present = np.fromiter((v is not _MISSING for v in values), bool, len(values))
    rec, rep, definition = col.record, col.rep, col.definition + present
    if not present.all():
        has = np.zeros(int(rec[-1]) + 1, bool)
        has[rec[present]] = True
        keep = has[rec]
        if not keep.all():
            rec, rep, definition = rec[keep], rep[keep], definition[keep]
            values = [v for v, k in zip(values, keep.tolist()) if k]
    return LevelColumn(col, name, rec, rep, definition.astype(np.int32), values, col.max_def + 1, col.max_rep)


def _enter_array(col: LevelColumn) -> LevelColumn:
    is_list = [type(v) is list for v in col.values]
    mask = np.fromiter(is_list, bool, len(is_list))
    has = np.zeros(int(col.record[-1]) + 1, bool)
    has[col.record[mask]] = True
    keep = has[col.record]
    sizes = np.fromiter((len(v) if i else 0 for v, i in zip(col.values, is_list)), np.int64, len(is_list))
    level = col.max_rep + 1
    values: list = []
    for v, i, k in zip(col.values, is_list, keep.tolist()):
        if i and v:
            values.extend(v)
        elif k:
            values.append(_MISSING)
    sizes, record, rep, definition = sizes[keep], col.record[keep], col.rep[keep], col.definition[keep]
    entries = np.maximum(sizes, 1)
    source = np.repeat(np.arange(len(sizes)), entries)
    first = np.zeros(len(source), bool)
    first[np.cumsum(entries) - entries] = True
    return LevelColumn(
        col, None, record[source], np.where(first, rep[source], level).astype(np.int32),
        (definition[source] + (sizes[source] > 0)).astype(np.int32), values, col.max_def + 1, level,
    )


def positions(rep: np.ndarray, level: int) -> np.ndarray:
    """Position within the array of ``level`` of each entry: entries that repeat at that level since
    the last one that repeats further out."""
    count = np.cumsum(rep == level)
    start = np.where(rep < level, np.arange(len(rep)), 0)
    return count - count[np.maximum.accumulate(start)]


def _templates(steps: list) -> tuple[str, str, str, int]:
    """Formats of the path, of the nearest enclosing object that is an element, the table name, and
    how many positions the parent's format takes."""
    path, name, parent, used, parent_used = ["$"], ["$"], 1, 0, 0
    for at, s in enumerate(steps):
        if s is None:
            path.append("[%d]")
            name.append("[]")
            used += 1
            if at + 1 < len(steps) and steps[at + 1] is not None:
                parent, parent_used = len(path), used
        else:
            path.append("." + s.replace("%", "%%"))
            name.append("." + s)
    return "".join(path), "".join(path[:parent]), "".join(name), parent_used


def _text(value) -> str | None:
    """A scalar as text: strings and numbers as they are, true and false by name."""
    if value is None or isinstance(value, str):
        return value
    return "true" if value else "false"


def assemble(col: LevelColumn) -> tuple[np.ndarray, str, list[str], list[str], pa.Array | None]:
    """Rows of one repeated ancestor from its levels: record, table, path, parent path, scalars."""
    is_object = np.fromiter((type(v) is dict for v in col.values), bool, len(col.values))
    rows = np.flatnonzero(is_object & (col.definition == col.max_def))
    if not len(rows):
        return col.record[rows], "", [], [], None
    steps = col.steps
    path, parent, name, parent_used = _templates(steps)
    at = [positions(col.rep, k)[rows].tolist() for k in range(1, col.max_rep + 1)]
    paths = [path % p for p in zip(*at)]
    parents = [parent % p for p in zip(*at[:parent_used])] if parent_used else ["$"] * len(rows)
    row_of = np.zeros(len(col.values), np.int64)
    row_of[rows] = np.arange(len(rows))
    at_rows, labels, texts = [np.zeros(0, np.int64)], [], []
    for leaf in col.leaves:
        if leaf is col:
            continue
        mine = np.zeros(int(col.record[-1]) + 1, bool)
        mine[leaf.record] = True
        scalar = [v is not _MISSING and type(v) is not dict and type(v) is not list for v in leaf.values]
        at_rows.append(row_of[np.flatnonzero(mine[col.record])[np.array(scalar, bool)]])
        labels += [".".join(leaf.steps[len(steps):])] * len(at_rows[-1])
        texts += [_text(v) for v, s in zip(leaf.values, scalar) if s]
    at_row = np.concatenate(at_rows)
    order = pa.array(np.argsort(at_row, kind="stable"))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(at_row, minlength=len(rows)))]).astype(np.int32)
    return col.record[rows], name, paths, parents, pa.MapArray.from_arrays(pa.array(offsets), _strings(labels).take(order), _strings(texts).take(order))


def _level_values(col: LevelColumn, is_element: bool) -> list:
    """What the shredded form shows of a column: kinds of elements, or scalars as text."""
    if is_element:
        return [{dict: "object", list: "array", object: None}.get(type(v), "scalar") for v in col.values]
    return [None if v is _MISSING or type(v) in (dict, list) else _text(v) for v in col.values]


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # lone surrogates written as escapes
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


@contextlib.contextmanager
def _without_collector():
    """Values of JSON texts hold no cycles; the collector would walk all of them again and again. Columns are taken apart by
    :func:`_released`."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _released(columns: list[LevelColumn]) -> None:
    for col in columns:
        col.leaves.clear()


def nested_tables(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Flat tables of all JSON objects that are array elements, at any depth, of the JSON ``fields``.

    One row for each object: ``id`` (of ``id_col``, any type), ``field``, ``path`` (``$.a[0].b``),
    ``parent_path`` (nearest enclosing object that is itself an element, else ``$``), ``table`` (the path without
    positions) and ``scalars`` (a map of the scalars that belong to the object itself and to no deeper array, as
    text, numbers as written).

    Null, empty, cut-off or otherwise unreadable fields give no rows; a JSON string that holds JSON
    is read as its content; of a name repeated in one object the last counts; lone surrogates in
    names become ``?``; numbers may have any length, nesting any depth. Rows repeated in ``df`` give their rows
    again; null ids are kept. Other columns of ``df``, whatever their names, are not read. Empty tables give an
    empty result.
    """
    text = T.StringType()
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(c, text) for c in ("field", "path", "parent_path", "table")], T.StructField("scalars", T.MapType(text, text))])
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _without_collector():
            for batch in batches:
                for part in _slices(batch):
                    yield from tables(part)

    def tables(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = part.column(0)
        for k, name in enumerate(names, 1):
            docs = [read_json(t) for t in part.column(k).to_pylist()]
            columns = shred(docs)
            for col in columns:
                record, tab, paths, parents, scalars = assemble(col)
                if not len(record):
                    continue
                n = len(record)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(record)), pa.array([name] * n, pa.string()), _strings(paths), _strings(parents), _strings([tab] * n), scalars], names=schema.names)
            _released(columns)

    return df.select(df[id_col].alias("id"), *[df[f].cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, SLICE_BYTES // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def level_columns(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """The shredded form itself: one row per entry of each column of ``field``.

    ``id, path, entry, rep, def, max_def, value``: element columns end in ``[]`` (their value tells
    the kind of element), scalar columns in a name. Same treatment of unusual input as
    :func:`nested_tables`.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("path", T.StringType()), T.StructField("entry", T.IntegerType()), T.StructField("rep", T.IntegerType()), T.StructField("def", T.IntegerType()), T.StructField("max_def", T.IntegerType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                docs = [read_json(t) for t in part.column(1).to_pylist()]
                for element in shred(docs):
                    for col in [element, *[x for x in element.leaves if x is not element]]:
                        n = len(col.values)
                        values = _level_values(col, col is element)
                        start = np.maximum.accumulate(np.where(col.rep == 0, np.arange(n), 0))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(col.record)), _strings([_templates(col.steps)[2]] * n), pa.array((np.arange(n) - start).astype(np.int32)), pa.array(col.rep), pa.array(col.definition), pa.array(np.full(n, col.max_def, np.int32)), _strings(values)],
                            names=["id", "path", "entry", "rep", "def", "max_def", "value"],
                        )

    return df.select(df[id_col].alias("id"), df[field].cast("string").alias("f")).mapInArrow(run, schema)
