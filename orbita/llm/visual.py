"""One form for texts that look the same, by table lookups over code points.

A batch's text is copied once to an array of code points. A lookup table tells how many code points
each becomes (none for what shows nothing, one, or the parts of a decomposed letter); offsets of
the expansion place them. Marks are sorted into canonical order within their runs and composed with
their letters by binary search over sorted pairs, the k-th mark of all runs at once. No string
function is called for a single row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbita.functions.runtime import cut, digest

#: Texts of about so many bytes are folded together.
SLICE_BYTES = 8 << 20

# Letters and signs that look like another, each beside the one it becomes. They go before the list of
# confusable_letters, which has about a thousand more, all of them letters that look like an ASCII letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Γ": "Г", "Π": "П", "Φ": "Ф", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "µ": "μ", "ɡ": "g", "‐": "-", "‑": "-", "ʼ": "’",
}
# Letters of that list which only look like the ASCII letter in slanted or old type; upright, a reader sees the difference.
NOT_ALIKE = "гЬγσɣ"
#: Compatibility forms that look like their parts: digraphs, Roman numerals, ligatures.
_SAME_LOOK = [(0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17)]
#: Code points outside category Cf that show nothing.
_BLANK = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
#: Format characters that do show: signs written under or over numbers.
_SHOWN_FORMAT = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
_LINE_ENDS = (0x0B, 0x0C, 0x85, 0x2028, 0x2029)


@dataclass
class Tables:
    count: np.ndarray  # how many code points each becomes
    start: np.ndarray  # where they begin in flat
    flat: np.ndarray
    order: np.ndarray  # canonical combining class
    pair_keys: np.ndarray  # first << 32 | second, sorted
    pair_to: np.ndarray


def _within(cp: int, ranges: list) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of any script that Unicode's list of confusable characters (UTS #39) takes for an ASCII letter, each
    beside that letter, as the ICU library that comes with Spark has the list.

    Only single letters beyond ASCII with a single ASCII letter behind them are taken. The list puts ``I``, ``l`` and ``1``
    together, so capitals become I and others l. Left out are digits and signs (changed digits are a visible
    difference), those of NOT_ALIKE, letters that stand for two (the list takes m for rn), and jamo, which make up syllables.
    Without that library, or where its answer isn't one form a letter, it is an error: fewer letters would miss pairs unseen.
    """
    letters = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo") and not 0x1100 <= c <= 0x11FF and not 0x3400 <= c <= 0x9FFF and not 0xAC00 <= c <= 0xD7A3]
    jvm = spark.sparkContext._jvm
    try:
        spoof = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as error:  # py4j takes a class that isn't there for a package, which can't be called
        raise RuntimeError("look-alike letters need the ICU library (icu4j, in Spark since 4.0) on the driver's class path") from error
    skeletons = lambda marks: spoof.getSkeleton("\n".join(marks)).split("\n")
    ascii_letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    behind: dict[str, list] = {}
    for letter, form in zip(ascii_letters, skeletons(ascii_letters), strict=True):
        behind.setdefault(form, []).append(letter)
    out = {}
    for letter, form in zip(letters, skeletons(letters), strict=True):
        found = behind.get(form, [])
        if len(found) > 1:
            found = [x for x in found if x.isupper() == (unicodedata.category(letter) == "Lu")][:1]
        if found and letter not in NOT_ALIKE and len(unicodedata.normalize("NFD", letter)) == 1:
            out[letter] = found[0]
    return out


def _parts(cp: int, look_alikes: dict[str, str]) -> list[int]:
    """What a code point becomes, by rule from the Unicode database and the look-alikes."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in _LINE_ENDS:
        return [10]
    if (kind == "Cf" and not _within(cp, _SHOWN_FORMAT)) or _within(cp, _BLANK) or (kind == "Cc" and ch not in "\t\n\r"):
        return []
    if kind == "Zs" and cp != 0x1680:
        return [32]
    if ch in look_alikes:
        return [ord(look_alikes[ch])]
    form = unicodedata.decomposition(ch).split()
    if form and form[0].startswith("<"):
        form = form[1:] if form[0] in ("<wide>", "<narrow>", "<noBreak>") or _within(cp, _SAME_LOOK) else []
    if not form:
        return [cp]
    return [p for x in form for p in _parts(int(x, 16), look_alikes)]


@lru_cache(maxsize=2)
def _tables(confusable: tuple) -> Tables:
    look_alikes = {**dict(confusable), **LOOK_ALIKES}
    size = 0x110000
    count, start, order = np.ones(size, np.uint8), np.arange(size, dtype=np.int32), np.zeros(size, np.uint8)
    extra: list[int] = []
    pairs = []
    for cp in range(size):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp <= 0xDFFFF or cp >= 0xF0000:
            continue  # Hangul syllables (see _hangul), surrogates, private use, characters without a decomposition
        ch = chr(cp)
        order[cp] = unicodedata.combining(ch)
        parts = _parts(cp, look_alikes)
        if parts != [cp]:
            count[cp], start[cp] = len(parts), size + len(extra)
            extra += parts
        form = unicodedata.decomposition(ch).split()
        if len(form) == 2 and not form[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            pairs.append((int(form[0], 16) << 32 | int(form[1], 16), cp))
    pairs.sort()
    flat = np.concatenate([np.arange(size, dtype=np.uint32), np.array(extra, np.uint32)])
    return Tables(count, start, flat, order, np.array([k for k, _ in pairs], np.int64), np.array([c for _, c in pairs], np.uint32))


def tables(spark: SparkSession) -> Tables:
    return _tables(tuple(confusable_letters(spark).items()))


def _composite(first: np.ndarray, second: np.ndarray, t: Tables) -> np.ndarray:
    """What each pair composes to, 0 where it doesn't."""
    key = (first.astype(np.int64) << 32) | second.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    out = np.where(t.pair_keys[at] == key, t.pair_to[at], 0).astype(np.uint32)
    lead, vowel, tail = first - np.uint32(0x1100), second - np.uint32(0x1161), second - np.uint32(0x11A7)
    syllable = first - np.uint32(0xAC00)
    out = np.where((lead < 19) & (vowel < 21), 0xAC00 + (lead * 21 + vowel) * 28, out)
    return np.where((syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28), first + tail, out).astype(np.uint32)


def fold_points(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Folds code points; ``rows`` tells the row of each. Both come back in their new length."""
    if len(points):
        cr = points == 13
        if cr.any():
            before_lf = np.zeros(len(points), bool)
            before_lf[:-1] = cr[:-1] & (points[1:] == 10) & (rows[1:] == rows[:-1])
            points = np.where(cr, np.uint32(10), points)[~before_lf]
            rows = rows[~before_lf]
    many = t.count[points]
    if (many == 1).all():
        points = t.flat[t.start[points]]
    else:
        begin = np.cumsum(many, dtype=np.int64) - many
        points = t.flat[np.repeat(t.start[points].astype(np.int64) - begin, many) + np.arange(int(many.sum()))]
        rows = np.repeat(rows, many)
    if not len(points) or points.max() < 0x300:
        return points, rows
    order = t.order[points]
    marks = np.flatnonzero(order)
    if len(marks):
        points = points.copy()
        run = np.cumsum(np.concatenate([[True], (np.diff(marks) > 1) | (rows[marks[1:]] != rows[marks[:-1]])]))
        points[marks] = points[marks][np.lexsort((order[marks], run))]
    points, rows = _join_starters(points, rows, t)
    points, rows = _join_marks(points, rows, t)
    return _join_starters(points, rows, t)


def _join_starters(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Composes neighbours that are both no marks (vowel signs, jamo) until none is left."""
    while len(points) > 1:
        near = np.flatnonzero((points[1:] > 0x900) & (t.order[points[1:]] == 0) & (t.order[points[:-1]] == 0) & (rows[1:] == rows[:-1]))
        new = _composite(points[near], points[near + 1], t)
        near, new = near[new > 0], new[new > 0]
        if not len(near):
            break
        fresh = np.concatenate([[True], np.diff(near) > 1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(near)), 0))
        take = (near - near[head]) % 2 == 0
        near, new = near[take], new[take]
        points = points.copy()
        points[near] = new
        stay = np.ones(len(points), bool)
        stay[near + 1] = False
        points, rows = points[stay], rows[stay]
    return points, rows


def _join_marks(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Composes each letter with the marks after it, in their order, unless another blocks them."""
    order = t.order[points]
    marks = np.flatnonzero(order)
    if not len(marks):
        return points, rows
    fresh = np.concatenate([[True], (np.diff(marks) > 1) | (rows[marks[1:]] != rows[marks[:-1]])])
    first = marks[fresh]
    length = np.diff(np.append(np.flatnonzero(fresh), len(marks)))
    has_base = (first > 0) & (rows[np.maximum(first, 1) - 1] == rows[first])
    first, length = first[has_base], length[has_base]
    points, stay = points.copy(), np.ones(len(points), bool)
    last = np.zeros(len(first), np.uint8)
    k = 0
    while len(first):
        here = first + k
        new = np.where(last < order[here], _composite(points[first - 1], points[here], t), 0)
        joined = new > 0
        points[first[joined] - 1] = new[joined]
        stay[here[joined]] = False
        last = np.where(joined, last, order[here])
        k += 1
        more = length > k
        first, length, last = first[more], length[more], last[more]
    return points[stay], rows[stay]


def fold_array(texts: pa.Array, t: Tables) -> pa.Array:
    """The folded form of each text of an Arrow string array; null stays null."""
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if len(texts) and texts.buffers()[2] is not None else pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets - offsets[0]]
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    points, rows = fold_points(points, np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(lead)), t)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    bytes_of_row = np.bincount(rows, weights=width, minlength=len(texts)).astype(np.int64)
    body = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    there = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(bytes_of_row)]).astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(texts), [there, ends, pa.py_buffer(body)]).cast(pa.string())


def visual_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``text`` and its ``form``: the one form of all texts that look the same.

    Wide and narrow forms become plain; blanks of any width become a space; CR, CR LF and the other
    line ends become LF; what shows nothing (zero-width and control characters, soft hyphens, marks
    of direction, variation selectors) goes; look-alike letters (see LOOK_ALIKES and :func:`confusable_letters`) become one of them; ligatures, digraphs and
    Roman numerals become their letters; letters are composed with their marks. Accents, case,
    raised digits, fractions, dashes and quotes of different shape stay apart. Null stays null, and an empty
    text or one that shows nothing becomes ''. Rows that repeat stay; other columns are not read; an empty
    table gives an empty result. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(tables(df.sparkSession))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("form", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SLICE_BYTES * max(1, batch.num_rows) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fold_array(part.column(1), shared.value)], names=[id_col, "text", "form"])

    return df.select(df[id_col], df[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs ``doc_a < doc_b`` of rows whose texts differ as stored but have the same form.

    Null texts and texts of blanks and line ends only take no part, null ids neither. Texts that are
    stored alike form no pair with each other; rows that repeat an id repeat its pairs. Only digests of texts are
    shuffled. Different stored texts of a form are paired first, however many rows each has; only then rows come
    in, so that no pair of rows is looked at that is not in the result, and a text of a third of all rows is split
    over tasks.
    """
    keyed = cut(
        visual_form(df, id_col, text_col).where(F.col(id_col).isNotNull() & (F.trim(F.translate("form", "\t\n", "  ")) != ""))
        .select(F.col(id_col).alias("id"), digest(F.col("form")).alias("form"), digest(F.col("text")).alias("text"))
    )
    mixed = keyed.groupBy("form").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("form")
    rows = cut(keyed.join(mixed, "form", "left_semi"))
    texts = rows.select("form", "text").distinct()
    pairs = texts.withColumnRenamed("text", "one").join(texts.withColumnRenamed("text", "two"), "form").where(F.col("one") < F.col("two")).select("one", "two")
    own = lambda text, name: rows.select(F.col("text").alias(text), F.col("id").alias(name))
    out = pairs.join(own("one", "x"), "one").join(own("two", "y"), "two").where(F.col("x") != F.col("y"))
    return out.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
