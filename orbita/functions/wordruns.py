"""Runs of words over states as columns: replays, projections, erasures, comparison runs, traces.

A word is a string of L, R, X; a state an array of cells. A run is one fold over the letters inside the plan, so a
table of states and words of any size is worked on without a shuffle. Zeros are told apart by numbers from 0, in their
order in the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbita.functions import states as S


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def atoms(v: Column) -> Column:
    """The cells with zero number j as -1 - j, so that each cell is told from all others."""
    return F.transform(v, lambda x, i: F.when(x == 0, -F.size(F.filter(F.slice(v, F.lit(1), i + 1), lambda y: y == 0))).otherwise(x.cast("int")))


def run(a: Column, word: Column, extra: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """Struct of ``a``, the cells after all letters, and of what ``step`` makes of ``extra`` letter by letter. ``step`` sees
    the struct before a letter, and the letter."""
    start = F.struct(a.alias("a"), *[c.alias(k) for k, c in extra.items()])
    return F.aggregate(letters(word), start, lambda acc, x: F.struct(S.moved(acc["a"], x).alias("a"), *[c.alias(k) for k, c in step(acc, x).items()]))


def front(a: Column, letter: Column) -> Column:
    """The cell a turn carries around: the first of L, the last of R."""
    return F.when(letter == "L", F.element_at(a, 1)).otherwise(F.element_at(a, -1))


def projection(v: Column, word: Column, dead: Column) -> Column:
    """Struct ``child, word`` after deleting the cells ``dead`` (array of atoms): what is left of the state, and the
    letters that still do something: turns that carry no deleted cell, swaps of two cells that are left."""
    own = atoms(v)
    gone = lambda x: F.array_contains(dead, x)

    def step(acc: Column, x: Column) -> dict[str, Column]:
        a = acc["a"]
        idle = F.when(x == "X", gone(F.element_at(a, 1)) | gone(F.element_at(a, 2))).otherwise(gone(front(a, x)))
        return {"out": F.concat(acc["out"], F.when(idle, "").otherwise(x))}

    child = F.transform(F.filter(own, lambda x: ~gone(x)), lambda x: F.greatest(x, F.lit(0)))
    return F.struct(child.alias("child"), run(own, word, {"out": F.lit("")}, step)["out"].alias("word"))


def reduced(word: Column, *pairs: str) -> Column:
    """The word after cancelling neighbours that undo each other (``pairs``, e.g. LR), until none is left."""
    short = lambda acc, x: F.when(F.concat(F.right(acc, F.lit(1)), x).isin(*pairs), F.left(acc, F.length(acc) - 1)).otherwise(F.concat(acc, x))
    return F.aggregate(letters(word), F.lit(""), short)


def without_label(v: Column, word: Column, label: Column) -> Column:
    """The reduced word that is left of a run when one label is taken out of it."""
    return reduced(projection(v, word, F.array(label.cast("int")))["word"], "LR", "RL")


def projection_counts(v: Column, word: Column) -> Column:
    """Struct ``idle`` (swaps of two zeros), ``own`` (of each zero the letters that only carry it around or swap it with a
    token) and ``a``. A run without zero j takes ``length - idle - own[j]`` letters."""
    none = F.transform(F.filter(v, lambda x: x == 0), lambda x: F.lit(0))

    def step(acc: Column, x: Column) -> dict[str, Column]:
        a = acc["a"]
        one, two = F.element_at(a, 1), F.element_at(a, 2)
        both = (x == "X") & (one < 0) & (two < 0)
        zero = F.when(x == "X", F.least(one, two)).otherwise(front(a, x))
        own = F.transform(acc["own"], lambda n, j: n + F.when(~both & (zero == -1 - j), 1).otherwise(0))
        return {"own": own, "idle": acc["idle"] + both.cast("int")}

    return run(atoms(v), word, {"own": none, "idle": F.lit(0)}, step)


# Families and their zeros.

def family_id(labels: Column, mask: Column) -> Column:
    m = F.size(labels)
    text = labels.cast("array<string>")
    return F.concat(F.lit("m"), m, F.lit("-mask"), mask, F.lit("-labels"), F.when(m <= 9, F.array_join(text, "")).otherwise(F.array_join(text, ".")))


def child_family(labels: Column, mask: Column, position: Column, split: Column) -> tuple[Column, Column]:
    """Labels and mask after label m + 1 is put at a position: bits above its gap move up by one, the gap's own zeros go to
    its left, its right or both sides."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    shift = lambda c, n, way: F.call_function(f"shift{way}", c.cast("bigint"), n)
    new = F.concat(F.slice(labels, F.lit(1), position), F.array(F.size(labels) + 1), F.slice(labels, position + 1, F.size(labels)))
    side = F.when(split == "left", 1).when(split == "right", 2).when(split == "both", 3).otherwise(0)
    return new, mask.bitwiseAND(bit(position) - 1).bitwiseOR(shift(shift(mask, position + 1, "right"), position + 2, "left")).bitwiseOR(shift(side, position, "left"))


def refined(v: Column, origin: Column) -> Column:
    """The state with zero j replaced by ``origin[j]`` zeros; null if there are not as many numbers as zeros."""
    out = F.flatten(F.transform(atoms(v), lambda x: F.when(x < 0, F.array_repeat(F.lit(0), F.try_element_at(origin, -x))).otherwise(F.array(x))))
    return F.when(F.size(origin) == F.size(F.filter(v, lambda x: x == 0)), out)


def _sizes(v: Column, picks: Column, z: Column) -> Column:
    """Cells that each cell of the state takes when the zeros ``picks`` are stretched by ``z``."""
    more = lambda x: F.coalesce(F.try_element_at(z, F.array_position(picks, -1 - x).cast("int")), F.lit(0))
    return F.transform(atoms(v), lambda x: F.when((x < 0) & (F.array_position(picks, -1 - x) > 0), 1 + more(x)).otherwise(1))


def stretched(v: Column, picks: Column, z: Column) -> Column:
    """The state with zero ``picks[j]`` made ``1 + z[j]`` zeros."""
    return F.flatten(F.zip_with(v.cast("array<int>"), _sizes(v, picks, z), lambda x, n: F.array_repeat(x, n)))


def stretched_places(v: Column, picks: Column, z: Column) -> Column:
    """Where each cell of the state begins in the stretched one."""
    sizes = _sizes(v, picks, z)
    return F.transform(v, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n))


def zero_blocks(v: Column) -> Column:
    """Sizes of the runs of zeros of a state, from the left; a run does not go around the end."""
    step = lambda a, x: F.struct(
        F.when(x > 0, a["out"]).when(a["inside"], F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.element_at(a["out"], -1) + 1))).otherwise(F.concat(a["out"], F.array(F.lit(1)))).alias("out"),
        (x == 0).alias("inside"),
    )
    return F.aggregate(v, F.struct(F.array().cast("array<int>").alias("out"), F.lit(False).alias("inside")), step, lambda a: a["out"])


def is_reversal(labels: Column) -> Column:
    """Whether the label order is a rotation of m, ..., 1: each label is followed by the one below it, 1 by m."""
    m = F.size(labels)
    follows = F.zip_with(labels, F.concat(F.slice(labels, F.lit(2), m), F.slice(labels, 1, 1)), lambda x, y: y == F.when(x == 1, m).otherwise(x - 1))
    return F.forall(follows, lambda x: x)


# Comparison runs: cells are told to which window place they have to go.

def target_ranks(v: Column, f: Column, cut: Column) -> Column:
    """Of the cell at each place of the window that begins at ``cut``: the window place it has to go to, if the sorted row
    begins at cell ``f``. Zeros keep their order in the window."""
    n = F.size(v)
    m = F.size(F.filter(v, lambda x: x > 0))
    window = F.transform(F.sequence(F.lit(0), n - 1), lambda w: F.element_at(v, F.pmod(w + cut, n) + 1))
    ends = F.array_sort(F.transform(F.sequence(F.lit(0), n - m), lambda i: F.when(i < n - m, F.pmod(f + m + i - cut, n))))
    return F.transform(window, lambda x, w: F.when(x > 0, F.pmod(f + x - 1 - cut, n)).otherwise(F.element_at(ends, F.greatest(F.lit(1), F.size(F.filter(F.slice(window, F.lit(1), w + 1), lambda y: y == 0))))).cast("int"))


def dominates(p: Column, q: Column) -> Column:
    """Whether of every first j ranks of ``p`` at least as many are below s as of ``q``, for all j and s."""
    below = lambda r, j, s: F.size(F.filter(F.slice(r, F.lit(1), j), lambda x: x < s))
    n = F.size(p)
    return F.forall(F.sequence(F.lit(1), n), lambda j: F.forall(F.sequence(F.lit(1), n), lambda s: below(p, j, s) >= below(q, j, s)))


def crossed(ranks: Column, v: Column, cut: Column, zero: Column) -> Column:
    """Labels that stand out of order with a zero, in the window of ``ranks``."""
    n = F.size(v)
    own = atoms(v)
    place = F.pmod(F.array_position(own, -1 - zero).cast("int") - 1 - cut, n)
    window = F.transform(F.sequence(F.lit(0), n - 1), lambda w: F.element_at(own, F.pmod(w + cut, n) + 1))
    mine = F.element_at(ranks, place + 1)
    out = F.zip_with(window, ranks, lambda x, r: F.struct(x.alias("x"), r.alias("r")))
    return F.size(F.filter(F.transform(out, lambda s, w: (s["x"] > 0) & (((w < place) & (s["r"] > mine)) | ((w > place) & (s["r"] < mine)))), lambda t: t))


def comparison_run(v: Column, word: Column, ranks: Column, cut: Column) -> Column:
    """Struct ``cells, swaps, turns, across`` of a run that turns as the word says and swaps only pairs whose ranks fall;
    ``across`` counts swaps asked for across the cut, which makes the run worthless."""
    n = F.size(v)
    cells = F.transform(v, lambda x, p: F.struct(x.cast("int").alias("x"), F.element_at(ranks, F.pmod(p - cut, n) + 1).alias("r")))
    start = F.struct(cells.alias("a"), F.lit(0).alias("at"), F.lit(0).alias("swaps"), F.lit(0).alias("turns"), F.lit(0).alias("across"))

    def step(acc: Column, x: Column) -> Column:
        a, swap = acc["a"], x == "X"
        falls = swap & (F.element_at(a, 1)["r"] > F.element_at(a, 2)["r"])
        return F.struct(
            F.when(swap & ~falls, a).otherwise(S.moved(a, x)).alias("a"), F.when(x == "L", F.pmod(acc["at"] + 1, n)).when(x == "R", F.pmod(acc["at"] - 1, n)).otherwise(acc["at"]).alias("at"),
            (acc["swaps"] + falls.cast("int")).alias("swaps"), (acc["turns"] + (~swap).cast("int")).alias("turns"), (acc["across"] + (swap & (F.pmod(acc["at"] + 1, n) == cut)).cast("int")).alias("across"),
        )

    return F.aggregate(letters(word), start, step, lambda acc: F.struct(F.transform(acc["a"], lambda s: s["x"]).alias("cells"), acc["swaps"].alias("swaps"), acc["turns"].alias("turns"), acc["across"].alias("across")))


def prefix_keys(p: Column, word: Column, n: int) -> Column:
    """Keys of the state after each letter of the word."""
    def step(acc: Column, x: Column) -> Column:
        new = F.when(x == "L", S.move_left(acc["p"], n)).when(x == "R", S.move_right(acc["p"], n)).otherwise(S.move_swap(acc["p"]))
        return F.struct(new.alias("p"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(letters(word), F.struct(p.alias("p"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])
