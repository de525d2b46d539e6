"""States of the circular arrangement as columns: packed keys, moves, ranks, features, families.

A state of ``m`` tokens and ``r`` zeros (n = m + r cells, n at most 15) is one bigint ``p`` with four
bits a cell, cell 0 lowest. Moves are a few bit operations inside generated code; no array is built,
joined on or shuffled. Arrays are derived from the key where a feature needs cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CELLS = 15


def check_graph(m: int, r: int) -> None:
    if m < 2 or r < 0 or m + r > MAX_CELLS:
        raise ValueError(f"need m >= 2, r >= 0 and at most {MAX_CELLS} cells, not m={m}, r={r}")


def states(m: int, r: int) -> int:
    """How many states there are."""
    return math.perm(m + r, m)


def root_key(m: int, r: int) -> int:
    return sum((i + 1) << (4 * i) for i in range(m))


def budget(m, r):
    """The budget T, of ints or of columns."""
    half = m * (m + 1) / 2 if isinstance(m, Column) or isinstance(r, Column) else m * (m + 1) // 2
    return half + (r - 1) * (m - 2)


def move_left(p: Column, n: int) -> Column:
    return F.shiftright(p, 4).bitwiseOR(F.shiftleft(p.bitwiseAND(15), 4 * (n - 1)))


def move_right(p: Column, n: int) -> Column:
    low = F.lit((1 << (4 * (n - 1))) - 1)
    return F.shiftleft(p.bitwiseAND(low), 4).bitwiseOR(F.shiftright(p, 4 * (n - 1)))


def move_swap(p: Column) -> Column:
    first, second = p.bitwiseAND(15), F.shiftright(p, 4).bitwiseAND(15)
    return p.bitwiseAND(~0xFF).bitwiseOR(F.shiftleft(first, 4)).bitwiseOR(second)


def moves(p: Column, n: int) -> list[tuple[str, Column]]:
    return [("L", move_left(p, n)), ("R", move_right(p, n)), ("X", move_swap(p))]


def cells(p: Column, n: int) -> Column:
    """The state as an array of ints."""
    return F.array(*[F.shiftright(p, 4 * i).bitwiseAND(15).cast("int") for i in range(n)])


def text(p: Column, n: int) -> Column:
    """The state's cells joined by blanks."""
    return F.concat_ws(" ", *[F.shiftright(p, 4 * i).bitwiseAND(15).cast("string") for i in range(n)])


def pack(v: Column) -> Column:
    """The key of an array of cells (null if it has more than MAX_CELLS cells)."""
    packed = F.aggregate(F.reverse(v), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 4).bitwiseOR(x.cast("bigint")))
    return F.when(F.size(v) <= MAX_CELLS, packed)


def rank_weights(m: int, r: int) -> list[int]:
    """Weights of the mixed-radix rank: the number of ways to place the tokens that follow."""
    n = m + r
    return [math.perm(n - i - 1, m - i - 1) for i in range(m)]


def rank(p: Column, m: int, r: int) -> Column:
    """Rank of a state: each token's position among the cells still free, in mixed radix; one fold over the tokens."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("seen"))
    steps = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).cast("bigint").alias("w")) for t, w in zip(range(1, m + 1), rank_weights(m, r))])

    def of(v: Column) -> Column:
        def place(acc, step):
            at = (F.array_position(v, step["t"]) - 1).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
            return F.struct((acc["total"] + (at - F.bit_count(acc["seen"].bitwiseAND(bit - 1))) * step["w"]).alias("total"), acc["seen"].bitwiseOR(bit).alias("seen"))

        return F.aggregate(steps, start, place, lambda acc: acc["total"])

    return F.element_at(F.transform(F.array(cells(p, m + r)), of), 1)


def unrank(code: Column, m: int, r: int) -> Column:
    """The key of the state with a rank, as one fold over the tokens."""
    n = m + r
    start = F.struct(code.cast("bigint").alias("rest"), F.sequence(F.lit(0), F.lit(n - 1)).alias("free"), F.lit(0).cast("bigint").alias("p"))
    steps = F.array(*[F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(w).cast("bigint").alias("w")) for t, w in zip(range(1, m + 1), rank_weights(m, r))])

    def place(acc, step):
        digit = F.floor(acc["rest"] / step["w"]).cast("int")
        cell = F.element_at(acc["free"], digit + 1)
        return F.struct(
            (acc["rest"] - digit * step["w"]).alias("rest"), F.filter(acc["free"], lambda x: x != cell).alias("free"),
            acc["p"].bitwiseOR(F.call_function("shiftleft", step["t"], cell * 4)).alias("p"),
        )

    return F.aggregate(steps, start, place, lambda acc: acc["p"])


def moved(u: Column, letter: Column) -> Column:
    """Cells after one letter; one other than L, R, X gives null."""
    n = F.size(u)
    return (
        F.when(letter == "L", F.concat(F.slice(u, F.lit(2), n - 1), F.slice(u, 1, 1)))
        .when(letter == "R", F.concat(F.slice(u, n, F.lit(1)), F.slice(u, F.lit(1), n - 1)))
        .when(letter == "X", F.concat(F.reverse(F.slice(u, 1, 2)), F.slice(u, F.lit(3), F.greatest(n - 2, F.lit(0)))))
    )


def replay(v: Column, word: Column) -> Column:
    """Cells after all letters of ``word``; a letter other than L, R, X gives null."""
    return F.aggregate(F.filter(F.split(word, ""), lambda x: x != ""), v, moved)


# Families: a label order and the set of its nonempty gaps.

def base_vector(labels: Column, mask: Column) -> Column:
    """One zero in every nonempty gap of the label order; bit g of the mask is the gap after g labels."""
    gap = lambda g: F.when(F.call_function("shiftright", mask, g.cast("int")).bitwiseAND(1) == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    body = F.flatten(F.transform(labels, lambda x, i: F.concat(F.array(x.cast("int")), gap(i + 1))))
    return F.concat(gap(F.lit(0)), body)


def gaps(mask: Column, m: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), m), lambda g: F.call_function("shiftright", mask, g).bitwiseAND(1) == 1)


def parse_labels(v: Column) -> Column:
    return F.filter(v, lambda x: x > 0)


def parse_mask(v: Column) -> Column:
    """The mask of nonempty gaps of a state: each zero sets the bit of the labels before it."""
    start = F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("mask"))
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("bigint"), g)
    step = lambda a, x: F.struct(F.when(x > 0, a["g"] + 1).otherwise(a["g"]).alias("g"), F.when(x > 0, a["mask"]).otherwise(a["mask"].bitwiseOR(bit(a["g"]))).alias("mask"))
    return F.aggregate(v, start, step, lambda a: a["mask"])


def inversions(seq: Column) -> Column:
    """Pairs out of order; null of null."""
    return F.aggregate(
        F.transform(seq, lambda x, i: F.size(F.filter(F.slice(seq, i + 2, F.greatest(F.size(seq) - i - 1, F.lit(0))), lambda y: y < x))), F.lit(0), lambda a, x: a + x
    )


def order_statistics(v: Column, m: int) -> dict[str, Column]:
    """Correlation statistics of a circular order ``v`` of 0..m-1: C (weights against windows), K (triples that
    turn one way), H (pairs shifted alike), V (squared windows) and E = C - 4K - 2H. Written out in
    plain arithmetic for the given m, so they stay in generated code."""
    from itertools import combinations

    at = lambda i: F.element_at(v, i % m + 1)
    mod = lambda x: F.pmod(x, F.lit(m))
    total = lambda xs: sum(xs, F.lit(0))
    windows = [2 * total((at(s + j) < j).cast("int") for j in range(1, m)) - m + 1 for s in range(m)]
    c = total((2 * at(s) - m + 1) * windows[s] for s in range(m))
    k = total((mod(at(j) - at(i)) < mod(at(x) - at(i))).cast("int") for i, j, x in combinations(range(m), 3))
    h = total((mod(at(i) - i - at(j) + j) == 0).cast("int") for i, j in combinations(range(m), 2))
    return {"C": c, "K": k, "H": h, "V": total(w * w for w in windows), "E": c - 4 * k - 2 * h}
