"""Exact linear programs over mixtures of words.

All of them choose weights that add up to 1 and pay non-negative prices for what they may add besides. So there is always a
start that no price can improve: the cheapest word alone. From it only the constraints have to be met, which the dual simplex
method does in one phase, without helper variables. The dictionary is kept in whole numbers over one common denominator
(each new entry divides without a rest by the old one), so no fraction is ever reduced on the way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction


@dataclass
class Optimum:
    value: Fraction
    weights: list[Fraction]
    extra: list[Fraction]
    duals: list[Fraction]  # of the rows; not negative


def minimum(costs: list, rows: list[list], bounds: list, prices: tuple | list = (), reliefs: tuple | list = ()) -> Optimum | None:
    """Least ``costs . w + prices . y`` over ``w >= 0`` with sum 1 and ``y >= 0``, where ``rows[i] . w - reliefs[i] . y <= bounds[i]``
    (no ``y`` without ``prices``, which must not be negative); None if no choice meets all rows. Numbers may be ints or fractions."""
    n, k = len(costs), len(rows)
    numbers = [*costs, *prices, *bounds, *[x for row in rows for x in row], *[x for row in reliefs for x in row]]
    scale = math.lcm(1, *[Fraction(x).denominator for x in numbers])
    whole = lambda x: int(Fraction(x) * scale)
    start = min(range(n), key=lambda j: (costs[j], j))
    # Unknowns: 0..n-1 weights, n..n+len(prices)-1 extras, then the slack of each row.
    free = [j for j in range(n) if j != start] + [n + j for j in range(len(prices))]
    held = [start] + [n + len(prices) + i for i in range(k)]
    # held = const - sum(coef * free), all over den; the first row says that weights add up to 1. Rows and costs are taken
    # scale times as large, so that all entries are whole.
    const = [1] + [whole(b) - whole(row[start]) for row, b in zip(rows, bounds)]
    coef = [[int(j < n) for j in free]]
    for i, row in enumerate(rows):
        coef.append([whole(row[j]) - whole(row[start]) if j < n else -whole(reliefs[i][j - n]) for j in free])
    den = 1
    gain = [whole(costs[j]) - whole(costs[start]) if j < n else whole(prices[j - n]) for j in free]
    while True:
        short = [i for i in range(len(held)) if const[i] < 0]
        if not short:
            break
        leave = min(short, key=lambda i: held[i])
        able = [e for e in range(len(free)) if coef[leave][e] < 0]
        if not able:
            return None
        enter = min(able, key=lambda e: (Fraction(gain[e], -coef[leave][e]), free[e]))
        out, base = coef[leave], const[leave]
        pivot = out[enter]
        for i in range(len(held)):
            if i != leave:
                own = coef[i][enter]
                const[i] = (const[i] * pivot - own * base) // den
                coef[i] = [-own if e == enter else (x * pivot - own * out[e]) // den for e, x in enumerate(coef[i])]
        own = gain[enter]
        gain = [-own if e == enter else (x * pivot - own * out[e]) // den for e, x in enumerate(gain)]
        coef[leave] = [den if e == enter else x for e, x in enumerate(out)]
        den = pivot
        held[leave], free[enter] = free[enter], held[leave]
        if den < 0:
            den, const, gain = -den, [-x for x in const], [-x for x in gain]
            coef = [[-x for x in row] for row in coef]
    found = {v: Fraction(c, den) for v, c in zip(held, const)}
    reduced = {v: Fraction(g, den) for v, g in zip(free, gain)}
    weights = [found.get(j, Fraction(0)) for j in range(n)]
    extra = [found.get(n + j, Fraction(0)) for j in range(len(prices))]
    value = sum((Fraction(c) * w for c, w in zip([*costs, *prices], [*weights, *extra])), Fraction(0))
    return Optimum(value, weights, extra, [reduced.get(n + len(prices) + i, Fraction(0)) for i in range(k)])


def verified(costs: list, rows: list[list], bounds: list, weights: list[Fraction], duals: list[Fraction]) -> bool:
    """Whether a mixture and prices of the rows prove each other the best: both allowed, of one value, no word cheaper than the
    prices say, and none used that is dearer."""
    mixed = lambda xs: sum((w * x for w, x in zip(weights, xs)), Fraction(0))
    if sum(weights) != 1 or min(weights) < 0 or any(y < 0 for y in duals) or any(mixed(row) > b for row, b in zip(rows, bounds)):
        return False
    full = [c + sum((y * row[j] for y, row in zip(duals, rows)), Fraction(0)) for j, c in enumerate(costs)]
    floor = min(full)
    return mixed(costs) == floor - sum((y * b for y, b in zip(duals, bounds)), Fraction(0)) and all(f == floor for f, w in zip(full, weights) if w)


def best_mixture(bases: list, slopes: list[list], bound) -> tuple[Optimum, Fraction]:
    """The mixture of least base whose slopes keep the bound, and 0; if none does, the least excess t first, then the least base
    under ``bound + t``."""
    rows = [list(x) for x in zip(*slopes)]
    best = minimum(bases, rows, [bound] * len(rows))
    if best is not None:
        return best, Fraction(0)
    least = minimum([0] * len(bases), rows, [bound] * len(rows), [1], [[1]] * len(rows)).extra[0]
    return minimum(bases, rows, [bound + least] * len(rows)), least


def least_gap(bases: list, slopes: list[list], bound, goal) -> Optimum:
    """Least u + t of a mixture whose base is at most ``goal + u`` and whose slopes are at most ``bound + t``; ``extra`` is t, u."""
    rows = [list(x) for x in zip(*slopes)]
    return minimum([0] * len(bases), [*rows, list(bases)], [*[bound] * len(rows), goal], [1, 1], [*[[1, 0]] * len(rows), [0, 1]])


def box_mixture(bases: list, slopes: list[list], widths: list, bound) -> Optimum | None:
    """Least base of a mixture over a box: on axes with a width each unit of slope above the bound is paid for with the width,
    on the others (None) the bound holds."""
    paid = [j for j, x in enumerate(widths) if x is not None]
    rows = [list(x) for x in zip(*slopes)]
    return minimum(bases, rows, [bound] * len(rows), [widths[j] for j in paid], [[int(i == j) for j in paid] for i in range(len(rows))])


def keeps_bounds(bases: list, slopes: list[list], weights: list[Fraction], bound, goal) -> bool:
    """Whether a mixture's base is below ``goal`` and no slope is above the bound."""
    mixed = lambda xs: sum((w * x for w, x in zip(weights, xs)), Fraction(0))
    return sum(weights) == 1 and min(weights) >= 0 and mixed(bases) < goal and all(mixed(row) <= bound for row in zip(*slopes))


def generated(columns: list[tuple], bound, oracle) -> tuple[Optimum, list[tuple], int]:
    """The best mixture of all columns ``(base, slopes)`` an ``oracle`` knows, from a pool that begins with ``columns`` (which must hold a mixture
    within the bound): the pool's optimum prices the slopes, the oracle is asked for the column that is cheapest at these
    prices, and joins the pool if it is cheaper than the mixture; else no column is, and the optimum holds for all of them.
    The optimum, the pool and the number of rounds."""
    pool, rounds = list(columns), 0
    while True:
        rounds += 1
        rows = [list(x) for x in zip(*[s for _, s in pool])]
        best = minimum([b for b, _ in pool], rows, [bound] * len(rows))
        floor = best.value + sum((y * bound for y in best.duals), Fraction(0))
        base, slopes = oracle(best.duals)
        if base + sum((y * x for y, x in zip(best.duals, slopes)), Fraction(0)) >= floor:
            return best, pool, rounds
        pool.append((base, slopes))
