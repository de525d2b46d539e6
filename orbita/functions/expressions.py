"""The JSON expression language compiled to columns.

An expression is an int, a name, or a list ``[operator, argument...]``, of integers only. Each node
becomes a pair of columns: its value, and an error text that is null where the value holds. Branches
that are not taken have no error, so ``if``, ``and`` and ``or`` stay lazy; an error never mixes with
null. Everything is built-in functions on the array of cells, inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbita.functions import states as S

# The language's limits and names.
MAX_NODES, MAX_DEPTH, MAX_CONST, MAX_PRODUCT = 80, 10, 10_000, 10**12
STATE_NAMES = (
    "n", "m", "r", "a", "b", "last", "pos1", "fixed", "hamming", "inv", "cinv", "cdes", "disp_sum", "disp_max", "cw_sum", "ccw_sum",
    "zeros_block", "zero_gap_max", "zero_gap_min", "zero_first", "zeros_in_prefix", "csorted", "rot_dist", "is_root", "T",
)
TOKEN_NAMES = ("t", "p", "tgt", "cw", "ccw", "dmin", "at_tgt", "gap_next", "zeros_next")


class ExpressionError(ValueError):
    """The expression is not one of the language."""


@dataclass
class Node:
    value: Column
    error: Column


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _position(v: Column, t: Column) -> Column:
    return (F.array_position(v, t.cast("int")) - 1).cast("int")


def features(v: Column, m: int, r: int) -> dict[str, Column]:
    """All state features of an array of cells."""
    n = m + r
    at = lambda i: F.element_at(v, i + 1)
    tokens = F.filter(v, lambda x: x > 0)
    t = F.sequence(F.lit(1), F.lit(m))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    cw = F.transform(t, lambda x: F.pmod(_position(v, x) - (x - 1), F.lit(n)))
    ccw = F.transform(cw, lambda d: F.pmod(-d, F.lit(n)))
    both = F.zip_with(cw, ccw, lambda a, b: F.least(a, b))
    zeros = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(v, i + 1) == 0)
    after = F.concat(F.slice(zeros, 2, n), F.slice(zeros, 1, 1))
    gap = F.zip_with(zeros, after, lambda a, b: F.when(F.pmod(b - a, F.lit(n)) == 0, n).otherwise(F.pmod(b - a, F.lit(n)))) if r else None
    goal = F.array(*[F.lit(i + 1 if i < m else 0) for i in range(n)])
    differs = F.zip_with(v, goal, lambda x, y: (x != y).cast("int"))
    pos1 = _position(v, F.lit(1))
    turned = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(v, F.pmod(pos1 + i, F.lit(n)) + 1))
    csorted = (turned == goal).cast("int")
    inv = S.inversions(tokens)
    # Turning the first of the tokens to the back changes the inversions by m + 1 - 2x.
    turn = F.aggregate(
        F.slice(tokens, 1, m - 1), F.struct(inv.alias("now"), inv.alias("best")),
        lambda a, x: F.struct((a["now"] + (m + 1) - 2 * x).alias("now"), F.least(a["best"], a["now"] + (m + 1) - 2 * x).alias("best")), lambda a: a["best"],
    )
    down = F.zip_with(tokens, F.concat(F.slice(tokens, 2, m), F.slice(tokens, 1, 1)), lambda x, y: (y < x).cast("int"))
    return {
        "n": F.lit(n), "m": F.lit(m), "r": F.lit(r), "T": F.lit(S.budget(m, r)), "a": at(0), "b": at(1), "last": at(n - 1), "pos1": pos1,
        "fixed": F.size(F.filter(t, lambda x: F.element_at(v, x) == x)), "hamming": add(differs), "inv": inv, "cinv": turn, "cdes": add(down),
        "disp_sum": add(both), "disp_max": F.array_max(both), "cw_sum": add(cw), "ccw_sum": add(ccw),
        "zeros_block": (F.array_max(gap) == n - r + 1).cast("int") if r else F.lit(1), "zero_gap_max": F.array_max(gap) if r else F.lit(0), "zero_gap_min": F.array_min(gap) if r else F.lit(0),
        "zero_first": _position(v, F.lit(0)), "zeros_in_prefix": F.size(F.filter(F.slice(v, 1, m), lambda x: x == 0)), "csorted": csorted,
        "rot_dist": F.when(csorted == 1, F.least(pos1, n - pos1)).otherwise(-1), "is_root": (v == goal).cast("int"),
    }


def _token_features(v: Column, t: Column, m: int, r: int) -> dict[str, Column]:
    n = m + r
    p, tgt = _position(v, t), t - 1
    cw = F.pmod(p - tgt, F.lit(n))
    gap = F.when(t == m, 0).otherwise(F.pmod(_position(v, t + 1) - p, F.lit(n)))
    between = F.filter(F.sequence(F.lit(1), F.lit(max(n - 1, 1))), lambda k: (k < gap) & (F.element_at(v, F.pmod(p + k, F.lit(n)) + 1) == 0))
    return {"t": t, "p": p, "tgt": tgt, "cw": cw, "ccw": F.pmod(-cw, F.lit(n)), "dmin": F.least(cw, F.pmod(-cw, F.lit(n))), "at_tgt": (p == tgt).cast("int"), "gap_next": gap, "zeros_next": F.size(between)}


class _Compiler:
    def __init__(self, v: Column, m: int, r: int, extra: dict[str, Column] | None = None):
        self.v, self.m, self.r, self.n = v, m, r, m + r
        self.names = {**features(v, m, r), **(extra or {})}
        self.nodes = 0

    def compile(self, e, depth: int = 0, token: dict | None = None) -> Node:
        self.nodes += 1
        if self.nodes > MAX_NODES or depth > MAX_DEPTH:
            raise ExpressionError("too large")
        none = F.lit(None).cast("string")
        if type(e) in (int, bool):
            if abs(e) > MAX_CONST:
                raise ExpressionError("constant out of range")
            return Node(F.lit(int(e)).cast("bigint"), none)
        if type(e) is str:
            if e in TOKEN_NAMES and token is not None:
                return Node(_long(token[e]), none)
            if e not in self.names:
                raise ExpressionError(f"unknown name {e!r}")
            return Node(_long(self.names[e]), none)
        if type(e) is not list or not e or type(e[0]) is not str:
            raise ExpressionError("malformed")
        op, args = e[0], e[1:]
        if op in ("sum_tokens", "max_tokens", "min_tokens", "count_tokens"):
            return self.over_tokens(op, args, depth, token)
        sub = [self.compile(a, depth + 1, token) for a in args]
        arity = {"if": 3, **dict.fromkeys(("sub", "lt", "le", "gt", "ge", "eq", "ne", "mul", "floordiv", "mod"), 2), **dict.fromkeys(("neg", "abs", "not", "at", "pos", "cw_of", "ccw_of", "dmin_of"), 1)}.get(op)
        if arity is None and op not in ("add", "max", "min", "and", "or"):
            raise ExpressionError(f"unknown operator {op!r}")
        if not sub or (arity is not None and len(sub) != arity):
            raise ExpressionError(f"{op} takes {arity or 'some'} arguments")
        return getattr(self, f"op_{op}", self.plain)(op, sub)

    @staticmethod
    def first_error(sub: list[Node]) -> Column:
        return F.coalesce(*[s.error for s in sub])

    def plain(self, op: str, sub: list[Node]) -> Node:
        x = sub[0].value
        y = sub[1].value if len(sub) > 1 else None
        values = [s.value for s in sub]
        n, v = F.lit(self.n).cast("bigint"), self.v
        if op in ("lt", "le", "gt", "ge", "eq", "ne"):
            value = _long({"lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y, "eq": x == y, "ne": x != y}[op])
        elif op in ("cw_of", "ccw_of", "dmin_of"):
            d = F.pmod(_long(_position(v, x)) - (x - 1), n)
            turned = F.pmod(-d, n)
            value = F.when(x.between(1, self.m), {"cw_of": d, "ccw_of": turned, "dmin_of": F.least(d, turned)}[op]).otherwise(F.lit(0).cast("bigint"))
        else:
            value = {
                "add": lambda: reduce(lambda a, b: a + b, values), "sub": lambda: x - y, "neg": lambda: -x, "abs": lambda: F.abs(x), "not": lambda: _long(x == 0),
                "max": lambda: F.greatest(*values) if y is not None else x, "min": lambda: F.least(*values) if y is not None else x,
                "at": lambda: _long(F.element_at(v, F.pmod(x, n).cast("int") + 1)), "pos": lambda: F.when(x.between(1, self.m), _long(_position(v, x))).otherwise(F.lit(-1).cast("bigint")),
            }[op]()
        return self.guarded(value, self.first_error(sub))

    @staticmethod
    def guarded(value: Column, error: Column) -> Node:
        return Node(F.when(error.isNull(), value), error)

    def op_mul(self, op: str, sub: list[Node]) -> Node:
        product = F.try_multiply(sub[0].value, sub[1].value)
        over = F.when(product.isNull() | (F.abs(product) > MAX_PRODUCT), "overflow")
        return self.guarded(product, F.coalesce(self.first_error(sub), over))

    def op_floordiv(self, op: str, sub: list[Node]) -> Node:
        x, y = sub[0].value, sub[1].value
        error = F.coalesce(sub[1].error, F.when(y <= 0, "non-positive divisor"), sub[0].error)
        rest = F.pmod(x, F.when(y > 0, y))
        value = rest if op == "mod" else F.call_function("div", x - rest, F.when(y > 0, y))
        return self.guarded(value, error)

    op_mod = op_floordiv

    def op_if(self, op: str, sub: list[Node]) -> Node:
        c, x, y = sub
        taken = c.value != 0
        return self.guarded(F.when(taken, x.value).otherwise(y.value), F.coalesce(c.error, F.when(taken, x.error).otherwise(y.error)))

    def op_and(self, op: str, sub: list[Node]) -> Node:
        stop = (lambda s: s.value == 0) if op == "and" else (lambda s: s.value != 0)
        value, error = F.lit(1 if op == "and" else 0).cast("bigint"), F.lit(None).cast("string")
        for s in reversed(sub):
            halt = s.error.isNull() & stop(s)
            value = F.when(halt, F.lit(0 if op == "and" else 1).cast("bigint")).otherwise(value)
            error = F.when(s.error.isNotNull(), s.error).when(halt, F.lit(None).cast("string")).otherwise(error)
        return self.guarded(value, error)

    op_or = op_and

    def over_tokens(self, op: str, args: list, depth: int, token: dict | None) -> Node:
        if token is not None:
            raise ExpressionError("nested token aggregates")
        if len(args) != 1:
            raise ExpressionError(f"{op} takes 1 argument")

        def one(t: Column) -> Column:
            before = self.nodes
            node = self.compile(args[0], depth + 1, _token_features(self.v, t, self.m, self.r))
            self.nodes = max(before, self.nodes)
            return F.struct(node.value.alias("value"), node.error.alias("error"))

        each = F.transform(F.sequence(F.lit(1), F.lit(self.m)), one)
        values, zero = F.transform(each, lambda s: s["value"]), F.lit(0).cast("bigint")
        failed = F.filter(F.transform(each, lambda s: s["error"]), lambda x: x.isNotNull())
        value = {
            "sum_tokens": lambda: F.aggregate(values, zero, lambda a, x: a + x), "max_tokens": lambda: F.array_max(values), "min_tokens": lambda: F.array_min(values),
            "count_tokens": lambda: _long(F.size(F.filter(values, lambda x: x != 0))),
        }[op]()
        return self.guarded(value, F.try_element_at(failed, F.lit(1)))


def node(expression, v: Column, m: int, r: int, extra: dict[str, Column] | None = None) -> Node:
    """Value and error columns of an expression; ``extra`` names may be used in it besides the features."""
    return _Compiler(v, m, r, extra).compile(expression)


def evaluate(df: DataFrame, expression, m: int, r: int, cells: str = "v") -> DataFrame:
    """Adds ``value`` (bigint) and ``error`` (text, null where there is a value) of an expression on the
    array of cells. Raises :class:`ExpressionError` for what is not an expression of the language."""
    one = node(expression, F.col(cells), m, r)
    return df.withColumns({"value": one.value, "error": one.error})
