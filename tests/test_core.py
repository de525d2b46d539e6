"""Operators of the core against brute force on small fixtures."""

import json
import random

from pyspark.sql import functions as F

from orbita.functions import expressions
from orbita.functions import states as S
from orbita.operators.distance import Incomplete, distance_table, layer_sizes, lifted_minima
from orbita.operators.hierarchy import hierarchy
from orbita.operators.shredding import level_columns, nested_tables


def _elements(value):
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}", parent)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                p = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((p, parent))
                walk(x, p, p if isinstance(x, dict) else parent)

    walk(value, "$", "$")
    return out


def _random_json(rnd, depth=0):
    kind = rnd.random()
    if depth > 4 or kind < 0.3:
        return rnd.choice([None, True, 3, 1.5, "x", "é%d", ""])
    if kind < 0.65:
        return {rnd.choice(["a", "b", "c", "%d.e"]): _random_json(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [_random_json(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def test_nested_tables_equal_a_walk(spark):
    rnd = random.Random(5)
    docs = [_random_json(rnd) for _ in range(300)]
    rows = [(i, json.dumps(d), "clash") for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id bigint, f string, path string")
    got = {(r.id, r.path, r.parent_path) for r in nested_tables(df, "id", ["f"]).collect()}
    assert got == {(i, p, q) for i, d in enumerate(docs) for p, q in _elements(d)}


def test_nested_tables_values_and_unusual_input(spark):
    rows = [(1, '{"a": [{"x": 1, "y": {"z": null}, "b": [{"x": "q"}]}, {}, 5]}'), (2, json.dumps('[{"k": true}]')), (3, '{"a": ['), (4, None), (5, ""), (6, '"text"'), (None, '[{"k": 1}]'), (1, '[{"k": 1}]')]
    df = spark.createDataFrame(rows, "id bigint, f string")
    got = sorted((r.id or 0, r.path, r.table, tuple(sorted(r.scalars.items(), key=str))) for r in nested_tables(df, "id", ["f"]).collect())
    assert got == [
        (0, "$[0]", "$[]", (("k", "1"),)), (1, "$.a[0]", "$.a[]", (("x", "1"), ("y.z", None))), (1, "$.a[0].b[0]", "$.a[].b[]", (("x", "q"),)), (1, "$.a[1]", "$.a[]", ()),
        (1, "$[0]", "$[]", (("k", "1"),)), (2, "$[0]", "$[]", (("k", "true"),)),
    ]
    assert nested_tables(df.limit(0), "id", ["f"]).count() == 0


def test_nested_tables_long_numbers_and_deep_nesting(spark):
    n = "7" * 5000
    deep = "[" * 100_000 + '{"z": 1}' + "]" * 100_000
    rows = [(1, f'[{{"n": {n}, "x": 1e400, "y": -0.10, "s": "12"}}]'), (2, deep), (3, '{"a": ' * 10_000 + '[{"k": null}]' + "}" * 10_000), (4, deep[:-1]), (5, deep + "]"), (6, "7" * 5000)]
    got = {r.id: r for r in nested_tables(spark.createDataFrame(rows, "id bigint, f string"), "id", ["f"]).collect()}
    assert set(got) == {1, 2, 3} and got[1].scalars == {"n": n, "x": "1e400", "y": "-0.10", "s": "12"}
    assert got[2].path == "$" + "[0]" * 100_000 and got[2].scalars == {"z": "1"} and got[2].parent_path == "$"
    assert got[3].path == "$" + ".a" * 10_000 + "[0]" and got[3].scalars == {"k": None}


def test_the_reader_for_deep_texts_reads_what_the_parser_reads():
    from orbita.operators.shredding import _read_deep, parse_json

    good = ['{"a": [1, -2.5e3, {"b": "x\\n\\u00e9"}], "c": {}, "d": [[], true, false, null]}', " 1 ", '""', "[]", "{}", "[NaN]", '{"a": 1, "a": 2}']
    assert all(_read_deep(t) == parse_json(t) for t in good)
    for bad in ("", "[", "[1,]", "{,}", '{"a" 1}', '{"a": 1,}', "[1 2]", "1 2", "01", "[}", "{1: 2}", '"a', "tru", "[1]]", '{"a": }', '["\x01"]'):
        for read in (_read_deep, parse_json):
            try:
                read(bad)
            except ValueError:
                continue
            raise AssertionError((read, bad))


def test_levels(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": [1, 2]}, {"c": 0}, {"b": []}]}')], "id bigint, f string")
    got = [(r.rep, r["def"], r.value) for r in level_columns(df, "id", "f").where("path = '$.a[].b[]'").orderBy("entry").collect()]
    assert [g[:2] for g in got][:1] == [(0, 4)] and [g[0] for g in got] == [0, 2, 1, 1] and [g[1] for g in got] == [4, 4, 2, 3]


def _brute_hierarchy(rows):
    par = dict(rows)
    out = {}
    for i in par:
        seen, j = [i], i
        while True:
            p = par[j]
            if p is None or p not in par:
                out[i] = ("tree", seen[-1], len(seen) - 1, "/".join(map(str, reversed(seen))))
                break
            if p in seen:
                out[i] = ("cycle" if p == i else "below_cycle", -1, -1, "")
                break
            seen.append(p)
            j = p
    return out


def test_hierarchy(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, i - 1, rnd.randrange(70), 999])) for i in range(60)]
    rows = [(i, p) for i, p in rows] + [(100 + k, 99 + k if k else None) for k in range(30)] + [(200, 200), (201, 202), (202, 203), (203, 201), (204, 203), (205, 204)]
    want = _brute_hierarchy(rows)
    df = spark.createDataFrame([(i, p, f"r{i}", "x") for i, p in rows] + [(None, 3, "r", "x"), (5, dict(rows)[5], "r5", "x")], "id bigint, parent_id bigint, run_id string, path string")
    got = hierarchy(df).collect()
    assert {r.id: (r.state, r.root_id, r.depth, r.path) for r in got} == want and len(got) == len(want)
    below = {i: sum(1 for s in want.values() if s[0] == "tree" and f"/{s[3]}/".find(f"/{i}/") >= 0) - 1 for i, s in want.items() if s[0] == "tree"}
    assert {r.id: r.descendants for r in got if r.state == "tree"} == below
    assert all(r.root_run_id == (f"r{r.root_id}" if r.state == "tree" else "") for r in got)
    assert hierarchy(df.limit(0)).count() == 0


def test_rank_is_a_bijection(spark):
    rows = spark.range(S.states(4, 2)).select(F.col("id").alias("code"), S.unrank(F.col("id"), 4, 2).alias("p")).select("code", "p", S.rank(F.col("p"), 4, 2).alias("again")).collect()
    assert len({r.p for r in rows}) == 360 and all(r.code == r.again for r in rows)


def _brute_distance(m, r):
    root = tuple(range(1, m + 1)) + (0,) * r
    d, todo = {root: 0}, [root]
    for v in todo:
        for u in (v[1:] + v[:1], v[-1:] + v[:-1], (v[1], v[0]) + v[2:]):
            if u not in d:
                d[u] = d[v] + 1
                todo.append(u)
    return d


def test_distance_table_and_golden_layers(spark):
    t = distance_table(spark, 3, 2, words=True).withColumn("v", S.cells(F.col("p"), 5))
    rows = t.withColumn("end", S.replay(F.col("v"), F.col("word"))).collect()
    want = _brute_distance(3, 2)
    assert {tuple(r.v): r.d for r in rows} == want
    assert all(len(r.word) == r.d and r.end == [1, 2, 3, 0, 0] for r in rows)
    assert [r.states for r in layer_sizes(t).orderBy("d").collect()] == [1, 3, 6, 9, 12, 14, 12, 3]
    try:
        distance_table(spark, 5, 5, max_states=10)
    except Incomplete:
        pass
    else:
        raise AssertionError


def _brute_lift(m, r, q):
    """Least word length per state by search over (state, mark, projected letters left)."""
    n, small = m + r, tuple(range(1, m + 1)) + (0,) * (r - 1)
    best = {(small, j, 0): 0 for j in range(m, n)}
    todo = list(best)
    for s in todo:
        u, j, used = s
        steps = [(u, n - 1, 0) if j == 0 else (u[1:] + u[:1], j - 1, 1), (u, 0, 0) if j == n - 1 else (u[-1:] + u[:-1], j + 1, 1), (u, 1 - j, 0) if j < 2 else ((u[1], u[0]) + u[2:], j, 1)]
        for w, k, c in steps:
            if used + c <= q and (w, k, used + c) not in best:
                best[w, k, used + c] = best[s] + 1
                todo.append((w, k, used + c))
    out = {}
    for (u, j, _), length in best.items():
        v = u[:j] + (0,) + u[j:]
        out[v] = min(out.get(v, 1 << 20), length)
    return out


def test_lifted_minima(spark):
    for q in (3, 6):
        rows = lifted_minima(spark, 3, 2, q).withColumn("v", S.cells(F.col("p"), 5)).collect()
        assert {tuple(r.v): r.a for r in rows if r.a is not None} == _brute_lift(3, 2, q) and len(rows) == 60


def test_expressions_and_errors(spark):
    df = spark.createDataFrame([([2, 0, 1, 3, 0],)], "v array<int>")
    one = lambda e: (lambda r: (r.value, r.error))(expressions.evaluate(df, e, 3, 2).first())
    assert one(["add", 1, "n", ["neg", 2]]) == (4, None)
    assert one(["floordiv", -7, 2]) == (-4, None) and one(["mod", -7, 2]) == (1, None)
    assert one(["floordiv", 1, ["sub", 1, 1]]) == (None, "non-positive divisor")
    assert one(["if", ["lt", 1, 2], 5, ["mod", 1, 0]]) == (5, None)
    assert one(["and", 0, ["mod", 1, 0]]) == (0, None) and one(["or", ["mod", 1, 0], 1]) == (None, "non-positive divisor")
    assert one(["mul", ["mul", 10000, 10000], ["mul", 10000, 10000]]) == (None, "overflow")
    assert one(["pos", 1]) == (2, None) and one(["pos", 9]) == (-1, None) and one(["at", -1]) == (0, None)
    assert one(["sum_tokens", "p"]) == (5, None) and one(["count_tokens", "at_tgt"]) == (0, None) and one(["max_tokens", ["cw_of", "t"]]) == (4, None)
    for bad in (["pos"], ["nope", 1], "zz", 20000, ["sum_tokens", ["sum_tokens", 1]], [], {"a": 1}):
        try:
            expressions.evaluate(df, bad, 3, 2)
        except expressions.ExpressionError:
            continue
        raise AssertionError(bad)
