"""Scored programs against plain Python."""

import itertools

from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.operators import programs


def _table(spark, m, r):
    return spark.range(S.states(m, r)).select(S.unrank(F.col("id"), m, r).alias("p"), F.lit(0).alias("d"))


def _near(v):
    return v[1:] + v[:1], v[-1:] + v[:-1], (v[1], v[0]) + v[2:]


def test_potential(spark):
    inv = lambda v: sum(x > y for x, y in itertools.combinations([x for x in v if x], 2))
    rows = programs.check_values(_table(spark, 3, 1), ["sub", "inv", 1], 3, 1, descend=True).withColumn("v", S.cells(F.col("p"), 4)).collect()
    assert len(rows) == 24
    for row in rows:
        v = tuple(row.v)
        phi = inv(v) - 1
        want = "negative" if phi < 0 else "no descent" if v != (1, 2, 3, 0) and min(map(inv, _near(v))) - 1 > phi - 1 else "below distance" if phi < 0 else None
        assert (row.value, row.reason) == (phi, want)
    out = programs.score(programs.check_values(_table(spark, 3, 1), ["mod", 1, ["sub", "a", 1]], 3, 1), 3, 1).first()
    assert (out.states, out.failures) == (24, 12)  # a is 0 or 1 in half of the states


def test_rules(spark):
    rules = [{"if": ["and", ["gt", "a", "b"], ["gt", "b", 0], ["lt", "r1", 3]], "do": "X", "set": {"r0": "r1", "r1": ["add", "r0", 1]}}, {"if": ["eq", "prev", 3], "do": "R"}]

    def run(v, cap):
        goal, regs, prev, word = (1, 2, 3, 0), [0, 0], 0, ""
        while v != goal and len(word) < cap:
            if v[0] > v[1] > 0 and regs[1] < 3:
                x, regs = "X", [regs[1], regs[0] + 1]
            else:
                x = "R" if prev == 3 else "L"
            v, prev, word = _near(v)["LRX".index(x)], "LRX".index(x) + 1, word + x
        return word if v == goal else None

    rows = programs.run_rules(_table(spark, 3, 1), rules, "L", 3, 1, 7).withColumn("v", S.cells(F.col("p"), 4)).collect()
    assert {tuple(r.v): r.word for r in rows} == {tuple(r.v): run(tuple(r.v), 7) for r in rows} and any(r.word is None for r in rows)
    assert all(r.outcome == ("step cap" if r.word is None else "solved") for r in rows)
    bad = programs.run_rules(_table(spark, 3, 1), [{"if": ["mod", 1, "a"], "do": "X"}], "L", 3, 1, 5).where("outcome LIKE 'eval error%'")
    assert bad.count() > 0 and bad.where("word IS NOT NULL").count() == 0
