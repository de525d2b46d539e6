"""Programs scored on every state: bounds, potentials, rules controllers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbita.functions import expressions
from orbita.functions import states as S

# Fixed values of the score: a failed share, each unit above the budget, the least m the budget binds.
FAIL_WEIGHT, EXCESS_WEIGHT, BUDGET_FROM = 1000, 10, 8


def check_values(table: DataFrame, expression, m: int, r: int, descend: bool = False) -> DataFrame:
    """``p, d, value, ok, gap, reason`` of every row of a distance table (``p, d``).

    A bound holds where its value is at least the distance. A potential (``descend``) must also be at
    least 0 and fall by 1 or more to some neighbour of every state but the root; its values on the three
    neighbours are computed in place, so nothing is joined or shuffled. What can't be evaluated fails
    with the error as reason. ``gap`` is value - d where the row is ok; with a null d it is null and the
    distance is not tested.
    """
    n = m + r
    names = {"v": F.col("p"), **({f"v_{x}": q for x, q in S.moves(F.col("p"), n)} if descend else {})}
    rows = table.select("p", "d", *[S.cells(q, n).alias(name) for name, q in names.items()])
    here = expressions.node(expression, F.col("v"), m, r)
    values = {"value": here.value, "error": here.error}
    if descend:
        near = [expressions.node(expression, F.col(f"v_{x}"), m, r) for x in "LRX"]
        values |= {"lowest": F.least(*[x.value for x in near]), "near_error": F.coalesce(*[x.error for x in near])}
    rows = rows.withColumns(values)
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("eval error: "), "error"))
    if descend:
        away = F.col("p") != S.root_key(m, r)
        reason = (
            reason.when(F.col("value") < 0, "negative").when(away & F.col("near_error").isNotNull(), F.concat(F.lit("eval error: "), "near_error"))
            .when(away & (F.col("lowest") > F.col("value") - 1), "no descent")
        )
    rows = rows.withColumn("reason", reason.when(F.col("value") < F.col("d"), "below distance"))
    ok = F.col("reason").isNull()
    return rows.select("p", "d", "value", ok.alias("ok"), F.when(ok, F.col("value") - F.col("d")).alias("gap"), "reason")


def score(checked: DataFrame, m: int, r: int, incomplete: int = 0) -> DataFrame:
    """One row: ``states, failures, value_max, gap_mean`` (3 decimals), ``gap_max, excess, score``.

    ``excess`` is the greatest value less the budget, from m = 8 on. States a limit left ``incomplete`` count as failures in the
    rate, never as states that were checked. Sums are of whole numbers, so they don't depend on the order. The score of an
    empty table is null."""
    total = checked.agg(
        F.count("*").alias("states"), F.count(F.when(~F.col("ok"), 1)).alias("failures"), F.max("value").alias("value_max"),
        F.round(F.sum("gap") / F.count("gap"), 3).alias("gap_mean"), F.max("gap").alias("gap_max"),
    )
    excess = F.col("value_max") - S.budget(m, r) if m >= BUDGET_FROM else F.lit(None).cast("bigint")
    total = total.withColumn("excess", excess)
    rate = (F.col("failures") + incomplete) / (F.col("states") + incomplete)
    value = -FAIL_WEIGHT * rate - EXCESS_WEIGHT * F.greatest(F.coalesce("excess", F.lit(0)), F.lit(0)) - F.coalesce("gap_mean", F.lit(0.0))
    return total.withColumn("score", F.round(value, 4))


def failure_kinds(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("ok")).groupBy("reason").agg(F.count("*").alias("states"))


def run_rules(states: DataFrame, rules: list[dict], default: str, m: int, r: int, max_steps: int) -> DataFrame:
    """Adds ``word`` and ``outcome`` of a rules controller to states (column ``p``).

    Each step takes the first rule whose ``if`` is not 0 (else ``default``), makes its move ``do`` and sets
    the registers of its ``set`` (r0 to r3, from 0) at once, all from the values before the step. Expressions may
    use ``rot`` (net turns modulo n), ``steps``, ``prev`` (0, or 1, 2, 3 for L, R, X) and the registers.
    ``outcome`` is ``solved``, ``step cap``, ``eval error: ...``, or ``cycle after k steps``: without the name ``steps`` in its rules a
    controller depends on state, turns, last letter and registers alone, so the first of these that comes again proves that it
    never ends. ``word`` is null unless solved. All steps of a state are one fold inside the plan: no job per step.
    """
    n, names = m + r, ("r0", "r1", "r2", "r3", "rot", "steps", "prev")
    goal = F.array(*[F.lit(i + 1 if i < m else 0) for i in range(n)])
    zero, cycles = F.lit(0).cast("bigint"), '"steps"' not in json.dumps(rules)
    start = F.struct(S.cells(F.col("p"), n).alias("v"), *[zero.alias(x) for x in names], F.lit("").alias("word"), F.lit(None).cast("string").alias("stop"), F.array().cast("array<string>").alias("seen"))

    def step(a: Column, _: Column) -> Column:
        extra = {x: a[x] for x in names}
        key = F.concat_ws(",", a["v"].cast("array<string>"), *[a[x].cast("string") for x in names if x != "steps"])
        letter, error = F.lit(default), F.lit(None).cast("string")
        sets = {x: a[x] for x in names[:4]}
        for rule in reversed(rules):
            cond = expressions.node(rule["if"], a["v"], m, r, extra)
            taken = cond.value != 0
            new = {x: expressions.node(e, a["v"], m, r, extra) for x, e in rule.get("set", {}).items()}
            failed = F.coalesce(*[x.error for x in new.values()], *[F.when(F.abs(x.value) > 10**9, "register overflow") for x in new.values()], F.lit(None).cast("string"))
            letter = F.when(taken, rule["do"]).otherwise(letter)
            error = F.coalesce(cond.error, F.when(taken, failed).otherwise(error))
            sets = {x: F.when(taken, new[x].value if x in new else a[x]).otherwise(old) for x, old in sets.items()}
        turn = F.when(letter == "L", 1).when(letter == "R", -1).otherwise(0)
        again = F.when(F.array_contains(a["seen"], key), F.concat(F.lit("cycle after "), a["steps"].cast("string"), F.lit(" steps"))) if cycles else F.lit(None).cast("string")
        stop = F.coalesce(again, F.concat(F.lit("eval error: "), error))
        after = F.struct(
            F.when(stop.isNull(), S.replay(a["v"], letter)).otherwise(a["v"]).alias("v"), *[c.alias(x) for x, c in sets.items()], F.pmod(a["rot"] + turn, F.lit(n)).cast("bigint").alias("rot"),
            (a["steps"] + 1).alias("steps"), F.when(letter == "L", 1).when(letter == "R", 2).otherwise(3).cast("bigint").alias("prev"), F.concat(a["word"], letter).alias("word"), stop.alias("stop"),
            (F.concat(a["seen"], F.array(key)) if cycles else a["seen"]).alias("seen"),
        )
        return F.when((a["v"] == goal) | a["stop"].isNotNull(), a).otherwise(after)

    ran = states.withColumn("_a", F.aggregate(F.sequence(F.lit(1), F.lit(max_steps)), start, step))
    solved = F.col("_a.stop").isNull() & (F.col("_a.v") == goal)
    return ran.select(*states.columns, F.when(solved, F.col("_a.word")).alias("word"), F.coalesce("_a.stop", F.when(solved, "solved").otherwise("step cap")).alias("outcome"))
