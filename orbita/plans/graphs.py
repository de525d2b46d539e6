"""Queries over generated states: distance tables, words, features, lifting."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbita.functions import expressions
from orbita.functions import states as S
from orbita.operators import distance as D
from orbita.operators import programs
from orbita.operators.distance import distance_table, layer_sizes, lifting_report, spread_sample
from orbita.plans.liftplans import _marked

#: The greatest distance in (4, 1), the cap of lifting to (4, 2).
RADIUS_4_1 = 10

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _walk(root: str, depth: int) -> str:
    """Recursive SQL that reaches every state (one letter a cell) within a depth."""
    n = len(root)
    return f"""w AS (SELECT '{root}' AS v, 0 AS d UNION SELECT unnest([v[2:{n}] || v[1:1], v[{n}:{n}] || v[1:{n - 1}], v[2:2] || v[1:1] || v[3:{n}]]), d + 1 FROM w WHERE d < {depth}),
    t AS (SELECT v, min(d) AS d FROM w GROUP BY v)"""


def _all(spark, m: int, r: int):
    """All states, generated by rank."""
    return spark.range(S.states(m, r)).select(F.col("id").alias("code"), S.unrank(F.col("id"), m, r).alias("p"))


@query(f"WITH RECURSIVE {_walk('1234500', 20)} SELECT CAST(d AS INTEGER) AS d, count(*) AS states FROM t GROUP BY d")
def layers_5_2(spark, sf):
    return layer_sizes(distance_table(spark, 5, 2))


@query(f"WITH RECURSIVE {_walk('1234500', 20)} SELECT array_to_string(string_split(v, ''), ' ') AS v, CAST(d AS INTEGER) AS d FROM t WHERE d = (SELECT max(d) FROM t)")
def states_at_radius_5_2(spark, sf):
    t = distance_table(spark, 5, 2)
    far = t.agg(F.max("d").alias("far"))
    return t.join(F.broadcast(far), F.col("d") == F.col("far")).select(S.text(F.col("p"), 7).alias("v"), "d")


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, e AS (SELECT b.v, b.d, b.u, b.x FROM (SELECT v, d, unnest([v[2:6] || v[1:1], v[6:6] || v[1:5], v[2:2] || v[1:1] || v[3:6]]) AS u, unnest(['L', 'R', 'X']) AS x FROM t) b JOIN t c ON c.v = b.u AND c.d = b.d - 1),
  g(v, d, n, word) AS (SELECT '123400', 0, 1::BIGINT, '' UNION ALL SELECT q.v, q.d, q.n, q.word FROM (SELECT e.v, e.d, sum(g.n) OVER (PARTITION BY e.v)::BIGINT AS n, e.x || g.word AS word, row_number() OVER (PARTITION BY e.v ORDER BY e.x) AS k FROM g JOIN e ON e.u = g.v AND e.d = g.d + 1) q WHERE q.k = 1)
  SELECT array_to_string(string_split(v, ''), ' ') AS v, CAST(d AS INTEGER) AS d, n AS n_shortest, word FROM g""")
def shortest_words_4_2(spark, sf):
    return distance_table(spark, 4, 2, words=True).select(S.text(F.col("p"), 6).alias("v"), "d", "n_shortest", "word")


@query(f"WITH RECURSIVE {_walk('1234000', 17)} SELECT CAST(max(d) AS INTEGER) AS radius, count(*) AS states, count(*) = 840 AS complete FROM t")
def radius_4_3(spark, sf):
    return distance_table(spark, 4, 3).agg(F.max("d").alias("radius"), F.count("*").alias("states")).withColumn("complete", F.col("states") == S.states(4, 3))


@query("""WITH RECURSIVE w AS (SELECT '123400' AS v UNION SELECT unnest([v[2:6] || v[1:1], v[6:6] || v[1:5], v[2:2] || v[1:1] || v[3:6]]) FROM w)
  SELECT v, v[2:6] || v[1:1] AS l, v[6:6] || v[1:5] AS r, v[2:2] || v[1:1] || v[3:6] AS x, strpos(v, '1') - 1 AS pos1 FROM w""")
def moves_4_2(spark, sf):
    joined = lambda p: F.concat_ws("", S.cells(p, 6))
    rows = _all(spark, 4, 2)
    p = F.col("p")
    return rows.select(joined(p).alias("v"), *[joined(q).alias(x.lower()) for x, q in S.moves(p, 6)], (F.array_position(S.cells(p, 6), F.lit(1)) - 1).alias("pos1"))


@query("SELECT range AS code, range AS again FROM range(0, 2520)")
def rank_round_trip_5_2(spark, sf):
    return _all(spark, 5, 2).select("code", S.rank(F.col("p"), 5, 2).alias("again"))


def _code(m: int, r: int) -> str:
    """SQL of the rank of a state ``c`` (list of cells)."""
    weights = ", ".join(map(str, S.rank_weights(m, r)))
    return f"CAST(list_sum([(list_position(c, i) - 1 - len(list_filter(range(1, i), lambda j: list_position(c, j) < list_position(c, i)))) * ([{weights}])[i] for i in range(1, {m + 1})]) AS BIGINT)"


_LIST = "CAST(string_split(v, '') AS INTEGER[])"
_RANKED = f"{_walk('1234500', 20)}, c AS (SELECT v, CAST(d AS INTEGER) AS d, {_LIST} AS c FROM t), k AS (SELECT v, d, {_code(5, 2)} AS code FROM c)"


@query(f"""WITH RECURSIVE {_RANKED}, l AS (SELECT code FROM k WHERE d = 12), a AS (SELECT i, i * 2520 / 20 AS anchor FROM range(0, 20) x(i)) SELECT DISTINCT coalesce((SELECT min(code) FROM l WHERE code >= floor(anchor)), (SELECT min(code) FROM l)) AS code, 12 AS d FROM a""")
def spread_sample_5_2(spark, sf):
    t = distance_table(spark, 5, 2).select(S.rank(F.col("p"), 5, 2).alias("code"), "d")
    return spread_sample(t, 12, 20, S.states(5, 2))


_INV = lambda q, m: f"list_sum([len(list_filter({q}[i + 1:], lambda y: y < {q}[i])) for i in range(1, {m + 1})])"


def _features(m: int, r: int, source: str = "t") -> str:
    """SQL of all features of the states ``v`` of ``source``: table ``f``."""
    n = m + r
    big = lambda e, name: f"CAST({e} AS BIGINT) AS {name}"
    goal = "[" + ", ".join(str(i if i <= m else 0) for i in range(1, n + 1)) + "]"
    gaps = "[CASE WHEN (z[i % len(z) + 1] - z[i] + {0}) % {0} = 0 THEN {0} ELSE (z[i % len(z) + 1] - z[i] + {0}) % {0} END for i in range(1, len(z) + 1)]".format(n)
    return f"""f0 AS (SELECT *, {_LIST} AS c FROM {source}), f1 AS (SELECT *, list_filter(c, lambda x: x > 0) AS q, [(list_position(c, i) - i + {n}) % {n} for i in range(1, {m + 1})] AS cw, list_filter(range(1, {n + 1}), lambda i: c[i] = 0) AS z, list_position(c, 1) - 1 AS p1 FROM f0),
    f2 AS (SELECT *, [least(x, ({n} - x) % {n}) for x in cw] AS dm, {gaps} AS gp, c[p1 + 1:] || c[1:p1] = {goal} AS cs, [{', '.join(f"q[{k + 1}:] || q[1:{k}]" for k in range(m))}] AS rots FROM f1),
    f AS (SELECT *, {n}::BIGINT AS n, {m}::BIGINT AS m, {r}::BIGINT AS r, {S.budget(m, r)}::BIGINT AS T, {big('c[1]', 'a')}, {big('c[2]', 'b')}, {big(f'c[{n}]', 'last')}, {big('p1', 'pos1')}, {big(f'len(list_filter(range(1, {m + 1}), lambda i: c[i] = i))', 'fixed')},
      {big(f'len(list_filter(range(1, {n + 1}), lambda i: c[i] <> ({goal})[i]))', 'hamming')}, {big(_INV('q', m), 'inv')}, {big(f"list_min([{_INV('w', m)} for w in rots])", 'cinv')}, {big(f'len(list_filter(range(1, {m + 1}), lambda i: q[i % {m} + 1] < q[i]))', 'cdes')},
      {big('list_sum(dm)', 'disp_sum')}, {big('list_max(dm)', 'disp_max')}, {big('list_sum(cw)', 'cw_sum')}, {big(f'list_sum([({n} - x) % {n} for x in cw])', 'ccw_sum')}, {big(f'list_max(gp) = {n - r + 1}', 'zeros_block')}, {big('list_max(gp)', 'zero_gap_max')}, {big('list_min(gp)', 'zero_gap_min')},
      {big('z[1] - 1', 'zero_first')}, {big(f'len(list_filter(c[1:{m}], lambda x: x = 0))', 'zeros_in_prefix')}, {big('cs', 'csorted')}, {big(f'CASE WHEN cs THEN least(p1, {n} - p1) ELSE -1 END', 'rot_dist')}, {big(f'c = {goal}', 'is_root')} FROM f2)"""


_ALL_FEATURES = list(expressions.STATE_NAMES)


@query(f"WITH RECURSIVE {_walk('123400', 16)}, {_features(4, 2)} SELECT array_to_string(c, ' ') AS v, {', '.join(_ALL_FEATURES)} FROM f")
def features_4_2(spark, sf):
    rows = _all(spark, 4, 2).withColumn("cells", S.cells(F.col("p"), 6))
    f = expressions.features(F.col("cells"), 4, 2)
    return rows.select(S.text(F.col("p"), 6).alias("v"), *[f[x].cast("bigint").alias(x) for x in _ALL_FEATURES])


#: A bound and a potential in the expression language: displacement with inversions.
BOUND = ["add", ["mul", 3, "inv"], ["floordiv", "disp_sum", 2], ["if", ["eq", "is_root", 1], 0, "n"]]


_BOUND_SQL = "3 * inv + disp_sum // 2 + CASE WHEN is_root = 1 THEN 0 ELSE n END"


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, {_features(4, 2)} SELECT CAST(d AS INTEGER) AS d, count(*) AS states, count(*) FILTER (WHERE {_BOUND_SQL} < d) AS failures, max({_BOUND_SQL}) AS value_max, max({_BOUND_SQL} - d) AS gap_max FROM f GROUP BY d""")
def bound_check_4_2(spark, sf):
    """A program in the expression language, scored on every state: where it is below the true
    distance it fails; what can't be evaluated fails with a reason."""
    t = distance_table(spark, 4, 2).withColumn("v", S.cells(F.col("p"), 6))
    rows = expressions.evaluate(t, BOUND, 4, 2)
    bad = F.col("error").isNotNull() | (F.col("value") < F.col("d"))
    return rows.groupBy("d").agg(F.count("*").alias("states"), F.count(F.when(bad, 1)).alias("failures"), F.max("value").alias("value_max"), F.max(F.col("value") - F.col("d")).alias("gap_max"))


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, {_marked(4, 2, RADIUS_4_1, 26)}, x AS (SELECT t.d, a.a FROM t LEFT JOIN a ON a.v = t.v AND a.q = {RADIUS_4_1}) SELECT CAST(a - {RADIUS_4_1} AS INTEGER) AS excess, count(*) AS states, count(*) FILTER (WHERE a = d) AS equal_distance, count(*) FILTER (WHERE a < d) AS below_distance FROM x GROUP BY a""")
def lifting_4_2(spark, sf):
    return lifting_report(spark, 4, 2)


_PHI = "3 * inv + disp_sum + CASE WHEN is_root = 1 THEN 0 ELSE n END"


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, {_features(4, 2)}, e AS (SELECT v, d, is_root, {_PHI} AS x FROM f), o AS (SELECT e.*, least((SELECT y.x FROM e y WHERE y.v = e.v[2:6] || e.v[1:1]), (SELECT y.x FROM e y WHERE y.v = e.v[6:6] || e.v[1:5]), (SELECT y.x FROM e y WHERE y.v = e.v[2:2] || e.v[1:1] || e.v[3:6])) AS low FROM e),
  k AS (SELECT *, NOT (x < 0 OR (is_root = 0 AND low > x - 1) OR x < d) AS ok FROM o), s AS (SELECT count(*) AS states, count(*) FILTER (WHERE NOT ok) AS failures, max(x) AS value_max, round(sum(x - d) FILTER (WHERE ok) / count(*) FILTER (WHERE ok), 3) AS gap_mean, max(x - d) FILTER (WHERE ok) AS gap_max FROM k)
  SELECT states, failures, value_max, gap_mean, gap_max, CAST(NULL AS BIGINT) AS excess, round(-1000 * failures / states - coalesce(gap_mean, 0), 4) AS score FROM s""")
def potential_score_4_2(spark, sf):
    """A potential scored on all states: sign, descent to a neighbour, distance."""
    return programs.score(programs.check_values(distance_table(spark, 4, 2), ["add", ["mul", 3, "inv"], "disp_sum", ["if", "is_root", 0, "n"]], 4, 2, descend=True), 4, 2)


#: Swap what is out of order, else turn; a register counts the swaps.
RULES = [{"if": ["and", ["gt", "a", "b"], ["gt", "b", 0]], "do": "X", "set": {"r0": ["add", "r0", 1]}}, {"if": ["and", ["eq", "a", 0], ["gt", "b", 1]], "do": "X"}]


@query("""WITH RECURSIVE g AS (SELECT '12340' AS v UNION SELECT unnest([v[2:5] || v[1:1], v[5:5] || v[1:4], v[2:2] || v[1:1] || v[3:5]]) FROM g),
  w(s, v, rot, prev, r0, word, seen, stop) AS (SELECT v, v, 0, 0, 0, '', CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM g UNION ALL
    SELECT s, CASE WHEN again THEN v WHEN x = 'X' THEN v[2:2] || v[1:1] || v[3:5] ELSE v[2:5] || v[1:1] END, CASE WHEN x = 'L' THEN (rot + 1) % 5 ELSE rot END, CASE x WHEN 'L' THEN 1 ELSE 3 END, r0 + CASE WHEN v[1:1] > v[2:2] AND v[2:2] > '0' THEN 1 ELSE 0 END, word || x, seen || [key],
      CASE WHEN again THEN 'cycle after ' || length(word) || ' steps' END
    FROM (SELECT *, CASE WHEN (v[1:1] > v[2:2] AND v[2:2] > '0') OR (v[1:1] = '0' AND v[2:2] > '1') THEN 'X' ELSE 'L' END AS x, concat_ws(',', v, rot, prev, r0) AS key, list_contains(seen, concat_ws(',', v, rot, prev, r0)) AS again FROM w WHERE v <> '12340' AND stop IS NULL AND length(word) < 60) q),
  z AS (SELECT s, v, word, stop, row_number() OVER (PARTITION BY s ORDER BY length(word) DESC) AS k FROM w)
  SELECT array_to_string(string_split(s, ''), ' ') AS v, CASE WHEN stop IS NULL AND v = '12340' THEN word END AS word, coalesce(stop, CASE WHEN v = '12340' THEN 'solved' ELSE 'step cap' END) AS outcome FROM z WHERE k = 1""")
def rules_4_1(spark, sf):
    """A rules controller run from every state."""
    return programs.run_rules(_all(spark, 4, 1).select("p"), RULES, "L", 4, 1, 60).select(S.text(F.col("p"), 5).alias("v"), "word", "outcome")


@query("""WITH d AS (SELECT unnest(range(0, 5)) AS x), o AS (SELECT [a.x, b.x, c.x, e.x, f.x] AS p FROM d a, d b, d c, d e, d f WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
  u AS (SELECT p, [2 * len(list_filter(range(1, 5), lambda j: p[(s + j) % 5 + 1] < j)) - 4 for s in range(0, 5)] AS w FROM o),
  i AS (SELECT x AS i FROM d), t AS (SELECT p, w, list_sum([(2 * p[s] - 4) * w[s] for s in range(1, 6)]) AS c, list_sum([w[s] * w[s] for s in range(1, 6)]) AS v,
    (SELECT count(*) FROM i a, i b WHERE a.i < b.i AND (p[a.i + 1] - a.i - p[b.i + 1] + b.i + 20) % 5 = 0) AS h,
    (SELECT count(*) FROM i a, i b, i c WHERE a.i < b.i AND b.i < c.i AND (p[b.i + 1] - p[a.i + 1] + 5) % 5 < (p[c.i + 1] - p[a.i + 1] + 5) % 5) AS k FROM u)
  SELECT array_to_string(p, ' ') AS circle, CAST(c AS BIGINT) AS c, CAST(k AS BIGINT) AS k, CAST(h AS BIGINT) AS h, CAST(v AS BIGINT) AS v, CAST(c - 4 * k - 2 * h AS BIGINT) AS e FROM t""")
def order_statistics_5(spark, sf):
    rows = _all(spark, 5, 0).select(F.transform(S.cells(F.col("p"), 5), lambda x: x - 1).alias("o"))
    return rows.select(F.concat_ws(" ", F.col("o").cast("array<string>")).alias("circle"), *[c.cast("bigint").alias(name.lower()) for name, c in S.order_statistics(F.col("o"), 5).items()])
