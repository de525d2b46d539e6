"""Queries over tables of distances: look-ups, samples, probes, scores, literal searches, beams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbita.functions import expressions
from orbita.functions import states as S
from orbita.operators import distance as D
from orbita.operators import programs
from orbita.operators import search as Q
from orbita.plans.archive import running
from orbita.plans.graphs import _BOUND_SQL, _LIST, _code, _features, _walk, BOUND

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _ranked(spark, m, r):
    return D.distance_table(spark, m, r).withColumn("code", S.rank(F.col("p"), m, r))


def _flat(c, n):
    return F.concat_ws("", S.cells(F.col(c), n))


def _k(root: str, depth: int, m: int, r: int) -> str:
    return f"{_walk(root, depth)}, k AS (SELECT v, CAST(d AS INTEGER) AS d, {_code(m, r)} AS code FROM (SELECT v, d, {_LIST} AS c FROM t))"


@query(f"WITH RECURSIVE {_walk('123400', 16)} SELECT x.v, CAST(t.d AS INTEGER) AS d FROM (VALUES ('002143'), ('432100'), ('123400'), ('999999'), ('040321')) x(v) LEFT JOIN t ON t.v = x.v")
def point_lookup_4_2(spark, sf):
    """Distances of given states; null of what is no state."""
    asked = spark.createDataFrame([(x,) for x in ("002143", "432100", "123400", "999999", "040321")], "v string")
    keys = asked.withColumn("p", S.pack(F.transform(F.filter(F.split("v", ""), lambda x: x != ""), lambda x: x.cast("int"))))
    return keys.join(D.distance_table(spark, 4, 2), "p", "left").select("v", "d")


@query(f"WITH RECURSIVE {_k('1234500', 20, 5, 2)} SELECT code, v, CAST(row_number() OVER (ORDER BY code) AS INTEGER) AS place FROM k WHERE d = 7 ORDER BY code LIMIT 25")
def layer_scan_5_2(spark, sf):
    """The first states of a layer in order of rank."""
    top = _ranked(spark, 5, 2).where("d = 7").orderBy("code").limit(25)
    return top.select("code", _flat("p", 7).alias("v"), F.row_number().over(Window.orderBy("code")).alias("place"))


@query(f"""WITH RECURSIVE {_k('123400', 16, 4, 2)}, m AS (SELECT max(d) AS far FROM k), a AS (SELECT k.* FROM k, m WHERE d = far), z AS (SELECT code, row_number() OVER (ORDER BY d, code) - 1 AS i, count(*) OVER () AS n FROM k, m WHERE d < far), nd AS (SELECT 20 - (SELECT count(*) FROM a) AS need),
  p AS (SELECT CAST(floor((SELECT any_value(n) FROM z) * 1.0 / need * i + (SELECT any_value(n) FROM z) * 1.0 / need / 2) AS BIGINT) AS i FROM nd, range(0, 20) x(i) WHERE i < need) SELECT code FROM a UNION ALL SELECT z.code FROM z JOIN p ON p.i = z.i""")
def screen_4_2(spark, sf):
    """All states of the last layer and evenly spaced ones of the rest, twenty in all: places by running counts of stretches."""
    rows = _ranked(spark, 4, 2).select("code", "d")
    far = rows.agg(F.max("d")).first()[0]
    last, rest = rows.where(F.col("d") == far), rows.where(F.col("d") < far)
    need, n = 20 - last.count(), rest.count()
    picks = spark.createDataFrame([(int(n / need * i + n / need / 2),) for i in range(need)], "i bigint")
    placed = running(rest, [], F.col("d") * (1 << 20) + F.floor(F.col("code") / 4096), ["d", "code"], F.lit(1), "i", agg=F.sum)
    return last.select("code").unionByName(placed.join(picks, "i").select("code"))


@query(f"WITH RECURSIVE {_k('1234500', 20, 5, 2)}, o AS (SELECT d, code, row_number() OVER (PARTITION BY d ORDER BY code) - 1 AS i FROM k) SELECT d, i AS ordinal, code FROM o WHERE i % 37 = 5")
def layer_ordinals_5_2(spark, sf):
    """The 5th, 42nd, ... state of each layer in order of rank."""
    rows = _ranked(spark, 5, 2).select("code", "d")
    placed = running(rows, ["d"], F.floor(F.col("code") / 4096), ["code"], F.lit(1), "ordinal", agg=F.sum)
    return placed.where("ordinal % 37 = 5").select("d", F.col("ordinal").cast("bigint").alias("ordinal"), "code")


@query(f"WITH RECURSIVE {_walk('123400', 16)}, {_features(4, 2)} SELECT v, {_BOUND_SQL} AS value, CAST(row_number() OVER (ORDER BY {_BOUND_SQL} DESC, v) AS INTEGER) AS place FROM f ORDER BY value DESC, v LIMIT 5")
def worst_values_4_2(spark, sf):
    """The five largest values of a program, equal ones by state."""
    t = D.distance_table(spark, 4, 2).withColumn("v", S.cells(F.col("p"), 6))
    top = expressions.evaluate(t, BOUND, 4, 2).select(F.concat_ws("", "v").alias("v"), "value").orderBy(F.desc("value"), "v").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "v")))


# Probes: given states, spread ones of the outer layers, then codes by a fixed step; each state counts once, at its first place.

HARD_LAYERS, PER_LAYER, BY_STEP = 3, 4, 10


def structured(m: int, r: int) -> list[str]:
    """Root, the root turned by half, reversed, reversed and turned by one, and reversed with the zeros spread evenly."""
    n = m + r
    up, down = [*range(1, m + 1), *[0] * r], [*range(m, 0, -1), *[0] * r]
    slots = sorted({i * n // m for i in range(m)})
    out = [up, up[n // 2:] + up[:n // 2], down, down[1:] + down[:1]]
    if len(slots) == m:
        spread = [0] * n
        for token, slot in zip(range(m, 0, -1), slots):
            spread[slot] = token
        out.append(spread)
    return ["".join(map(str, v)) for v in out]


def probes(spark, ranked, m: int, r: int):
    """``ordinal, p, d``: the probe set, numbered from 0 without the states that came before."""
    size = S.states(m, r)
    far = ranked.agg(F.max("d")).first()[0]
    given = spark.createDataFrame([(i, v) for i, v in enumerate(structured(m, r))], "o int, v string")
    parts = [given.select("o", S.pack(F.transform(F.filter(F.split("v", ""), lambda x: x != ""), lambda x: x.cast("int"))).alias("p"))]
    for k in range(HARD_LAYERS):
        picked = D.spread_sample(ranked, far - k, PER_LAYER, size).join(ranked.select("code", "p"), "code")
        parts.append(picked.select((F.lit(100 * (k + 1)) + F.row_number().over(Window.orderBy("code"))).alias("o"), "p"))
    steps = spark.range(BY_STEP).select((F.lit(1000) + F.col("id")).cast("int").alias("o"), F.pmod(F.col("id") * 97 + 13, F.lit(size)).alias("code"))
    parts.append(steps.join(ranked.select("code", "p"), "code").select("o", "p"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    first = out.groupBy("p").agg(F.min("o").alias("o"))
    numbered = first.select("p", (F.row_number().over(Window.orderBy("o")) - 1).alias("ordinal"))  # as many rows as probes
    return numbered.join(ranked.select("p", "d"), "p", "left").select("ordinal", "p", "d")


def _probes_sql(m: int, r: int) -> str:
    size = S.states(m, r)
    given = ", ".join(f"({i}, '{v}')" for i, v in enumerate(structured(m, r)))
    return f"""pl AS (SELECT 100 * (h + 1) AS base, (SELECT max(d) FROM k) - h AS d FROM range(0, {HARD_LAYERS}) x(h)), pa AS (SELECT DISTINCT base, coalesce((SELECT min(code) FROM k WHERE k.d = pl.d AND k.code >= i * {size} // {PER_LAYER}), (SELECT min(code) FROM k WHERE k.d = pl.d)) AS code FROM pl, range(0, {PER_LAYER}) y(i)),
    po AS (SELECT o, v FROM (VALUES {given}) x(o, v) UNION ALL SELECT base + row_number() OVER (PARTITION BY base ORDER BY pa.code), k.v FROM pa JOIN k ON k.code = pa.code UNION ALL SELECT 1000 + i, k.v FROM range(0, {BY_STEP}) x(i) JOIN k ON k.code = (i * 97 + 13) % {size}),
    pr AS (SELECT k.v, k.d, row_number() OVER (ORDER BY min(o)) - 1 AS ordinal FROM po JOIN k ON k.v = po.v GROUP BY k.v, k.d)"""


@query(f"WITH RECURSIVE {_k('123400', 16, 4, 2)}, {_probes_sql(4, 2)} SELECT CAST(ordinal AS INTEGER) AS ordinal, v, d FROM pr")
def probe_set_4_2(spark, sf):
    return probes(spark, _ranked(spark, 4, 2), 4, 2).select("ordinal", _flat("p", 6).alias("v"), "d")


_CHEAP = ["add", ["mul", 2, "inv"], "disp_max"]
_SCORED = """SELECT count(*) AS checked, count(*) FILTER (WHERE NOT ok) AS failures, max(x) AS value_max, round(sum(x - d) FILTER (WHERE ok) / count(*) FILTER (WHERE ok), 3) AS gap_mean, max(x - d) FILTER (WHERE ok) AS gap_max,
    array_to_string(list_sort(list({'o': ordinal, 'v': v}) FILTER (WHERE NOT ok))[1:4].list_transform(lambda zz: zz.v), ' ') AS worst, array_to_string(list_reverse_sort(list({'x': x, 'o': ordinal, 'v': v}))[1:2].list_transform(lambda zz: zz.v), ' ') AS largest"""


def _scores(m, r, root, depth, role, expr, which):
    source = "pr" if role == "train" else "(SELECT v, d, code AS ordinal FROM k)"
    probe = f", {_probes_sql(m, r)}" if role == "train" else ""
    return f"""(WITH RECURSIVE {_k(root, depth, m, r)}{probe}, {_features(m, r, source)}, e AS (SELECT v, ordinal, d, {expr} AS x, {expr} >= d AS ok FROM f) SELECT '{which}' AS graph, '{role}' AS role, s.* FROM ({_SCORED} FROM e) s)"""


_CHEAP_SQL = "2 * inv + disp_max"
_BOTH = f"""g AS (SELECT *, round(-1000 * failures / checked - coalesce(gap_mean, 0), 4) AS score FROM (SELECT * FROM {_scores(3, 2, '12300', 10, 'sanity', _BOUND_SQL, 'm3r2')} UNION ALL SELECT * FROM {_scores(4, 2, '123400', 16, 'train', _BOUND_SQL, 'm4r2')}))"""


def _score_graphs(spark, expression, graphs):
    """A row a graph: all states of sanity graphs, the probes of others."""
    out = None
    for m, r, role in graphs:
        ranked = _ranked(spark, m, r)
        rows = ranked.select(F.col("code").alias("ordinal"), "p", "d") if role == "sanity" else probes(spark, ranked, m, r)
        checked = programs.check_values(rows.select("p", "d"), expression, m, r).join(rows.select("p", F.col("ordinal").cast("bigint").alias("ordinal")), "p")
        one = programs.score(checked, m, r).select(F.lit(f"m{m}r{r}").alias("graph"), F.lit(role).alias("role"), F.col("states").alias("checked"), "failures", "value_max", "gap_mean", "gap_max", "score")
        v = _flat("p", m + r)
        # Only the first failures and the largest values are kept, never the list of all states.
        worst = checked.where(~F.col("ok")).orderBy("ordinal").limit(4).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", v.alias("v")))), lambda e: e["v"]), " ").alias("worst"))
        largest = checked.orderBy(F.desc("value"), F.desc("ordinal")).limit(2).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("value", "ordinal", v.alias("v"))), False), lambda e: e["v"]), " ").alias("largest"))
        one = one.crossJoin(F.broadcast(worst)).crossJoin(F.broadcast(largest))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_BOTH} SELECT graph, role, checked, failures, value_max, gap_mean, gap_max, score, CASE WHEN failures = 0 THEN '' ELSE worst END AS worst, CASE WHEN failures = 0 THEN largest ELSE '' END AS largest FROM g")
def probe_scores(spark, sf):
    """A program scored on a sanity graph (all states) and a training graph (its probes), with the first failures or the largest values."""
    rows = _score_graphs(spark, BOUND, ((3, 2, "sanity"), (4, 2, "train")))
    return rows.withColumns({"worst": F.when(F.col("failures") == 0, "").otherwise(F.col("worst")), "largest": F.when(F.col("failures") == 0, F.col("largest")).otherwise("")})


@query(f"""WITH {_BOTH}, s AS (SELECT bool_or(role = 'sanity' AND failures > 0) AS stopped FROM g), u AS (SELECT g.*, stopped FROM g, s WHERE role = 'sanity' OR NOT stopped)
  SELECT count(*) AS graphs, any_value(stopped) AS stopped, NOT any_value(stopped) AND bool_and(failures = 0) AS feasible, round(avg(score) - CASE WHEN any_value(stopped) THEN 1000 ELSE 0 END, 4) AS score FROM u""")
def candidate_score(spark, sf):
    """Graph scores rolled up: a failure on a sanity graph stops the evaluation, costs 1000 and leaves the later graphs out."""
    rows = _score_graphs(spark, BOUND, ((3, 2, "sanity"), (4, 2, "train")))
    stopped = rows.agg(F.coalesce(F.bool_or((F.col("role") == "sanity") & (F.col("failures") > 0)), F.lit(False)).alias("stopped"))
    used = rows.crossJoin(F.broadcast(stopped)).where((F.col("role") == "sanity") | ~F.col("stopped"))
    total = used.agg(F.count("*").alias("graphs"), F.bool_or("stopped").alias("stopped"), F.bool_and(F.col("failures") == 0).alias("clean"), F.avg("score").alias("a"))
    return total.select("graphs", "stopped", (~F.col("stopped") & F.col("clean")).alias("feasible"), F.round(F.col("a") - F.when(F.col("stopped"), 1000).otherwise(0), 4).alias("score"))


@query(f"""WITH RECURSIVE {_k('123400', 16, 4, 2)}, {_features(4, 2, 'k')}, e AS (SELECT v, code, d, {_CHEAP_SQL} AS x FROM f) SELECT count(*) AS states, count(*) FILTER (WHERE x < d) AS failures, max(x) AS value_max, CAST(max(d) AS INTEGER) AS radius, count(*) FILTER (WHERE x < d) = 0 AS holds, max(x) <= {S.budget(4, 2)} AS within_budget,
  array_to_string(list_sort(list({{'c': code, 'v': v}}) FILTER (WHERE x < d))[1:10].list_transform(lambda z: z.v), ' ') AS worst FROM e""")
def certify_4_2(spark, sf):
    """A program checked on all states of a graph, with the first ten failures by rank."""
    ranked = _ranked(spark, 4, 2)
    checked = programs.check_values(ranked.select("p", "d"), _CHEAP, 4, 2).join(ranked.select("p", "code"), "p")
    first = checked.where(~F.col("ok")).orderBy("code").limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code", _flat("p", 6).alias("v")))), lambda e: e["v"]), " ").alias("worst"))
    total = checked.agg(F.count("*").alias("states"), F.count(F.when(~F.col("ok"), 1)).alias("failures"), F.max("value").alias("value_max"), F.max("d").alias("radius"))
    return total.withColumns({"holds": F.col("failures") == 0, "within_budget": F.col("value_max") <= S.budget(4, 2)}).crossJoin(F.broadcast(first))


@query(f"""WITH RECURSIVE {_walk('1234500', 20)}, e AS (SELECT v, d, unnest([v[2:7] || v[1:1], v[7:7] || v[1:6], v[2:2] || v[1:1] || v[3:7]]) AS u FROM t), x AS (SELECT e.v, e.d, max(abs(t.d - e.d)) AS jump, min(t.d) AS low FROM e JOIN t ON t.v = e.u GROUP BY e.v, e.d)
  SELECT count(*) AS states, count(*) FILTER (WHERE jump > 1) AS jumps, count(*) FILTER (WHERE d > 0 AND low <> d - 1) AS without_predecessor, CAST(max(d) AS INTEGER) AS radius FROM x""")
def table_check_5_2(spark, sf):
    """A finished table checked against its meaning, on every state: neighbours differ by at most one, and each state but the
    root has a neighbour one nearer."""
    t = D.distance_table(spark, 5, 2)
    near = t.select("p", "d", F.explode(F.array(*[q for _, q in S.moves(F.col("p"), 7)])).alias("u")).join(t.select(F.col("p").alias("u"), F.col("d").alias("e")), "u", "left")
    each = near.groupBy("p", "d").agg(F.max(F.abs(F.coalesce("e", F.lit(999)) - F.col("d"))).alias("jump"), F.min("e").alias("low"))
    count = lambda c: F.count(F.when(c, 1))
    return each.agg(F.count("*").alias("states"), count(F.col("jump") > 1).alias("jumps"), count((F.col("d") > 0) & (F.col("low") != F.col("d") - 1)).alias("without_predecessor"), F.max("d").alias("radius"))


@query(f"WITH RECURSIVE {_walk('1234500', 20)} SELECT CAST(d AS INTEGER) AS d, count(DISTINCT u) AS frontier FROM (SELECT d, unnest([v[2:7] || v[1:1], v[7:7] || v[1:6], v[2:2] || v[1:1] || v[3:7]]) AS u FROM t) GROUP BY d")
def bitmap_frontiers_5_2(spark, sf):
    """How many states lie one move from each layer: a bitmap per letter and block of codes, merged by OR, and its bits counted."""
    rows = D.distance_table(spark, 5, 2).select("d", F.posexplode(F.array(*[q for _, q in S.moves(F.col("p"), 7)])).alias("letter", "u"))
    codes = rows.select("d", "letter", S.rank(F.col("u"), 5, 2).alias("code")).select("d", "letter", F.bitmap_bucket_number("code").alias("block"), F.bitmap_bit_position("code").alias("bit"))
    own = codes.groupBy("d", "letter", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return own.groupBy("d", "block").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy("d").agg(F.sum(F.bitmap_count("bits")).alias("frontier"))


@query(f"WITH RECURSIVE {_walk('12300', 10)} SELECT CAST(d AS INTEGER) AS d, count(*) AS literal, count(*) AS ranked, true AS agree FROM t GROUP BY d")
def literal_layers_3_2(spark, sf):
    """Layer sizes of a search over written states, which assumes nothing, beside those of the packed search."""
    a = Q.layered(spark.createDataFrame([("12300",)], "key string"), Q.literal_moves).groupBy("d").agg(F.count("*").alias("literal"))
    b = D.layer_sizes(D.distance_table(spark, 3, 2)).withColumnRenamed("states", "ranked")
    return a.join(b, "d", "full").withColumn("agree", F.coalesce(F.col("literal") == F.col("ranked"), F.lit(False)))


_MARKED = """w(u, j, d) AS (SELECT '1230', 3, 0 UNION SELECT s.u, s.j, d FROM (SELECT unnest([{'u': CASE WHEN j = 0 THEN u ELSE u[2:4] || u[1:1] END, 'j': CASE WHEN j = 0 THEN 4 ELSE j - 1 END}, {'u': CASE WHEN j = 4 THEN u ELSE u[4:4] || u[1:3] END, 'j': CASE WHEN j = 4 THEN 0 ELSE j + 1 END},
  {'u': CASE WHEN j < 2 THEN u ELSE u[2:2] || u[1:1] || u[3:4] END, 'j': CASE WHEN j < 2 THEN 1 - j ELSE j END}]) AS s, d + 1 AS d FROM w WHERE d < 14) q), t AS (SELECT u, j, min(d) AS d FROM w GROUP BY u, j)"""


@query(f"WITH RECURSIVE {_MARKED} SELECT u || '|' || j AS marked, CAST(d AS INTEGER) AS d, CAST(d AS INTEGER) AS length, j >= 3 AND u = '1230' AS terminal FROM t")
def marked_search_3_2(spark, sf):
    """Distances of marked states from the one start with the mark behind the tokens, and the paths back as words."""
    t = Q.layered(spark.createDataFrame([("1230|3",)], "key string"), lambda c: Q.marked_moves(c, 5))
    words = Q.paths(t, t.select("key"))
    end = (F.substring_index("marked", "|", 1) == "1230") & (F.substring_index("marked", "|", -1).cast("int") >= 3)
    return t.join(words, "key").select(F.col("key").alias("marked"), "d", F.length("word").alias("length")).withColumn("terminal", end)


@query(f"""WITH RECURSIVE {_walk('123400', 4).replace('FROM w ', 'FROM w ')}, a AS (SELECT v FROM t), b0 AS (SELECT '304021' AS v, 0 AS d UNION SELECT unnest([v[2:6] || v[1:1], v[6:6] || v[1:5], v[2:2] || v[1:1] || v[3:6]]), d + 1 FROM b0 WHERE d < 4), b AS (SELECT DISTINCT v FROM b0)
  SELECT (SELECT count(*) FROM a) AS near_root, (SELECT count(*) FROM b) AS near_state, (SELECT count(*) FROM a JOIN b ON a.v = b.v) AS common, (SELECT count(*) FROM a JOIN b ON a.v = b.v) = 0 AS farther_than_8""")
def disjoint_balls_4_2(spark, sf):
    """Balls of radius 4 around the root and a state: without a common state, the state is more than 8 letters away."""
    ball = lambda v: Q.layered(spark.createDataFrame([(v,)], "key string"), Q.literal_moves, max_depth=4)
    a, b = ball("123400"), ball("304021")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(a, "near_root").crossJoin(one(b, "near_state")).crossJoin(one(a.join(b.select("key"), "key", "left_semi"), "common"))
    return out.withColumn("farther_than_8", F.col("common") == 0)


_BEAM = ["add", "hamming", ["mul", 2, "inv"]]
_VALUE = lambda u: f"(len([1 for i in range(1, 6) if {u}[i:i] <> ('12300')[i:i]]) + 2 * list_sum([len([1 for j in range(i + 1, 4) if replace({u}, '0', '')[j:j] < replace({u}, '0', '')[i:i]]) for i in range(1, 4)]))"


@query(f"""WITH RECURSIVE {_walk('12300', 10)}, b(s, k, beam, seen, made, outcome, length, total) AS (SELECT v, 0, [v], [v], 0, CASE WHEN v = '12300' THEN 'solved' END, CASE WHEN v = '12300' THEN 0 END, 0 FROM t UNION ALL
    SELECT s, k + 1, [x.u for x in list_sort([{{'x': {_VALUE('fresh[y]')}, 'i': y, 'u': fresh[y]}} for y in range(1, len(fresh) + 1)])[1:2]], seen || fresh, made + len(fresh),
      CASE WHEN len(fresh) = 0 THEN 'beam exhausted' WHEN spot IS NOT NULL AND made + spot - 1 <= 12 THEN 'solved' WHEN made + len(fresh) - CASE WHEN spot IS NULL THEN 0 ELSE 1 END > 12 THEN 'expansion cap' END, CASE WHEN spot IS NOT NULL AND made + spot - 1 <= 12 THEN k + 1 END,
      CASE WHEN spot IS NOT NULL AND made + spot - 1 <= 12 THEN made + spot - 1 WHEN made + len(fresh) > 12 THEN 13 ELSE made + len(fresh) END
    FROM (SELECT *, CASE WHEN list_position(fresh, '12300') > 0 THEN list_position(fresh, '12300') END AS spot FROM (SELECT *, [g[i] for i in range(1, len(g) + 1) if NOT list_contains(seen, g[i]) AND list_position(g, g[i]) = i] AS fresh
      FROM (SELECT *, flatten([[v[2:5] || v[1:1], v[5:5] || v[1:4], v[2:2] || v[1:1] || v[3:5]] for v in beam]) AS g FROM b WHERE outcome IS NULL) q1) q2) q3)
  SELECT s AS start, outcome, CAST(length AS INTEGER) AS length, CAST(total AS BIGINT) AS expansions FROM b WHERE outcome IS NOT NULL""")
def beams_3_2(spark, sf):
    """Beams of width 2 from every state, at most 12 expansions."""
    out = Q.beam_search(D.all_states(spark, 3, 2), _BEAM, 3, 2, 2, 12)
    return out.select(_flat("start", 5).alias("start"), "outcome", "length", "expansions")
