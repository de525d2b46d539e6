"""Queries over runs of words: on the families' unit states, and on all states of small graphs.

Each family runs a word cut from one fixed pattern at a place and of a length of its own, so that the SQL can name it too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.functions import wordruns as W
from orbita.functions.runtime import table
from orbita.operators.distance import distance_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORD = "substring(repeat('LXRRXLLXLXRXLLX', 4), 1 + k, 12 + m)"


def _families(spark, sf):
    return table(spark, sf, "families").where("unit_base IS NOT NULL").withColumn("v", F.col("unit_base").cast("array<int>")).withColumn("word", F.expr(_WORD))


_F = f"f AS (SELECT *, unit_base AS v, {_WORD} AS word FROM families WHERE unit_base IS NOT NULL)"
#: A state with its zeros told apart: number j is -1 - j.
_ATOMS = "[CASE WHEN v[i] = 0 THEN -len(list_filter(v[1:i], lambda y: y = 0)) ELSE v[i] END for i in range(1, len(v) + 1)]"
_X = "substring(word, i + 1, 1)"
_NEXT = f"CASE {_X} WHEN 'L' THEN a[2:] || a[1:1] WHEN 'R' THEN a[len(a):] || a[1:len(a) - 1] ELSE [a[2], a[1]] || a[3:] END"
_FRONT = f"CASE {_X} WHEN 'L' THEN a[1] ELSE a[len(a)] END"


def _run(start: str, extra: dict[str, tuple[str, str]], source: str = "f", keys: str = "id") -> str:
    """Recursive SQL of a run over ``source`` (``keys, v, word``): extra columns with their start and step."""
    names = "".join(f", {k}" for k in extra)
    first = "".join(f", {a}" for a, _ in extra.values())
    steps = "".join(f", {b}" for _, b in extra.values())
    return f"w({keys}, word, i, a{names}) AS (SELECT {keys}, word, 0, {start}{first} FROM {source} UNION ALL SELECT {keys}, word, i + 1, {_NEXT}{steps} FROM w WHERE i < length(word))"


def _joined(c: str) -> str:
    return f"array_to_string({c}, ' ')"


def _text(c) -> F.Column:
    return F.array_join(c.cast("array<string>"), " ")


@query(f"WITH RECURSIVE {_F}, {_run('v', {})} SELECT id, word, {_joined('a')} AS final FROM w WHERE i = length(word)")
def replayed_words(spark, sf):
    return _families(spark, sf).select("id", "word", _text(S.replay(F.col("v"), F.col("word"))).alias("final"))


_GONE = "[-1, CASE WHEN k > 2 THEN -3 ELSE -1 END]"


@query(f"""WITH RECURSIVE {_F}, g AS (SELECT *, {_GONE} AS gone FROM f), {_run(_ATOMS, {'gone': ('gone', 'gone'), 'kept': ("''", f"kept || CASE WHEN {_X} = 'X' AND (list_contains(gone, a[1]) OR list_contains(gone, a[2])) THEN '' WHEN {_X} <> 'X' AND list_contains(gone, {_FRONT}) THEN '' ELSE {_X} END")}, 'g')}
  SELECT w.id, {_joined(f"[greatest(x, 0) for x in {_ATOMS} if NOT list_contains(gone, x)]")} AS child, kept AS child_word FROM w JOIN f ON f.id = w.id WHERE i = length(w.word)""")
def projected_words(spark, sf):
    """The first zero, and the third where there is one, deleted from a run."""
    gone = F.when(F.col("k") > 2, F.array(F.lit(-1), F.lit(-3))).otherwise(F.array(F.lit(-1)))
    rows = _families(spark, sf).withColumn("p", W.projection(F.col("v"), F.col("word"), gone))
    return rows.select("id", _text(F.col("p.child")).alias("child"), F.col("p.word").alias("child_word"))


_IDLE = f"{_X} = 'X' AND a[1] < 0 AND a[2] < 0"
_EVENT = f"CASE WHEN {_IDLE} THEN 0 WHEN {_X} = 'X' THEN least(a[1], a[2]) ELSE {_FRONT} END"


@query(f"""WITH RECURSIVE {_F}, {_run(_ATOMS, {'idle': ('0', f"idle + CAST({_IDLE} AS INTEGER)"), 'ev': ('CAST([] AS INTEGER[])', f"ev || [{_EVENT}]")})}, z AS (SELECT *, unnest(range(0, len(list_filter(a, lambda x: x < 0)))) AS zero FROM w WHERE i = length(word))
  SELECT id, CAST(zero AS INTEGER) AS zero, idle AS idle_swaps, CAST(len(list_filter(ev, lambda x: x = -1 - zero)) AS INTEGER) AS erased, CAST(length(word) - idle - len(list_filter(ev, lambda x: x = -1 - zero)) AS INTEGER) AS projection_length FROM z""")
def projection_lengths(spark, sf):
    """How long the run is without each of the zeros, all in one pass."""
    rows = _families(spark, sf).withColumn("c", W.projection_counts(F.col("v"), F.col("word")))
    each = rows.select("id", "word", "c.idle", F.posexplode("c.own").alias("zero", "erased"))
    return each.select("id", "zero", F.col("idle").alias("idle_swaps"), "erased", (F.length("word") - F.col("idle") - F.col("erased")).alias("projection_length"))


def _reduce_sql(pairs: str, source: str) -> str:
    """Recursive SQL that cancels pairs with a stack, over ``source`` (``id, whole``)."""
    return f"""r(id, n, rest, out) AS (SELECT id, 0, whole, '' FROM {source} UNION ALL SELECT id, n + 1, rest, CASE WHEN (right(out, 1) || substring(rest, n + 1, 1)) IN {pairs} THEN left(out, length(out) - 1) ELSE out || substring(rest, n + 1, 1) END FROM r WHERE n < length(rest))"""


@query(f"""WITH RECURSIVE {_F}, h AS (SELECT id, word AS whole FROM f), {_reduce_sql("('LR', 'RL', 'XX')", 'h')}, {_reduce_sql("('LR', 'RL')", 'h').replace('r(id', 's(id').replace('FROM r ', 'FROM s ')}
  SELECT r.id, r.out AS reduced, s.out AS turns_reduced FROM r JOIN s ON r.id = s.id WHERE r.n = length(r.rest) AND s.n = length(s.rest)""")
def reduced_words(spark, sf):
    rows = _families(spark, sf)
    return rows.select("id", W.reduced(F.col("word"), "LR", "RL", "XX").alias("reduced"), W.reduced(F.col("word"), "LR", "RL").alias("turns_reduced"))


@query(f"""WITH RECURSIVE {_F}, {_run('v', {'m': ('m', 'm'), 'kept': ("''", f"kept || CASE WHEN {_X} = 'X' AND (a[1] = m OR a[2] = m) THEN '' WHEN {_X} <> 'X' AND {_FRONT} = m THEN '' ELSE {_X} END")})},
  h AS (SELECT id, kept AS whole FROM w WHERE i = length(word)), {_reduce_sql("('LR', 'RL')", 'h')} SELECT id, out AS child_word FROM r WHERE n = length(rest)""")
def words_without_last_label(spark, sf):
    return _families(spark, sf).select("id", W.without_label(F.col("v"), F.col("word"), F.col("m")).alias("child_word"))


@query("""WITH p AS (SELECT id, m, labels, mask, unnest(range(0, m + 1)) AS position FROM families), s AS (SELECT *, unnest(CASE WHEN (mask >> position) & 1 = 1 THEN ['left', 'right', 'both'] ELSE ['none'] END) AS split FROM p),
  c AS (SELECT *, labels[1:position] || [m + 1] || labels[position + 1:] AS child_labels, (mask & ((1::BIGINT << position) - 1)) | ((mask >> (position + 1)) << (position + 2)) | (CASE split WHEN 'left' THEN 1 WHEN 'right' THEN 2 WHEN 'both' THEN 3 ELSE 0 END::BIGINT << position) AS child_mask FROM s)
  SELECT id, CAST(position AS INTEGER) AS position, split, 'm' || (m + 1) || '-mask' || child_mask || '-labels' || CASE WHEN m + 1 <= 9 THEN array_to_string(child_labels, '') ELSE array_to_string(child_labels, '.') END AS child_id, CAST(bit_count(child_mask) AS INTEGER) AS child_k FROM c""")
def child_families(spark, sf):
    """All families one label larger: the label at every position, the zeros of its gap on either side or both."""
    rows = table(spark, sf, "families").select("id", "m", "labels", "mask", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("position"))
    full = F.call_function("shiftright", F.col("mask"), F.col("position")).bitwiseAND(1) == 1
    rows = rows.withColumn("split", F.explode(F.when(full, F.array(F.lit("left"), F.lit("right"), F.lit("both"))).otherwise(F.array(F.lit("none")))))
    labels, mask = W.child_family(F.col("labels"), F.col("mask"), F.col("position"), F.col("split"))
    rows = rows.select("id", "position", "split", labels.alias("labels"), mask.alias("mask"))
    return rows.select("id", "position", "split", W.family_id(F.col("labels"), F.col("mask")).alias("child_id"), F.bit_count("mask").alias("child_k"))


_ZERO = "len(list_filter(v[1:i], lambda y: y = 0))"


@query(f"""WITH {_F}, t AS (SELECT id, k, v, [CASE WHEN v[i] <> 0 THEN 1 ELSE 1 + ({_ZERO} % 3) END for i in range(1, len(v) + 1)] AS o, [CASE WHEN v[i] = 0 AND {_ZERO} = 1 THEN 3 WHEN v[i] = 0 AND {_ZERO} = k THEN 2 ELSE 1 END for i in range(1, len(v) + 1)] AS n FROM f)
  SELECT id, {_joined('flatten([list_resize([v[i]], o[i], v[i]) for i in range(1, len(v) + 1)])')} AS refined, {_joined('flatten([list_resize([v[i]], n[i], v[i]) for i in range(1, len(v) + 1)])')} AS stretched,
  {_joined('[coalesce(list_sum(n[1:i - 1]), 0)::INTEGER for i in range(1, len(v) + 1)]')} AS places, {_joined('[o[i] for i in range(1, len(v) + 1) if v[i] = 0]')} AS blocks FROM t""")
def stretched_states(spark, sf):
    """Zero j of a family refined to 1 + (j + 1) mod 3 zeros; its first zero stretched by 2 and its last by 1; read back."""
    origin = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: 1 + j % 3)
    picks, z = F.when(F.col("k") > 1, F.array(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.lit(0))), F.array(F.lit(2), F.lit(1))
    rows = _families(spark, sf).withColumn("refined", W.refined(F.col("v"), origin))
    return rows.select(
        "id", _text(F.col("refined")).alias("refined"), _text(W.stretched(F.col("v"), picks, z)).alias("stretched"), _text(W.stretched_places(F.col("v"), picks, z)).alias("places"),
        _text(W.zero_blocks(F.col("refined"))).alias("blocks"),
    )


@query("""SELECT 'm' || m || '-mask' || mask || '-labels' || CASE WHEN m <= 9 THEN array_to_string(labels, '') ELSE array_to_string(labels, '.') END AS family, m, mask, len(list_filter(range(1, m + 1), lambda i: labels[i % m + 1] = CASE WHEN labels[i] = 1 THEN m ELSE labels[i] - 1 END)) = m AS reversal,
  k, m * (m + 1) // 2 + (k - 1) * (m - 2) AS budget_unit, m - 2 AS slope_bound FROM families WHERE unit_base IS NOT NULL""")
def families_of_states(spark, sf):
    """Families read back from their unit states: labels, mask, id, blocks, budget."""
    v = F.col("unit_base")
    rows = table(spark, sf, "families").where("unit_base IS NOT NULL").select(S.parse_labels(v).alias("labels"), S.parse_mask(v).alias("mask"))
    m, k = F.size("labels"), F.bit_count("mask")
    return rows.select(W.family_id(F.col("labels"), F.col("mask")).alias("family"), m.alias("m"), "mask", W.is_reversal(F.col("labels")).alias("reversal"), k.alias("k"), S.budget(m, k).cast("int").alias("budget_unit"), (m - 2).alias("slope_bound"))


# Comparison runs on all states of (3, 2): the sorted row begins at cell f, the window at the cut.

_PERMS = """p AS (SELECT unnest(range(0, 5)) AS x), v AS (SELECT DISTINCT [greatest(0, 3 - a.x), greatest(0, 3 - b.x), greatest(0, 3 - c.x), greatest(0, 3 - d.x), greatest(0, 3 - e.x)]::INTEGER[] AS v FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  o AS (SELECT v, unnest([0, 2]) AS f, unnest([1, 3]) AS cut FROM v), n AS (SELECT *, [v[(w + cut) % 5 + 1] for w in range(0, 5)] AS win, list_sort([(f + 3 + i + 5 - cut) % 5 for i in range(0, 2)]) AS ends FROM o),
  r AS (SELECT *, [CASE WHEN win[w] > 0 THEN (f + win[w] - 1 + 5 - cut) % 5 ELSE ends[len(list_filter(win[1:w], lambda y: y = 0))] END for w in range(1, 6)]::INTEGER[] AS ranks FROM n)"""


def _small(spark):
    rows = spark.range(S.states(3, 2)).select(S.unrank(F.col("id"), 3, 2).alias("p")).select(S.cells(F.col("p"), 5).alias("v"))
    rows = rows.crossJoin(F.broadcast(spark.createDataFrame([(0, 1), (2, 3)], "f int, cut int")))
    return rows.withColumn("ranks", W.target_ranks(F.col("v"), F.col("f"), F.col("cut")))


@query(f"""WITH {_PERMS}, z AS (SELECT *, [i for i in range(1, 6) if v[i] = 0][1] AS z0 FROM r), y AS (SELECT *, (z0 - 1 - cut + 5) % 5 + 1 AS w0 FROM z)
  SELECT array_to_string(v, ' ') AS v, cut, array_to_string(ranks, ' ') AS ranks, CAST(list_sum([len(list_filter(ranks[i + 1:], lambda y: y < ranks[i])) for i in range(1, 6)]) AS INTEGER) AS inversions,
  CAST(len([w for w in range(1, 6) if win[w] > 0 AND ((w < w0 AND ranks[w] > ranks[w0]) OR (w > w0 AND ranks[w] < ranks[w0]))]) AS INTEGER) AS crossed FROM y""")
def target_ranks_3_2(spark, sf):
    """Window ranks of every state, their inversions, and the labels out of order with the first zero."""
    rows = _small(spark).select(F.col("v").alias("c"), F.col("ranks").alias("r"), "cut")
    return rows.select(_text(F.col("c")).alias("v"), "cut", _text(F.col("r")).alias("ranks"), S.inversions(F.col("r")).alias("inversions"), W.crossed(F.col("r"), F.col("c"), F.col("cut"), F.lit(0)).alias("crossed"))


@query(f"""WITH {_PERMS}, q AS (SELECT * FROM r WHERE cut = 1) SELECT array_to_string(a.v, ' ') AS v, count(*) AS dominated FROM q a JOIN q b
  ON len([1 for j in range(1, 6) if len([1 for s in range(1, 6) if len(list_filter(a.ranks[1:j], lambda x: x < s)) < len(list_filter(b.ranks[1:j], lambda x: x < s))]) > 0]) = 0 GROUP BY a.v""")
def prefix_dominance_3_2(spark, sf):
    """How many states' ranks each state's ranks come before in prefix order: a pair test over one small table."""
    rows = _small(spark).where("cut = 1").select("v", "ranks")
    other = rows.select(F.col("ranks").alias("q"))
    return rows.join(other, W.dominates(F.col("ranks"), F.col("q"))).groupBy("v").agg(F.count("*").alias("dominated")).select(_text(F.col("v")).alias("v"), "dominated")


_CRUN = """w(v, cut, i, a, k, spot, swaps, turns, across) AS (SELECT v, cut, 0, v, [ranks[(p - cut + 5) % 5 + 1] for p in range(0, 5)], 0, 0, 0, 0 FROM r UNION ALL
  SELECT v, cut, i + 1, CASE WHEN x = 'L' THEN a[2:] || a[1:1] WHEN x = 'R' THEN a[5:] || a[1:4] WHEN k[1] > k[2] THEN [a[2], a[1]] || a[3:] ELSE a END, CASE WHEN x = 'L' THEN k[2:] || k[1:1] WHEN x = 'R' THEN k[5:] || k[1:4] WHEN k[1] > k[2] THEN [k[2], k[1]] || k[3:] ELSE k END,
  CASE x WHEN 'L' THEN (spot + 1) % 5 WHEN 'R' THEN (spot + 4) % 5 ELSE spot END, swaps + CASE WHEN x = 'X' AND k[1] > k[2] THEN 1 ELSE 0 END, turns + CASE WHEN x <> 'X' THEN 1 ELSE 0 END, across + CASE WHEN x = 'X' AND (spot + 1) % 5 = cut THEN 1 ELSE 0 END
  FROM (SELECT *, substring('LXLXLXRRXLX', i + 1, 1) AS x FROM w WHERE i < 11) w)"""


@query(f"WITH RECURSIVE {_PERMS}, {_CRUN} SELECT array_to_string(v, ' ') AS v, cut, array_to_string(a, ' ') AS final, swaps, turns, across FROM w WHERE i = 11")
def comparison_runs_3_2(spark, sf):
    """A word run on every state so that only pairs whose ranks fall are swapped."""
    rows = _small(spark).withColumn("c", W.comparison_run(F.col("v"), F.lit("LXLXLXRRXLX"), F.col("ranks"), F.col("cut")))
    return rows.select(_text(F.col("v")).alias("v"), "cut", _text(F.col("c.cells")).alias("final"), "c.swaps", "c.turns", "c.across")


# Traces along words, against the exact table of (4, 2).

def _walk(root: str, depth: int) -> str:
    n = len(root)
    return f"""g AS (SELECT '{root}' AS v, 0 AS d UNION SELECT unnest([v[2:{n}] || v[1:1], v[{n}:{n}] || v[1:{n - 1}], v[2:2] || v[1:1] || v[3:{n}]]), d + 1 FROM g WHERE d < {depth}), t AS (SELECT v, min(d) AS d FROM g GROUP BY v)"""


_TRACE_WORD = "LXRXLLXRRXLXL"
_TRACE = f"""{_walk('123400', 16)}, w(v, i, a) AS (SELECT v, 0, v FROM t UNION ALL SELECT v, i + 1, CASE substring('{_TRACE_WORD}', i + 1, 1) WHEN 'L' THEN a[2:6] || a[1:1] WHEN 'R' THEN a[6:6] || a[1:5] ELSE a[2:2] || a[1:1] || a[3:6] END FROM w WHERE i < {len(_TRACE_WORD)}),
  s AS (SELECT w.v, w.i, t.d, t0.d AS d0, lag(t.d) OVER (PARTITION BY w.v ORDER BY w.i) AS before FROM w JOIN t ON t.v = w.a JOIN t t0 ON t0.v = w.v)"""


def _trace(spark):
    """``p, d0, s``: of every state its distance and, step by step, the distance after each letter of a word."""
    t = distance_table(spark, 4, 2)
    keys = t.select("p", F.col("d").alias("d0"), F.posexplode(W.prefix_keys(F.col("p"), F.lit(_TRACE_WORD), 6)).alias("at", "key"))
    met = keys.join(t.select(F.col("p").alias("key"), "d"), "key").select("p", "d0", F.struct((F.col("at") + 1).alias("step"), "d").alias("s"))
    return met.groupBy("p", "d0").agg(F.sort_array(F.collect_list("s")).alias("s"))


@query(f"WITH RECURSIVE {_TRACE} SELECT array_to_string(string_split(v, ''), ' ') AS v, CAST(i AS INTEGER) AS step, CAST(d AS INTEGER) AS d FROM s WHERE i > 0")
def prefix_distances_4_2(spark, sf):
    return _trace(spark).select(S.text(F.col("p"), 6).alias("v"), F.explode("s").alias("s")).select("v", "s.step", "s.d")


_LOST = 13


@query(f"""WITH RECURSIVE {_TRACE} SELECT array_to_string(string_split(v, ''), ' ') AS v, CAST(min(CASE WHEN i > 0 AND i + d > d0 THEN i END) AS INTEGER) AS off_path, CAST(min(CASE WHEN i > 0 AND i + d > {_LOST} THEN i END) AS INTEGER) AS budget_lost,
  CAST(count(*) FILTER (WHERE d > before) AS INTEGER) AS uphill, CAST(count(*) FILTER (WHERE d = before) AS INTEGER) AS flat FROM s GROUP BY v""")
def word_traces_4_2(spark, sf):
    """Of a word from every state: the first step off all shortest paths, the first after which the budget can't be kept,
    the steps away from the root and the steps that change nothing."""
    runs = _trace(spark)
    d = F.concat(F.array("d0"), F.transform("s", lambda x: x["d"]))
    steps = F.filter(F.transform(d, lambda x, i: F.struct(i.alias("step"), x.alias("d"), F.when(i > 0, F.element_at(d, F.greatest(i, F.lit(1)))).alias("before"))), lambda x: x["step"] > 0)
    runs = runs.withColumn("steps", steps)
    first = lambda cond: F.array_min(F.transform(F.filter("steps", cond), lambda x: x["step"]))
    count = lambda cond: F.size(F.filter("steps", cond))
    return runs.select(
        S.text(F.col("p"), 6).alias("v"), first(lambda x: x["step"] + x["d"] > F.col("d0")).alias("off_path"), first(lambda x: x["step"] + x["d"] > _LOST).alias("budget_lost"),
        count(lambda x: x["d"] > x["before"]).alias("uphill"), count(lambda x: x["d"] == x["before"]).alias("flat"),
    )


@query("""SELECT CAST(k AS INTEGER) AS k, CAST(8 * k - 1 AS INTEGER) AS m, repeat('L', k - 1) || 'X' || repeat('RX', k - 1) || repeat('R', k) || 'X' || repeat('LX', k - 2) || 'LLL' AS word,
  array_to_string(range(1, k + 1) || [0] || range(k + 1, 7 * k + 1) || [0] || range(7 * k + 1, 8 * k), ' ') AS v, CAST(6 * k - 2 AS INTEGER) AS length, true AS sorts FROM range(2, 30) t(k)""")
def closed_form_words(spark, sf):
    """The closed words of the series m = 8k - 1, r = 2, with their states, replayed."""
    k = F.col("k")
    rows = spark.range(2, 30).select(F.col("id").cast("int").alias("k"))
    word = F.concat(F.repeat(F.lit("L"), k - 1), F.lit("X"), F.repeat(F.lit("RX"), k - 1), F.repeat(F.lit("R"), k), F.lit("X"), F.repeat(F.lit("LX"), k - 2), F.lit("LLL"))
    v = F.concat(F.sequence(F.lit(1), k), F.array(F.lit(0)), F.sequence(k + 1, 7 * k), F.array(F.lit(0)), F.sequence(7 * k + 1, 8 * k - 1))
    rows = rows.select("k", (8 * k - 1).alias("m"), word.alias("word"), v.alias("v"))
    goal = F.concat(F.sequence(F.lit(1), F.col("m")), F.array(F.lit(0), F.lit(0)))
    return rows.select("k", "m", "word", _text(F.col("v")).alias("v"), F.length("word").alias("length"), (S.replay(F.col("v"), F.col("word")) == goal).alias("sorts"))
