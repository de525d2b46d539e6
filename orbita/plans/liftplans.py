"""Queries over marked states: lifting under a cap on the projection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.operators import distance as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _walk(root: str, depth: int, name: str = "t") -> str:
    n = len(root)
    return f"""g{name} AS (SELECT '{root}' AS v, 0 AS d UNION SELECT unnest([v[2:{n}] || v[1:1], v[{n}:{n}] || v[1:{n - 1}], v[2:2] || v[1:1] || v[3:{n}]]), d + 1 FROM g{name} WHERE d < {depth}), {name} AS (SELECT v, min(d) AS d FROM g{name} GROUP BY v)"""


def _marked(m: int, r: int, q: int, longest: int) -> str:
    """Recursive SQL: marked states with the letters and projected letters of words to the end, from the ends backwards;
    then ``h(u, j, q, h)`` and ``a(v, q, a)``."""
    n, k = m + r, m + r - 1
    root = "".join(map(str, range(1, m + 1))) + "0" * (r - 1)
    ends = ", ".join(f"({j})" for j in range(m, n))
    return f"""e AS (SELECT '{root}' AS u, j, 0 AS used, 0 AS len FROM (VALUES {ends}) x(j) UNION SELECT s.u, s.j, s.used, len FROM (SELECT unnest([
      {{'u': CASE WHEN j = 0 THEN u ELSE u[2:{k}] || u[1:1] END, 'j': CASE WHEN j = 0 THEN {n - 1} ELSE j - 1 END, 'used': used + CASE WHEN j = 0 THEN 0 ELSE 1 END}},
      {{'u': CASE WHEN j = {n - 1} THEN u ELSE u[{k}:{k}] || u[1:{k - 1}] END, 'j': CASE WHEN j = {n - 1} THEN 0 ELSE j + 1 END, 'used': used + CASE WHEN j = {n - 1} THEN 0 ELSE 1 END}},
      {{'u': CASE WHEN j < 2 THEN u ELSE u[2:2] || u[1:1] || u[3:{k}] END, 'j': CASE WHEN j < 2 THEN 1 - j ELSE j END, 'used': used + CASE WHEN j < 2 OR u[1:1] = u[2:2] THEN 0 ELSE 1 END}}]) AS s, len + 1 AS len FROM e WHERE len < {longest}) z WHERE s.used <= {q}),
    b AS (SELECT u, j, used, min(len) AS len FROM e GROUP BY u, j, used), h AS (SELECT u, j, CAST(range AS INTEGER) AS q, CAST(min(len) AS INTEGER) AS h FROM b JOIN range(0, {q + 1}) ON used <= range GROUP BY u, j, range),
    a AS (SELECT u[1:j] || '0' || u[j + 1:{k}] AS v, q, min(h) AS a FROM h GROUP BY v, q)"""


def _text(c, n: int):
    return F.concat_ws("", S.cells(F.col(c), n))


@query(f"WITH RECURSIVE {_marked(3, 2, 7, 26)} SELECT u, CAST(j AS INTEGER) AS j, q, h FROM h")
def lifted_words_3_2(spark, sf):
    """Least lengths of all marked states under every cap up to 7."""
    return D.h_table(D.lifted_layers(spark, 3, 2, 7), 7).select(_text("u", 4).alias("u"), "j", "q", "h")


@query(f"WITH RECURSIVE {_walk('1230', 12)}, {_marked(3, 2, 12, 26)} SELECT h.u, CAST(j AS INTEGER) AS j, CAST(e AS INTEGER) AS e, h AS f FROM t JOIN range(0, 4) x(e) ON true JOIN h ON h.u = t.v AND h.q = t.d + e")
def excess_words_3_2(spark, sf):
    """Least lengths when the projection may take 0 to 3 letters more than it has to."""
    return D.excess_table(spark, 3, 2, 3).select(_text("u", 4).alias("u"), "j", "e", "f")


@query(f"""WITH RECURSIVE {_walk('12300', 10)}, {_marked(3, 2, 9, 26)} SELECT q, count(*) AS lifted, count(*) FILTER (WHERE a > {S.budget(3, 2)}) AS over_budget, count(*) FILTER (WHERE a = d) AS equal_distance, max(a) AS max_a FROM a JOIN t ON t.v = a.v WHERE q >= 2 GROUP BY q""")
def lift_sweep_3_2(spark, sf):
    return D.sweep(spark, 3, 2, range(2, 10))


@query(f"""WITH RECURSIVE {_walk('12300', 10)}, {_marked(3, 2, 9, 26)}, s AS (SELECT q, count(*) FILTER (WHERE a.a <> t.d) + (60 - count(*)) AS misses FROM a JOIN t ON t.v = a.v GROUP BY q) SELECT CAST(min(q) AS INTEGER) AS least_q FROM s WHERE misses = 0""")
def sweep_threshold_3_2(spark, sf):
    """The least cap under which every state keeps a shortest word."""
    rows = D.sweep(spark, 3, 2, range(0, 10)).where(F.col("equal_distance") == S.states(3, 2))
    return rows.agg(F.min("q").alias("least_q"))


@query(f"""WITH RECURSIVE {_walk('12300', 10)}, {_marked(3, 2, 11, 26)}, s AS (SELECT a.v, e, min(q) AS projection FROM a JOIN t ON t.v = a.v JOIN range(0, 4) x(e) ON a.a <= t.d + e GROUP BY a.v, e) SELECT CAST(e AS INTEGER) AS e, projection, count(*) AS states FROM s GROUP BY e, projection""")
def slack_profile_3_2(spark, sf):
    return D.slack_profile(spark, 3, 2, 3)


@query(f"""WITH RECURSIVE {_marked(3, 2, 6, 26)} SELECT u, CAST(j AS INTEGER) AS j, h AS length, true AS sorts FROM h WHERE q = 6""")
def lift_witnesses_3_2(spark, sf):
    """A word of every marked state under the cap 6, replayed on the state with its zero put in."""
    layers = D.lifted_layers(spark, 3, 2, 6)
    asked = D.all_states(spark, 3, 1).select(F.col("p").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    out = D.witnesses(spark, asked, layers, 3, 2, 6)
    cells = S.cells(F.col("u"), 4)
    whole = F.concat(F.slice(cells, F.lit(1), F.col("j")), F.array(F.lit(0)), F.slice(cells, F.col("j") + 1, F.lit(4)))
    goal = F.array(*[F.lit(x) for x in (1, 2, 3, 0, 0)])
    return out.select(_text("u", 4).alias("u"), "j", F.length("word").alias("length"), (S.replay(whole, F.col("word")) == goal).alias("sorts"))


@query(f"""WITH RECURSIVE {_walk('12300', 10)}, {_marked(3, 2, 5, 26)} SELECT t.v, CAST(t.d AS INTEGER) AS d, a.a AS least, CASE WHEN a.a IS NULL THEN 'NO_WORD' WHEN a.a <= {S.budget(3, 2)} THEN 'WITHIN' ELSE 'OVER' END AS status FROM t LEFT JOIN a ON a.v = t.v AND a.q = 5 WHERE t.d >= 5""")
def far_states_3_2(spark, sf):
    """The states of the outer layers checked one by one: whether a word keeps the cap 5, and the budget."""
    table = D.distance_table(spark, 3, 2).where("d >= 5")
    both = table.join(D.minima(D.of_cap(D.lifted_layers(spark, 3, 2, 5), 5), 5), "p", "left")
    status = F.when(F.col("a").isNull(), "NO_WORD").when(F.col("a") <= S.budget(3, 2), "WITHIN").otherwise("OVER")
    return both.select(_text("p", 5).alias("v"), "d", F.col("a").alias("least"), status.alias("status"))


_DROP = lambda v, x, m: f"translate(replace({v}, '{x}', ''), '{''.join(map(str, range(x + 1, m + 1)))}', '{''.join(map(str, range(x, m)))}')" if x < m else f"replace({v}, '{x}', '')"
_CENSUS = f"""{_walk('1234500', 20)}, {_walk('123400', 16, 's')}, x AS (SELECT t.v, t.d, s.d AS e FROM (SELECT v, d, unnest([{', '.join(_DROP('v', x, 5) for x in range(1, 6))}]) AS w FROM t) t JOIN s ON s.v = t.w), y AS (SELECT v, d, min(e) AS low, max(e) AS high FROM x GROUP BY v, d), p AS (SELECT max(d) AS p FROM s)"""


@query(f"""WITH RECURSIVE {_CENSUS} SELECT CASE WHEN low <= p - 2 THEN 'proved' WHEN high <= p THEN 'open' ELSE 'above' END AS part, CAST(low AS INTEGER) AS low, CAST(d AS INTEGER) AS d, count(*) AS states FROM y, p GROUP BY ALL""")
def deletion_census_5_2(spark, sf):
    """Every state with each label taken out, looked up in the smaller table: the least and greatest of these distances tell
    which part it is in; counted jointly with the distance."""
    out, p = _deletions(spark)
    part = F.when(F.col("low") <= p - 2, "proved").when(F.col("high") <= p, "open").otherwise("above")
    return out.groupBy(part.alias("part"), "low", "d").agg(F.count("*").alias("states"))


@query(f"""WITH RECURSIVE {_CENSUS}, z AS (SELECT *, max(d) OVER () AS top FROM y, p WHERE low > p - 2 AND high <= p) SELECT v, CAST(d AS INTEGER) AS d FROM z WHERE d = top""")
def farthest_open_5_2(spark, sf):
    """The states of the outer class that lie farthest."""
    out, p = _deletions(spark)
    open_states = out.where((F.col("low") > p - 2) & (F.col("high") <= p))
    top = open_states.agg(F.max("d").alias("top"))
    return open_states.join(F.broadcast(top), F.col("d") == F.col("top")).select(_text("p", 7).alias("v"), "d")


def _deletions(spark):
    smaller = D.distance_table(spark, 4, 2)
    p = smaller.agg(F.max("d")).first()[0]

    def without(x: int):
        """Key of the state without label x, those above it one down."""
        left = F.filter(S.cells(F.col("p"), 7), lambda c: c != x)
        return S.pack(F.transform(left, lambda c: F.when(c > x, c - 1).otherwise(c)))

    keys = F.array(*[without(x) for x in range(1, 6)])
    rows = D.distance_table(spark, 5, 2).select("p", "d", F.explode(keys).alias("key"))
    met = rows.join(smaller.select(F.col("p").alias("key"), F.col("d").alias("e")), "key")
    return met.groupBy("p", "d").agg(F.min("e").alias("low"), F.max("e").alias("high")), p


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, {_marked(4, 2, 10, 26)} SELECT t.v, CAST(t.d AS INTEGER) AS d, a.a, CAST(row_number() OVER (ORDER BY a.a DESC, t.v) AS INTEGER) AS place FROM t JOIN a ON a.v = t.v AND a.q = 10 ORDER BY a.a DESC, t.v LIMIT 5""")
def lifting_examples_4_2(spark, sf):
    """The states with the longest least words under the cap, equal ones by state."""
    both = D.distance_table(spark, 4, 2).join(D.minima(D.of_cap(D.lifted_layers(spark, 4, 2, 10), 10), 6), "p").select(_text("p", 6).alias("v"), "d", "a")
    top = both.orderBy(F.desc("a"), "v").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("a"), "v")))


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, {_marked(4, 2, 10, 26)}, x AS (SELECT t.d, a.a FROM t LEFT JOIN a ON a.v = t.v AND a.q = 10) SELECT count(*) AS visible, count(*) FILTER (WHERE a IS NULL) AS no_word, count(*) FILTER (WHERE a > {S.budget(4, 2)}) AS over_budget, CAST(max(a) AS INTEGER) AS max_a, count(*) FILTER (WHERE a = d) AS equal_distance, count(*) FILTER (WHERE a < d) AS below_distance,
  (SELECT string_agg(CAST(e AS VARCHAR) || ':' || n, ' ' ORDER BY e) FROM (SELECT a - 10 AS e, count(*) AS n FROM x WHERE a - 10 >= -3 GROUP BY e)) AS histogram FROM x""")
def lifting_summary_4_2(spark, sf):
    """One row of counts with the upper end of the histogram, from three below the cap on."""
    both = D.distance_table(spark, 4, 2).join(D.lifted_minima(spark, 4, 2, 10), "p")
    count = lambda c: F.count(F.when(c, 1))
    total = both.agg(F.count("*").alias("visible"), count(F.col("a").isNull()).alias("no_word"), count(F.col("a") > S.budget(4, 2)).alias("over_budget"), F.max("a").alias("max_a"), count(F.col("a") == F.col("d")).alias("equal_distance"), count(F.col("a") < F.col("d")).alias("below_distance"))
    bars = both.where("a >= 7").groupBy((F.col("a") - 10).alias("e")).agg(F.count("*").alias("n"))
    text = bars.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("e", "n"))), lambda x: F.concat(x["e"].cast("string"), F.lit(":"), x["n"].cast("string"))), " ").alias("histogram"))
    return total.crossJoin(F.broadcast(text))
