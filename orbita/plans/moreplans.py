"""Queries over bounded searches, trees, groups of instances, clause domains and folds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.functions.runtime import remove_at_exit, shared_folder, table
from orbita.operators import distance as D
from orbita.operators import search as Q
from orbita.plans import rollupplans, wordplans
from orbita.plans.archive import running
from orbita.plans.graphs import _walk
from orbita.plans.searchplans import _flat, _k, _ranked
from orbita.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_STARTS = "s0 AS (SELECT unnest(['432100', '002143', '340012', '143200', '420013']) AS s)"
_DIST = """e(s, v, g) AS (SELECT s, s, 0 FROM s0 UNION SELECT s, unnest([v[2:6] || v[1:1], v[6:6] || v[1:5], v[2:2] || v[1:1] || v[3:6]]), g + 1 FROM e WHERE g < 13), u AS (SELECT s, v, min(g) AS g FROM e GROUP BY s, v)"""


@query(f"""WITH RECURSIVE {_STARTS}, {_DIST}, {_walk('120000', 12)}, d AS (SELECT s, g AS d FROM u WHERE v = '123400'), q AS (SELECT d.s, d.d + x AS bound, d.d FROM d, (SELECT unnest([0, 1]) AS x)),
  k AS (SELECT q.s, q.bound, count(*) AS states FROM q JOIN u ON u.s = q.s JOIN t ON t.v = translate(u.v, '34', '00') WHERE u.g + t.d < q.bound GROUP BY q.s, q.bound)
  SELECT q.s AS start, CAST(q.bound AS INTEGER) AS bound, CASE WHEN d < q.bound THEN 'FOUND' ELSE 'PROVED' END AS status, CAST(CASE WHEN d < q.bound THEN d END AS INTEGER) AS length, coalesce(k.states, 0) AS states, 0 AS inconsistent FROM q LEFT JOIN k ON k.s = q.s AND k.bound = q.bound""")
def bounded_searches_4_2(spark, sf):
    """States asked whether a word shorter than their distance exists, and than one letter more: proved and found, with the states made."""
    patterns = D.distance_table(spark, 2, 4)
    table_ = D.distance_table(spark, 4, 2)
    starts = spark.createDataFrame([(x,) for x in ("432100", "002143", "340012", "143200", "420013")], "v string")
    keys = starts.select(S.pack(F.transform(F.filter(F.split("v", ""), lambda x: x != ""), lambda x: x.cast("int"))).alias("start"))
    asked = keys.join(table_.withColumnRenamed("p", "start"), "start").select("start", F.explode(F.array(F.col("d"), F.col("d") + 1)).alias("bound"))
    wrong = Q.inconsistent(patterns, 6)
    out = Q.bounded_search(asked, patterns, 4, 2, 2)
    return out.select(_flat("start", 6).alias("start"), "bound", "status", "length", "states", F.lit(wrong).alias("inconsistent"))


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, ww(s, v, d, word) AS (SELECT v, v, d, '' FROM t WHERE d >= 11 UNION ALL SELECT s, t.v, t.d, word || x FROM (SELECT s, d, word, unnest(['L', 'R', 'X']) AS x, unnest([v[2:6] || v[1:1], v[6:6] || v[1:5], v[2:2] || v[1:1] || v[3:6]]) AS u FROM ww WHERE d > 0) q JOIN t ON t.v = q.u AND t.d = q.d - 1)
  SELECT s AS v, word FROM ww WHERE d = 0""")
def all_shortest_words_4_2(spark, sf):
    """Every shortest word of the states of the last two layers."""
    t = D.distance_table(spark, 4, 2)
    return Q.all_words(t, t.where("d >= 11").select("p"), 4, 2).select(_flat("start", 6).alias("v"), "word")


@query(f"WITH RECURSIVE {wordplans._TRACE} SELECT array_to_string(string_split(v, ''), ' ') AS v, CAST(min(i + d) AS INTEGER) AS best, CAST(arg_min(i, i + d + i / 1000.0) AS INTEGER) AS kept FROM s GROUP BY v")
def suffixes_redone_4_2(spark, sf):
    """A word cut at every letter and finished from there as shortly as can be: the least length in all, and how many letters of the
    word are kept for it (as few as possible)."""
    runs = wordplans._trace(spark)
    all_cuts = F.concat(F.array(F.struct(F.col("d0").alias("n"), F.lit(0).alias("kept"))), F.transform("s", lambda x: F.struct((x["step"] + x["d"]).alias("n"), x["step"].alias("kept"))))
    return runs.withColumn("b", F.array_min(all_cuts)).select(S.text(F.col("p"), 6).alias("v"), F.col("b.n").alias("best"), F.col("b.kept").alias("kept"))


@query("""WITH f AS (SELECT id, k FROM families WHERE k >= 2) SELECT id, 'l' AS leaf, array_to_string([0 for _ in range(0, 3)], ' ') AS low, k || ' - -' AS high FROM f UNION ALL SELECT id, 'rl', (k + 1) || ' 0 0', '- 2 -' FROM f
  UNION ALL SELECT id, 'rrl', (k + 1) || ' 3 0', (k + 5) || ' - -' FROM f UNION ALL SELECT id, 'rrr', (k + 6) || ' 3 0', '- - -' FROM f UNION ALL SELECT id, '', '0 0 0', '- - -' FROM families WHERE k = 1""")
def tree_boxes(spark, sf):
    """Boxes of the leaves of trees: those of families of several blocks have three splits."""
    leaf = F.lit('{"kind": "leaf"}')
    inner = F.concat(F.lit('{"j": 0, "t": '), F.col("k") + 5, F.lit(', "le": '), leaf, F.lit(', "ge": '), leaf, F.lit("}"))
    middle = F.concat(F.lit('{"j": 1, "t": 2, "le": '), leaf, F.lit(', "ge": '), inner, F.lit("}"))
    tree = F.when(F.col("k") >= 2, F.concat(F.lit('{"j": 0, "t": '), F.col("k"), F.lit(', "le": '), leaf, F.lit(', "ge": '), middle, F.lit("}"))).otherwise(leaf)
    out = Q.tree_leaves(table(spark, sf, "families").select("id", tree.alias("tree")), 3)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ")
    return out.select("id", "leaf", text("low").alias("low"), text("high").alias("high"))


@query(f"WITH RECURSIVE {_k('123400', 16, 4, 2)}, o AS (SELECT code, d, row_number() OVER (ORDER BY d, code) - 1 AS i FROM k) SELECT 'r2-s' || (i // 60 + 1) AS instance, count(*) AS states, min(d) AS low, max(d) AS high, CAST(sum(code) AS BIGINT) AS codes FROM o GROUP BY 1")
def instance_groups_4_2(spark, sf):
    """All states in six equal groups by distance and rank; a number that six does not divide is refused."""
    rows = _ranked(spark, 4, 2).select("code", "d")
    n = rows.count()
    if n % 6:
        raise ValueError(f"{n} states do not make 6 equal groups")
    placed = running(rows, [], F.col("d") * (1 << 20) + F.floor(F.col("code") / 4096), ["d", "code"], F.lit(1), "i", agg=F.sum)
    name = F.concat(F.lit("r2-s"), (F.floor(F.col("i") / (n // 6)) + 1).cast("string"))
    return placed.groupBy(name.alias("instance")).agg(F.count("*").alias("states"), F.min("d").alias("low"), F.max("d").alias("high"), F.sum("code").alias("codes"))


@query(f"""WITH RECURSIVE {_walk('123400', 16)} SELECT v, CAST(d AS INTEGER) AS d, true AS accepted FROM t UNION ALL SELECT unnest(['wrong budget', 'wrong labels', 'held out']), 0, false""")
def frozen_states(spark, sf):
    """A frozen set of states read and tested: labels, budget, distance; sets with a wrong one and held-out ones are refused."""
    place = f"{shared_folder(spark)}/orbita_states_{uuid.uuid4().hex}"
    remove_at_exit(spark, place)
    rows = D.distance_table(spark, 4, 2).select(F.lit("development").alias("set"), F.lit(4).alias("m"), F.lit(2).alias("r"), S.cells(F.col("p"), 6).alias("v"), "d", F.lit(S.budget(4, 2)).alias("budget"))
    rows.write.json(f"{place}/good")
    one = rows.limit(1)
    bad = {"wrong budget": one.withColumn("budget", F.lit(1)), "wrong labels": one.withColumn("v", F.array(*[F.lit(x) for x in (1, 1, 2, 3, 0, 0)])), "held out": one.withColumn("set", F.lit("holdout"))}
    out = files.read_states(spark, f"{place}/good").select(F.concat_ws("", "v").alias("v"), "d", F.lit(True).alias("accepted"))
    for name, df in bad.items():
        path = f"{place}/{name.replace(' ', '_')}"
        df.write.json(path)
        try:
            files.read_states(spark, path)
            kept = True
        except ValueError:
            kept = False
        out = out.unionByName(spark.createDataFrame([(name, 0, kept)], "v string, d int, accepted boolean"))
    return out


@query(f"""WITH z AS ({rollupplans.SQL['island_folds']}), t AS (SELECT *, sum(visits) OVER (PARTITION BY run_id) + 1 AS total FROM z), c AS (SELECT *, reward / visits + 1.4 * sqrt(ln(total) / visits) AS value FROM t) SELECT run_id, CAST(island AS INTEGER) AS island, round(value, 5) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(value, 5) DESC, island) AS k FROM c) WHERE k = 1""")
def next_islands(spark, sf):
    """The island each run would draw from next: mean reward plus what few visits are worth."""
    folds = rollupplans.island_folds(spark, sf)
    total = folds.groupBy(F.col("run_id").alias("r")).agg((F.sum("visits") + 1).alias("total"))
    value = F.round(F.col("reward") / F.col("visits") + 1.4 * F.sqrt(F.log("total") / F.col("visits")), 5)
    scored = folds.join(total, F.col("run_id") == F.col("r")).select("run_id", "island", value.alias("value"))
    return scored.groupBy("run_id").agg(F.max(F.struct("value", (-F.col("island")).alias("i"))).alias("b")).select("run_id", (-F.col("b.i")).alias("island"), "b.value")


# Clauses: a set of labels that has to fill the places from a start on; a row of clauses accepts an order if one of them holds, a tree if all rows do.

_CLAUSES = ((0, 1, (0, 1)), (0, 2, (3, 4)), (0, 0, (4,)), (1, 0, (0, 1, 2)), (1, 3, (1, 2)), (2, 4, (2,)), (2, 1, (1, 3)))


@query("WITH p AS (SELECT unnest(range(1, 6)) AS x), o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS l FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5), q(r, s, w) AS (VALUES "
       + ", ".join(f"({r}, {s}, {[x + 1 for x in w]})" for r, s, w in _CLAUSES)
       + "), m AS (SELECT l, r, bool_or(list_sort([l[(s + j) % 5 + 1] for j in range(0, len(w))]) = w) AS ok FROM o, q GROUP BY l, r) SELECT array_to_string(l, ' ') AS labels, count(*) FILTER (WHERE ok) AS rows_met, bool_and(ok) AS accepted FROM m GROUP BY l")
def clause_domains_5(spark, sf):
    """Label orders of five and the rows of clauses they meet: the orders of each clause, merged within rows, met over rows."""
    orders = spark.range(S.states(5, 0)).select(S.unrank(F.col("id"), 5, 0).alias("p")).select(S.cells(F.col("p"), 5).alias("l"))
    clauses = spark.createDataFrame([(r, s, [x + 1 for x in w]) for r, s, w in _CLAUSES], "r int, s int, w array<int>")
    filled = F.sort_array(F.transform("w", lambda _, j: F.element_at("l", F.pmod(F.col("s") + j, F.lit(5)) + 1)))
    each = orders.crossJoin(F.broadcast(clauses)).groupBy("l", "r").agg(F.max(filled == F.col("w")).alias("ok"))  # a fixed list of clauses
    return each.groupBy("l").agg(F.count(F.when(F.col("ok"), 1)).alias("rows_met"), F.min("ok").alias("accepted")).select(F.concat_ws(" ", F.col("l").cast("array<string>")).alias("labels"), "rows_met", "accepted")


_CHARTS = """c(q, fin, cost, k) AS (SELECT '01234', fin, [least(abs(u - fin), 5 - abs(u - fin)) for u in range(0, 5)], 0 FROM range(0, 5) x(fin) UNION ALL
    SELECT q, fin, [list_min([least(abs(u - x.edge), 5 - abs(u - x.edge)) + x.rest for x in ways]) for u in range(0, 5)], k FROM (SELECT q, fin, k, list({'edge': edge, 'rest': rest}) OVER (PARTITION BY q, fin) AS ways, row_number() OVER (PARTITION BY q, fin) AS r FROM
      (SELECT q[1:edge] || q[edge + 2:edge + 2] || q[edge + 1:edge + 1] || q[edge + 3:] AS q, fin, edge, cost[edge + 1] + 1 AS rest, k + 1 AS k FROM c, range(0, 4) y(edge) WHERE q[edge + 1:edge + 1] < q[edge + 2:edge + 2] AND k < 10) z) y2 WHERE r = 1)"""


@query(f"""WITH RECURSIVE {_CHARTS}, {_walk('12300', 10)}, o AS (SELECT v, cut, fin, [CAST(x AS INTEGER) for x in string_split(v[cut + 1:] || v[1:cut], '')] AS l, list_sort([(i + fin) % 5 for i in [3, 4]]) AS z FROM t, range(0, 5) a(cut), range(0, 5) b(fin)),
  r AS (SELECT v, cut, fin, array_to_string([CASE WHEN l[i] > 0 THEN (l[i] - 1 + fin) % 5 ELSE z[len(list_filter(l[1:i], lambda y: y = 0))] END for i in range(1, 6)], '') AS q FROM o)
  SELECT v, CAST(b.x AS INTEGER) AS cost, CAST(b.cut AS INTEGER) AS cut, CAST(b.fin AS INTEGER) AS fin FROM (SELECT r.v, min({{'x': c.cost[(5 - r.cut) % 5 + 1], 'cut': r.cut, 'fin': r.fin}}) AS b FROM r JOIN c ON c.q = r.q AND c.fin = r.fin GROUP BY r.v)""")
def charts_3_2(spark, sf):
    """The cheapest chart of every state: where the ring is cut, where the sorted row begins, and the letters that takes."""
    states = D.all_states(spark, 3, 2).select(S.cells(F.col("p"), 5).alias("c"), _flat("p", 5).alias("v"))
    grid = spark.range(25).select(F.floor(F.col("id") / 5).cast("int").alias("cut"), (F.col("id") % 5).cast("int").alias("fin"))
    rows = states.crossJoin(F.broadcast(grid))
    window = F.concat(F.slice("c", F.col("cut") + 1, F.lit(5)), F.slice("c", F.lit(1), F.col("cut")))
    rows = rows.select("v", "cut", "fin", window.alias("l"), F.array_sort(F.array(*[F.pmod(F.lit(i) + F.col("fin"), F.lit(5)) for i in (3, 4)])).alias("z"))
    rank = F.transform("l", lambda x, i: F.when(x > 0, F.pmod(x - 1 + F.col("fin"), F.lit(5))).otherwise(F.element_at("z", F.greatest(F.lit(1), F.size(F.filter(F.slice("l", F.lit(1), i + 1), lambda y: y == 0))))))
    asked = rows.select("v", "cut", "fin", F.array_join(rank.cast("array<string>"), "").alias("q"))
    met = asked.join(Q.chart_costs(spark, 5).withColumnRenamed("end", "fin"), ["q", "fin"]).select("v", F.struct(F.element_at("cost", F.pmod(-F.col("cut"), F.lit(5)) + 1).alias("cost"), "cut", "fin").alias("b"))
    return met.groupBy("v").agg(F.min("b").alias("b")).select("v", "b.cost", "b.cut", "b.fin")


@query(f"""WITH RECURSIVE {_walk('12340', 12)}, x AS (SELECT v, CAST(range AS INTEGER) AS j FROM t, range(0, 6)) SELECT v AS u, j, v[1:j] || '0' || v[j + 1:5] AS inserted, v AS removed FROM x""")
def zero_splices_4_1(spark, sf):
    """A zero put in at every cell of every state, and taken out again."""
    rows = D.all_states(spark, 4, 1).select("p", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), D._insert_zero(F.col("p"), j).alias("w")) for j in range(6)])).alias("s")).select("p", "s.*")
    out = F.lit(None).cast("bigint")
    for j in range(6):
        low = (1 << (4 * j)) - 1
        out = F.when(F.col("j") == j, F.col("w").bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftright("w", 4 * (j + 1)), 4 * j))).otherwise(out)
    return rows.withColumn("back", out).select(_flat("p", 5).alias("u"), "j", _flat("w", 6).alias("inserted"), _flat("back", 5).alias("removed"))


@query(f"""WITH RECURSIVE {_walk('12300', 10)}, ww(s, v, d, rest, word) AS (SELECT v, v, d, d + 2, '' FROM t UNION ALL SELECT s, t.v, t.d, rest - 1, word || x FROM (SELECT s, rest, word, unnest(['L', 'R', 'X']) AS x, unnest([v[2:5] || v[1:1], v[5:5] || v[1:4], v[2:2] || v[1:1] || v[3:5]]) AS u FROM ww WHERE rest > 0) q JOIN t ON t.v = q.u AND t.d <= q.rest - 1)
  SELECT s AS v, CAST(length(word) AS INTEGER) AS length, count(*) AS words, min(word) AS first_word FROM ww WHERE d = 0 GROUP BY s, length(word)""")
def words_with_slack_3_2(spark, sf):
    """How many words sort each state with at most two letters more than needed, and the first of each length."""
    t = D.distance_table(spark, 3, 2)
    words = Q.all_words(t, t.select("p"), 3, 2, slack=2)
    return words.groupBy("start", F.length("word").alias("length")).agg(F.count("*").alias("words"), F.min("word").alias("first_word")).select(_flat("start", 5).alias("v"), "length", "words", "first_word")
