"""Queries that roll evaluated cases, graphs, ledgers and campaigns up."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbita.functions.runtime import table
from orbita.operators import rollups as R
from orbita.operators.pricing import mixtures
from orbita.operators.shredding import nested_tables
from orbita.plans.archive import _LINES, _REAL, _lines, _money, _real, running

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Evaluated cases: the elements of a candidate's traces that name a family and a status, with the deficit its feedback tells.

_UNWRAP = "CASE WHEN json_valid({0}) THEN CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid({0} ->> '$') THEN {0} ->> '$' END ELSE {0} END END"
_CASES = f"""tj AS (SELECT id, run_id, engine, {_UNWRAP.format('traces_json')} AS j FROM candidates), fj AS (SELECT id, {_UNWRAP.format('feedback_json')} AS j FROM candidates),
  te AS (SELECT x.id, run_id, engine, e.value AS c FROM (SELECT * FROM tj WHERE json_type(j) = 'ARRAY') x, json_each(x.j) e UNION ALL SELECT x.id, run_id, engine, e.value FROM (SELECT * FROM tj WHERE json_type(j, '$.families') = 'ARRAY') x, json_each(x.j, '$.families') e
    UNION ALL SELECT x.id, run_id, engine, e.value FROM (SELECT * FROM tj WHERE json_type(j, '$.traces') = 'ARRAY') x, json_each(x.j, '$.traces') e),
  tc AS (SELECT id, run_id, engine, coalesce(c ->> '$.case_id', c ->> '$.case.id') AS case_id, c ->> '$.status' AS status FROM te WHERE json_type(c) = 'OBJECT'),
  ms AS (SELECT x.id, e.value ->> '$.case_id' AS case_id, min(e.value ->> '$.deficit') AS gap FROM (SELECT * FROM fj WHERE json_type(j, '$.misses') = 'ARRAY') x, json_each(x.j, '$.misses') e WHERE json_type(e.value) = 'OBJECT' GROUP BY ALL),
  cases AS (SELECT tc.id, run_id, engine, tc.case_id, m, k, class, status, status NOT IN ('INVALID_OUTPUT', 'INCOMPLETE') AS valid, gap FROM tc JOIN families f ON f.id = tc.case_id LEFT JOIN ms ON ms.id = tc.id AND ms.case_id = tc.case_id WHERE status IS NOT NULL)"""


def _misses(spark, sf) -> DataFrame:
    rows = nested_tables(table(spark, sf, "candidates"), "id", ["feedback_json"]).where(F.col("table") == "$.misses[]")
    return rows.groupBy("id", F.col("scalars")["case_id"].alias("case_id")).agg(F.min(F.col("scalars")["deficit"]).alias("gap"))


def _cases(spark, sf) -> DataFrame:
    places = ("$[]", "$.families[]", "$.traces[]")
    rows = nested_tables(table(spark, sf, "candidates").withColumn("who", F.struct("id", "run_id", "engine")), "who", ["traces_json"]).where(F.col("table").isin(*places))
    rows = rows.select("id.*", F.coalesce(F.col("scalars")["case_id"], F.col("scalars")["case.id"]).alias("case_id"), F.col("scalars")["status"].alias("status")).where("status IS NOT NULL")
    known = rows.join(table(spark, sf, "families").select(F.col("id").alias("case_id"), "m", "k", "class"), "case_id")
    return known.withColumn("valid", ~F.col("status").isin("INVALID_OUTPUT", "INCOMPLETE")).join(_misses(spark, sf), ["id", "case_id"], "left")


_LCM = math.lcm(*range(1, 61))
#: A gap as a whole number of 1/_LCM, and such a number as text p/q.
_PARTS = f"CAST(split_part(gap, '/', 1) AS HUGEINT) * ({_LCM}::HUGEINT // CAST(coalesce(nullif(split_part(gap, '/', 2), ''), '1') AS HUGEINT))"


def _fraction(n: str, d: str) -> str:
    g = f"gcd({n}, {d})"
    return f"CASE WHEN {n} IS NULL OR {d} = 0 THEN NULL WHEN ({d}) // {g} = 1 THEN CAST(({n}) // {g} AS VARCHAR) ELSE CAST(({n}) // {g} AS VARCHAR) || '/' || CAST(({d}) // {g} AS VARCHAR) END"


def _status(s: str, name: str) -> str:
    return f"count(*) FILTER (WHERE status = '{s}') AS {name}"


@query(f"""WITH {_CASES}, g AS (SELECT *, {_PARTS} AS u FROM cases), s AS (SELECT m, count(*) AS families, {_status('CERTIFICATE', 'certified')}, {_status('BOUNDARY', 'boundary')}, {_status('NO_CERTIFICATE', 'no_certificate')}, {_status('INVALID_OUTPUT', 'invalid')}, {_status('INCOMPLETE', 'incomplete')},
    count(*) FILTER (WHERE valid) AS valid, max(u) AS top, sum(u) FILTER (WHERE valid) AS total, count(u) FILTER (WHERE valid) AS n FROM g GROUP BY m),
  p AS (SELECT m, string_agg(k || ':' || c || '/' || n, ' ' ORDER BY k) AS per_k FROM (SELECT m, k, count(*) FILTER (WHERE status = 'CERTIFICATE') AS c, count(*) AS n FROM cases GROUP BY m, k) GROUP BY m)
  SELECT s.m, families, certified, boundary, no_certificate, invalid, incomplete, valid, {_fraction('top', f'{_LCM}::HUGEINT')} AS w, {_fraction('total', f'n::HUGEINT * {_LCM}::HUGEINT')} AS g, per_k, valid = families AS w_complete FROM s JOIN p ON p.m = s.m""")
def certification_by_m(spark, sf):
    return R.certification(_cases(spark, sf))


@query(f"""WITH {_CASES}, g AS (SELECT *, {_PARTS} AS u FROM cases), s AS (SELECT m, 100.0 * count(*) FILTER (WHERE status = 'CERTIFICATE') / count(*) AS pct, CAST(max(u) AS DOUBLE) / {_LCM} AS w, CAST(sum(u) FILTER (WHERE valid) AS DOUBLE) / {_LCM} / nullif(count(u) FILTER (WHERE valid), 0) AS g FROM g GROUP BY m)
  SELECT (SELECT count(*) FROM cases) AS families, (SELECT m FROM s ORDER BY pct, CAST(m AS VARCHAR) LIMIT 1) AS worst_m, round(avg(pct) + min(pct) + (SELECT 0.06 * count(*) FILTER (WHERE valid) / count(*) FROM cases) + 0.06 / (1 + coalesce(max(w), 0)) + coalesce(0.03 / (1 + avg(g)), 0), 6) AS combined FROM s""")
def certification_score(spark, sf):
    """One number for all cases: mean and least share certified, shares valid, largest and mean gap."""
    per = R.certification(_cases(spark, sf))
    ratio = lambda c: F.element_at(F.split(c, "/"), 1).cast("double") / F.coalesce(F.try_element_at(F.split(c, "/"), F.lit(2)), F.lit("1")).cast("double")
    per = per.select("m", "families", "valid", (100.0 * F.col("certified") / F.col("families")).alias("pct"), ratio("w").alias("w"), ratio("g").alias("g"))
    total = per.agg(
        F.sum("families").alias("families"), F.min_by("m", F.struct("pct", F.col("m").cast("string"))).alias("worst_m"), F.avg("pct").alias("a"), F.min("pct").alias("b"),
        (F.sum("valid") / F.sum("families")).alias("v"), F.max("w").alias("w"), F.avg("g").alias("g"),
    )
    score = F.col("a") + F.col("b") + 0.06 * F.col("v") + 0.06 / (1 + F.coalesce("w", F.lit(0.0))) + F.coalesce(0.03 / (1 + F.col("g")), F.lit(0.0))
    return total.select("families", "worst_m", F.round(score, 6).alias("combined"))


@query(f"""WITH {_CASES} SELECT m, class, count(*) FILTER (WHERE status = 'CERTIFICATE') AS certified, count(*) AS cases FROM cases GROUP BY m, class""")
def certified_per_class(spark, sf):
    return _cases(spark, sf).groupBy("m", "class").agg(R.count_if(F.col("status") == "CERTIFICATE").alias("certified"), F.count("*").alias("cases"))


@query(f"""WITH {_CASES}, b AS (SELECT DISTINCT id, case_id, k, class, coalesce(CAST({_PARTS} AS DOUBLE) / {_LCM}, 0) AS g FROM cases WHERE status <> 'CERTIFICATE'), c AS (SELECT *, row_number() OVER (PARTITION BY id, class ORDER BY g DESC, k, case_id) AS r FROM b),
  d AS (SELECT id, case_id, row_number() OVER (PARTITION BY id ORDER BY r > 1, g DESC, k, case_id) AS place FROM c) SELECT id, case_id, CAST(place AS INTEGER) AS place FROM d WHERE place <= 3""")
def failing_cases(spark, sf):
    """The three worst cases of each candidate, of different classes where it can be."""
    rows = _cases(spark, sf).select("id", "case_id", "k", "class", "status", "gap").where("status <> 'CERTIFICATE'").dropDuplicates(["id", "case_id"])
    return R.failing(rows, ["id"], 3).select("id", "case_id", "place")


@query(f"""WITH {_CASES}, g AS (SELECT *, {_PARTS} AS u FROM cases) SELECT engine, count(*) AS instances, count(*) FILTER (WHERE status = 'CERTIFICATE') AS certificates, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE status = 'INCOMPLETE') AS timeouts,
  {_fraction('sum(u) FILTER (WHERE valid)', f'{_LCM}::HUGEINT')} AS gap_sum FROM g GROUP BY engine""")
def lift_evaluation(spark, sf):
    """Certificates, valid answers, timeouts and the exact sum of gaps of each engine."""
    rows = _cases(spark, sf)
    counts = rows.groupBy("engine").agg(F.count("*").alias("instances"), R.count_if(F.col("status") == "CERTIFICATE").alias("certificates"), R.count_if(F.col("valid")).alias("valid"), R.count_if(F.col("status") == "INCOMPLETE").alias("timeouts"))
    gaps = R.exact(rows, ["engine"], "gap", F.col("valid")).select(F.col("engine").alias("e"), F.col("total").alias("gap_sum"))
    return counts.join(gaps, F.col("engine").eqNullSafe(F.col("e"))).drop("e")


@query(f"""WITH {_CASES}, v AS (SELECT c.id, c.source_sha256 AS sha, count(*) FILTER (WHERE status = 'CERTIFICATE') AS certified, count(*) FILTER (WHERE valid) AS valid FROM cases JOIN candidates c ON c.id = cases.id WHERE c.source_sha256 IS NOT NULL GROUP BY ALL),
  r AS (SELECT c.run_id, v.id, certified, valid, row_number() OVER (PARTITION BY c.run_id ORDER BY certified DESC, valid DESC, sha, v.id) AS r FROM v JOIN candidates c ON c.id = v.id) SELECT run_id, id, certified, valid FROM r WHERE r = 1""")
def finalists(spark, sf):
    """Of each run the candidate with most certificates, then most valid answers, then the smaller digest: one aggregation."""
    score = _cases(spark, sf).groupBy("id").agg(R.count_if(F.col("status") == "CERTIFICATE").alias("certified"), R.count_if(F.col("valid")).alias("valid"))
    rows = score.join(table(spark, sf, "candidates").where("source_sha256 IS NOT NULL").select("id", "run_id", "source_sha256"), "id")
    best = F.min_by(F.struct("id", "certified", "valid"), F.struct((-F.col("certified")).alias("a"), (-F.col("valid")).alias("b"), "source_sha256", "id"))
    return rows.groupBy("run_id").agg(best.alias("x")).select("run_id", "x.*")


@query(f"""WITH {_CASES}, x AS (SELECT id, case_id FROM ms WHERE case_id IS NOT NULL UNION SELECT id, case_id FROM tc WHERE case_id IS NOT NULL) SELECT id, count(DISTINCT case_id) AS cases FROM x GROUP BY id""")
def case_coverage(spark, sf):
    """How many different cases the feedback and traces of a candidate name."""
    places = ("$[]", "$.families[]", "$.traces[]")
    rows = nested_tables(table(spark, sf, "candidates"), "id", ["feedback_json", "traces_json"])
    mine = ((F.col("field") == "feedback_json") & (F.col("table") == "$.misses[]")) | ((F.col("field") == "traces_json") & F.col("table").isin(*places))
    return rows.where(mine).select("id", F.coalesce(F.col("scalars")["case_id"], F.col("scalars")["case.id"]).alias("c")).where("c IS NOT NULL").groupBy("id").agg(F.count_distinct("c").alias("cases"))


@query(f"""WITH {_CASES}, x AS (SELECT DISTINCT id, case_id, CASE WHEN status = 'CERTIFICATE' THEN 1 WHEN status = 'BOUNDARY' THEN 2 WHEN status = 'NO_CERTIFICATE' THEN 3 ELSE 4 END AS p FROM cases), b AS (SELECT f.id, f.k, coalesce(min(p), 5) AS p FROM families f LEFT JOIN x ON x.case_id = f.id GROUP BY f.id, f.k)
  SELECT k, CASE p WHEN 1 THEN 'certificate' WHEN 2 THEN 'boundary' WHEN 3 THEN 'none' WHEN 4 THEN 'invalid' ELSE 'uncovered' END AS how, count(*) AS families, string_agg(id, ' ' ORDER BY id) FILTER (WHERE p >= 4) AS open FROM b GROUP BY k, p""")
def coverage_tally(spark, sf):
    """Families by the best that any candidate reached for them, in order of methods; those not covered are named (there are
    no more of them than families)."""
    prio = F.when(F.col("status") == "CERTIFICATE", 1).when(F.col("status") == "BOUNDARY", 2).when(F.col("status") == "NO_CERTIFICATE", 3).otherwise(4)
    best = _cases(spark, sf).groupBy("case_id").agg(F.min(prio).alias("p"))
    all_f = table(spark, sf, "families").select("id", "k").join(best.withColumnRenamed("case_id", "id"), "id", "left").withColumn("p", F.coalesce("p", F.lit(5)))
    how = F.element_at(F.array(*[F.lit(x) for x in ("certificate", "boundary", "none", "invalid", "uncovered")]), F.col("p"))
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("p") >= 4, F.col("id")))), " ")
    return all_f.groupBy("k", "p").agg(F.count("*").alias("families"), names.alias("open")).select("k", how.alias("how"), "families", F.when(F.col("p") >= 4, F.col("open")).alias("open"))


@query(f"""WITH {_CASES}, c AS (SELECT DISTINCT case_id FROM tc WHERE case_id IS NOT NULL), x AS (SELECT coalesce(f.id, c.case_id) AS id, f.id IS NOT NULL AS expected, c.case_id IS NOT NULL AS used FROM families f FULL JOIN c ON c.case_id = f.id)
  SELECT expected, used, count(*) AS families FROM x GROUP BY expected, used""")
def universe_check(spark, sf):
    """Families expected and used: none missing, none unknown, each once."""
    places = ("$[]", "$.families[]", "$.traces[]")
    rows = nested_tables(table(spark, sf, "candidates"), "id", ["traces_json"]).where(F.col("table").isin(*places))
    used = rows.select(F.coalesce(F.col("scalars")["case_id"], F.col("scalars")["case.id"]).alias("case_id")).where("case_id IS NOT NULL").distinct().withColumn("u", F.lit(True))
    both = table(spark, sf, "families").select("id", F.lit(True).alias("e")).join(used, F.col("id") == F.col("case_id"), "full")
    return both.groupBy(F.col("e").isNotNull().alias("expected"), F.col("u").isNotNull().alias("used")).agg(F.count("*").alias("families"))


# Evaluated graphs of the log.

_GRAPHS = f"""{_LINES}, g AS (SELECT log_id, run_id, candidate_id, u.graph AS graph, u.failures AS excess, coalesce(u.failures = 0, false) AS within, u.score IS NOT NULL AND NOT CAST(u.score AS VARCHAR) = 'nan' AS valid, u.score AS score FROM (SELECT log_id, run_id, candidate_id, unnest(graphs) AS u FROM lines WHERE event = 'candidate'))"""


def _graphs(spark, sf) -> DataFrame:
    rows = _lines(spark, sf, "run_id", "event", "candidate_id", "graphs").where("event = 'candidate'").select("log_id", "run_id", "candidate_id", F.explode("graphs").alias("u"))
    return rows.select("log_id", "run_id", "candidate_id", "u.graph", F.col("u.failures").alias("excess"), F.coalesce(F.col("u.failures") == 0, F.lit(False)).alias("within"), (F.col("u.score").isNotNull() & ~F.isnan("u.score")).alias("valid"), "u.score")


_WITHIN = "count(*) AS states, count(*) FILTER (WHERE within) AS within, count(*) FILTER (WHERE valid) AS valid, CAST(sum(excess) FILTER (WHERE valid) AS BIGINT) AS excess_sum"


@query(f"WITH {_GRAPHS} SELECT graph, {_WITHIN}, round(count(*) FILTER (WHERE within) / count(*), 6) AS within_rate, round(sum(excess) FILTER (WHERE valid) / nullif(count(*) FILTER (WHERE valid), 0), 6) AS mean_excess FROM g GROUP BY graph")
def graphs_within(spark, sf):
    out = R.within(_graphs(spark, sf), ["graph"])
    return out.withColumns({"within_rate": F.round("within_rate", 6), "mean_excess": F.round("mean_excess", 6)})


@query(f"""WITH {_GRAPHS}, p AS (SELECT graph, count(*) FILTER (WHERE within) / count(*) AS rate FROM g GROUP BY graph), t AS (SELECT {_WITHIN}, max(excess) FILTER (WHERE valid) AS max_excess FROM g)
  SELECT states, within, valid, max_excess, (SELECT graph FROM p ORDER BY rate, graph LIMIT 1) AS worst, round(within / states + 0.5 * (SELECT min(rate) FROM p) + 0.25 / (1 + excess_sum / valid) - (states - valid) / states, 6) AS combined FROM t""")
def sort_score(spark, sf):
    """All graphs in one number: share within, the worst graph's share, mean excess, what is invalid."""
    rows = _graphs(spark, sf)
    per = R.within(rows, ["graph"]).agg(F.min("within_rate").alias("least"), F.min_by("graph", F.struct("within_rate", "graph")).alias("worst"))
    whole = R.within(rows.withColumn("all", F.lit(1)), ["all"]).crossJoin(F.broadcast(rows.agg(F.max(F.when(F.col("valid"), F.col("excess"))).alias("max_excess")))).crossJoin(F.broadcast(per))
    score = F.col("within_rate") + 0.5 * F.col("least") + F.when(F.col("valid") > 0, 0.25 / (1 + F.col("mean_excess"))).otherwise(0.0) - (F.col("states") - F.col("valid")) / F.col("states")
    return whole.select("states", "within", "valid", "max_excess", "worst", F.round(score, 6).alias("combined"))


@query(f"WITH {_GRAPHS}, t AS (SELECT candidate_id, {_WITHIN} FROM g WHERE candidate_id IS NOT NULL GROUP BY candidate_id) SELECT candidate_id, states, round(within / states + CASE WHEN valid > 0 THEN 0.25 / (1 + excess_sum / valid) ELSE 0 END - (states - valid) / states, 6) AS score FROM t")
def instance_scores(spark, sf):
    out = R.within(_graphs(spark, sf).where("candidate_id IS NOT NULL"), ["candidate_id"])
    return out.select("candidate_id", "states", F.round(R.instance_score(out), 6).alias("score"))


@query(f"""WITH {_GRAPHS}, t AS (SELECT run_id, graph IN ('m3r3', 'm4r2', 'm8r3') AS revealed, count(*) AS n, count(*) FILTER (WHERE within) / count(*) AS rate FROM g GROUP BY ALL), x AS (SELECT run_id, max(rate) FILTER (WHERE revealed) AS a, max(rate) FILTER (WHERE NOT revealed) AS b, coalesce(sum(n) FILTER (WHERE revealed), 0) AS revealed, coalesce(sum(n) FILTER (WHERE NOT revealed), 0) AS hidden FROM t GROUP BY run_id)
  SELECT run_id, CAST(revealed AS BIGINT) AS revealed, CAST(hidden AS BIGINT) AS hidden, round(a - b, 6) AS gap, coalesce(a - b > 0.1, false) AS flag FROM x""")
def memorisation_gap(spark, sf):
    """How much better a run does on graphs it was shown than on others; null where it has only one kind."""
    shown = F.col("graph").isin("m3r3", "m4r2", "m8r3")
    one = lambda c: (R.count_if(c & F.col("within")) / F.when(R.count_if(c) > 0, R.count_if(c)))
    hidden = F.coalesce(~shown, F.lit(False))
    out = _graphs(spark, sf).groupBy("run_id").agg(R.count_if(shown).alias("revealed"), R.count_if(hidden).alias("hidden"), (one(shown) - one(hidden)).alias("g"))
    return out.select("run_id", "revealed", "hidden", F.round("g", 6).alias("gap"), F.coalesce(F.col("g") > 0.1, F.lit(False)).alias("flag"))


@query(f"""WITH {_GRAPHS}, s AS (SELECT *, CAST(regexp_extract(graph, '^m(\\d+)r(\\d+)$', 1) AS INTEGER) AS m, CAST(regexp_extract(graph, '^m(\\d+)r(\\d+)$', 2) AS INTEGER) AS r FROM g WHERE candidate_id IS NOT NULL AND valid),
  t AS (SELECT candidate_id, max(-score / (m * (m + 1) // 2 + (r - 1) * (m - 2))) FILTER (WHERE m >= 8) AS worst, bool_and(within) AS sound FROM s GROUP BY candidate_id) SELECT coalesce(round(min(worst) FILTER (WHERE sound), 4), 99.0) AS lead_ratio, count(*) FILTER (WHERE sound) AS sound FROM t""")
def lead_ratio(spark, sf):
    """The least, over candidates without a failure, of their largest value over the budget of graphs from m = 8 on; 99 if none."""
    rows = _graphs(spark, sf).where("candidate_id IS NOT NULL AND valid")
    m, r = (F.regexp_extract("graph", r"^m(\d+)r(\d+)$", i).cast("int") for i in (1, 2))
    budget = (m * (m + 1) / 2 + (r - 1) * (m - 2)).cast("bigint")
    per = rows.groupBy("candidate_id").agg(F.max(F.when(m >= 8, -F.col("score") / budget)).alias("worst"), F.bool_and("within").alias("sound"))
    return per.agg(F.coalesce(F.round(F.min(F.when(F.col("sound"), F.col("worst"))), 4), F.lit(99.0)).alias("lead_ratio"), R.count_if(F.col("sound")).alias("sound"))


# Campaigns.

@query(f"""SELECT engine, count(score) AS n, round(avg(CAST(score AS DECIMAL(20,6))), 4) AS mean, round(stddev_samp(score), 4) AS sd, min(score) AS low, max(score) AS high
  FROM (SELECT engine, {_REAL} AS score FROM candidates WHERE score IS NULL OR CAST(score AS VARCHAR) NOT IN ('inf', '-inf')) GROUP BY engine""")
def arm_spread(spark, sf):
    """Number, mean, sample deviation (null for fewer than two), least and most of each engine's scores."""
    score = F.when(~F.isnan("score") & (F.abs("score") != float("inf")), F.col("score"))
    rows = table(spark, sf, "candidates").where(F.abs(F.coalesce("score", F.lit(0.0))) != float("inf")).select("engine", score.alias("score"))
    mean = F.round((F.sum(F.col("score").cast("decimal(20,6)")).cast("double") / F.count("score")), 4)
    return rows.groupBy("engine").agg(F.count("score").alias("n"), mean.alias("mean"), F.round(F.stddev_samp("score"), 4).alias("sd"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"""WITH c AS (SELECT run_id, {_REAL} AS score FROM candidates WHERE {_REAL} IS NOT NULL), r AS (SELECT run_id, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM c)
  SELECT run_id, max(n) AS archive, max(score) AS best, max(CASE WHEN i = n // 2 THEN score END) AS upper_median FROM r GROUP BY run_id""")
def population(spark, sf):
    """Size, best and the score in the middle (of an even number the lower one of the two) of each run's archive."""
    rows = table(spark, sf, "candidates").select("run_id", (_real("score") + F.lit(0.0)).alias("score")).where("score IS NOT NULL")
    return rows.groupBy("run_id").agg(F.count("*").alias("archive"), F.max("score").alias("best"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)").alias("upper_median"))


@query(f"""WITH {_LINES} SELECT run_id, mode, count(*) AS n, count(*) FILTER (WHERE status = 'keep') AS keep, count(*) FILTER (WHERE valid IS NOT TRUE) AS invalid FROM lines WHERE event = 'candidate' AND mode IS DISTINCT FROM 'seed' GROUP BY run_id, mode""")
def population_modes(spark, sf):
    rows = _lines(spark, sf, "run_id", "event", "mode", "status", "valid").where("event = 'candidate'").where(~F.col("mode").eqNullSafe(F.lit("seed")))
    return rows.groupBy("run_id", "mode").agg(F.count("*").alias("n"), R.count_if(F.col("status") == "keep").alias("keep"), R.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"))


@query("""SELECT run_id, round(CAST(sum(CAST(coalesce(charged_usd, reserved_usd, 0) AS DECIMAL(18,6))) AS DOUBLE), 4) AS usd, count(*) FILTER (WHERE charged_usd IS NULL) AS unsettled FROM (SELECT DISTINCT run_id, attempt_no, charged_usd, reserved_usd FROM ledger_attempts) GROUP BY run_id""")
def logged_spend(spark, sf):
    rows = table(spark, sf, "ledger_attempts").select("run_id", "attempt_no", "charged_usd", "reserved_usd").distinct()
    usd = F.sum(F.coalesce("charged_usd", "reserved_usd", F.lit(0.0)).cast("decimal(18,6)")).cast("double")
    return rows.groupBy("run_id").agg(F.round(usd, 4).alias("usd"), R.count_if(F.col("charged_usd").isNull()).alias("unsettled"))


@query(f"""WITH {_LINES}, c AS (SELECT run_id, t, log_id, candidate_id, mode, coalesce(valid, false) AS valid, {_REAL} AS score FROM lines WHERE event = 'candidate'),
  w AS (SELECT *, max(CASE WHEN valid THEN score END) OVER (PARTITION BY run_id ORDER BY t, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
  h AS (SELECT run_id, candidate_id, bool_and(valid) AS ok FROM c WHERE mode IS DISTINCT FROM 'seed' GROUP BY run_id, candidate_id), a AS (SELECT run_id, count(*) FILTER (WHERE valid AND before IS NOT NULL AND score > before) AS accepted FROM w GROUP BY run_id)
  SELECT a.run_id, coalesce(n, 0) AS proposals, coalesce(good, 0) AS valid, coalesce(n - good, 0) AS invalid, accepted FROM a LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM h GROUP BY run_id) h ON h.run_id IS NOT DISTINCT FROM a.run_id""")
def proposal_statistics(spark, sf):
    """Of each run the proposals that were valid every time, those that were not, and how often the best score rose."""
    rows = _lines(spark, sf, "run_id", "event", "t", "candidate_id", "mode", "valid", "score").where("event = 'candidate'").withColumn("score", _real("score")).withColumn("valid", F.coalesce("valid", F.lit(False)))
    each = rows.where(~F.col("mode").eqNullSafe(F.lit("seed"))).groupBy("run_id", "candidate_id").agg(F.bool_and("valid").alias("ok")).groupBy(F.col("run_id").alias("r")).agg(F.count("*").alias("n"), R.count_if(F.col("ok")).alias("good"))
    before = running(rows, ["run_id"], F.date_trunc("hour", "t"), ["t", "log_id"], F.when(F.col("valid"), F.col("score")), "before")
    rose = before.groupBy("run_id").agg(R.count_if(F.col("valid") & F.col("before").isNotNull() & (F.col("score") > F.col("before"))).alias("accepted"))
    zero = F.lit(0)
    return rose.join(each, F.col("run_id").eqNullSafe(F.col("r")), "left").select("run_id", F.coalesce("n", zero).alias("proposals"), F.coalesce("good", zero).alias("valid"), F.coalesce(F.col("n") - F.col("good"), zero).alias("invalid"), "accepted")


@query(f"""WITH {_LINES}, c AS (SELECT run_id, mode, status, coalesce(valid, false) AS valid, coalesce(feasible, false) AS feasible, {_REAL} AS score, candidate_id, cost_usd, tokens_in, tokens_out FROM lines WHERE event = 'candidate'),
  a AS (SELECT DISTINCT run_id, attempt_no, lower(status) AS status, charged_usd FROM ledger_attempts), l AS (SELECT run_id, count(*) AS requests, count(*) FILTER (WHERE status <> 'settled') AS unsettled, CAST(sum(CAST(charged_usd AS DECIMAL(18,6))) AS DOUBLE) AS charged FROM a GROUP BY run_id),
  s AS (SELECT run_id, count(*) FILTER (WHERE mode IS DISTINCT FROM 'seed') AS proposals, count(*) FILTER (WHERE valid AND mode IS DISTINCT FROM 'seed') AS valid, count(*) FILTER (WHERE feasible) AS solved, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'keep') AS kept, max(score) AS best,
    CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE) AS usd, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM c GROUP BY run_id)
  SELECT r.run_id, r.engine, r.ended_utc IS NOT NULL AS complete, proposals, valid, solved, duplicates, kept, s.best AS best_score, usd, tokens_in, tokens_out, requests, unsettled, charged FROM runs r LEFT JOIN s ON s.run_id = r.run_id LEFT JOIN l ON l.run_id = r.run_id""")
def campaign_comparison(spark, sf):
    """Runs side by side: proposals, what came of them, spend by the log and by the ledger."""
    rows = _lines(spark, sf, "run_id", "event", "mode", "status", "valid", "feasible", "score", "cost_usd", "tokens_in", "tokens_out").where("event = 'candidate'").withColumn("score", _real("score"))
    own = ~F.col("mode").eqNullSafe(F.lit("seed"))
    log = rows.groupBy("run_id").agg(
        R.count_if(own).alias("proposals"), R.count_if(own & F.col("valid")).alias("valid"), R.count_if(F.col("feasible")).alias("solved"), R.count_if(F.col("status") == "duplicate").alias("duplicates"), R.count_if(F.col("status") == "keep").alias("kept"),
        F.max("score").alias("best_score"), _money("cost_usd").alias("usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    ledger = table(spark, sf, "ledger_attempts").select("run_id", "attempt_no", F.lower("status").alias("status"), "charged_usd").distinct()
    ledger = ledger.groupBy("run_id").agg(F.count("*").alias("requests"), R.count_if(F.col("status") != "settled").alias("unsettled"), _money("charged_usd").alias("charged"))
    runs = table(spark, sf, "runs").select("run_id", "engine", F.col("ended_utc").isNotNull().alias("complete"))
    return runs.join(log, "run_id", "left").join(ledger, "run_id", "left")


@query(f"""WITH {_LINES}, o AS (SELECT log_id, run_id, t FROM lines WHERE event = 'candidate'), w AS (SELECT run_id AS window_run, engine, started_utc AS a, ended_utc AS b FROM runs WHERE started_utc IS NOT NULL AND ended_utc IS NOT NULL),
  m AS (SELECT o.log_id, window_run, engine, row_number() OVER (PARTITION BY o.log_id ORDER BY a, window_run) AS r FROM o JOIN w ON o.t BETWEEN a AND b)
  SELECT o.log_id, m.window_run, coalesce(m.engine, 'unattributed') AS engine FROM o LEFT JOIN m ON m.log_id = o.log_id AND r = 1""")
def first_window(spark, sf):
    """The run in whose window, among all runs, a line of the log falls: the one that began first; whatever falls in none is
    unattributed. Windows are cut up by days, so lines meet only the windows of their day."""
    lines = _lines(spark, sf, "event", "t").where("event = 'candidate'").select("log_id", "t", F.to_date("t").alias("day"))
    runs = table(spark, sf, "runs").where("started_utc IS NOT NULL AND ended_utc IS NOT NULL AND started_utc <= ended_utc").select(F.col("run_id").alias("window_run"), F.col("engine").alias("e"), F.col("started_utc").alias("a"), F.col("ended_utc").alias("b"))
    windows = runs.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))))
    met = lines.join(windows, "day").where((F.col("t") >= F.col("a")) & (F.col("t") <= F.col("b"))).groupBy("log_id").agg(F.min_by(F.struct("window_run", "e"), F.struct("a", "window_run")).alias("x"))
    return lines.select("log_id").join(met, "log_id", "left").select("log_id", "x.window_run", F.coalesce("x.e", F.lit("unattributed")).alias("engine"))


@query(f"""WITH {_LINES}, c AS (SELECT run_id, {_REAL} AS score, (row_number() OVER (PARTITION BY run_id ORDER BY t, log_id) - 1) // 10 AS win FROM lines WHERE event = 'candidate'), b AS (SELECT run_id, win, count(*) AS n, max(score) AS top FROM c GROUP BY run_id, win),
  e AS (SELECT run_id, win, n, max(top) OVER (PARTITION BY run_id ORDER BY win) AS fin, max(top) OVER (PARTITION BY run_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM b)
  SELECT run_id, CAST(win AS BIGINT) AS window_no, n AS width, start AS from_score, fin AS to_score, round(fin - start, 4) AS delta, round((fin - start) / (abs(start) + 1) / sqrt(n), 6) AS j FROM e""")
def window_scores(spark, sf):
    """How far each ten proposals of a run moved its best score, against the score before and the width."""
    rows = _lines(spark, sf, "run_id", "event", "t", "score").where("event = 'candidate'").withColumn("score", _real("score"))
    placed = running(rows, ["run_id"], F.date_trunc("hour", "t"), ["t", "log_id"], F.lit(1), "before", agg=F.sum)
    wins = placed.groupBy("run_id", F.floor(F.col("before") / 10).alias("window_no")).agg(F.count("*").alias("width"), F.max("score").alias("top"))
    out = running(wins, ["run_id"], F.floor(F.col("window_no") / 64), ["window_no"], F.col("top"), "from_score").withColumn("to_score", F.greatest("top", "from_score"))
    delta = F.col("to_score") - F.col("from_score")
    return out.select("run_id", "window_no", "width", "from_score", "to_score", F.round(delta, 4).alias("delta"), F.round(delta / (F.abs("from_score") + 1) / F.sqrt("width"), 6).alias("j"))


@query(f"""WITH {_LINES}, c AS (SELECT run_id, island, t, log_id, coalesce(valid, false) AND {_REAL} IS NOT NULL AND status IS DISTINCT FROM 'duplicate' AS ok, {_REAL} AS score FROM lines WHERE event = 'candidate' AND island IS NOT NULL),
  w AS (SELECT *, max(CASE WHEN ok THEN score END) OVER (PARTITION BY run_id, island ORDER BY t, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mine, max(CASE WHEN ok THEN score END) OVER (PARTITION BY run_id ORDER BY t, log_id ROWS UNBOUNDED PRECEDING) AS best,
    count(*) OVER (PARTITION BY run_id, island) - row_number() OVER (PARTITION BY run_id, island ORDER BY t, log_id) AS after FROM c),
  d AS (SELECT *, CASE WHEN ok AND mine IS NOT NULL AND score > mine THEN score - mine ELSE 0 END AS rise FROM w)
  SELECT run_id, island, count(*) AS pulls, round(sum(0.1 * pow(rise / (abs(coalesce(mine, 0)) + 1), 2) * pow(0.9, after)), 6) AS g, round(sum(least(1.0, rise / (abs(coalesce(best, 0)) + 1)) * pow(0.9, after)), 6) AS reward, round(sum(pow(0.9, after)), 6) AS visits FROM d GROUP BY run_id, island""")
def island_folds(spark, sf):
    """Decayed gains, rewards and visits of each island of a run after its last proposal: each proposal counts 0.9 times as
    much for every later one, so the fold is a weighted sum and needs no order within a group but a place."""
    rows = _lines(spark, sf, "run_id", "event", "island", "t", "valid", "status", "score").where("event = 'candidate' AND island IS NOT NULL").withColumn("score", _real("score"))
    ok = F.coalesce("valid", F.lit(False)) & F.col("score").isNotNull() & ~F.col("status").eqNullSafe(F.lit("duplicate"))
    rows, hour, order = rows.withColumn("good", F.when(ok, F.col("score"))), F.date_trunc("hour", "t"), ["t", "log_id"]
    rows = running(rows, ["run_id", "island"], hour, order, F.col("good"), "mine")
    rows = running(rows, ["run_id"], hour, order, F.col("good"), "before").withColumn("best", F.greatest("good", "before"))
    rows = running(rows, ["run_id", "island"], hour, order, F.lit(1), "place", agg=F.sum)
    size = rows.groupBy("run_id", "island").agg(F.count("*").alias("pulls"))
    rise = F.when(F.col("good") > F.col("mine"), F.col("good") - F.col("mine")).otherwise(0.0)
    weight = F.pow(F.lit(0.9), F.col("pulls") - 1 - F.col("place"))
    each = rows.join(size, ["run_id", "island"]).select(
        "run_id", "island", weight.alias("visits"), (0.1 * F.pow(rise / (F.abs(F.coalesce("mine", F.lit(0.0))) + 1), 2) * weight).alias("g"),
        (F.least(F.lit(1.0), rise / (F.abs(F.coalesce("best", F.lit(0.0))) + 1)) * weight).alias("reward"),
    )
    return each.groupBy("run_id", "island").agg(F.count("*").alias("pulls"), *[F.round(F.sum(c), 6).alias(c) for c in ("g", "reward", "visits")])


@query(f"""WITH {_LINES}, o AS (SELECT *, {_REAL} AS s, row_number() OVER (PARTITION BY run_id ORDER BY t, log_id) AS i FROM lines), b AS (SELECT run_id, log_id, t, i, row_number() OVER (PARTITION BY run_id ORDER BY i) AS batch FROM o WHERE event = 'batch'),
  x AS (SELECT b.run_id, b.batch, b.t, (SELECT count(*) FROM o WHERE o.run_id IS NOT DISTINCT FROM b.run_id AND o.event = 'candidate' AND o.i < b.i) AS proposals, (SELECT max(CASE WHEN valid THEN s END) FROM o WHERE o.run_id IS NOT DISTINCT FROM b.run_id AND o.event = 'candidate' AND o.i < b.i) AS best_score FROM b)
  SELECT run_id, batch, t, proposals, best_score FROM x""")
def timeline(spark, sf):
    """A row for each batch line of a run: its number, the proposals before it and their best score."""
    rows = _lines(spark, sf, "run_id", "event", "t", "valid", "score").withColumn("score", _real("score"))
    hour, order, cand = F.date_trunc("hour", "t"), ["t", "log_id"], F.col("event") == "candidate"
    rows = running(rows, ["run_id"], hour, order, F.when(cand, 1).otherwise(0), "proposals", agg=F.sum)
    rows = running(rows, ["run_id"], hour, order, F.when(F.col("event") == "batch", 1).otherwise(0), "batches", agg=F.sum)
    rows = running(rows, ["run_id"], hour, order, F.when(cand & F.col("valid"), F.col("score")), "best_score")
    return rows.where("event = 'batch'").select("run_id", (F.col("batches") + 1).cast("bigint").alias("batch"), "t", F.col("proposals").cast("bigint").alias("proposals"), "best_score")


@query(f"""WITH r AS (SELECT run_id, id, source_sha256, {_REAL} AS score FROM candidates WHERE {_REAL} IS NOT NULL AND source_sha256 IS NOT NULL), d AS (SELECT run_id, source_sha256, max(score) AS score, min(id) FILTER (WHERE score = top) AS id FROM (SELECT *, max(score) OVER (PARTITION BY run_id, source_sha256) AS top FROM r) GROUP BY run_id, source_sha256)
  SELECT run_id, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id) AS place FROM d) WHERE place <= 3""")
def heldout_candidates(spark, sf):
    """The three best candidates of a run with different sources: one aggregation by source, then a limit per run that
    is kept by every task before the shuffle."""
    rows = table(spark, sf, "candidates").where("source_sha256 IS NOT NULL").select("run_id", "id", "source_sha256", (_real("score") + F.lit(0.0)).alias("score")).where("score IS NOT NULL")
    best = rows.groupBy("run_id", "source_sha256").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("x")).select("run_id", "x.score", (-F.col("x.minus")).alias("id"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("place", place).where("place <= 3").select("run_id", "id", "place")


@query(f"""WITH {_LINES}, c AS (SELECT run_id, candidate_id, {_REAL} AS score, coalesce(valid, false) AS valid, coalesce((SELECT sum(u.failures) FROM (SELECT unnest(graphs) AS u)), 0) AS failures FROM lines WHERE event = 'candidate' AND candidate_id IS NOT NULL)
  SELECT run_id, candidate_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY valid DESC, failures, score DESC NULLS LAST, candidate_id) AS place FROM (SELECT run_id, candidate_id, bool_and(valid) AS valid, CAST(min(failures) AS BIGINT) AS failures, max(score) AS score FROM c GROUP BY run_id, candidate_id)) WHERE place <= 10""")
def ranked_archive(spark, sf):
    """Ten best of each run by a key of several parts: valid ones first, then fewer failures, then score."""
    rows = _lines(spark, sf, "run_id", "event", "candidate_id", "score", "valid", "graphs").where("event = 'candidate' AND candidate_id IS NOT NULL").withColumn("score", _real("score"))
    failures = F.aggregate(F.coalesce(F.transform("graphs", lambda g: F.coalesce(g["failures"].cast("bigint"), F.lit(0).cast("bigint"))), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    one = rows.groupBy("run_id", "candidate_id").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("valid"), F.min(failures).alias("failures"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("valid"), "failures", F.desc_nulls_last("score"), "candidate_id"))
    return one.withColumn("place", place).where("place <= 10").select("run_id", "candidate_id", "place")


@query(f"""WITH r AS (SELECT run_id, id, length(source) AS n, {_REAL} AS score FROM candidates WHERE source IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST, id) AS place FROM r), t AS (SELECT * FROM o WHERE place <= 8),
  s AS (SELECT run_id, id, place, n, sum(n) OVER (PARTITION BY run_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT run_id, id, CAST(place AS INTEGER) AS place, CAST(used AS BIGINT) AS used FROM s WHERE used <= 6000 OR place = 1""")
def prompt_context(spark, sf):
    """What fits into a context of 6,000 characters: the best candidate of a run always, then the next best while they fit."""
    rows = table(spark, sf, "candidates").where("source IS NOT NULL").select("run_id", "id", F.length("source").alias("n"), (_real("score") + F.lit(0.0)).alias("score"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc_nulls_last("score"), "id"))
    top = rows.withColumn("place", place).where("place <= 8")
    used = F.sum("n").over(Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).where("used <= 6000 OR place = 1").select("run_id", "id", "place", "used")


@query("""WITH f AS (SELECT DISTINCT c.source_sha256 FROM candidates c JOIN runs r ON r.run_id = c.run_id WHERE r.engine = 'sequential' AND c.source_sha256 IS NOT NULL) SELECT c.engine, count(*) AS kept FROM candidates c WHERE c.engine <> 'sequential' AND NOT EXISTS (SELECT 1 FROM f WHERE f.source_sha256 = c.source_sha256) GROUP BY c.engine""")
def split_disjoint(spark, sf):
    """Candidates of other engines whose source no sequential run has."""
    rows = table(spark, sf, "candidates").select("run_id", "engine", "source_sha256")
    runs = table(spark, sf, "runs").where("engine = 'sequential'").select("run_id")
    out = rows.where("source_sha256 IS NOT NULL").join(runs, "run_id", "left_semi").select("source_sha256").distinct()
    return rows.where("engine <> 'sequential'").join(out, "source_sha256", "left_anti").groupBy("engine").agg(F.count("*").alias("kept"))


@query("""WITH a AS (SELECT run_id, attempt_no, min(lower(status)) AS status, min(reserved_usd) AS reserved, min(charged_usd) AS charged FROM ledger_attempts GROUP BY run_id, attempt_no), s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY attempt_no) - sum(CASE WHEN status = 'settled' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY attempt_no) AS grp FROM a),
  f AS (SELECT run_id, grp, count(*) FILTER (WHERE status <> 'settled') AS streak FROM s GROUP BY run_id, grp)
  SELECT a.run_id, count(*) AS attempts, CAST(sum(CAST(coalesce(charged, 0) AS DECIMAL(18,6))) AS DOUBLE) AS spent, CAST(sum(CASE WHEN charged IS NULL THEN CAST(coalesce(reserved, 0) AS DECIMAL(18,6)) ELSE 0 END) AS DOUBLE) AS held, count(*) FILTER (WHERE charged > reserved) AS overruns, max(st.streak) AS longest_failure, max(st.streak) >= 3 AS halted, count(*) FILTER (WHERE charged IS NULL) = 0 AS may_restart
  FROM a JOIN (SELECT run_id, max(streak) AS streak FROM f GROUP BY run_id) st ON st.run_id = a.run_id GROUP BY a.run_id""")
def ledger_states(spark, sf):
    """The ledger's state machine replayed: what each run spent and still holds, charges above what was reserved, the longest
    row of attempts that failed (three halt a run), and whether it may be started again (nothing unsettled)."""
    rows = table(spark, sf, "ledger_attempts").groupBy("run_id", "attempt_no").agg(F.min(F.lower("status")).alias("status"), F.min("reserved_usd").alias("reserved"), F.min("charged_usd").alias("charged"))
    bad = F.coalesce((F.col("status") != "settled").cast("int"), F.lit(1))
    stretch = F.floor(F.col("attempt_no") / 4096)
    rows = rows.withColumn("bad", bad)
    rows = running(rows, ["run_id"], stretch, ["attempt_no"], F.lit(1), "i", agg=F.sum)
    rows = running(rows, ["run_id"], stretch, ["attempt_no"], F.col("bad"), "b", agg=F.sum).withColumn("grp", F.col("i") + 1 - F.col("b") - F.col("bad"))
    streaks = rows.groupBy("run_id", "grp").agg(R.count_if(F.col("status") != "settled").alias("streak")).groupBy("run_id").agg(F.max("streak").alias("longest_failure"))
    money = lambda c: F.sum(F.coalesce(c, F.lit(0.0)).cast("decimal(18,6)")).cast("double")
    out = rows.groupBy("run_id").agg(
        F.count("*").alias("attempts"), money(F.col("charged")).alias("spent"), money(F.when(F.col("charged").isNull(), F.col("reserved"))).alias("held"),
        R.count_if(F.col("charged") > F.col("reserved")).alias("overruns"), (R.count_if(F.col("charged").isNull()) == 0).alias("may_restart"),
    )
    return out.join(streaks, "run_id").withColumn("halted", F.col("longest_failure") >= 3)


# Exact mixtures where the SQL can name them: one block of zeros, six words a family with prices from one fixed rule.

_PRICES = "budget_unit - 4 + (cut * 7 + mask % 13) % 11 AS base, (cut * 5 + mask % 7) % (2 * m) AS slope"
_ONE = f"""w AS (SELECT id, m, m * (m + 1) // 2 + 1 AS goal, m - 2 AS s, cut, {_PRICES} FROM (SELECT *, unnest(range(0, 6)) AS cut FROM families WHERE k = 1)),
  c AS (SELECT id, goal, s, base::BIGINT AS bn, slope::BIGINT AS sn, 1::BIGINT AS d FROM w UNION ALL SELECT a.id, a.goal, a.s, a.base * (b.slope - a.s) + b.base * (a.s - a.slope), a.s * (b.slope - a.slope), b.slope - a.slope FROM w a JOIN w b ON a.id = b.id AND a.slope < a.s AND b.slope > a.s
    UNION ALL SELECT a.id, a.goal, a.s, a.goal * (b.base - a.base), a.slope * (b.base - a.goal) + b.slope * (a.goal - a.base), b.base - a.base FROM w a JOIN w b ON a.id = b.id AND a.base < a.goal AND b.base > a.goal),
  l AS (SELECT id, min(slope) - any_value(s) AS x FROM w GROUP BY id), e AS (SELECT id, greatest(x, 0) AS excess FROM l),
  o AS (SELECT c.id, arg_min({{'n': bn, 'd': d}}, bn / d) AS b FROM c JOIN e ON e.id = c.id WHERE sn <= (s + excess) * d GROUP BY c.id),
  g AS (SELECT id, arg_min({{'n': greatest(0, bn - goal * d) + greatest(0, sn - s * d), 'd': d}}, (greatest(0, bn - goal * d) + greatest(0, sn - s * d)) / d) AS g FROM c GROUP BY id)"""


@query(f"""WITH {_ONE} SELECT o.id, {_fraction('o.b.n', 'o.b.d')} AS objective, CAST(excess AS VARCHAR) AS excess, {_fraction('g.g.n', 'g.g.d')} AS gap, true AS proved,
  CASE WHEN excess = 0 AND o.b.n < (m * (m + 1) // 2 + 1) * o.b.d THEN 'CERTIFIED' WHEN g.g.n = 0 THEN 'BOUNDARY' ELSE 'NO_CERTIFICATE' END AS status FROM o JOIN e ON e.id = o.id JOIN g ON g.id = o.id JOIN families f ON f.id = o.id""")
def one_block_mixtures(spark, sf):
    """Best mixtures of families with one block, from given prices."""
    rows = table(spark, sf, "families").where("k = 1").withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(5))))
    base = F.col("budget_unit") - 4 + (F.col("cut") * 7 + F.col("mask") % 13) % 11
    slope = (F.col("cut") * 5 + F.col("mask") % 7) % (2 * F.col("m"))
    priced = rows.select("id", "m", "k", "cut", base.cast("bigint").alias("base"), F.array(slope.cast("bigint")).alias("slopes"), F.lit("PRICED").alias("status"))
    return mixtures(priced).select("id", "objective", "excess", "gap", "proved", "status")
