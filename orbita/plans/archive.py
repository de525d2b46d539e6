"""Queries over the archive's tables: campaign log, ledger, runs, candidates, families.

Each entry is a plan and the SQL it must equal. Log lines that were delivered again count once (their
first delivery). Sums of fractions are taken in decimals, so that they don't depend on the order. The SQL
tells NaN by its text: with isnan() some NaN of the Parquet files passed DuckDB's filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.functions.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """First delivery of each log line: one aggregation with map-side combine, no sort."""
    rows = table(spark, sf, "run_log").select("log_id", "received_utc", F.struct(*columns).alias("x"))
    return rows.groupBy("log_id").agg(F.min_by("x", "received_utc").alias("x")).select("log_id", "x.*")


_LINES = "lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_utc) AS delivery FROM run_log) WHERE delivery = 1)"


def _real(c: str) -> Column:
    """A score that can be compared: NaN counts as none."""
    return F.when(~F.isnan(c), F.col(c))


_REAL = "CASE WHEN NOT CAST(score AS VARCHAR) = 'nan' THEN score END"


def _money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,6)")).cast("double")


def running(df: DataFrame, keys: list[str], stretch: Column, order: list, value: Column, name: str, agg=F.max) -> DataFrame:
    """Adds the running ``agg`` of ``value`` before each row in ``order`` within ``keys``.

    ``stretch`` cuts each group along the order. Stretches are summed up first, a window over these
    few rows carries their totals forward, and the rows only meet inside their stretch: a group of any
    size is worked on in many tasks."""
    rows = df.withColumns({"_s": stretch, "_v": value})
    totals = rows.groupBy(*keys, "_s").agg(agg("_v").alias("_t"))
    carried = totals.withColumn("_before", agg("_t").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = {F.max: F.greatest, F.min: F.least}.get(agg)
    local = rows.withColumn("_local", agg("_v").over(inside))
    same = None
    for k in [*keys, "_s"]:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) if same is None else same & F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = local.alias("l").join(carried.alias("c"), same)
    total = both(F.col("_local"), F.col("_before")) if both else F.coalesce("_local", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], total.alias(name))


@query(f"""WITH {_LINES} SELECT a.event, a.deliveries, b.distinct_lines, b.late_lines FROM
  (SELECT event, count(*) AS deliveries FROM run_log GROUP BY event) a JOIN
  (SELECT event, count(*) AS distinct_lines, count(*) FILTER (WHERE received_utc > t + INTERVAL 1 HOUR) AS late_lines FROM lines GROUP BY event) b ON a.event IS NOT DISTINCT FROM b.event""")
def log_events(spark, sf):
    raw = table(spark, sf, "run_log").groupBy("event").agg(F.count("*").alias("deliveries"))
    rows = table(spark, sf, "run_log").groupBy("log_id").agg(F.min_by(F.struct("event", "t", "received_utc"), "received_utc").alias("x")).select("x.*")
    late = F.col("received_utc") > F.col("t") + F.expr("INTERVAL 1 HOUR")
    once = rows.groupBy("event").agg(F.count("*").alias("distinct_lines"), F.count(F.when(late, 1)).alias("late_lines"))
    return raw.alias("a").join(once.alias("b"), F.col("a.event").eqNullSafe(F.col("b.event"))).select("a.event", "deliveries", "distinct_lines", "late_lines")


@query(f"""WITH {_LINES}, c AS (SELECT log_id, run_id, t, valid, status, {_REAL} AS score FROM lines WHERE event = 'candidate'),
  w AS (SELECT *, max(CASE WHEN valid AND status IS DISTINCT FROM 'duplicate' THEN score END) OVER (PARTITION BY run_id ORDER BY t, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
  SELECT log_id, run_id, before AS best_before, CASE WHEN status = 'duplicate' THEN 'duplicate' WHEN valid IS NOT TRUE OR score IS NULL THEN 'invalid' WHEN before IS NULL OR score > before THEN 'keep' ELSE 'discard' END AS outcome FROM w""")
def best_so_far(spark, sf):
    """The best score before each proposal, and what became of it; duplicates and invalid ones raise no best."""
    rows = _lines(spark, sf, "run_id", "event", "t", "valid", "status", "score").where("event = 'candidate'").withColumn("score", _real("score"))
    fresh = F.col("valid") & ~F.col("status").eqNullSafe(F.lit("duplicate"))
    out = running(rows, ["run_id"], F.date_trunc("hour", "t"), ["t", "log_id"], F.when(fresh, F.col("score")), "best_before")
    outcome = (
        F.when(F.col("status") == "duplicate", "duplicate").when(F.col("valid").isNull() | ~F.col("valid") | F.col("score").isNull(), "invalid")
        .when(F.col("best_before").isNull() | (F.col("score") > F.col("best_before")), "keep").otherwise("discard")
    )
    return out.select("log_id", "run_id", "best_before", outcome.alias("outcome"))


@query(f"""WITH {_LINES} SELECT run_id, CAST(r AS INTEGER) AS recency, log_id FROM (SELECT run_id, log_id,
  row_number() OVER (PARTITION BY run_id ORDER BY t DESC NULLS LAST, log_id DESC) AS r FROM lines WHERE event = 'candidate') WHERE r <= 3""")
def recent_attempts(spark, sf):
    rows = _lines(spark, sf, "run_id", "event", "t").where("event = 'candidate'")
    last = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("t"), F.desc("log_id"))
    return rows.withColumn("recency", F.row_number().over(last)).where("recency <= 3").select("run_id", "recency", "log_id")


@query(f"""WITH {_LINES} SELECT mode, status, count(*) AS proposals, count(*) FILTER (WHERE feasible) AS feasible,
  count(*) FILTER (WHERE valid) AS valid, CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE) AS usd, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM lines WHERE event = 'candidate' GROUP BY mode, status""")
def proposal_tally(spark, sf):
    rows = _lines(spark, sf, "event", "mode", "status", "feasible", "valid", "cost_usd", "tokens_in", "tokens_out").where("event = 'candidate'")
    return rows.groupBy("mode", "status").agg(
        F.count("*").alias("proposals"), F.count(F.when(F.col("feasible"), 1)).alias("feasible"), F.count(F.when(F.col("valid"), 1)).alias("valid"),
        _money("cost_usd").alias("usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )


@query(f"""WITH {_LINES}, c AS (SELECT run_id, candidate_id, t, log_id, {_REAL} AS score, cost_usd FROM lines WHERE event = 'candidate')
  SELECT run_id, count(*) AS proposals, count(score) AS scored, max(score) AS best, min(CASE WHEN score = best_of THEN candidate_id END) AS best_id,
  CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE) AS usd, max(t) AS last_t FROM (SELECT *, max(score) OVER (PARTITION BY run_id) AS best_of FROM c) GROUP BY run_id""")
def run_overview(spark, sf):
    rows = _lines(spark, sf, "run_id", "event", "candidate_id", "t", "score", "cost_usd").where("event = 'candidate'").withColumn("score", _real("score"))
    first_best = F.max(F.when(F.col("score").isNotNull() & F.col("candidate_id").isNotNull(), F.struct("score", (-F.col("candidate_id")).alias("minus"))))
    best = F.max("score")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("proposals"), F.count("score").alias("scored"), best.alias("best"), first_best.alias("b"), _money("cost_usd").alias("usd"), F.max("t").alias("last_t")
    ).select("run_id", "proposals", "scored", "best", F.when(F.col("b.score") == F.col("best"), -F.col("b.minus")).alias("best_id"), "usd", "last_t")


@query(f"""SELECT engine, count(score) AS n, round(avg(CAST(score AS DECIMAL(20,6))), 4) AS mean, min(score) AS low, max(score) AS high
  FROM (SELECT engine, {_REAL} AS score FROM candidates WHERE score IS NULL OR CAST(score AS VARCHAR) NOT IN ('inf', '-inf')) GROUP BY engine""")
def arm_statistics(spark, sf):
    score = F.when(~F.isnan("score") & (F.abs("score") != float("inf")), F.col("score"))
    rows = table(spark, sf, "candidates").where(F.abs(F.coalesce("score", F.lit(0.0))) != float("inf")).select("engine", score.alias("score"))
    mean = F.round((F.sum(F.col("score").cast("decimal(20,6)")).cast("double") / F.count("score")), 4)
    return rows.groupBy("engine").agg(F.count("score").alias("n"), mean.alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("""SELECT kind, role, lower(status) AS status, count(*) AS attempts, CAST(sum(CAST(charged_usd AS DECIMAL(18,6))) AS DOUBLE) AS usd,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(DISTINCT run_id) AS runs FROM
  (SELECT DISTINCT run_id, attempt_no, kind, role, lower(status) AS status, charged_usd, input_tokens, output_tokens FROM ledger_attempts) GROUP BY kind, role, lower(status)""")
def ledger_rollup(spark, sf):
    rows = table(spark, sf, "ledger_attempts").select("run_id", "attempt_no", "kind", "role", F.lower("status").alias("status"), "charged_usd", "input_tokens", "output_tokens").distinct()
    return rows.groupBy("kind", "role", "status").agg(
        F.count("*").alias("attempts"), _money("charged_usd").alias("usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_distinct("run_id").alias("runs")
    )


@query(f"""WITH {_LINES} SELECT CASE WHEN r.run_id IS NULL THEN 'unattributed' WHEN l.t < r.started_utc THEN 'before' WHEN l.t <= r.ended_utc THEN 'inside'
  WHEN r.ended_utc IS NULL THEN 'open' ELSE 'after' END AS place, r.engine, count(*) AS lines FROM lines l LEFT JOIN runs r ON l.run_id = r.run_id GROUP BY ALL""")
def interval_attribution(spark, sf):
    runs = table(spark, sf, "runs").select("run_id", "engine", "started_utc", "ended_utc", F.lit(True).alias("known"))
    rows = _lines(spark, sf, "run_id", "t").join(runs, "run_id", "left")
    place = (
        F.when(F.col("known").isNull(), "unattributed").when(F.col("t") < F.col("started_utc"), "before").when(F.col("t") <= F.col("ended_utc"), "inside")
        .when(F.col("ended_utc").isNull(), "open").otherwise("after")
    )
    return rows.groupBy(place.alias("place"), "engine").agg(F.count("*").alias("lines"))


@query(f"""WITH {_LINES}, c AS (SELECT run_id, t, log_id, {_REAL} AS score, coalesce(CAST(cost_usd AS DECIMAL(18,6)), 0) AS usd FROM lines WHERE event = 'candidate'),
  s AS (SELECT *, sum(usd) OVER (PARTITION BY run_id ORDER BY t, log_id ROWS UNBOUNDED PRECEDING) AS spent FROM c)
  SELECT run_id, CAST(level AS INTEGER) AS level_cents, max(score) AS best FROM s JOIN (SELECT unnest([1, 5, 10, 25, 50, 100]) AS level) ON spent * 100 <= level GROUP BY run_id, level""")
def best_at_spend(spark, sf):
    """Best score a run had when it had spent at most so many cents: backward as-of by spend."""
    rows = _lines(spark, sf, "run_id", "event", "t", "score", "cost_usd").where("event = 'candidate'").withColumn("score", _real("score"))
    usd = F.coalesce(F.col("cost_usd").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    before = running(rows, ["run_id"], F.date_trunc("hour", "t"), ["t", "log_id"], usd, "spent", agg=F.sum)
    levels = spark.createDataFrame([(x,) for x in (1, 5, 10, 25, 50, 100)], "level_cents int")
    spent = (F.col("spent") + usd) * 100
    return before.join(F.broadcast(levels), spent <= F.col("level_cents")).groupBy("run_id", "level_cents").agg(F.max("score").alias("best"))


@query(f"""WITH {_LINES}, g AS (SELECT DISTINCT candidate_id, u.graph AS graph, u.score AS score FROM (SELECT candidate_id, unnest(graphs) AS u FROM lines WHERE event = 'candidate' AND candidate_id IS NOT NULL)
  WHERE u.score IS NOT NULL AND NOT CAST(u.score AS VARCHAR) = 'nan'), b AS (SELECT graph, max(score) AS best FROM g GROUP BY graph)
  SELECT candidate_id, count(*) AS wins FROM g JOIN b ON g.graph = b.graph AND g.score = b.best GROUP BY candidate_id""")
def pareto_wins(spark, sf):
    """How many graphs each candidate is best on; ties count for all."""
    rows = _lines(spark, sf, "event", "candidate_id", "graphs").where("event = 'candidate' AND candidate_id IS NOT NULL").select("candidate_id", F.explode("graphs").alias("u"))
    g = rows.select("candidate_id", "u.graph", "u.score").where("score IS NOT NULL AND NOT isnan(score) AND graph IS NOT NULL").distinct()
    best = g.groupBy("graph").agg(F.max("score").alias("best"))
    return g.join(best, "graph").where("score = best").groupBy("candidate_id").agg(F.count("*").alias("wins"))


@query(f"""WITH {_LINES} SELECT u.graph AS graph, count(*) AS evaluations, CAST(sum(u.failures) AS BIGINT) AS failures, max(u.failures) AS most_failures,
  max(CASE WHEN NOT CAST(u.score AS VARCHAR) = 'nan' THEN u.score END) AS best FROM (SELECT unnest(graphs) AS u FROM lines WHERE event = 'candidate') GROUP BY u.graph""")
def graph_scores(spark, sf):
    rows = _lines(spark, sf, "event", "graphs").where("event = 'candidate'").select(F.explode("graphs").alias("u")).select("u.*")
    return rows.groupBy("graph").agg(F.count("*").alias("evaluations"), F.sum("failures").alias("failures"), F.max("failures").alias("most_failures"), F.max(_real("score")).alias("best"))


@query("""WITH c AS (SELECT engine, max_proposals, max(best) AS best FROM runs WHERE best IS NOT NULL AND max_proposals IS NOT NULL GROUP BY ALL)
  SELECT engine, max_proposals, best FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.engine = a.engine AND b.max_proposals <= a.max_proposals AND b.best >= a.best AND (b.max_proposals < a.max_proposals OR b.best > a.best))""")
def skyline(spark, sf):
    """Runs no cheaper run of the engine beats: best score against proposals, in one pass over sorted costs."""
    c = table(spark, sf, "runs").where("best IS NOT NULL AND max_proposals IS NOT NULL AND engine IS NOT NULL").groupBy("engine", "max_proposals").agg(F.max("best").alias("best"))
    below = F.max("best").over(Window.partitionBy("engine").orderBy("max_proposals").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("below", below).where("below IS NULL OR best > below").select("engine", "max_proposals", "best")


@query("""SELECT run_id, engine, best, CAST(row_number() OVER (ORDER BY best DESC NULLS LAST, run_id) AS INTEGER) AS place FROM runs ORDER BY best DESC NULLS LAST, run_id LIMIT 20""")
def leaderboard(spark, sf):
    top = table(spark, sf, "runs").select("run_id", "engine", "best").orderBy(F.desc_nulls_last("best"), "run_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("best"), "run_id")))


@query("""SELECT c.id, c.run_id, count(k.id) AS children, min(k.id) AS first_child FROM candidates c LEFT JOIN candidates k ON k.parent_id = c.id AND k.run_id = c.run_id GROUP BY c.id, c.run_id""")
def lineage_children(spark, sf):
    rows = table(spark, sf, "candidates").select("id", "run_id", "parent_id")
    kids = rows.groupBy(F.col("parent_id").alias("id"), "run_id").agg(F.count("*").alias("children"), F.min("id").alias("first_child"))
    return rows.select("id", "run_id").join(kids, ["id", "run_id"], "left").select("id", "run_id", F.coalesce("children", F.lit(0)).alias("children"), "first_child")


@query("""SELECT c.id, c.parent_id FROM candidates c WHERE c.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candidates p WHERE p.id = c.parent_id)""")
def missing_parents(spark, sf):
    rows = table(spark, sf, "candidates").select("id", "parent_id")
    return rows.where("parent_id IS NOT NULL").join(rows.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


@query("""SELECT sha256(source) AS digest, count(*) AS copies, min(id) AS first_id, count(*) FILTER (WHERE source_sha256 = sha256(source)) AS well_signed FROM candidates WHERE source IS NOT NULL GROUP BY sha256(source)""")
def content_digests(spark, sf):
    rows = table(spark, sf, "candidates").where("source IS NOT NULL").select("id", F.sha2("source", 256).alias("digest"), "source_sha256")
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.count(F.when(F.col("source_sha256") == F.col("digest"), 1)).alias("well_signed"))


@query("""SELECT id, run_id FROM candidates WHERE feedback_json ILIKE '%descent%' OR traces_json ILIKE '%descent%' OR provenance_json ILIKE '%descent%' OR source ILIKE '%descent%'""")
def text_search(spark, sf):
    rows = table(spark, sf, "candidates")
    hit = F.lit(False)
    for c in ("feedback_json", "traces_json", "provenance_json", "source"):
        hit = hit | F.coalesce(F.col(c).ilike("%descent%"), F.lit(False))
    return rows.where(hit).select("id", "run_id")


@query("""SELECT id, source_sha256 FROM (SELECT id, source_sha256, row_number() OVER (PARTITION BY source_sha256 ORDER BY coalesce(length(traces_json), 0) DESC, id DESC) AS r
  FROM candidates WHERE source_sha256 IS NOT NULL) WHERE r = 1""")
def richest_per_source(spark, sf):
    rows = table(spark, sf, "candidates").where("source_sha256 IS NOT NULL")
    best = F.max_by("id", F.struct(F.coalesce(F.length("traces_json"), F.lit(0)).alias("n"), F.col("id").alias("i")))
    return rows.groupBy("source_sha256").agg(best.alias("id")).select("id", "source_sha256")


@query(f"""WITH r AS (SELECT engine, id, score, ntile(6) OVER (PARTITION BY engine ORDER BY score, id) AS tile FROM candidates WHERE score IS NOT NULL AND NOT CAST(score AS VARCHAR) = 'nan')
  SELECT engine, CAST(tile AS INTEGER) AS tile, count(*) AS n, min(score) AS low, max(score) AS high FROM r GROUP BY engine, tile""")
def score_tiles(spark, sf):
    """Six equal groups of each engine's candidates by score and id: each score's place is the number of rows in lower ones.
    Scores are cut into stretches by a logarithm of theirs, which keeps their order, so no engine is sorted in one task."""
    rows = table(spark, sf, "candidates").where("score IS NOT NULL AND NOT isnan(score)").select("engine", (F.col("score") + 0.0).alias("score"))
    sizes = rows.groupBy("engine", "score").agg(F.count("*").alias("n"))
    stretch = F.floor(F.signum("score") * 256 * F.least(F.log2(1 + F.abs("score")), F.lit(1100.0)))
    placed = running(sizes, ["engine"], stretch, ["score"], F.col("n"), "lower", agg=F.sum)
    totals = sizes.groupBy(F.col("engine").alias("e")).agg(F.sum("n").alias("all"))
    places = placed.join(totals, F.col("engine").eqNullSafe(F.col("e"))).select("e", "score", "n", "lower", "all")
    # A tile only needs the extent of each score: equal scores are told apart by count, not by row.
    small, more = F.floor(F.col("all") / 6), F.col("all") % 6
    cut_at = lambda t: F.lit(t) * small + F.least(F.lit(t), more)
    tiles = places.select("e", "score", F.explode(F.array(*[F.struct(F.lit(t + 1).alias("tile"), F.greatest(F.col("lower"), cut_at(t)).alias("a"), F.least(F.col("lower") + F.col("n"), cut_at(t + 1)).alias("b")) for t in range(6)])).alias("x"))
    return tiles.where("x.b > x.a").groupBy(F.col("e").alias("engine"), "x.tile").agg(F.sum(F.col("x.b") - F.col("x.a")).cast("bigint").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"""WITH {_LINES}, o AS (SELECT run_id, {_REAL} AS score, (row_number() OVER (PARTITION BY run_id ORDER BY t, log_id) - 1) // 10 AS win, row_number() OVER (PARTITION BY run_id ORDER BY t, log_id) AS r FROM lines WHERE event = 'candidate')
  SELECT run_id, CAST(win AS BIGINT) AS window_no, count(*) AS proposals, max(score) AS best, min(score) AS worst FROM o GROUP BY run_id, win""")
def count_windows(spark, sf):
    """Windows of ten proposals of a run in order of time."""
    rows = _lines(spark, sf, "run_id", "event", "t", "score").where("event = 'candidate'").withColumn("score", _real("score"))
    placed = running(rows, ["run_id"], F.date_trunc("hour", "t"), ["t", "log_id"], F.lit(1), "before", agg=F.sum)
    return placed.groupBy("run_id", F.floor(F.col("before") / 10).alias("window_no")).agg(F.count("*").alias("proposals"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("""SELECT c.engine, count(*) FILTER (WHERE c.score > p.score) AS uphill, count(*) FILTER (WHERE c.score = p.score) AS flat, count(*) FILTER (WHERE c.score < p.score) AS downhill
  FROM candidates c JOIN candidates p ON c.parent_id = p.id WHERE NOT CAST(c.score AS VARCHAR) = 'nan' AND NOT CAST(p.score AS VARCHAR) = 'nan' GROUP BY c.engine""")
def steps_from_parent(spark, sf):
    rows = table(spark, sf, "candidates").where("NOT isnan(score)").select("id", "parent_id", "engine", "score")
    both = rows.join(rows.select(F.col("id").alias("parent_id"), F.col("score").alias("p")), "parent_id")
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy("engine").agg(count(F.col("score") > F.col("p")).alias("uphill"), count(F.col("score") == F.col("p")).alias("flat"), count(F.col("score") < F.col("p")).alias("downhill"))


@query(f"""WITH {_LINES} SELECT CASE WHEN c.id IS NULL THEN 'log only' WHEN l.candidate_id IS NULL THEN 'archive only' WHEN l.score IS NULL OR c.score IS NULL THEN 'unscored'
  WHEN l.score = c.score OR (CAST(l.score AS VARCHAR) = 'nan' AND CAST(c.score AS VARCHAR) = 'nan') THEN 'agree' ELSE 'differ' END AS verdict, count(*) AS n
  FROM (SELECT candidate_id, min(score) AS score FROM lines WHERE event = 'candidate' AND candidate_id IS NOT NULL GROUP BY candidate_id) l FULL JOIN candidates c ON c.id = l.candidate_id GROUP BY 1""")
def audit_scores(spark, sf):
    log = _lines(spark, sf, "event", "candidate_id", "score").where("event = 'candidate' AND candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.min("score").alias("l"))
    both = log.join(table(spark, sf, "candidates").select("id", "score"), F.col("id") == F.col("candidate_id"), "full")
    verdict = (
        F.when(F.col("id").isNull(), "log only").when(F.col("candidate_id").isNull(), "archive only").when(F.col("l").isNull() | F.col("score").isNull(), "unscored")
        .when(F.col("l") == F.col("score"), "agree").otherwise("differ")
    )
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.run_id, b.run_id) AS run_id, a.run_id IS NOT NULL AS announced, coalesce(b.n, 0) AS candidates FROM runs a FULL JOIN (SELECT run_id, count(*) AS n FROM candidates GROUP BY run_id) b ON a.run_id = b.run_id""")
def run_completeness(spark, sf):
    runs = table(spark, sf, "runs").select("run_id", F.lit(True).alias("known"))
    n = table(spark, sf, "candidates").groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.join(n, "run_id", "full").select("run_id", F.col("known").isNotNull().alias("announced"), F.coalesce("n", F.lit(0)).alias("candidates"))


@query("""SELECT id FROM ((SELECT id FROM families WHERE m = 12 OR m = 11) EXCEPT (SELECT id FROM families WHERE k > 5)) INTERSECT SELECT id FROM families WHERE class IS NOT NULL""")
def families_left(spark, sf):
    f = table(spark, sf, "families")
    return f.where("m IN (11, 12)").select("id").exceptAll(f.where("k > 5").select("id")).intersect(f.where("class IS NOT NULL").select("id"))


@query("""SELECT m, k, class, count(*) AS families, min(budget_unit) AS low_budget, max(budget_unit) AS high_budget FROM families GROUP BY m, k, class""")
def family_tally(spark, sf):
    return table(spark, sf, "families").groupBy("m", "k", "class").agg(F.count("*").alias("families"), F.min("budget_unit").alias("low_budget"), F.max("budget_unit").alias("high_budget"))


@query("""SELECT id, len(list_filter(range(0, m + 1), lambda g: (mask >> g) & 1 = 1)) = k AS k_ok, list_filter(range(0, m + 1), lambda g: (mask >> g) & 1 = 1) = CAST(gaps AS BIGINT[]) AS gaps_ok,
  m * (m + 1) // 2 + (k - 1) * (m - 2) = budget_unit AS budget_ok, m - 2 = slope_bound AS slope_ok, list_filter(unit_base, lambda x: x > 0) = labels AS labels_ok, len(unit_base) = m + k AS length_ok FROM families""")
def family_check(spark, sf):
    """Every family recomputed from its labels and mask, and its unit base read back."""
    f = table(spark, sf, "families")
    base = S.base_vector(F.col("labels"), F.col("mask"))
    return f.select(
        "id", (F.bit_count("mask") == F.col("k")).alias("k_ok"), (S.gaps(F.col("mask"), F.col("m")) == F.col("gaps")).alias("gaps_ok"),
        (S.budget(F.col("m"), F.col("k")).cast("int") == F.col("budget_unit")).alias("budget_ok"), (F.col("m") - 2 == F.col("slope_bound")).alias("slope_ok"),
        ((S.parse_labels(F.col("unit_base")) == F.col("labels")) & (base == F.col("unit_base")) & (S.parse_mask(F.col("unit_base")) == F.col("mask"))).alias("labels_ok"),
        (F.size("unit_base") == F.col("m") + F.col("k")).alias("length_ok"),
    )


@query("""SELECT p.id AS parent, c.id AS child FROM families p JOIN families c ON p.m = c.m AND (p.mask & c.mask) = c.mask AND p.mask <> c.mask""")
def submask_pairs(spark, sf):
    f = table(spark, sf, "families")
    p, c = f.select("m", F.col("id").alias("parent"), F.col("mask").alias("pm")), f.select("m", F.col("id").alias("child"), F.col("mask").alias("cm"))
    return p.join(c, "m").where((F.col("pm").bitwiseAND(F.col("cm")) == F.col("cm")) & (F.col("pm") != F.col("cm"))).select("parent", "child")


@query("""SELECT id, CAST(list_sum([len(list_filter(labels[i + 1:], lambda y: y < labels[i])) for i in range(1, len(labels) + 1)]) AS INTEGER) AS inversions FROM families""")
def family_inversions(spark, sf):
    return table(spark, sf, "families").select("id", S.inversions(F.col("labels")).alias("inversions"))


@query("""SELECT CASE WHEN best IS NULL OR seed_best IS NULL THEN 'INF' ELSE CAST(CAST(floor((best - seed_best) / 100) AS BIGINT) AS VARCHAR) END AS bucket, count(*) AS runs FROM runs GROUP BY 1""")
def gain_histogram(spark, sf):
    return table(spark, sf, "runs").groupBy(F.coalesce(F.floor((F.col("best") - F.col("seed_best")) / 100).cast("string"), F.lit("INF")).alias("bucket")).agg(F.count("*").alias("runs"))


@query("""SELECT l.returnflag, l.linestatus, count(*) AS lines, CAST(sum(CAST(l.quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM
  (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, l_quantity AS quantity FROM lineitem) l GROUP BY ALL""")
def grouped_lines(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return rows.agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
