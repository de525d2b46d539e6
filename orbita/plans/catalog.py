"""All queries of the core, by name, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.runtime import table
from orbita.operators.hierarchy import hierarchy
from orbita.operators.pricing import frontier, mixtures, word_profiles
from orbita.operators.shredding import nested_tables
from orbita.plans import archive, certplans, graphs, liftplans, moreplans, rollupplans, searchplans, sinkplans, wordplans
from orbita.streaming.tail import tally

JSON_FIELDS = ["feedback_json", "traces_json", "provenance_json"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested_tables(table(spark, sf, "candidates"), "id", JSON_FIELDS).select("id", "field", "path", "parent_path")


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables with their scalars, as lines ``name=value`` in order of names."""
    lines = F.array_sort(F.transform(F.map_entries("scalars"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return nested_tables(table(spark, sf, "candidates"), "id", JSON_FIELDS).select("id", "field", "path", "parent_path", "table", F.array_join(lines, "\n").alias("scalars"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(table(spark, sf, "candidates"))


#: Walks every JSON value with DuckDB's json_tree; names here hold no dot or bracket.
_P1 = " UNION ALL ".join(
    f"""SELECT id, '{f}' AS field, fullkey AS path, CASE WHEN regexp_matches(fullkey, '\\].*\\.[^\\]]+(\\[\\d+\\])+$') THEN regexp_extract(fullkey, '^(.*\\])(\\.[^.\\[\\]]+)+(\\[\\d+\\])+$', 1) ELSE '$' END AS parent_path
  FROM (SELECT id, unnest(json_tree_of) AS n FROM (SELECT c.id, list({{'fullkey': t.fullkey, 'type': t.type}}) AS json_tree_of FROM
    (SELECT id, CASE WHEN json_type({f}) = 'VARCHAR' THEN CASE WHEN json_valid({f} ->> '$') THEN {f} ->> '$' END ELSE {f} END AS j FROM candidates WHERE json_valid({f})) c, json_tree(c.j) t GROUP BY c.id)) x,
    LATERAL (SELECT n.fullkey AS fullkey, n.type AS type) y WHERE type = 'OBJECT' AND fullkey LIKE '%]'"""
    for f in JSON_FIELDS
)

_P4 = """WITH RECURSIVE t(id, root_id, root_run_id, depth, path) AS (
    SELECT id, id, run_id, 0, CAST(id AS VARCHAR) FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates p WHERE p.id = c.parent_id)
    UNION ALL SELECT c.id, t.root_id, t.root_run_id, t.depth + 1, t.path || '/' || c.id FROM candidates c JOIN t ON c.parent_id = t.id),
  below AS (SELECT a, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM t) GROUP BY a),
  u AS (SELECT id, parent_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = c.id)),
  up(id, a) AS (SELECT id, parent_id FROM u UNION SELECT up.id, u.parent_id FROM up JOIN u ON u.id = up.a)
  SELECT t.id, 'tree' AS state, root_id, root_run_id, depth, path, CAST(n AS INTEGER) AS descendants FROM t JOIN below ON below.a = CAST(t.id AS VARCHAR)
  UNION ALL SELECT id, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.id = u.id AND up.a = u.id) THEN 'cycle' ELSE 'below_cycle' END, -1, '', -1, '', -1 FROM u"""


def family_words(spark: SparkSession, sf: str) -> DataFrame:
    """One word per cut for each family, with its prices."""
    return word_profiles(table(spark, sf, "families")).withColumn("slopes", F.array_join(F.col("slopes").cast("array<string>"), " "))


def family_mixtures(spark: SparkSession, sf: str) -> DataFrame:
    """The best exact mixture of each family's words."""
    return mixtures(word_profiles(table(spark, sf, "families")))


def family_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each family that no other word of it beats."""
    return frontier(word_profiles(table(spark, sf, "families"))).select("id", "cut", "base", F.array_join(F.col("slopes").cast("array<string>"), " ").alias("slopes"))


def stream_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines per event and status, read as a stream."""
    return tally(spark, f"{sf}/run_log.parquet")


QUERIES = {**{f.__name__: f for f in (p1_found, p1_tables, p4_found, family_words, family_mixtures, family_frontier, stream_tally)}, **archive.QUERIES, **graphs.QUERIES, **wordplans.QUERIES, **rollupplans.QUERIES, **liftplans.QUERIES, **searchplans.QUERIES, **sinkplans.QUERIES, **certplans.QUERIES, **moreplans.QUERIES}
_SCALARS = " UNION ALL ".join(
    f"""SELECT id, '{f}' AS field, fullkey AS path, CASE WHEN regexp_matches(fullkey, '\\].*\\.[^\\]]+(\\[\\d+\\])+$') THEN regexp_extract(fullkey, '^(.*\\])(\\.[^.\\[\\]]+)+(\\[\\d+\\])+$', 1) ELSE '$' END AS parent_path, type,
      regexp_extract(fullkey, '^(.*\\])', 1) AS owner, regexp_extract(fullkey, '\\]\\.([^\\]]*)$', 1) AS label, coalesce(atom ->> '$', 'null') AS value
    FROM (SELECT c.id, t.fullkey, t.type, t.atom FROM (SELECT id, CASE WHEN json_type({f}) = 'VARCHAR' THEN CASE WHEN json_valid({f} ->> '$') THEN {f} ->> '$' END ELSE {f} END AS j FROM candidates WHERE json_valid({f})) c, json_tree(c.j) t)"""
    for f in JSON_FIELDS
)
_P1_TABLES = f"""WITH x AS ({_SCALARS}), o AS (SELECT id, field, path, parent_path FROM x WHERE type = 'OBJECT' AND path LIKE '%]'), s AS (SELECT id, field, owner, string_agg(label || '=' || value, chr(10) ORDER BY label || '=' || value) AS scalars FROM x WHERE type NOT IN ('OBJECT', 'ARRAY') AND label <> '' GROUP BY id, field, owner)
  SELECT o.id, o.field, path, parent_path, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS "table", coalesce(scalars, '') AS scalars FROM o LEFT JOIN s ON s.id = o.id AND s.field = o.field AND s.owner = o.path"""

#: Sweeps as a recursion over single steps, then each word's run: turns since the last swap, passes of each zero since then.
_FAMILY_WORDS = """b AS (SELECT id, m, k, unit_base, len(unit_base) AS n, unnest(range(0, len(unit_base))) AS cut FROM families WHERE unit_base IS NOT NULL AND len(unit_base) > 1),
  s(id, cut, n, a, i, swaps, sweep, word, over) AS (SELECT id, cut, n, unit_base[cut + 1:] || unit_base[1:cut], 0, 0, '', repeat('L', cut), false FROM b UNION ALL
    SELECT id, cut, n, CASE WHEN i = n - 1 THEN a WHEN x THEN a[1:i] || [a[i + 2], a[i + 1]] || a[i + 3:] ELSE a END, CASE WHEN i = n - 1 THEN 0 ELSE i + 1 END, CASE WHEN i = n - 1 THEN 0 ELSE swaps + CASE WHEN x THEN 1 ELSE 0 END END,
      CASE WHEN i = n - 1 THEN '' ELSE sweep || CASE WHEN x THEN 'X' ELSE '' END || 'L' END, CASE WHEN i = n - 1 AND swaps > 0 THEN word || sweep || 'L' ELSE word END, i = n - 1 AND swaps = 0
    FROM (SELECT *, i < n - 1 AND CASE WHEN a[i + 1] = 0 THEN 99 ELSE a[i + 1] END > CASE WHEN a[i + 2] = 0 THEN 99 ELSE a[i + 2] END AS x FROM s WHERE NOT over) z),
  w AS (SELECT s.id, b.m, b.k, s.cut, s.word, [CASE WHEN b.unit_base[i] = 0 THEN -len(list_filter(b.unit_base[1:i], lambda y: y = 0)) ELSE b.unit_base[i] END for i in range(1, b.n + 1)] AS own FROM s JOIN b ON b.id = s.id AND b.cut = s.cut WHERE over),
  r(id, cut, k, word, p, a, d, c, base, slope, fits, bad) AS (SELECT id, cut, k, word, 0, own, 0, [0 for _ in range(0, k)], 0, [0 for _ in range(0, k)], true, false FROM w UNION ALL
    SELECT id, cut, k, word, p + 1, CASE x WHEN 'L' THEN a[2:] || a[1:1] WHEN 'R' THEN a[len(a):] || a[1:len(a) - 1] ELSE [a[2], a[1]] || a[3:] END,
      CASE x WHEN 'L' THEN d + 1 WHEN 'R' THEN d - 1 ELSE 0 END, CASE WHEN x = 'L' THEN [c[j] + CASE WHEN a[1] = -j THEN 1 ELSE 0 END for j in range(1, k + 1)] WHEN x = 'R' THEN [c[j] - CASE WHEN a[len(a)] = -j THEN 1 ELSE 0 END for j in range(1, k + 1)] ELSE [CASE WHEN a[2] = -j THEN -1 ELSE 0 END for j in range(1, k + 1)] END,
      base + CASE WHEN x = 'X' THEN 1 + abs(d) ELSE 0 END, CASE WHEN x = 'X' THEN [slope[j] + abs(c[j] + CASE WHEN a[1] = -j THEN 1 ELSE 0 END) + CASE WHEN a[1] = -j OR a[2] = -j THEN 2 ELSE 0 END for j in range(1, k + 1)] ELSE slope END,
      fits AND (x <> 'X' OR (d >= 0 AND list_min([c[j] + CASE WHEN a[1] = -j THEN 1 ELSE 0 END for j in range(1, k + 1)]) >= 0) OR (d <= 0 AND list_max([c[j] + CASE WHEN a[1] = -j THEN 1 ELSE 0 END for j in range(1, k + 1)]) <= 0)), bad OR (x = 'X' AND a[1] < 0 AND a[2] < 0)
    FROM (SELECT *, word[p + 1:p + 1] AS x FROM r WHERE p < length(word)) z),
  f AS (SELECT r.id, w.m, r.k, r.cut, r.word, base + abs(d) AS base, [slope[j] + abs(c[j]) for j in range(1, r.k + 1)] AS slopes, fits AND ((d >= 0 AND list_min(c) >= 0) OR (d <= 0 AND list_max(c) <= 0)) AS same_sign, bad FROM r JOIN w ON w.id = r.id AND w.cut = r.cut WHERE p = length(r.word))"""
_FAMILY_FRONTIER = f"""WITH RECURSIVE {_FAMILY_WORDS} SELECT id, CAST(cut AS INTEGER) AS cut, CAST(base AS BIGINT) AS base, array_to_string(slopes, ' ') AS slopes FROM f a WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.id = a.id AND o.base <= a.base AND len([1 for j in range(1, len(a.slopes) + 1) if o.slopes[j] > a.slopes[j]]) = 0 AND (o.base <> a.base OR o.slopes <> a.slopes OR o.cut < a.cut))"""

SQL: dict[str, str] = {
    "family_words": f"WITH RECURSIVE {_FAMILY_WORDS} SELECT id, m, k, CAST(cut AS INTEGER) AS cut, word, CAST(base AS BIGINT) AS base, array_to_string(slopes, ' ') AS slopes, same_sign, CASE WHEN bad THEN 'INVALID_OUTPUT' ELSE 'PRICED' END AS status FROM f",
    "family_frontier": _FAMILY_FRONTIER,
    "p1_tables": _P1_TABLES,
    "p1_found": _P1, "p4_found": _P4, "stream_tally": "SELECT event, status, count(*) AS lines FROM (SELECT DISTINCT log_id, event, status FROM run_log) GROUP BY event, status", **archive.SQL, **graphs.SQL, **wordplans.SQL, **rollupplans.SQL, **liftplans.SQL, **searchplans.SQL, **sinkplans.SQL, **certplans.SQL, **moreplans.SQL}
