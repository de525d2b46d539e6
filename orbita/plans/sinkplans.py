"""Round trips: what a sink wrote, as its source reads it. Everything is written below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.functions.runtime import remove_at_exit, shared_folder, table
from orbita.operators import distance as D
from orbita.plans.archive import _LINES, _REAL, _lines, _real
from orbita.plans.graphs import _walk
from orbita.sources import files, sinks
from orbita.streaming.lines import growing_log

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _place(spark) -> str:
    path = f"{shared_folder(spark)}/orbita_{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


_GRAPHS = (("12300", 3, 2, 10), ("12000", 2, 3, 8), ("123400", 4, 2, 16))


@query("WITH " + ", ".join(f"r{i} AS (WITH RECURSIVE {_walk(root, depth)} SELECT {m} AS m, {r} AS r, CAST(max(d) AS INTEGER) AS radius, count(*) AS states FROM t)" for i, (root, m, r, depth) in enumerate(_GRAPHS))
       + ", ".join([""] + ["a AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(_GRAPHS))) + ")"]) + " SELECT m, r, radius, states, true AS complete, true AS refused FROM a")
def registry_tables(spark, sf):
    """Tables of all graphs of a registry, built, written beside their digests, refused a second time, read and verified."""
    place = _place(spark)
    rows = [(m, r, "sanity" if m < 4 else "train", True) for _, m, r, _ in _GRAPHS]
    registry = spark.createDataFrame([(1, rows)], "version int, graphs array<struct<m: int, r: int, role: string, table: boolean>>")
    registry.coalesce(1).write.json(f"{place}/registry")
    out = None
    for g in files.read_registry(spark, f"{place}/registry").where("table").orderBy("m", "r").collect():
        path, about = f"{place}/m{g['m']}r{g['r']}", {"m": g["m"], "r": g["r"]}
        table_ = D.distance_table(spark, g["m"], g["r"]).withColumn("code", S.rank(F.col("p"), g["m"], g["r"]))
        sinks.write_verified(table_, path, **about)
        try:
            sinks.write_verified(table_, path, **about)
            refused = False
        except sinks.Refused:
            refused = True
        one = sinks.read_verified(spark, path, **about).agg(F.max("d").alias("radius"), F.count("*").alias("states"))
        one = one.select(F.lit(g["m"]).alias("m"), F.lit(g["r"]).alias("r"), "radius", "states", (F.col("states") == S.states(g["m"], g["r"])).alias("complete"), F.lit(refused).alias("refused"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_LINES} SELECT event, kind, status, count(*) AS lines, count(candidate_id) AS named, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM lines GROUP BY event, kind, status")
def event_files(spark, sf):
    """The log appended as JSON lines in two parts, one folder an event, and read as logs are."""
    place = _place(spark)
    rows = _lines(spark, sf, "event", "candidate_id", "kind", "status", "tokens_in", "score").select("event", F.col("candidate_id").alias("id"), "kind", "status", "tokens_in", _real("score").alias("score"), "log_id")
    for half in (0, 1):
        sinks.append_events(rows.where(F.col("log_id") % 2 == half).drop("log_id"), place)
    read = files.read_events(spark, f"{place}/*/*.json")
    return read.groupBy("event", "kind", "status").agg(F.count("*").alias("lines"), F.count("id").alias("named"), F.sum("tokens_in").alias("tokens_in"))


@query(f"WITH {_LINES} SELECT event, count(*) AS lines FROM lines GROUP BY event")
def growing_file(spark, sf):
    """A log that grows while it is read: complete lines come once, in batches, the torn last line not before it is finished."""
    place = _place(spark)
    rows = _lines(spark, sf, "event").select(F.to_json(F.struct("log_id", "event")).alias("value"))
    rows.coalesce(1).write.text(f"{place}/log")
    path = [f.path for f in spark.read.format("binaryFile").load(f"{place}/log/*.txt").select("path").collect()][0]
    parsed = growing_log(spark, path.removeprefix("file:")).select(F.from_json("line", "log_id bigint, event string").alias("e")).select("e.*")
    out = f"{place}/out"
    query_ = parsed.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", f"{place}/state").start()
    query_.processAllAvailable()
    query_.stop()
    return spark.read.schema("log_id bigint, event string").parquet(out).groupBy("event").agg(F.count("*").alias("lines"))


@query(f"SELECT engine, count(*) AS n, count(score) AS scored, max(score) AS best, max(length(claim_status)) AS longest FROM (SELECT engine, {_REAL} AS score, claim_status FROM candidates) GROUP BY engine")
def result_files(spark, sf):
    """Results as tab-separated files and back."""
    place = _place(spark)
    sinks.write_tsv(table(spark, sf, "candidates").select("id", "engine", _real("score").alias("score"), "claim_status"), place)
    read = sinks.read_tsv(spark, place, "id bigint, engine string, score double, claim_status string")
    return read.groupBy("engine").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.max("score").alias("best"), F.max(F.length("claim_status")).cast("bigint").alias("longest"))


@query("SELECT run_id, engine, best, CAST(row_number() OVER (ORDER BY best DESC NULLS LAST, run_id) AS INTEGER) AS place FROM runs ORDER BY best DESC NULLS LAST, run_id LIMIT 10")
def summary_files(spark, sf):
    """A summary document for each run in a folder of its own, found by a pattern; a folder with a broken one is passed over."""
    place = _place(spark)
    sinks.write_documents(table(spark, sf, "runs").select("run_id", F.col("run_id").alias("run"), "engine", "best"), f"{place}/runs", "run")
    spark.createDataFrame([('{"run_id": "bro',)], "value string").coalesce(1).write.text(f"{place}/runs/run=broken")
    read = sinks.read_documents(spark, f"{place}/runs/*", "run_id string, engine string, best double").where("run_id IS NOT NULL")
    return read.orderBy(F.desc_nulls_last("best"), "run_id").limit(10).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("best"), "run_id")))


_SPLIT = "CASE WHEN json_valid(provenance_json) THEN CASE WHEN json_type(provenance_json) = 'OBJECT' THEN provenance_json ->> '$.split' END END"


@query(f"WITH d AS (SELECT id, run_id FROM (SELECT id, run_id, {_SPLIT} AS split FROM candidates) WHERE split = 'development') SELECT (SELECT count(*) FROM d) AS added, (SELECT count(*) FROM d WHERE id % 20 = 0) AS found, true AS others_refused")
def development_archive(spark, sf):
    """An archive that takes rows of the development split only, added in two parts, and asked for ids."""
    place = _place(spark)
    rows = table(spark, sf, "candidates").select("id", "run_id", "source", F.get_json_object("provenance_json", "$.split").alias("split"))
    own = rows.where("split = 'development'")
    added = sum(sinks.add_to_archive(own.where(F.col("id") % 2 == k), place) for k in (0, 1))
    try:
        sinks.add_to_archive(rows.where("split <> 'development' OR split IS NULL"), place)
        refused = False
    except sinks.Refused:
        refused = True
    found = sinks.from_archive(spark, place, rows.where("id % 20 = 0").select("id"))
    return found.agg(F.count("*").alias("found")).select(F.lit(added).cast("bigint").alias("added"), "found", F.lit(refused).alias("others_refused"))


@query("SELECT 1 AS call, false AS hit, count(*) AS n FROM candidates WHERE source IS NOT NULL UNION ALL SELECT 2, length(source) % 7 <> 0, count(*) FROM candidates WHERE source IS NOT NULL GROUP BY 2")
def result_cache(spark, sf):
    """Evaluations asked for twice: the second time all that were complete come from the cache."""
    place = _place(spark)
    rows = table(spark, sf, "candidates").where("source IS NOT NULL").select("id", "source")
    measure = lambda df: df.withColumns({"result": F.length("source").cast("string"), "complete": F.length("source") % 7 != 0})
    out = None
    for call in (1, 2):
        one = sinks.cached(rows, "source", place, measure).groupBy("hit").agg(F.count("*").alias("n")).select(F.lit(call).alias("call"), "hit", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, CAST(unnest(gaps) AS BIGINT) AS gap FROM families")
def mask_matrices(spark, sf):
    """Masks packed as matrices in NPZ files and read back."""
    rows = table(spark, sf, "families").select("id", F.dense_rank().over(Window.orderBy("id")).alias("row"), F.explode("gaps").alias("col"))
    numbered = rows.select((F.col("row") - 1).cast("bigint").alias("row"), "col", "id")
    back = sinks.npz_entries(sinks.to_npz(numbered, "masks", 32), "content").where("value = 1").select(F.col("row").alias("at"), "col")
    names = numbered.select("row", "id").distinct()
    return back.join(names, F.col("at") == F.col("row")).select("id", F.col("col").alias("gap"))


@query("SELECT id, m, k, budget_unit AS budget FROM families")
def certificate_packages(spark, sf):
    """Records of families as members of ZIP packages, taken out and read."""
    rows = table(spark, sf, "families").select(F.concat(F.lit("records/"), "id", F.lit(".json")).alias("member"), F.to_json(F.struct("id", "m", "k", F.struct(F.col("budget_unit").alias("T")).alias("bound"))).alias("text"))
    back = sinks.zip_members(sinks.to_zip(rows), "content").select(F.from_json("text", "id string, m int, k int, bound struct<T: int>").alias("r"))
    return back.select("r.id", "r.m", "r.k", F.col("r.bound.T").alias("budget"))


@query("SELECT 'rows' AS kind, count(DISTINCT engine) AS n FROM candidates WHERE engine IS NOT NULL UNION ALL SELECT 'bars', count(DISTINCT engine) FROM candidates WHERE engine IS NOT NULL")
def html_report(spark, sf):
    """A page with a table and a chart of the engines."""
    rows = table(spark, sf, "candidates").where("engine IS NOT NULL").groupBy(F.col("engine").alias("label")).agg(F.count("*").cast("double").alias("value"))
    return sinks.write_report(rows, "Candidates by engine", _place(spark))


@query("SELECT id, m, k, true AS accepted FROM families UNION ALL SELECT 'holdout', 0, 0, false UNION ALL SELECT 'twice', 0, 0, false")
def frozen_families(spark, sf):
    """A set of families read as frozen: recomputed from labels and mask, ids unique; a held-out set and one with an id twice are refused."""
    place = _place(spark)
    rows = table(spark, sf, "families").select("id", "m", "labels", "mask", "k", S.budget(F.col("m"), F.col("k")).cast("int").alias("budget_unit"), "slope_bound")
    rows.withColumn("set", F.lit("development")).write.json(f"{place}/dev")
    rows.withColumn("set", F.lit("holdout")).write.json(f"{place}/hold")
    rows.unionByName(rows.limit(1)).withColumn("set", F.lit("development")).write.json(f"{place}/twice")
    good = files.read_families(spark, f"{place}/dev").select("id", "m", "k", F.lit(True).alias("accepted"))
    for name, path in (("holdout", "hold"), ("twice", "twice")):
        try:
            files.read_families(spark, f"{place}/{path}")
            kept = True
        except ValueError:
            kept = False
        good = good.unionByName(spark.createDataFrame([(name, 0, 0, kept)], "id string, m int, k int, accepted boolean"))
    return good


@query(f"WITH RECURSIVE {_walk('123400', 16)} SELECT CAST(d AS SMALLINT) AS d, count(*) AS states, true AS digest_refused FROM t GROUP BY d")
def distance_files_4_2(spark, sf):
    """A table written as a dense file of bytes by rank, read back in blocks; another digest than the file's is refused."""
    place = _place(spark)
    spark.range(1).write.parquet(f"{place}/x")  # the folder
    path = f"{place}/d.bin".removeprefix("file:")
    files.write_distance_file(D.distance_table(spark, 4, 2).select(S.rank(F.col("p"), 4, 2).alias("code"), "d"), path, 4, 2)
    digest_ = files.file_digest(spark, path)
    try:
        files.read_distance_file(spark, path, 4, 2, "0" * 64)
        refused = False
    except ValueError:
        refused = True
    return files.read_distance_file(spark, path, 4, 2, digest_).groupBy("d").agg(F.count("*").alias("states")).withColumn("digest_refused", F.lit(refused))
