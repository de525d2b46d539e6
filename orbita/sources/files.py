"""Sources and sinks: event logs, graph registries, dense distance files, tables that are never overwritten."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import states as S

#: Columns of a log's JSON lines; what a line doesn't have is null.
EVENT_SCHEMA = (
    "event string, t double, id bigint, hash string, kind string, mode string, parents array<bigint>, island int, score double, feasible boolean, valid boolean, status string, "
    "cost_usd double, tokens_in bigint, tokens_out bigint, batch int, proposals int, best_score double, best_id bigint, graphs array<struct<graph: string, score: double, failures: int>>"
)


def read_events(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """Lines of one or more JSONL logs with ``run_path``, the file they are from, and ``bad_line``.

    An unreadable last line of a file, which its writer has not finished, is left out. Any other unreadable line
    is never dropped: it fails the query (``unreadable line`` in the message), or with ``keep_bad`` comes as a row of
    nulls with its text in ``bad_line``. Large files are split by lines over tasks.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("run_path"), place.alias("place")).where(F.trim("value") != "")
    parsed = F.from_json("value", EVENT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("run_path", "place", parsed.alias("e")).select("e.*", "run_path", "place").withColumnRenamed("_bad", "bad_line")
    last = lines.groupBy("run_path").agg(F.max("place").alias("place"))
    good = rows.where("bad_line IS NULL").drop("place")
    bad = rows.where("bad_line IS NOT NULL").join(last.withColumn("torn", F.lit(True)), ["run_path", "place"], "left")
    complain = F.raise_error(F.concat(F.lit("unreadable line of "), F.col("run_path"), F.lit(": "), F.substring("bad_line", 1, 200))).cast("boolean")
    whole = F.col("torn").isNull()
    bad = bad.where(whole if keep_bad else F.when(whole, complain).otherwise(False)).select(*good.columns)
    return good.unionByName(bad)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``m, r, role, table`` of each graph of a registry."""
    schema = "version int, graphs array<struct<m: int, r: int, role: string, table: boolean>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("graphs").alias("g")).select("g.*")


FAMILY_SCHEMA = "set string, id string, m int, labels array<int>, mask bigint, k int, budget_unit int, slope_bound int"


def read_families(spark: SparkSession, path: str, allow_holdout: bool = False) -> DataFrame:
    """Families of a frozen set (JSON lines). Refused (ValueError) are held-out sets unless allowed, ids that come twice, labels that
    are no order of 1..m, and any k, budget or slope bound that is not what labels and mask give."""
    rows = spark.read.schema(FAMILY_SCHEMA).option("mode", "FAILFAST").json(path)
    m, k = F.size("labels"), F.bit_count("mask")
    right = (F.sort_array("labels") == F.sequence(F.lit(1), m)) & (m == F.col("m")) & (k == F.col("k")) & (F.col("mask") < F.call_function("shiftleft", F.lit(1).cast("bigint"), m + 1))
    right = right & (S.budget(m, k) == F.col("budget_unit")) & (F.col("slope_bound") == m - 2)
    bad = lambda c: F.count(F.when(c, 1))
    found = rows.agg(bad(F.col("set") == "holdout").alias("holdout"), bad(~F.coalesce(right, F.lit(False))).alias("wrong"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if found["holdout"] and not allow_holdout:
        raise ValueError(f"{path} is held out")
    if found["n"] != found["ids"] or found["wrong"]:
        raise ValueError(f"{path}: {found['n'] - found['ids']} ids repeated, {found['wrong']} families not as recomputed")
    return rows


STATE_SCHEMA = "set string, m int, r int, v array<int>, d int, budget int"


def read_states(spark: SparkSession, path: str, allow_holdout: bool = False) -> DataFrame:
    """States of a frozen set (JSON lines). Refused (ValueError) are held-out sets unless allowed, cells that are not the labels 1..m and r
    zeros, another budget than m and r give, and distances below 0."""
    rows = spark.read.schema(STATE_SCHEMA).option("mode", "FAILFAST").json(path)
    want = F.concat(F.array_repeat(F.lit(0), F.col("r")), F.sequence(F.lit(1), F.col("m")))
    right = (F.sort_array("v") == want) & (S.budget(F.col("m"), F.col("r")) == F.col("budget")) & (F.col("d") >= 0)
    bad = lambda c: F.count(F.when(c, 1))
    found = rows.agg(bad(F.col("set") == "holdout").alias("holdout"), bad(~F.coalesce(right, F.lit(False))).alias("wrong")).first()
    if found["holdout"] and not allow_holdout:
        raise ValueError(f"{path} is held out")
    if found["wrong"]:
        raise ValueError(f"{path}: {found['wrong']} states are not as they should be")
    return rows


#: Bytes of a distance file that are read together.
BLOCK_BYTES = 1 << 20


def _opened(path: str):
    """A file of any file system pyarrow knows, to be read from any place."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(at)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, read in blocks by one task (a digest has to be taken in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            total = hashlib.sha256()
            with _opened(path) as stream:
                while block := stream.read(64 << 20):
                    total.update(block)
            yield pa.RecordBatch.from_pydict({"digest": [total.hexdigest()]})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "digest string").first()[0]


def read_distance_file(spark: SparkSession, path: str, m: int, r: int, sha256: str | None = None) -> DataFrame:
    """``code, d`` of a dense file with one byte a state in order of rank (255: not reached, null).

    Refused are files of the wrong size and, where ``sha256`` is given, of another digest. Tasks read blocks of
    the file, each at its offset, so a file of any size is read by many."""
    size = S.states(m, r)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(hadoop).getFileStatus(target).getLen()
    if there != size:
        raise ValueError(f"{there} bytes for {size} states")
    if sha256 is not None and file_digest(spark, path) != sha256:
        raise ValueError("another digest than the expected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _opened(path) as stream:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    stream.seek(block * BLOCK_BYTES)
                    d = np.frombuffer(stream.read(BLOCK_BYTES), np.uint8)
                    first = block * BLOCK_BYTES
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(d))), pa.array(d.astype(np.int16), mask=d == 255)], names=["code", "d"])

    return spark.range(-(-size // BLOCK_BYTES)).mapInArrow(run, "code bigint, d smallint")


def write_distance_file(ranked: DataFrame, path: str, m: int, r: int) -> int:
    """Writes ``code, d`` as a dense file of one byte a state in order of rank (255: not reached); the number of states written.

    One file has to be written in order, so one task writes it, a block at a time as sorted rows come; a file that is there,
    a table with codes missing or repeated, and distances of 255 and more are refused."""
    size = S.states(m, r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        if system.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{path} is there already")
        done = 0
        with system.open_output_stream(f"{at}.draft") as out:
            for batch in batches:
                code, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                if not np.array_equal(code, np.arange(done, done + len(code))) or (d > 254).any() or (d < -1).any():
                    raise ValueError(f"codes or distances from {done} on are not as they should be")
                out.write(np.where(d < 0, 255, d).astype(np.uint8).tobytes())
                done += len(code)
        if done != size:
            raise ValueError(f"{done} of {size} states")
        system.move(f"{at}.draft", at)
        yield pa.RecordBatch.from_pydict({"n": [done]})

    rows = ranked.select(F.col("code").cast("bigint"), F.coalesce(F.col("d").cast("int"), F.lit(-1))).repartition(1).sortWithinPartitions("code")
    return rows.mapInArrow(run, "n bigint").first()[0]


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes a table that is not there yet (else it is an error) and reads it."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Tab-separated results with a header, never over others."""
    df.write.mode("error").option("sep", "\t").option("header", True).csv(path)
