"""Sinks and the sources that read them back: verified tables, event logs, results, archives, caches, containers."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.runtime import digest


class Refused(ValueError):
    """The target is there already, or what was read is not what was written."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_digest(df: DataFrame) -> DataFrame:
    """One row ``rows, digest``: the number of rows and a sum over their hashes, the same in whatever order and files they lie."""
    key = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(key, at, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(F.sum(part(at)), F.lit(0)).cast("string") for at in (1, 16)]).alias("digest"))


def write_verified(df: DataFrame, path: str, **about) -> DataFrame:
    """Writes a table that is not there yet, with a row beside it that tells its size, digest and what it is ``about``.

    Rows go to a folder of another name first, which takes its own name once all are there: a reader sees all or
    nothing. An existing ``path`` is refused, and so is one that another writer took in the meantime."""
    spark = df.sparkSession
    jvm, target, system = _files(spark, path)
    if system.exists(target):
        raise Refused(f"{path} is there already")
    draft = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(f"{draft}/rows")
    written = spark.read.schema(df.schema).parquet(f"{draft}/rows")
    table_digest(written).withColumn("about", F.lit(json.dumps(about, sort_keys=True))).coalesce(1).write.parquet(f"{draft}/sidecar")
    if system.exists(target) or not system.rename(jvm.org.apache.hadoop.fs.Path(draft), target):
        system.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
        raise Refused(f"{path} was taken")
    return read_verified(spark, path)


def read_verified(spark: SparkSession, path: str, **about) -> DataFrame:
    """Reads what :func:`write_verified` wrote, after its size and digest were found again; what it is ``about`` must match."""
    rows, side = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sidecar").first()
    now = table_digest(rows).first()
    if (now["rows"], now["digest"]) != (side["rows"], side["digest"]):
        raise Refused(f"{path}: not what was written")
    if about and json.loads(side["about"]) != json.loads(json.dumps(about)):
        raise Refused(f"{path} is about {side['about']}")
    return rows


def append_events(df: DataFrame, path: str) -> None:
    """Appends JSON lines, one folder an ``event``; nulls are left out of a line. Files of a task that fails are never seen."""
    df.withColumn("kind_of_event", F.col("event")).write.mode("append").partitionBy("kind_of_event").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("sep", "\t").option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "\\N").option("enforceSchema", False).csv(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """One JSON document a row, in a folder of its own named after ``key``."""
    df.repartition(key).write.mode("error").partitionBy(key).json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of all folders below ``path``; files that hold no JSON object are left out, and counted nowhere."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def add_to_archive(df: DataFrame, path: str) -> int:
    """Adds rows of split ``development`` (column ``split``) to an archive; a row of another split refuses all. The number added."""
    other = df.where(~F.col("split").eqNullSafe(F.lit("development"))).limit(1).count()
    if other:
        raise Refused("only rows of the split development")
    df.write.mode("append").parquet(path)
    return df.count()


def from_archive(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Archive rows of the given ``id``; ids of no row give none."""
    return spark.read.parquet(path).join(ids.select("id"), "id", "left_semi")


def cached(asked: DataFrame, key: str, path: str, compute) -> DataFrame:
    """``asked`` with ``result, hit``: results of earlier calls by the digest of column ``key``, others by ``compute`` (which adds ``result`` and
    ``complete``). Only complete results are kept, each with a checksum that is tested when it is read."""
    spark = asked.sparkSession
    _, target, system = _files(spark, path)
    rows = asked.withColumn("_k", digest(F.col(key)))
    if system.exists(target):
        known = spark.read.parquet(path).where(digest(F.concat_ws("|", F.hex("_k"), "result")) == F.col("check")).dropDuplicates(["_k"]).select("_k", "result")
    else:
        known = spark.createDataFrame([], "_k binary, result string")
    both = rows.join(known, "_k", "left")
    fresh = compute(both.where("result IS NULL").drop("result"))
    store = fresh.where("complete").select("_k", "result", digest(F.concat_ws("|", F.hex("_k"), "result")).alias("check")).dropDuplicates(["_k"])
    hits = both.where("result IS NOT NULL").select(*asked.columns, "result", F.lit(True).alias("hit"))
    out = hits.unionByName(fresh.select(*asked.columns, "result", F.lit(False).alias("hit")))
    kept = f"{path}.{uuid.uuid4().hex}"
    out.write.parquet(kept)
    store.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(kept)


def npz_entries(df: DataFrame, content: str) -> DataFrame:
    """``name, row, col, value`` of the entries that are not 0 of all two-dimensional arrays in NPZ files (binary column ``content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with np.load(io.BytesIO(blob), allow_pickle=False) as held:
                    for name in held.files:
                        row, col = np.nonzero(held[name])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(row), pa.string()), pa.array(row), pa.array(col), pa.array(held[name][row, col].astype(np.int64))], names=["name", "row", "col", "value"])

    return df.select(content).mapInArrow(run, "name string, row bigint, col bigint, value bigint")


def to_npz(df: DataFrame, name: str, width: int) -> DataFrame:
    """One NPZ file (``content``) a partition of ``df`` (``row, col``): a matrix of ``width`` columns with 1 where there is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        rows, cols = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        matrix = np.zeros((int(rows.max()) + 1 if len(rows) else 0, width), np.uint8)
        matrix[rows, cols] = 1
        held = io.BytesIO()
        np.savez_compressed(held, **{name: matrix})
        yield pa.RecordBatch.from_pydict({"content": pa.array([held.getvalue()], pa.binary())})

    return df.select(F.col("row").cast("bigint"), F.col("col").cast("bigint")).mapInArrow(run, "content binary")


def zip_members(df: DataFrame, content: str) -> DataFrame:
    """``member, text`` of all files in ZIP archives (binary column ``content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(blob)) as held:
                    names = held.namelist()
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held.read(n).decode() for n in names], pa.string())], names=["member", "text"])

    return df.select(content).mapInArrow(run, "member string, text string")


def to_zip(df: DataFrame) -> DataFrame:
    """One ZIP archive (``content``) a partition of ``df`` (``member, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
            for batch in batches:
                for member, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.writestr(member, text)
        yield pa.RecordBatch.from_pydict({"content": pa.array([held.getvalue()], pa.binary())})

    return df.select("member", "text").mapInArrow(run, "content binary")


def write_report(df: DataFrame, title: str, path: str) -> DataFrame:
    """An HTML page with a table and a bar chart (SVG) of ``df`` (``label, value``; a report's rows, at most 1,000), written as one file; gives
    back ``kind, n``: how many rows and bars the page has."""
    from html import escape

    rows = df.orderBy("label").limit(1000).collect()
    top = max([abs(r["value"]) for r in rows if r["value"] is not None] or [1]) or 1
    bars = "".join(f'<rect x="0" y="{14 * i}" width="{300 * abs(r["value"] or 0) / top:.1f}" height="12"/>' for i, r in enumerate(rows))
    cells = "".join(f"<tr><td>{escape(str(r['label']))}</td><td>{r['value']}</td></tr>" for r in rows)
    page = f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><h1>{escape(title)}</h1><svg width="320" height="{14 * len(rows)}">{bars}</svg><table>{cells}</table>'
    spark = df.sparkSession
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("error").text(path)
    back = spark.read.option("wholetext", True).text(path).where("value <> ''")
    counted = lambda tag: (F.length("value") - F.length(F.replace("value", F.lit(tag), F.lit("")))) / len(tag)
    pairs = F.array(F.struct(F.lit("rows").alias("kind"), counted("<tr>").cast("bigint").alias("n")), F.struct(F.lit("bars").alias("kind"), counted("<rect").cast("bigint").alias("n")))
    return back.select(F.explode(pairs).alias("x")).select("x.*")
