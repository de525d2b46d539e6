"""Session helpers shared by all operators: tables, sizes, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary folder, if all
    work is done on this machine; else it is an error, for no other machine would see that folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="orbita-"))
    return f"file://{_FALLBACK[0]}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be over
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def _fresh(spark: SparkSession) -> tuple[str, str]:
    name = f"orbita_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    remove_at_exit(spark, path)
    return name, path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there: its lineage ends.

    The files outlive executors, so a lost executor costs only the work after the cut; and the
    plans that follow know the table's size, by which Spark chooses its joins. The table is removed
    by :func:`free`, else when the program ends.
    """
    spark = df.sparkSession
    _, path = _fresh(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbita_path = path
    return out


def cut_in_place(df: DataFrame, key: str) -> DataFrame:
    """As :func:`cut`, with each partition's rows kept together in buckets by ``key``, a column whose values never
    spread over partitions: nothing is shuffled, and a later join on ``key`` shuffles the other side only."""
    spark = df.sparkSession
    name, path = _fresh(spark)
    buckets = min(max(1, df.rdd.getNumPartitions()), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    atexit.register(lambda: _drop(spark, name))
    out = spark.table(name)
    out._orbita_name, out._orbita_buckets = name, buckets
    return out


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def free(*tables: DataFrame | None) -> None:
    """Removes tables :func:`cut` wrote, which no plan still to be run may read. Others are left alone."""
    for df in tables:
        path = getattr(df, "_orbita_path", None)
        if path:
            _remove(df.sparkSession, path)


def digest(c: Column) -> Column:
    """32-byte SHA-256 of a string column; null stays null."""
    return F.unhex(F.sha2(c, 256))
