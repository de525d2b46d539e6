"""The campaign log as a stream: lines counted once however often and late they are delivered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.runtime import remove_at_exit, shared_folder


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a log: those there and those that come. ``path`` is a folder
    of files, or one file."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if target.getFileSystem(hadoop).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def once(lines: DataFrame, delay: str = "4 days") -> DataFrame:
    """Lines of which each ``log_id`` passes once. State of a line is kept for ``delay`` after its
    arrival; the log's promise is that nothing comes again later than three days."""
    return lines.withColumn("arrived", F.col("received_utc").cast("timestamp")).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["log_id"])


def tally(spark: SparkSession, path: str) -> DataFrame:
    """``event, status, lines`` after all that is there now; the stream ends then. Each batch's counts replace the table
    of the batch before in the shared folder; nothing passes through the driver."""
    counts = once(log_stream(spark, path)).groupBy("event", "status").agg(F.count("*").alias("lines"))
    out = f"{shared_folder(spark)}/orbita_{uuid.uuid4().hex}"
    remove_at_exit(spark, out)
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}_state").trigger(availableNow=True).start()
    remove_at_exit(spark, f"{out}_state")
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)
