"""Roll-ups of evaluated cases, with fractions kept exact."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact(df: DataFrame, keys: list[str], gap: str, of: Column | None = None) -> DataFrame:
    """For each group the ``largest`` of the fractions in ``gap`` (texts ``p/q`` or ``p``), and of the rows where ``of`` holds
    (all by default) their number ``gaps``, ``total`` and ``mean``, all as exact texts; null where there is none.

    Numerators are summed by denominator first, so what a group brings together is one row for each denominator it
    has. Null gaps count nowhere; a group of nulls only is kept.
    """
    parts = F.split(gap, "/")
    p, q = F.element_at(parts, 1).cast("decimal(38,0)"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).cast("decimal(38,0)")
    own = F.lit(True) if of is None else F.coalesce(of, F.lit(False))
    by = df.select(*keys, p.alias("_p"), q.alias("_q"), own.alias("_own")).groupBy(*keys, "_q").agg(F.sum(F.when(F.col("_own"), F.col("_p"))).alias("_s"), F.max("_p").alias("_m"), F.count(F.when(F.col("_own"), F.col("_p"))).alias("_n"))
    lists = by.groupBy(*keys).agg(F.collect_list(F.when(F.col("_q").isNotNull(), F.struct("_q", "_s", "_m", "_n"))).alias("x"))
    out = ["largest", "gaps", "total", "mean"]
    schema = T.StructType([*[lists.schema[k] for k in keys], T.StructField("largest", T.StringType()), T.StructField("gaps", T.LongType()), T.StructField("total", T.StringType()), T.StructField("mean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                n = sum(e["_n"] for e in x)
                total = sum((Fraction(int(e["_s"]), int(e["_q"])) for e in x if e["_s"] is not None), Fraction(0)) if n else None
                largest = max((Fraction(int(e["_m"]), int(e["_q"])) for e in x if e["_m"] is not None), default=None)
                rows.append((largest if largest is None else str(largest), n, total if total is None else str(total), None if total is None else str(total / n)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keys, *out])

    return lists.mapInArrow(run, schema)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def certification(rows: DataFrame) -> DataFrame:
    """Per m of cases (``m, k, status, valid, gap``): families, statuses, the exact largest gap ``w`` and mean gap ``g`` of
    valid ones, whether all were valid, and ``per_k``: certified/all of each k in its order."""
    status = lambda s: count_if(F.col("status") == s)
    small = rows.groupBy("m", "k").agg(status("CERTIFICATE").alias("c"), F.count("*").alias("n"))
    per_k = small.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("k", "c", "n"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(e["k"].cast("string"), F.lit(":"), e["c"].cast("string"), F.lit("/"), e["n"].cast("string"))), " ")
    counts = rows.groupBy("m").agg(
        F.count("*").alias("families"), status("CERTIFICATE").alias("certified"), status("BOUNDARY").alias("boundary"), status("NO_CERTIFICATE").alias("no_certificate"),
        status("INVALID_OUTPUT").alias("invalid"), status("INCOMPLETE").alias("incomplete"), count_if(F.col("valid")).alias("valid"),
    )
    gaps = exact(rows, ["m"], "gap", F.col("valid")).select("m", F.col("largest").alias("w"), F.col("mean").alias("g"))
    return counts.join(gaps, "m").join(per_k.select("m", text.alias("per_k")), "m").withColumn("w_complete", F.col("valid") == F.col("families"))


def failing(rows: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The ``n`` worst cases of each group that are not certified: largest gap first, then smaller k, then id; the worst of
    each class comes before the second of any. Adds ``place``."""
    parts = F.split("gap", "/")
    size = F.element_at(parts, 1).cast("decimal(38,0)") / F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).cast("decimal(38,0)")
    bad = rows.where("status <> 'CERTIFICATE'").withColumn("_g", F.coalesce(size.cast("double"), F.lit(0.0)))
    order = [F.desc("_g"), "k", "case_id"]
    ranked = bad.withColumn("_c", F.row_number().over(Window.partitionBy(*groups, "class").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("_c") > 1, *order))
    return ranked.withColumn("place", place).where(F.col("place") <= n).drop("_g", "_c")


def within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (``within, valid`` booleans, ``excess``): states, shares and the mean excess of valid ones for each group."""
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("states"), count_if(F.col("within")).alias("within"), count_if(F.col("valid")).alias("valid"), F.sum(F.when(F.col("valid"), F.col("excess"))).alias("excess_sum")
    )
    return out.withColumns({"within_rate": F.col("within") / F.col("states"), "mean_excess": F.when(F.col("valid") > 0, F.col("excess_sum") / F.col("valid"))})


def instance_score(groups: DataFrame) -> Column:
    """Share within budget, more for a small mean excess, less for what is invalid; of the columns of :func:`within`."""
    middle = F.when(F.col("valid") > 0, 0.25 / (1 + F.col("mean_excess"))).otherwise(0.0)
    return F.col("within_rate") + middle - (F.col("states") - F.col("valid")) / F.col("states")
