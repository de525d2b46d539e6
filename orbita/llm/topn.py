"""The N best items of every group, by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbita.functions.runtime import cut

#: Places over which the rows of a group are spread to meet their bound.
SALTS = 8


def _best_of_partition(n: int, groups: list[str]):
    """Keeps, over all batches of a partition, the n best rows of each group, with their local rank.

    A group never holds more than n rows between batches, however many rows it has or how equal
    their scores are.
    """
    order = [(g, "ascending") for g in groups] + [("score", "descending"), ("id", "ascending")]

    def best(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order))
        size = table.num_rows
        fresh = None
        for g in groups:
            column = table.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = column.indices
            change = pc.not_equal(codes.slice(1), codes.slice(0, size - 1))
            fresh = change if fresh is None else pc.or_(fresh, change)
        import numpy as np

        start = np.zeros(size, np.int64)
        if size > 1:
            start[1:] = np.where(fresh.to_numpy(zero_copy_only=False), np.arange(1, size), 0)
        rank = np.arange(size) - np.maximum.accumulate(start) + 1
        table = table.append_column("local_rank", pa.array(rank.astype(np.int32)))
        return table.filter(pa.array(rank <= n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        fresh: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            fresh.append(batch)
            rows += batch.num_rows
            if rows >= max(100_000, held.num_rows if held is not None else 0):
                held, fresh, rows = best(_join(held, fresh)), [], 0
        if fresh and (rows or held is None):
            together = _join(held, fresh)
            if not together.num_rows:
                return
            held = best(together)
        if held is not None:
            yield from held.to_batches(max_chunksize=50_000)

    def _join(held: pa.Table | None, fresh: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(fresh)
        return table if held is None else pa.concat_tables([held.drop_columns(["local_rank"]), table])

    return run


def top_n(df: DataFrame, groups: list[str], score: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group: the group columns, ``rank_no`` (int, from 1) and ``id``.

    Higher score first, equal scores by smaller id. Rows whose score is null or NaN are not ranked;
    minus infinity is, and -0.0 equals 0.0. Null is a group value like any other. Groups with fewer
    rows give what they have; rows that repeat an id are ranked one after the other. Group columns
    keep their names; other columns are not read. Empty tables give an empty result.

    Every partition keeps its n best rows of each group. Its n-th best is a lower bound of the
    group's n-th best. The highest bound of each group comes from the n-th rows alone, a small table: where
    Spark finds it small enough it is broadcast and rows below their bound never leave their task, else the rows
    meet their bounds spread over SALTS places a group. Only what is left is shuffled by group, after each task
    kept its n best again. So a group of any size sends at most n rows from each of SALTS places or from each
    partition that has n rows above the bound of all others.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    rows = (
        df.select(*[df[g].alias(k) for g, k in zip(groups, keys)], (df[score].cast("double") + F.lit(0.0)).alias("score"), df[id_col].alias("id"))
        .where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("id").isNotNull())
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("local_rank", T.IntegerType())])
    local = cut(rows.mapInArrow(_best_of_partition(n, keys), schema))
    # A bound needs the order of (score, id): the n-th best row of the partition, best = largest.
    at_n = F.struct("score", (-F.col("id")).alias("minus_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    bounds = local.where(F.col("local_rank") == n).groupBy(*keys).agg(F.max(at_n).alias("bound")).select(*[F.col(k).alias(f"b_{k}") for k in keys], "bound", salts.alias("b_salt"))
    same = F.col("salt") == F.col("b_salt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    above = F.col("bound").isNull() | (at_n >= F.col("bound"))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "local_rank")
    left = local.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(bounds, same, "left").where(above).select(*keys, "score", "id", "local_rank")
    return (
        left.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= n)
        .select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "rank_no", "id")
    )
