"""Drawing documents to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbita.functions.runtime import cut

#: Sizes within a factor of 2^(1/16) lie together, in so many strata; running sums are taken inside
#: one, so none of them holds a large source.
BUCKETS = 1024


def draw_mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draws documents so that each source gives its target share of all tokens.

    ``targets`` has ``source, target_share, max_repeats``. Returns two tables: the documents drawn
    (``doc_id, source, n_tokens, copies``; those drawn at least once) and, for each listed source, ``source,
    target_share, wanted_share, max_repeats, documents, available_tokens, expected_copies, drawn_documents,
    drawn_copies, drawn_tokens, reached_share``.

    Every document of a source is expected equally often: (wanted share x total) / tokens of the
    source, at most ``max_repeats``. Documents lie in order of size class; their expected copies
    are summed up over the source's strata, one random offset of the source is added, and a document
    is drawn once for each whole number its stretch of the sum crosses, so never more than
    ``max_repeats`` times. Wanted shares are the target shares of the sources that have tokens,
    scaled to 1. Without ``total`` it is the largest at which no source would need more than
    ``max_repeats``, so that all shares are reached; with a larger one the caps bind and
    ``reached_share`` tells what came out.

    Documents of null or unlisted sources, of null ids, and without tokens are not drawn. Listed sources without
    documents are reported with 0. A null or negative target_share counts as 0, a null max_repeats as
    1. Rows that repeat an id are documents of their own. A source listed twice counts once, with its
    largest share. Empty tables give an empty drawing.
    """
    rows = cut(
        docs.where(docs[id_col].isNotNull() & docs[source_col].isNotNull() & (docs[size_col] > 0))
        .select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), docs[size_col].cast("bigint").alias("n_tokens"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.floor(16 * F.log2("n_tokens")) * BUCKETS + F.pmod("h", F.lit(BUCKETS)))
    )
    plan = targets.groupBy("source").agg(
        F.greatest(F.lit(0.0), F.coalesce(F.max("target_share"), F.lit(0.0))).alias("target_share"), F.greatest(F.lit(0), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("max_repeats")
    ).where(F.col("source").isNotNull())
    strata = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    have = strata.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    known = plan.join(have, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    weight = F.when(usable, F.col("target_share")).otherwise(0.0)
    whole = known.agg(F.sum(weight).alias("all_shares"))
    known = known.crossJoin(whole).withColumn("wanted", F.when(usable, F.col("target_share") / F.col("all_shares")).otherwise(0.0))
    reach = known.agg(F.min(F.when(F.col("wanted") > 0, F.col("max_repeats") * F.col("tokens") / F.col("wanted"))).alias("reach"))
    known = cut(
        known.crossJoin(reach).withColumn("total", F.lit(float(total)) if total is not None else F.coalesce("reach", F.lit(0.0)))
        .withColumn("expected", F.when(F.col("wanted") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") * F.col("total") / F.col("tokens"))).otherwise(0.0))
        .select("source", "target_share", "max_repeats", "tokens", "n", "wanted", "expected")
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = strata.join(known.select("source", "expected"), "source").select("source", "bucket", "expected", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("n_tokens", "h", "doc_id")
    offset = (F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    numbered = rows.withColumn("place", F.row_number().over(inside)).join(start, ["source", "bucket"])
    upto = lambda k: F.floor(F.col("expected") * (F.col("start") + F.col("place") + k) + offset)
    drawn = (
        numbered.withColumn("copies", (upto(0) - upto(-1)).cast("int")).where(F.col("copies") > 0)
        .select("doc_id", "source", "n_tokens", "copies")
    )
    out = drawn.groupBy("source").agg(F.count("*").alias("drawn_documents"), F.sum("copies").alias("drawn_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    sums = out.agg(F.sum("drawn_tokens").alias("all_drawn"))
    zero = F.lit(0)
    report = (
        known.join(out, "source", "left").crossJoin(sums)
        .select(
            "source", "target_share", F.col("wanted").alias("wanted_share"), "max_repeats", F.col("n").alias("documents"), F.col("tokens").alias("available_tokens"), F.col("expected").alias("expected_copies"),
            F.coalesce("drawn_documents", zero).alias("drawn_documents"), F.coalesce("drawn_copies", zero).alias("drawn_copies"), F.coalesce("drawn_tokens", zero).alias("drawn_tokens"),
            F.coalesce(F.col("drawn_tokens") / F.col("all_drawn"), F.lit(0.0)).alias("reached_share"),
        )
    )
    return drawn, report
