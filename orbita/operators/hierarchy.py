"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles.

Levels are reached from the roots by frontier joins whose stride doubles: in round ``i`` every node
not yet reached knows its ancestor ``2^i`` levels up and the ids between, and all nodes of the levels ``2^i`` to
``2^(i+1) - 1`` are reached by one equi-join, which gives them root, depth and path at once; the others learn from the
same join their ancestor ``2^(i+1)`` levels up. So a lineage of depth d takes log2(d) + 2 joins instead of d. A round
that reaches nobody proves that no deeper level exists; whatever is left then never ends, i.e. lies on or below a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbita.functions.runtime import cut, free


def _linked(df: DataFrame, id_col: str, parent_col: str, run_col: str) -> DataFrame:
    """``id, up, run``: one row per id; ``up`` is null where the parent is null or not there."""
    nodes = (
        df.select(df[id_col].alias("id"), F.struct(df[parent_col].isNull().alias("none"), df[parent_col].alias("p"), df[run_col].alias("r")).alias("s"))
        .where(F.col("id").isNotNull()).groupBy("id").agg(F.min("s").alias("s")).select("id", F.col("s.p").alias("p"), F.col("s.r").alias("run"))
    )
    there = nodes.select(F.col("id").alias("up"))
    # Rows without a parent need no look-up; as null keys they would all meet in one task.
    none = nodes.where("p IS NULL").select("id", F.col("p").alias("up"), "run")
    return nodes.where("p IS NOT NULL").join(there, F.col("p") == F.col("up"), "left").select("id", "up", "run").unionByName(none)


def _climb(linked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``id, root, run, depth, path`` (an array of ids) of the nodes of trees; ``id, ptr`` of those that never end, where
    ``ptr`` is an ancestor some levels up, the same number for all; None if there are none of these."""
    top = F.col("up").isNull()
    done = linked.where(top).select("id", F.col("id").alias("root"), "run", F.lit(0).alias("depth"), F.array("id").alias("path"))
    waiting = linked.where(~top).select("id", F.col("up").alias("ptr"), F.array("id").alias("path"))
    kind, stride = linked.schema["id"].dataType, 1
    while True:
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        above = done.select(F.col("id").alias("ptr"), "root", "run", "depth", F.col("path").alias("above"), none("next", kind))
        above = above.unionByName(waiting.select(F.col("id").alias("ptr"), none("root", kind), none("run", linked.schema["run"].dataType), none("depth", "int"), F.col("path").alias("above"), F.col("ptr").alias("next")))
        # Every pointer names a node, so the inner join loses none. No side is broadcast: their sizes grow with the table.
        met = cut(waiting.join(above.hint("merge"), "ptr").select("id", F.col("next").alias("ptr"), "root", "run", (F.col("depth") + stride).alias("depth"), F.concat("above", "path").alias("path")))
        left, all_met = met.agg(F.count("ptr"), F.count("*")).first()
        done = _narrow(done.unionByName(met.where("ptr IS NULL").select("id", "root", "run", "depth", "path")))
        waiting = met.where("ptr IS NOT NULL").select("id", "ptr", "path")
        if not left or left == all_met:
            return done, waiting.select("id", "ptr") if left else None
        stride *= 2


def _narrow(df: DataFrame) -> DataFrame:
    """A union of many small tables in no more tasks than a shuffle has."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _on_cycle(endless: DataFrame) -> DataFrame:
    """``id`` of the nodes that are among their own ancestors.

    The nodes reached after k steps from any endless node only get fewer as k doubles; once their
    number stays, every one of them lies on a cycle, and all nodes of cycles are among them.
    """
    jump, older, before = endless, None, -1
    while True:
        image = jump.agg(F.count_distinct("ptr")).first()[0]
        if image == before:
            return jump.select(F.col("ptr").alias("id")).distinct()
        before = image
        further = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        older, jump = (jump if jump is not endless else None), cut(jump.join(further.hint("merge"), "ptr").select("id", F.col("next").alias("ptr")))
        free(older)


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", run_col: str = "run_id") -> DataFrame:
    """One row per id: ``id, state, root_id, root_run_id, depth, path, descendants``.

    ``state`` is ``tree``, ``cycle`` (the node is among its own ancestors) or ``below_cycle``. A node
    whose parent is null or not there is a root, of depth 0. ``path`` holds the ids from the root to
    the node joined by ``/``; ``descendants`` counts all nodes below. Nodes that never reach a root
    have root_id, depth and descendants -1 and root_run_id and path ''.

    Rows with a null id are left out, for nothing can refer to them. Of rows that repeat an id the
    one with the smallest non-null parent (then run) counts. A null run of a root stays null. Other columns
    are not read. An empty table gives an empty result. Descendants come from ancestor pairs, added
    up map-side, so a root above a third of all rows is no hot key.
    """
    linked = cut(_linked(df, id_col, parent_col, run_col))
    tree, endless = _climb(linked)
    kind = linked.schema["id"].dataType
    below = tree.where("depth > 0").select(F.explode(F.slice("path", F.lit(1), F.col("depth"))).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("descendants"))
    out = tree.join(below, "id", "left").select(
        "id", F.lit("tree").alias("state"), F.col("root").alias("root_id"), F.col("run").alias("root_run_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        F.coalesce("descendants", F.lit(0)).alias("descendants"),
    )
    if endless is None:
        return out
    on = _on_cycle(endless).select("id", F.lit(True).alias("on"))
    minus = F.lit(-1)
    never = endless.select("id").join(on, "id", "left").select(
        "id", F.when(F.col("on"), "cycle").otherwise("below_cycle").alias("state"), minus.cast(kind).alias("root_id"), F.lit("").alias("root_run_id"), minus.alias("depth"), F.lit("").alias("path"), minus.alias("descendants")
    )
    return out.unionByName(never)
