"""Searches over states as sets: literal layers from any start with parents, and beams of many starts at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbita.functions import expressions
from orbita.functions import states as S
from orbita.functions.runtime import cut, free
from orbita.operators.distance import Incomplete

UNDO = {"L": "R", "R": "L", "X": "X"}


def literal_moves(v: Column) -> list[tuple[str, Column]]:
    """Moves of a state written as text, one character a cell."""
    n = F.length(v)
    return [("L", F.concat(F.substring(v, F.lit(2), n - 1), F.left(v, F.lit(1)))), ("R", F.concat(F.right(v, F.lit(1)), F.left(v, n - 1))), ("X", F.concat(F.substring(v, 2, 1), F.left(v, F.lit(1)), F.substring(v, F.lit(3), n)))]


def marked_moves(key: Column, n: int) -> list[tuple[str, Column]]:
    """Moves of a marked state ``u|j``: the state without the mark as text, and the mark's cell."""
    parts = F.split(key, r"\|")
    u, j = F.element_at(parts, 1), F.element_at(parts, 2).cast("int")
    (_, left), (_, right), (_, swap) = literal_moves(u)
    put = lambda w, k: F.concat(w, F.lit("|"), k.cast("string"))
    return [
        ("L", F.when(j == 0, put(u, F.lit(n - 1))).otherwise(put(left, j - 1))), ("R", F.when(j == n - 1, put(u, F.lit(0))).otherwise(put(right, j + 1))),
        ("X", F.when(j < 2, put(u, 1 - j)).otherwise(put(swap, j))),
    ]


def layered(starts: DataFrame, moves: Callable[[Column], list[tuple[str, Column]]], max_states: int = 1_000_000, max_depth: int = 254) -> DataFrame:
    """``key, d, parent, letter`` of all keys reached from ``starts`` (column ``key``) in at most ``max_depth`` letters; of several ways
    to a key that of the smallest letter, then parent, is kept. Raises :class:`Incomplete` beyond ``max_states``.

    Nothing is assumed of the moves: each layer is tested against all keys reached before."""
    now = cut(starts.select("key", F.lit(0).alias("d"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("letter")).dropDuplicates(["key"]))
    done, total, d = now, now.count(), 0
    while d < max_depth:
        ways = F.array(*[F.struct(q.alias("key"), F.lit(x).alias("letter")) for x, q in moves(F.col("key"))])
        near = now.select(F.col("key").alias("parent"), F.explode(ways).alias("s")).groupBy("s.key").agg(F.min(F.struct("s.letter", "parent")).alias("w"))
        now = cut(near.join(done.select("key"), "key", "left_anti").select("key", F.lit(d + 1).alias("d"), "w.parent", "w.letter"))
        fresh = now.count()
        if not fresh:
            break
        total, d = total + fresh, d + 1
        if total > max_states:
            raise Incomplete(f"more than {max_states} states")
        done = done.unionByName(now)
    return done


def paths(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, word`` from a start to each of ``keys``: parents followed back, all keys a letter together."""
    now = cut(keys.select("key", F.col("key").alias("at"), F.lit("").alias("word")).join(table.select(F.col("key").alias("at"), "d", "parent", "letter"), "at"))
    for _ in range(now.agg(F.max("d")).first()[0] or 0):
        up = table.select(F.col("key").alias("parent"), F.col("parent").alias("next"), F.col("letter").alias("before"))
        moved = now.where("parent IS NOT NULL").join(up, "parent").select("key", F.col("parent").alias("at"), F.concat("letter", "word").alias("word"), "d", F.col("next").alias("parent"), F.col("before").alias("letter"))
        older, now = now, cut(now.where("parent IS NULL").unionByName(moved.select(*now.columns)))
        free(older)
    return now.select("key", "word")


def beam_search(starts: DataFrame, expression, m: int, r: int, width: int, max_expansions: int = 3000, max_rounds: int = 400) -> DataFrame:
    """``start, outcome, length, expansions`` of a beam search from each of ``starts`` (column ``p``).

    A round makes the moves L, R, X of each state of the beam in its order; what was made before counts once, for its first
    maker. The root ends the search (``solved``); after more than ``max_expansions`` other states it ends with ``expansion cap``, without
    a new state with ``beam exhausted``. The next beam are the ``width`` new states of least value, equal ones in the order they were
    made. What can't be evaluated ends it with ``eval error: ...``. All starts take a round together; a start's beam is at most
    ``3 width`` rows, its states made before at most ``max_expansions``.
    """
    n, root = m + r, S.root_key(m, r)
    solved = starts.where(F.col("p") == root).select(F.col("p").alias("start"), F.lit("solved").alias("outcome"), F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("expansions"))
    beam = cut(starts.where(F.col("p") != root).dropDuplicates(["p"]).select(F.col("p").alias("start"), "p", F.lit(1).alias("place"), F.lit(0).cast("bigint").alias("made")))
    seen, results = beam.select("start", "p"), [solved]
    for k in range(1, max_rounds + 1):
        ways = F.array(*[q for _, q in S.moves(F.col("p"), n)])
        made = beam.select("start", "made", "place", F.posexplode(ways).alias("letter", "p")).groupBy("start", "p").agg(F.min(F.col("place") * 3 + F.col("letter")).alias("order"), F.first("made").alias("made"))
        fresh = made.join(seen, ["start", "p"], "left_anti")
        fresh = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("order")))
        value = expressions.node(expression, F.col("v"), m, r)
        fresh = cut(fresh.withColumn("v", S.cells(F.col("p"), n)).select("start", "p", "order", "made", "rank", value.value.alias("value"), value.error.alias("error")))
        per = fresh.groupBy("start").agg(F.max("rank").alias("n"), F.min(F.when(F.col("p") == root, F.col("rank"))).alias("at"), F.first("made").alias("made"), F.min(F.when(F.col("error").isNotNull(), F.struct("rank", "error"))).alias("bad"))
        per = beam.select("start", F.col("made").alias("had")).distinct().join(per, "start", "left")
        room = F.lit(max_expansions) - F.col("had")
        capped = F.when(F.col("n") - F.col("at").isNotNull().cast("int") > room, room + 1)  # the rank that is one too many
        first = F.least(F.coalesce("at", F.lit(1 << 30)), F.coalesce(capped, F.lit(1 << 30)), F.coalesce("bad.rank", F.lit(1 << 30)))
        outcome = (
            F.when(F.col("n").isNull(), "beam exhausted").when(first == (1 << 30), None).when(F.col("at") == first, "solved").when(capped == first, "expansion cap")
            .otherwise(F.concat(F.lit("eval error: "), F.col("bad.error")))
        )
        ended = cut(per.select("start", outcome.alias("outcome"), F.when(F.col("at") == first, k).alias("length"), (F.col("had") + F.coalesce(F.when(first < (1 << 30), F.when(F.col("at") == first, first - 1).otherwise(first)), F.col("n"), F.lit(0))).cast("bigint").alias("expansions")))
        results.append(ended.where("outcome IS NOT NULL"))
        going = ended.where("outcome IS NULL").select("start", F.col("expansions").alias("total"))
        seen = seen.unionByName(fresh.select("start", "p"))
        place = F.row_number().over(Window.partitionBy("start").orderBy("value", "rank"))
        beam = cut(fresh.join(going, "start").withColumn("place", place).where(F.col("place") <= width).select("start", "p", "place", F.col("total").alias("made")))
        if beam.isEmpty():
            break
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out


# Search bounded by patterns: labels above a limit are taken for zeros, which gives a smaller graph whose distances never exceed the true ones.

def pattern(p: Column, n: int, labels: int) -> Column:
    """Key of a state with all labels above ``labels`` taken for zeros."""
    return F.aggregate(F.reverse(S.cells(p, n)), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 4).bitwiseOR(F.when(x > labels, 0).otherwise(x).cast("bigint")))


def inconsistent(table: DataFrame, n: int) -> int:
    """Edges of a pattern table (``p, d``) along which its values differ by more than 1: must be none for it to prune exactly."""
    near = table.select("d", F.explode(F.array(*[q for _, q in S.moves(F.col("p"), n)])).alias("q"))
    return near.join(table.select(F.col("p").alias("q"), F.col("d").alias("e")), "q").where(F.abs(F.col("d") - F.col("e")) > 1).count()


def bounded_search(asked: DataFrame, patterns: DataFrame, m: int, r: int, labels: int, max_states: int = 10_000_000) -> DataFrame:
    """``start, bound, status, length, states`` for rows ``start, bound`` (a state and K): ``FOUND`` with the length of a shortest word if
    that is below K, else ``PROVED``: no shorter word than K letters exists. ``INCOMPLETE`` is raised as :class:`Incomplete` beyond
    ``max_states``, never taken for a proof.

    A state at g letters from the start is kept only while g plus its pattern's distance (``patterns``: ``p, d`` of the graph with
    ``labels`` labels) is below K, so exactly these states are made; ``states`` is their number. All searches go a letter a round
    together, and as moves are undone by moves, what is new is only tested against the last two rounds."""
    n, root = m + r, S.root_key(m, r)
    h = patterns.select(F.col("p").alias("key"), F.col("d").alias("h"))
    first = asked.select("start", "bound", F.col("start").alias("p")).withColumn("key", pattern(F.col("p"), n, labels)).join(h, "key").where(F.col("h") < F.col("bound")).select("start", "bound", "p")
    before, now, parts, g, total = None, cut(first), [], 0, 0
    while True:
        size = now.count()
        total += size
        if total > max_states:
            raise Incomplete(f"more than {max_states} states")
        parts.append(now.withColumn("g", F.lit(g)))
        if not size:
            break
        g += 1
        near = now.select("start", "bound", F.explode(F.array(*[q for _, q in S.moves(F.col("p"), n)])).alias("p")).distinct()
        for old in (now, before):
            near = near if old is None else near.join(old, ["start", "bound", "p"], "left_anti")
        kept = near.withColumn("key", pattern(F.col("p"), n, labels)).join(h, "key").where(F.col("h") + g < F.col("bound")).select("start", "bound", "p")
        before, now = now, cut(kept)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    found = out.groupBy("start", "bound").agg(F.min(F.when(F.col("p") == root, F.col("g"))).alias("length"), F.count("*").alias("states"))
    both = asked.join(found, ["start", "bound"], "left")
    return both.select("start", "bound", F.when(F.col("length").isNotNull(), "FOUND").otherwise("PROVED").alias("status"), "length", F.coalesce("states", F.lit(0)).alias("states"))


def all_words(table: DataFrame, asked: DataFrame, m: int, r: int, slack: int = 0) -> DataFrame:
    """``start, word``: every word of the asked states (column ``p``) that sorts them and is at most ``slack`` letters longer than a shortest one.
    All go a letter a round together; what can't be sorted any more with the letters left, by the distance table (``p, d``), is dropped."""
    n = m + r
    now = cut(asked.select(F.col("p").alias("start"), "p", F.lit("").alias("word")).join(table, "p").withColumn("left", F.col("d") + slack))
    found, rounds = now.where("d = 0").select("start", "word"), now.agg(F.max("left")).first()[0] or 0
    for _ in range(rounds):
        ways = now.where("left > 0").select("start", "word", (F.col("left") - 1).alias("left"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), q.alias("q")) for x, q in S.moves(F.col("p"), n)])).alias("s"))
        now = cut(ways.select("start", F.concat("word", "s.x").alias("word"), "left", F.col("s.q").alias("p")).join(table, "p").where("d <= left").select("start", "p", "word", "d", "left"))
        found = found.unionByName(now.where("d = 0").select("start", "word"))
    return found


def tree_leaves(trees: DataFrame, axes: int) -> DataFrame:
    """``id, leaf, low, high`` of certificate trees (``id, tree``: JSON of ``{"j", "t", "le", "ge"}`` splits and anything else as leaves): the box of
    each leaf, from 0 and without an end (null) at first; left of a split the axis ends at t, right it begins at t + 1. The boxes of
    a tree cover all of it and no two meet. A split outside its box fails the query. ``leaf`` is the path of splits, l and r."""
    schema = "j int, t int, le string, ge string"
    start = F.array_repeat(F.lit(0), axes), F.array_repeat(F.lit(None).cast("int"), axes)
    now, done = cut(trees.select("id", F.lit("").alias("leaf"), F.col("tree").alias("node"), start[0].alias("low"), start[1].alias("high"))), []
    put = lambda xs, j, value: F.transform(xs, lambda x, i: F.when(i == j, value).otherwise(x))
    while True:
        read = now.withColumn("s", F.from_json("node", schema))
        split = F.coalesce(F.col("s.j").isNotNull() & F.col("s.t").isNotNull() & F.col("s.le").isNotNull(), F.lit(False))
        done.append(read.where(~split).select("id", "leaf", "low", "high"))
        lo, hi = F.element_at("low", F.col("s.j") + 1), F.element_at("high", F.col("s.j") + 1)
        fits = (lo <= F.col("s.t")) & F.coalesce(F.col("s.t") + 1 <= hi, F.lit(True))
        own = read.where(split).withColumn("ok", F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("split outside its box in "), F.col("id"))).cast("boolean"))).where("ok")
        left = own.select("id", F.concat("leaf", F.lit("l")).alias("leaf"), F.col("s.le").alias("node"), "low", put(F.col("high"), F.col("s.j"), F.col("s.t")).alias("high"))
        right = own.select("id", F.concat("leaf", F.lit("r")).alias("leaf"), F.col("s.ge").alias("node"), put(F.col("low"), F.col("s.j"), F.col("s.t") + 1).alias("low"), "high")
        now = cut(left.unionByName(right))
        if now.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


# Sorting on a fixed chart: the ring is cut open once, the cursor walks around it, and only neighbours that fall are swapped.

def around(a: Column, b: Column, n: int) -> Column:
    return F.least(F.abs(a - b), n - F.abs(a - b))


def chart_costs(spark, n: int) -> DataFrame:
    """``q, end, cost`` of all orders of n ranks (text, one digit each): ``cost[u]`` is the least number of letters that sorts them, swapping only
    neighbours that fall, from cursor u to cursor ``end``. Orders of k inversions come from those of k - 1, one join each."""
    ends = spark.range(n).select(F.col("id").cast("int").alias("end"))
    start = F.array(*[around(F.lit(u), F.col("end"), n) for u in range(n)])
    now = cut(ends.select(F.lit("".join(map(str, range(n)))).alias("q"), "end", start.alias("cost")))
    done = [now]
    for _ in range(n * (n - 1) // 2):
        at = lambda i: F.substring("q", i + 1, 1)
        ways = F.array(*[F.when(at(e) < at(e + 1), F.struct(F.concat(F.substring("q", 1, e), at(e + 1), at(e), F.substring("q", e + 3, n)).alias("q"), F.lit(e).alias("edge"), (F.element_at("cost", e + 1) + 1).alias("rest"))) for e in range(n - 1)])
        up = now.select("end", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("s")).select("end", "s.*")
        best = up.groupBy("q", "end").agg(F.array(*[F.min(around(F.lit(u), F.col("edge"), n) + F.col("rest")) for u in range(n)]).alias("cost"))
        now = cut(best)
        done.append(now)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
