"""Complete distance tables by layered search, and budgeted lifting over marked states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import states as S
from orbita.functions.runtime import cut, free

#: More states than this are refused before any work.
MAX_STATES = 5_000_000_000


class Incomplete(Exception):
    """A resource limit was met; never a result."""


#: Rows one round of the search may make of its frontier, and letters it may go at most.
ROUND_ROWS, ROUND_LETTERS = 2_000_000, 10


def distance_table(spark: SparkSession, m: int, r: int, words: bool = False, max_states: int = MAX_STATES) -> DataFrame:
    """``p, d`` of all states reachable from the root, with ``words`` also ``n_shortest`` (how many
    shortest words there are) and ``word`` (the shortest one whose letters are smallest, L < R < X).

    A round goes k letters on from the frontier, the last layer known: all words of up to k letters in which no letter
    undoes the one before, which doubles the rows with each letter. A state's least length is kept (removed map-side
    before the one shuffle of the round), and what lies in the last k layers already is no new state; farther back no
    word of k letters leads, for moves are undone by moves. So no round joins the table of all visited states. Small
    frontiers go many letters a round (ROUND_ROWS), large ones one. Raises :class:`Incomplete` beyond ``max_states``.
    """
    S.check_graph(m, r)
    if S.states(m, r) > max_states:
        raise Incomplete(f"{S.states(m, r)} states, more than {max_states}")
    if words:
        return _table_with_words(spark, m, r)
    n, d, width = m + r, 0, 1
    done = [(0, cut(spark.range(1).select(F.lit(S.root_key(m, r)).alias("p"), F.lit(0).alias("d"))))]
    while True:
        k = max(1, min(ROUND_LETTERS, (ROUND_ROWS // (3 * width)).bit_length() - 1))
        # The last letter's number (1 L, 2 R, 3 X), 4 before the first, 0 for words that end here; what undoes it has 2, 1, 3.
        near = done[-1][1].where(F.col("d") == d).select("p", F.lit(0).alias("len"), F.lit(4).alias("last"))
        for _ in range(k):
            ways = near.select("len", "last", F.posexplode(F.array("p", *[q for _, q in S.moves(F.col("p"), n)])).alias("letter", "p"))
            go = (F.col("last") > 0) & ~((F.col("last") + F.col("letter") == 3) | ((F.col("last") == 3) & (F.col("letter") == 3)))
            near = ways.where((F.col("letter") == 0) | go).select("p", (F.col("len") + F.least(F.col("letter"), F.lit(1))).alias("len"), F.col("letter").alias("last"))
        fresh = near.where("len > 0").groupBy("p").agg(F.min("len").alias("len"))
        for far, table in done:
            if far >= d - k:
                fresh = fresh.join(table.select("p"), "p", "left_anti")
        table = cut(fresh.select("p", (F.lit(d) + F.col("len")).alias("d")))
        d += k
        width = table.where(F.col("d") == d).count()
        done.append((d, table))
        if not width:
            break
    out = done[0][1]
    for _, table in done[1:]:
        out = out.unionByName(table)
    return out


def _table_with_words(spark: SparkSession, m: int, r: int) -> DataFrame:
    """Layer by layer: a new layer is what is in neither of the last two."""
    n = m + r
    now = cut(spark.range(1).select(F.lit(S.root_key(m, r)).alias("p"), F.lit(1).cast("bigint").alias("n_shortest"), F.lit("").alias("word")))
    before, done, d = None, [], 0
    undo = {"L": "R", "R": "L", "X": "X"}
    while True:
        done.append(now.withColumn("d", F.lit(d)))
        # Reached from u by a letter, a state gets back to u by the letter's inverse.
        ways = [F.struct(q.alias("q"), F.lit(undo[x]).alias("x")) for x, q in S.moves(F.col("p"), n)]
        near = now.select("n_shortest", "word", F.explode(F.array(*ways)).alias("s")).select(F.col("s.q").alias("p"), "n_shortest", F.struct(F.col("s.x").alias("x"), "word").alias("w"))
        fresh = near.groupBy("p").agg(F.sum("n_shortest").alias("n_shortest"), F.min("w").alias("w")).select("p", "n_shortest", F.concat("w.x", "w.word").alias("word"))
        old = now.select("p") if before is None else now.select("p").unionByName(before.select("p"))
        fresh = cut(fresh.join(old, "p", "left_anti"))
        if fresh.isEmpty():
            break
        before, now, d = now, fresh, d + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def layer_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("d").agg(F.count("*").alias("states"))


def spread_sample(ranked: DataFrame, d: int, k: int, size: int) -> DataFrame:
    """At most k codes of distance d: the first at or after each of k evenly spaced anchors, the
    first of all where there is none. ``ranked`` has ``code, d``.

    Every code finds its anchor by arithmetic, so this is one aggregation: the least code of each
    stretch between anchors, then over at most k rows the next stretch that has one."""
    from pyspark.sql import Window

    at = ranked.where(F.col("d") == d)
    # Anchor i is floor(i size / k); a code lies in the stretch of the last anchor that is not above it.
    least = at.select("code", F.call_function("div", (F.col("code") + 1) * k - 1, F.lit(size)).cast("int").alias("i")).groupBy("i").agg(F.min("code").alias("code"))
    anchors = at.sparkSession.range(k).select(F.col("id").cast("int").alias("i"))
    up = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    hit = anchors.join(least, "i", "left").select(F.min("code").over(up).alias("code"))
    first = at.agg(F.min("code").alias("first"))
    return hit.crossJoin(F.broadcast(first)).select(F.coalesce("code", "first").alias("code")).where("code IS NOT NULL").distinct().withColumn("d", F.lit(d))


INF = 1 << 20


def lifted_layers(spark: SparkSession, m: int, r: int, q: int) -> list[DataFrame]:
    """For each cap 0..q a table ``u, h``: ``h[j]`` is the least length of a word that sorts state u of (m, r - 1) with a marked
    zero put in at cell j, while at most so many letters do anything but carry the mark around; INF where there is none, and no
    row where there is none for any j. Shorter than q + 1 tables if from the last on nothing changes any more.

    The mark's place is the index of an array kept with the smaller state, so a letter more is one shuffle of the smaller
    table. It begins with the root alone; in each round only states whose array changed send it to the three states from
    which a letter leads to them. Moves that only carry the mark are free and closed within the array.
    """
    S.check_graph(m, r)
    if r < 1:
        raise ValueError("there is no zero to delete")
    n, k = m + r, m + r - 1
    inf = F.lit(INF)

    def closed(h):
        """Cells 0 and n-1 are one letter apart, so are 0 and 1."""
        a, b, z = F.element_at(h, 1), F.element_at(h, 2), F.element_at(h, n)
        first, second, last = F.least(a, b + 1, z + 1), F.least(b, a + 1, z + 2), F.least(z, a + 1, b + 2)
        return F.transform(h, lambda x, j: F.least(inf, F.when(j == 0, first).when(j == 1, second).when(j == n - 1, last).otherwise(x)))

    ends = F.array(*[F.lit(0) if j >= m else inf for j in range(n)])
    now = cut(spark.range(1).select(F.lit(S.root_key(m, r - 1)).alias("u"), ends.alias("h")).select("u", closed(F.col("h")).alias("h"), F.lit(True).alias("changed")))
    layers = [now]
    for _ in range(q):
        u, h = F.col("u"), F.transform("h", lambda x: F.least(x + 1, inf))
        # A state reached by L from its R-neighbour: there the mark stood one cell further, and so on.
        sent = F.array(
            F.struct(S.move_right(u, k).alias("u"), F.concat(F.array(inf), F.slice(h, 1, n - 1)).alias("h")), F.struct(S.move_left(u, k).alias("u"), F.concat(F.slice(h, 2, n - 1), F.array(inf)).alias("h")),
            F.struct(S.move_swap(u).alias("u"), F.transform(h, lambda x, j: F.when(j < 2, inf).otherwise(x)).alias("h")),
        )
        told = now.where("changed").select(F.explode(sent).alias("s")).select("s.u", *[F.element_at("s.h", j + 1).alias(f"h{j}") for j in range(n)], F.lit(None).cast("array<int>").alias("old"))
        own = now.select("u", *[F.element_at("h", j + 1).alias(f"h{j}") for j in range(n)], F.col("h").alias("old"))
        met = told.unionByName(own).groupBy("u").agg(*[F.min(f"h{j}").alias(f"h{j}") for j in range(n)], F.max("old").alias("old"))
        new = met.select("u", closed(F.array(*[f"h{j}" for j in range(n)])).alias("h"), "old").where(F.array_min("h") < INF)
        now = cut(new.select("u", "h", (F.col("old").isNull() | (F.col("old") != F.col("h"))).alias("changed")))
        if not now.where("changed").limit(1).count():
            break
        layers.append(now)
    return [x.select("u", "h") for x in layers]


def of_cap(layers: list[DataFrame], q: int) -> DataFrame:
    return layers[min(q, len(layers) - 1)]


def minima(layer: DataFrame, n: int) -> DataFrame:
    """``p, a``: the least entry over the marks of each visible state a layer reaches."""
    places = F.array(*[F.struct(_insert_zero(F.col("u"), j).alias("p"), F.element_at("h", j + 1).alias("a")) for j in range(n)])
    return layer.select(F.explode(places).alias("s")).where(F.col("s.a") < INF).groupBy("s.p").agg(F.min("s.a").alias("a"))


def all_states(spark: SparkSession, m: int, r: int) -> DataFrame:
    return spark.range(S.states(m, r)).select(S.unrank(F.col("id"), m, r).alias("p"))


def lifted_minima(spark: SparkSession, m: int, r: int, q: int) -> DataFrame:
    """``p, a`` of every state of (m, r): the least length of a word that sorts it while the word's
    projection, with the best one of the zeros deleted, takes at most q letters; null if there is none."""
    return all_states(spark, m, r).join(minima(of_cap(lifted_layers(spark, m, r, q), q), m + r), "p", "left").select("p", "a")


def h_table(layers: list[DataFrame], q: int) -> DataFrame:
    """``u, j, q, h`` of all caps up to q; entries without a word are left out."""
    out = None
    for k in range(q + 1):
        one = of_cap(layers, k).select("u", F.posexplode("h").alias("j", "h"), F.lit(k).alias("q")).where(F.col("h") < INF)
        out = one if out is None else out.unionByName(one)
    return out.select("u", "j", "q", "h")


def excess_table(spark: SparkSession, m: int, r: int, e: int) -> DataFrame:
    """``u, j, e, f``: the least length when the projection may take e letters more than the smaller state's distance."""
    smaller = distance_table(spark, m, r - 1)
    far = smaller.agg(F.max("d")).first()[0]
    h = h_table(lifted_layers(spark, m, r, far + e), far + e)
    asked = smaller.select(F.col("p").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(e))).alias("e"), "d").withColumn("q", F.col("d") + F.col("e"))
    return asked.join(h, ["u", "q"]).select("u", "j", "e", F.col("h").alias("f"))


def sweep(spark: SparkSession, m: int, r: int, caps: range) -> DataFrame:
    """For each cap ``q, lifted, over_budget, equal_distance, max_a``: states with a word, those whose least one is longer than
    the budget, those where it is a shortest word; all caps from one run of layers."""
    layers, n, t = lifted_layers(spark, m, r, max(caps)), m + r, S.budget(m, r)
    table = distance_table(spark, m, r)
    out = None
    for q in caps:
        one = minima(of_cap(layers, q), n).withColumn("q", F.lit(q))
        out = one if out is None else out.unionByName(one)
    both = out.join(table, "p")
    return both.groupBy("q").agg(F.count("*").alias("lifted"), F.count(F.when(F.col("a") > t, 1)).alias("over_budget"), F.count(F.when(F.col("a") == F.col("d"), 1)).alias("equal_distance"), F.max("a").alias("max_a"))


def slack_profile(spark: SparkSession, m: int, r: int, extra: int) -> DataFrame:
    """``e, projection, states``: for words at most e letters longer than the distance, the fewest letters the projection can
    take, over all states."""
    table = distance_table(spark, m, r)
    most = table.agg(F.max("d")).first()[0] + extra
    layers, out = lifted_layers(spark, m, r, most), None
    for q in range(len(layers)):
        one = minima(layers[q], m + r).withColumn("q", F.lit(q))
        out = one if out is None else out.unionByName(one)
    both = out.join(table, "p").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(extra)))).where(F.col("a") <= F.col("d") + F.col("e"))
    return both.groupBy("p", "e").agg(F.min("q").alias("projection")).groupBy("e", "projection").agg(F.count("*").alias("states"))


def witnesses(spark: SparkSession, asked: DataFrame, layers: list[DataFrame], m: int, r: int, q: int) -> DataFrame:
    """Adds ``word`` to ``asked`` (``u, j``): a shortest word of the marked state whose projection keeps the cap q; the first
    letter of L, R, X that leads to a state one letter nearer is taken. States without a word are left out.

    All states take a step together: one join with the layers a letter."""
    n, k = m + r, m + r - 1
    h = cut(h_table(layers, q))
    now = cut(asked.select("u", "j", F.col("u").alias("x"), F.col("j").alias("y"), F.lit(q).alias("q"), F.lit("").alias("word")).join(h.select(F.col("u").alias("x"), F.col("j").alias("y"), "q", F.col("h").alias("left")), ["x", "y", "q"]))
    steps = now.agg(F.max("left")).first()[0] or 0
    x, y = F.col("x"), F.col("y")
    moves = F.array(
        F.struct(F.lit("L").alias("letter"), F.when(y == 0, x).otherwise(S.move_left(x, k)).alias("x"), F.when(y == 0, n - 1).otherwise(y - 1).alias("y")),
        F.struct(F.lit("R").alias("letter"), F.when(y == n - 1, x).otherwise(S.move_right(x, k)).alias("x"), F.when(y == n - 1, 0).otherwise(y + 1).alias("y")),
        F.struct(F.lit("X").alias("letter"), F.when(y < 2, x).otherwise(S.move_swap(x)).alias("x"), F.when(y < 2, 1 - y).otherwise(y).alias("y")),
    )
    for _ in range(steps):
        ways = now.where("left > 0").select("u", "j", "word", "left", "q", "x", F.explode(moves).alias("s"))
        ways = ways.select("u", "j", F.concat("word", "s.letter").alias("word"), F.col("s.x").alias("nx"), F.col("s.y").alias("ny"), (F.col("q") - (F.col("s.x") != F.col("x")).cast("int")).alias("nq"), (F.col("left") - 1).alias("left"))
        met = ways.join(h.select(F.col("u").alias("nx"), F.col("j").alias("ny"), F.col("q").alias("nq"), F.col("h").alias("left")), ["nx", "ny", "nq", "left"])
        best = met.groupBy("u", "j").agg(F.min(F.struct("word", "nx", "ny", "nq", "left")).alias("b")).select("u", "j", F.col("b.nx").alias("x"), F.col("b.ny").alias("y"), F.col("b.nq").alias("q"), "b.word", "b.left")
        older, now = now, cut(now.where("left = 0").unionByName(best))
        free(older)
    return now.select("u", "j", "word")


def _insert_zero(u, j: int):
    low = (1 << (4 * j)) - 1
    return u.bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftright(u, 4 * j), 4 * (j + 1)))


def lifting_report(spark: SparkSession, m: int, r: int, q: int | None = None) -> DataFrame:
    """Histogram ``excess, states`` of the lifted minima less the smaller graph's radius (or ``q``), with
    ``equal_distance`` states whose minimum is their true distance and ``below_distance`` states below it
    (which must be none). ``excess`` is null for states without an admissible word."""
    cap = q if q is not None else distance_table(spark, m, r - 1).agg(F.max("d")).first()[0]
    values = lifted_minima(spark, m, r, cap)
    table = distance_table(spark, m, r)
    return (
        table.join(values, "p", "left").groupBy((F.col("a") - cap).alias("excess"))
        .agg(F.count("*").alias("states"), F.count(F.when(F.col("a") == F.col("d"), 1)).alias("equal_distance"), F.count(F.when(F.col("a") < F.col("d"), 1)).alias("below_distance"))
    )
