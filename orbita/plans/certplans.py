"""Queries over certificates, boxes, literal lifts, quotas and descents."""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

from orbita.functions import expressions
from orbita.functions import states as S
from orbita.functions.runtime import table
from orbita.operators import certificates as C
from orbita.operators import distance as D
from orbita.operators.exactlp import box_mixture, generated, minimum
from orbita.operators.pricing import profile, word_profiles
from orbita.plans.graphs import _features, _walk
from orbita.plans.rollupplans import _PRICES, _fraction

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# A certificate of m = 5 labels with coefficients from one fixed rule; it holds nowhere near everywhere, so repair has work.

M, SCALE = 5, 3
_RULE = {"lambda": "(a * 31 + b * 17) % 29 - 20", "mu": "(a * 13 + q * 7) % 11 - 8", "alpha": "(a * 7 + b * 5 + c * 3 + q * 11) % 13 - 9", "beta": "(a * 3 + b * 11 + c * 5 + q * 7) % 17 - 9", "gamma": "(a * 5 + b * 3 + c * 7 + q * 13) % 11 - 5"}


def _cert(M: int) -> str:
    return f"""i AS (SELECT range AS a FROM range(0, {M})), l AS (SELECT range AS q FROM range(1, {M})), p AS (SELECT x.a, y.a AS b FROM i x, i y WHERE x.a < y.a), tr AS (SELECT p.*, z.a AS c FROM p, i z WHERE z.a > p.b),
  lam AS (SELECT a, b, {_RULE['lambda']} AS v FROM p), mu AS (SELECT a, q, {_RULE['mu']} AS v FROM i, l), al AS (SELECT a, b, c, q, {_RULE['alpha']} AS v FROM tr, l), be AS (SELECT a, b, c, q, {_RULE['beta']} AS v FROM tr, l), ga AS (SELECT a, b, c, q, {_RULE['gamma']} AS v FROM tr, l)"""


def _kappa(a: str, b: str, q: str, M: int = M) -> str:
    return f"(-{M} * (CASE WHEN {q} > {b} THEN 2 * (2 * {a} - {M} + 1) ELSE 0 END + CASE WHEN {q} < {M} - {a} THEN 2 * (2 * {b} - {M} + 1) ELSE 0 END) - 4 * ({M} - 2 * ({b} - {a})) * {q} + CASE WHEN {q} = {b} - {a} THEN {2 * M} ELSE 0 END)"


def _slacks(lam: str, al: str, name: str, M: int = M) -> str:
    return f"""t{name} AS (SELECT al.a, al.b, al.c, -(al.v + be.v + ga.v) AS slack FROM {al} al JOIN be ON (al.a, al.b, al.c) = (be.a, be.b, be.c) AND al.q + be.q <> {M} JOIN ga ON (al.a, al.b, al.c) = (ga.a, ga.b, ga.c) AND ga.q = (al.q + be.q) % {M}),
  p{name} AS (SELECT lam.a, lam.b, l.q, {SCALE} * {_kappa('lam.a', 'lam.b', 'l.q', M)} - (lam.v + x.v + y.v - coalesce((SELECT sum(v) FROM {al} al WHERE al.a = lam.a AND al.b = lam.b AND al.q = l.q), 0) - coalesce((SELECT sum(v) FROM be WHERE be.b = lam.a AND be.c = lam.b AND be.q = l.q), 0) - coalesce((SELECT sum(v) FROM ga WHERE ga.a = lam.a AND ga.c = lam.b AND ga.q = l.q), 0)) AS slack
    FROM {lam} lam, l JOIN mu x ON true JOIN mu y ON true WHERE x.a = lam.a AND x.q = l.q AND y.a = lam.b AND y.q = {M} - l.q)"""


def _summary(kind: str, t: str) -> str:
    return f"SELECT '{kind}' AS kind, count(*) AS checks, count(*) FILTER (WHERE slack < 0) AS violations, CAST(min(slack) AS BIGINT) AS worst, CAST(coalesce(sum(-slack) FILTER (WHERE slack < 0), 0) AS BIGINT) AS shortfall FROM {t}"


def _certificate(spark, M: int = M):
    rows = None
    span = spark.range(M).select(F.col("id").alias("a"))
    b, c = (span.select(F.col("a").alias(x)) for x in "bc")
    pairs = span.join(b, F.col("a") < F.col("b"))
    parts = {"lambda": pairs.select("a", "b", F.lit(None).cast("bigint").alias("c")), "mu": span.select("a", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("c"))}
    triples = pairs.join(c, F.col("b") < F.col("c"))
    for kind, rule in _RULE.items():
        own = parts.get(kind, triples)
        own = own.withColumn("q", F.lit(None).cast("bigint") if kind == "lambda" else F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(M - 1).cast("bigint"))))
        one = own.select(F.lit(kind).alias("kind"), "a", "b", "c", "q", F.expr(rule).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"WITH {_cert(M)}, {_slacks('lam', 'al', '1')} {_summary('triple', 't1')} UNION ALL {_summary('pair', 'p1')}")
def certificate_check_5(spark, sf):
    """Every condition of a certificate: how many, how many fail, by how much."""
    return C.check(_certificate(spark), M, SCALE)


@query(f"""WITH {_cert(M)}, {_slacks('lam', 'al', '1')}, dv AS (SELECT a, b, c, greatest(0, -min(slack)) AS d FROM t1 GROUP BY a, b, c), al2 AS (SELECT al.a, al.b, al.c, q, v - d AS v FROM al JOIN dv ON (al.a, al.b, al.c) = (dv.a, dv.b, dv.c)),
  {_slacks('lam', 'al2', '2')}, dp AS (SELECT a, b, greatest(0, -min(slack)) AS d FROM p2 GROUP BY a, b), lam2 AS (SELECT lam.a, lam.b, v - d AS v FROM lam JOIN dp ON (lam.a, lam.b) = (dp.a, dp.b)), {_slacks('lam2', 'al2', '3')}, j AS (SELECT -(SELECT sum(v) FROM lam2) - (SELECT sum(v) FROM mu) - {4 * 10 * SCALE * M} AS n)
  SELECT s.kind, s.checks, s.violations, {_fraction('CAST(j.n AS HUGEINT)', f'{SCALE * M}::HUGEINT')} AS epsilon FROM (SELECT * FROM ({_summary('triple', 't3')}) UNION ALL SELECT * FROM ({_summary('pair', 'p3')})) s, j""")
def certificate_repair_5(spark, sf):
    """The certificate repaired: no condition fails any more; what it then proves."""
    fixed = C.repaired(_certificate(spark), M, SCALE)
    return C.check(fixed, M, SCALE).select("kind", "checks", "violations", F.lit(str(C.epsilon(fixed, M, SCALE))).alias("epsilon"))


# One block of zeros: boxes, and what one more word gains.

def _priced(spark, sf):
    rows = table(spark, sf, "families").where("k = 1").withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rows.select("id", "m", F.expr(_PRICES.split(" AS base, ")[0]).alias("base"), F.expr(_PRICES.split(" AS base, ")[1].split(" AS slope")[0]).alias("slope"), "cut")


def _per_family(rows, out: str, make):
    """Exact programs a family: its words come together (at most six here), ``make`` gives the rest of the row."""
    grouped = rows.groupBy("id", "m").agg(F.sort_array(F.collect_list(F.struct("cut", "base", "slope"))).alias("w"))
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for batch in batches:
            made = [make(m, w) for m, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[i] for x in made], pa.string()) for i in range(len(names))]], names=["id", *names])

    return grouped.mapInArrow(run, f"id string, {out}")


_WORDS = f"w AS (SELECT id, m, m - 2 AS s, cut, 4 AS width, {_PRICES} FROM (SELECT *, unnest(range(0, 6)) AS cut FROM families WHERE k = 1))"
_CORNERS = """SELECT id, s, cut AS hi, base::BIGINT AS bn, slope::BIGINT AS sn, 1::BIGINT AS d FROM w UNION ALL SELECT a.id, a.s, greatest(a.cut, b.cut), a.base * (b.slope - a.s) + b.base * (a.s - a.slope), a.s * (b.slope - a.slope), b.slope - a.slope FROM w a JOIN w b ON a.id = b.id AND a.slope < a.s AND b.slope > a.s"""


@query(f"""WITH {_WORDS}, c AS ({_CORNERS}), o AS (SELECT id, arg_min({{'n': bn + 4 * greatest(0, sn - s * d), 'd': d}}, (bn + 4 * greatest(0, sn - s * d)) / d) AS b FROM c GROUP BY id), u AS (SELECT id, arg_min({{'n': bn, 'd': d}}, bn / d) AS b FROM c WHERE sn <= s * d GROUP BY id)
  SELECT o.id, {_fraction('o.b.n', 'o.b.d')} AS bounded, {_fraction('u.b.n', 'u.b.d')} AS unbounded FROM o LEFT JOIN u ON u.id = o.id""")
def one_block_boxes(spark, sf):
    """Least base over a box of width 4, where slope above the bound is paid for, and over one without an end."""
    def make(m, w):
        bases, slopes = [x["base"] for x in w], [[x["slope"]] for x in w]
        best = [box_mixture(bases, slopes, [width], m - 2) for width in (4, None)]
        return [b and str(b.value) for b in best]

    return _per_family(_priced(spark, sf), "bounded string, unbounded string", make)


@query(f"""WITH {_WORDS}, c AS ({_CORNERS}), a AS (SELECT id, arg_min({{'n': bn, 'd': d}}, bn / d) AS b FROM c WHERE sn <= s * d GROUP BY id), p AS (SELECT id, arg_min({{'n': bn, 'd': d}}, bn / d) AS b FROM c WHERE sn <= s * d AND hi < 5 GROUP BY id)
  SELECT a.id, {_fraction('p.b.n', 'p.b.d')} AS pool, {_fraction('a.b.n', 'a.b.d')} AS with_word, {_fraction('(p.b.n * a.b.d - a.b.n * p.b.d)', '(p.b.d * a.b.d)')} AS gain FROM a LEFT JOIN p ON p.id = a.id""")
def pool_gains(spark, sf):
    """What the last word of each family adds to the pool of the others: the exact fall of the least base."""
    def make(m, w):
        best = [minimum([x["base"] for x in ws], [[x["slope"] for x in ws]], [m - 2]) for ws in (w[:-1], w)]
        gain = str(Fraction(best[0].value - best[1].value)) if all(best) else None
        return [*[b and str(b.value) for b in best], gain]

    return _per_family(_priced(spark, sf), "pool string, with_word string, gain string", make).where("with_word IS NOT NULL")


@query("""SELECT id, CAST(cut AS INTEGER) AS cut, CAST(z AS INTEGER) AS z, true AS sorts, true AS within FROM (SELECT id, unnest(range(0, len(unit_base))) AS cut FROM families WHERE unit_base IS NOT NULL AND m <= 7) f, (SELECT unnest([0, 1, 3]) AS z) x""")
def literal_lifts(spark, sf):
    """Words of families run letter by letter on states whose zeros are stretched, by as much as their place plus z says."""
    rows = word_profiles(table(spark, sf, "families").where("m <= 7")).where("status = 'PRICED'").join(table(spark, sf, "families").select("id", "unit_base"), "id")
    rows = rows.select("id", "cut", "word", "unit_base", "m", "base", "slopes", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("z"))

    def run(batches):
        for batch in batches:
            lifted, stretched, bound = [], [], []
            for word, state, base, slopes, z in zip(*(batch.column(c).to_pylist() for c in (2, 3, 5, 6, 7))):
                own = [z + j % 2 for j in range(len(slopes))]
                lifted.append(profile(state, word).word(own))
                j, cells = 0, []
                for x in state:
                    cells += [x] if x else [0] * (1 + own[j])
                    j += x == 0
                stretched.append(cells)
                bound.append(base + sum(a * b for a, b in zip(slopes, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(7), batch.column(4), pa.array(lifted, pa.string()), pa.array(stretched, pa.list_(pa.int32())), pa.array(bound, pa.int64())], names=["id", "cut", "z", "m", "lifted", "cells", "bound"])

    ran = rows.mapInArrow(run, "id string, cut int, z int, m int, lifted string, cells array<int>, bound bigint")
    goal = F.concat(F.sequence(F.lit(1), F.col("m")), F.array_repeat(F.lit(0), F.size("cells") - F.col("m")))
    return ran.select("id", "cut", "z", (S.replay(F.col("cells"), F.col("lifted")) == goal).alias("sorts"), (F.length("lifted") <= F.col("bound")).alias("within"))


@query("""WITH o AS (SELECT DISTINCT m, array_to_string(labels, '.') AS o FROM families), k AS (SELECT DISTINCT m, mask FROM families), f AS (SELECT DISTINCT m, array_to_string(labels, '.') AS o, mask FROM families)
  SELECT o.m, count(*) AS combinations, count(f.mask) AS listed, count(*) FILTER (WHERE f.mask IS NULL AND EXISTS (SELECT 1 FROM f g WHERE g.m = o.m AND g.o = o.o AND (g.mask & k.mask) = k.mask)) AS below_listed FROM o JOIN k ON k.m = o.m LEFT JOIN f ON f.m = o.m AND f.o = o.o AND f.mask = k.mask GROUP BY o.m""")
def order_mask_cover(spark, sf):
    """All label orders of an m with all masks of it: how many are families of the list, how many lie below one (a reference list that does not grow)."""
    f = table(spark, sf, "families").select("m", F.array_join(F.col("labels").cast("array<string>"), ".").alias("o"), "mask").distinct()
    both = f.select("m", "o").distinct().join(f.select("m", "mask").distinct(), "m")
    above = f.select("m", "o", F.col("mask").alias("big"))
    met = both.join(above, ["m", "o"]).groupBy("m", "o", "mask").agg(F.max(F.col("big") == F.col("mask")).alias("listed"), F.max(F.col("big").bitwiseAND(F.col("mask")) == F.col("mask")).alias("below"))
    count = lambda c: F.count(F.when(c, 1))
    return met.groupBy("m").agg(F.count("*").alias("combinations"), count(F.col("listed")).alias("listed"), count(~F.col("listed") & F.col("below")).alias("below_listed"))


_LITERAL = r"\b(m|n|k|len\([^)]*\)|max\([^)]*\))\s*(==|!=|<=|>=|<|>)\s*(9|10|11|12)\b"


@query(f"""WITH s AS (SELECT id, string_split(regexp_replace(source, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS l FROM candidates WHERE source IS NOT NULL), x AS (SELECT id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM s)
  SELECT id, count(*) AS lines, CAST(min(i) AS INTEGER) AS first_line FROM x WHERE regexp_matches(line, '{_LITERAL}') GROUP BY id""")
def size_literals(spark, sf):
    """Sources that compare a size with a number from 9 to 12, in how many lines, and the first of them."""
    lines = F.split(F.regexp_replace("source", "\r\n|\r", "\n"), "\n")
    rows = table(spark, sf, "candidates").where("source IS NOT NULL").select("id", F.posexplode(lines).alias("i", "line"))
    return rows.where(F.col("line").rlike(_LITERAL)).groupBy("id").agg(F.count("*").alias("lines"), (F.min("i") + 1).alias("first_line"))


# Why a potential does not fall.

_PHI = ["add", "inv", "disp_max"]


@query(f"""WITH RECURSIVE {_walk('123400', 16)}, {_features(4, 2)}, e AS (SELECT v, d, inv + disp_max AS x FROM f), o AS (SELECT v, d, x, unnest(['L', 'R', 'X']) AS c, unnest([v[2:6] || v[1:1], v[6:6] || v[1:5], v[2:2] || v[1:1] || v[3:6]]) AS u FROM e WHERE v <> '123400'),
  j AS (SELECT o.v, o.d, o.x, o.c, e.x AS y, e.d AS nd FROM o JOIN e ON e.v = o.u), k AS (SELECT v, min(y) AS low, any_value(x) AS x, string_agg(c, '/' ORDER BY c) FILTER (WHERE nd = d - 1) AS geo, min(y - x) FILTER (WHERE nd = d - 1) AS step FROM j GROUP BY v)
  SELECT 'geodesic ' || geo || '; phi change along it ' || CASE WHEN step >= 0 THEN '+' ELSE '' END || step AS class, count(*) AS states FROM k WHERE low > x - 1 GROUP BY 1 ORDER BY states DESC, class LIMIT 6""")
def descent_classes_4_2(spark, sf):
    """States where a potential does not fall to any neighbour, by the letters of shortest words and what the best of these changes."""
    t = D.distance_table(spark, 4, 2)
    valued = expressions.evaluate(t.withColumn("v", S.cells(F.col("p"), 6)), _PHI, 4, 2).select("p", "d", F.col("value").alias("x"))
    near = valued.where(F.col("p") != S.root_key(4, 2)).select("p", "d", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q.alias("u")) for c, q in S.moves(F.col("p"), 6)])).alias("s")).select("p", "d", "x", "s.*")
    met = near.join(valued.select(F.col("p").alias("u"), F.col("d").alias("nd"), F.col("x").alias("y")), "u")
    good = F.col("nd") == F.col("d") - 1
    each = met.groupBy("p", "x").agg(F.min("y").alias("low"), F.array_join(F.sort_array(F.collect_list(F.when(good, F.col("c")))), "/").alias("geo"), F.min(F.when(good, F.col("y") - F.col("x"))).alias("step"))
    name = F.concat(F.lit("geodesic "), "geo", F.lit("; phi change along it "), F.when(F.col("step") >= 0, "+").otherwise(""), F.col("step").cast("string"))
    return each.where(F.col("low") > F.col("x") - 1).groupBy(name.alias("class")).agg(F.count("*").alias("states")).orderBy(F.desc("states"), "class").limit(6)


# Samples of layers by quota.

def waterfill(total: int, caps: list[int]) -> list[int]:
    """Shares as equal as the caps allow; what can't be shared out evenly goes to the last ones with room, one each."""
    low, high = 0, max(caps, default=0)
    while low < high:
        middle = (low + high + 1) // 2
        if sum(min(c, middle) for c in caps) <= total:
            low = middle
        else:
            high = middle - 1
    out = [min(c, low) for c in caps]
    left = total - sum(out)
    for i in reversed(range(len(caps))):
        if left > 0 and caps[i] > out[i]:
            out[i], left = out[i] + 1, left - 1
    return out


@query(f"""WITH RECURSIVE {_walk('1234500', 20)}, c AS (SELECT CAST(d AS INTEGER) AS d, count(*) AS cap FROM t WHERE d > 0 GROUP BY d), l AS (SELECT max(level) AS level FROM (SELECT level, sum(least(cap, level)) AS s FROM c, range(0, 400) x(level) GROUP BY level) WHERE s <= 700),
  q AS (SELECT d, cap, least(cap, level) AS q, level, row_number() OVER (PARTITION BY cap > level ORDER BY d DESC) AS place FROM c, l), z AS (SELECT 700 - sum(q) AS left_over FROM q) SELECT d, cap, q + CASE WHEN cap > level AND place <= left_over THEN 1 ELSE 0 END AS quota, 0 AS in_both FROM q, z""")
def layer_quotas_5_2(spark, sf):
    """700 states shared out over the layers; two disjoint samples of that size are drawn where a layer has enough for both."""
    t = D.distance_table(spark, 5, 2).where("d > 0")
    sizes = sorted((r["d"], r["n"]) for r in t.groupBy("d").agg(F.count("*").alias("n")).collect())  # a row a layer
    quota = spark.createDataFrame([(d, n, q) for (d, n), q in zip(sizes, waterfill(700, [n for _, n in sizes]))], "d int, cap bigint, quota bigint")
    from orbita.plans.archive import running

    ranked = running(t.withColumn("code", S.rank(F.col("p"), 5, 2)), ["d"], F.floor(F.col("code") / 4096), ["code"], F.lit(1), "i", agg=F.sum).join(F.broadcast(quota), "d")
    first, second = ranked.where(F.col("i") < F.col("quota")), ranked.where((F.col("i") >= F.col("quota")) & (F.col("i") < 2 * F.col("quota")))
    both = first.select("code").intersect(second.select("code")).agg(F.count("*").cast("int").alias("in_both"))
    return quota.crossJoin(both)


@query(f"""WITH RECURSIVE {_walk('1230', 10)}, e AS (SELECT b.v, b.d, b.u, b.x FROM (SELECT v, d, unnest([v[2:4] || v[1:1], v[4:4] || v[1:3], v[2:2] || v[1:1] || v[3:4]]) AS u, unnest(['L', 'R', 'X']) AS x FROM t) b JOIN t c ON c.v = b.u AND c.d = b.d - 1),
  g(v, d, word) AS (SELECT '1230', 0, '' UNION ALL SELECT q.v, q.d, q.word FROM (SELECT e.v, e.d, e.x || g.word AS word, row_number() OVER (PARTITION BY e.v ORDER BY e.x) AS k FROM g JOIN e ON e.u = g.v AND e.d = g.d + 1) q WHERE q.k = 1),
  h(v, j, word, spot, at_j, len) AS (SELECT v, j, word, 0, j, 0 FROM g, range(0, 5) x(j) UNION SELECT * FROM (
    SELECT v, j, word, spot, unnest(CASE WHEN at_j = 0 THEN [4, 1] WHEN at_j = 1 THEN [0] WHEN at_j = 4 THEN [0] ELSE [] END) AS at_j, len + 1 FROM h WHERE len < 30
    UNION ALL SELECT v, j, word, spot + 1, CASE word[spot + 1:spot + 1] WHEN 'L' THEN at_j - 1 WHEN 'R' THEN at_j + 1 ELSE at_j END, len + 1 FROM h WHERE spot < length(word) AND len < 30 AND CASE word[spot + 1:spot + 1] WHEN 'L' THEN at_j > 0 WHEN 'R' THEN at_j < 4 ELSE at_j > 1 END))
  SELECT g.v AS u, CAST(x.j AS INTEGER) AS j, g.word, (SELECT CAST(min(len) AS INTEGER) FROM h WHERE h.v = g.v AND h.j = x.j AND spot = length(h.word) AND at_j >= 3) AS length FROM g, range(0, 5) x(j)""")
def fixed_word_lifts_3_2(spark, sf):
    """The shortest word of each smaller state lifted as it is: how few letters more carry a marked zero from each cell to the end, null
    where no way does. One fold over the letters from the last; the mark's cell is the place in the array."""
    n, m, inf = 5, 3, F.lit(1 << 20)
    free = lambda c: F.transform(c, lambda x, j: F.least(inf, F.when(j == 0, F.least(x, c[1] + 1, c[n - 1] + 1)).when(j == 1, F.least(x, c[0] + 1, c[n - 1] + 2)).when(j == n - 1, F.least(x, c[0] + 1, c[1] + 2)).otherwise(x)))

    def step(c, letter):
        after = F.transform(c, lambda _, j: F.when((letter == "L") & (j > 0), F.element_at(c, F.greatest(j, F.lit(1)))).when((letter == "R") & (j < n - 1), F.element_at(c, F.least(j + 2, F.lit(n)))).when((letter == "X") & (j > 1), F.element_at(c, j + 1)).otherwise(inf) + 1)
        return F.element_at(F.transform(F.array(after), free), 1)

    ends = F.array(*[F.lit(0) if j >= m else inf for j in range(n)])
    back = F.reverse(F.filter(F.split("word", ""), lambda x: x != ""))
    rows = D.distance_table(spark, 3, 1, words=True).select(F.concat_ws("", S.cells(F.col("p"), 4)).alias("u"), "word", F.element_at(F.transform(F.array(ends), free), 1).alias("ends"))
    costs = F.aggregate(back, F.col("ends"), step)
    return rows.select("u", "word", F.posexplode(costs).alias("j", "length")).select("u", "j", "word", F.when(F.col("length") < (1 << 20), F.col("length")).alias("length"))


_SIZES = (3, 4, 6)
_ROLL = " UNION ALL ".join(f"""SELECT {m} AS m, * FROM (WITH {_cert(m)}, {_slacks('lam', 'al', '1', m)}, a AS (SELECT slack FROM t1 UNION ALL SELECT slack FROM p1) SELECT count(*) AS checks, count(*) FILTER (WHERE slack < 0) AS violations, CAST(coalesce(sum(-slack) FILTER (WHERE slack < 0), 0) AS BIGINT) AS shortfall FROM a)""" for m in _SIZES)


@query(f"WITH r AS ({_ROLL}) SELECT m, checks, violations, shortfall, checks AS expected, CASE WHEN violations = 0 THEN 'PASS' ELSE 'INVALID' END AS status FROM r")
def certificate_rollup(spark, sf):
    """Certificates of several sizes: all conditions that have to be tested, what fails and by how much, and the verdict."""
    out = None
    for m in _SIZES:
        one = C.check(_certificate(spark, m), m, SCALE).agg(F.sum("checks").alias("checks"), F.sum("violations").alias("violations"), F.sum("shortfall").alias("shortfall"))
        one = one.select(F.lit(m).alias("m"), "checks", "violations", "shortfall", F.lit(C.expected_checks(m)).cast("bigint").alias("expected"), F.when(F.col("violations") == 0, "PASS").otherwise("INVALID").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_WORDS}, c AS ({_CORNERS}), u AS (SELECT id, arg_min({{'n': bn, 'd': d}}, bn / d) AS b FROM c WHERE sn <= s * d GROUP BY id) SELECT id, {_fraction('u.b.n', 'u.b.d')} AS objective, 'true' AS within_pool FROM u""")
def generated_mixtures(spark, sf):
    """The least base over all words of a family from a pool that starts with the flattest one and takes in what the prices ask for."""
    def make(m, w):
        words = [(x["base"], [x["slope"]]) for x in w]
        flat = min(words, key=lambda x: (x[1], x[0]))
        if flat[1][0] > m - 2:
            return [None, None]
        cheapest = lambda duals: min(words, key=lambda x: x[0] + duals[0] * x[1][0])
        best, pool, rounds = generated([flat], m - 2, cheapest)
        return [str(best.value), str(rounds <= len(words) and len(pool) == rounds).lower()]

    return _per_family(_priced(spark, sf), "objective string, within_pool string", make).where("objective IS NOT NULL")
