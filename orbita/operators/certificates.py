"""Correlation certificates: whole-number coefficients of pairs, labels and triples, checked and repaired as tables.

Long form, one row a coefficient: ``kind, a, b, c, q, value``. Kinds are ``lambda`` (pairs a < b; c and q null), ``mu`` (labels a, with q)
and ``alpha, beta, gamma`` (triples a < b < c, with q); q goes from 1 to m - 1.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kappa(m: int, a: Column, b: Column, q: Column) -> Column:
    """What a pair's coefficients may come to for a shift q, for Q = 1."""
    weight = lambda x: 2 * (2 * x - m + 1)
    ahead = F.when(q > b, weight(a)).otherwise(0) + F.when(q < m - a, weight(b)).otherwise(0)
    return -m * ahead - 4 * (m - 2 * (b - a)) * q + F.when(q == b - a, 2 * m).otherwise(0)


def triple_slacks(cert: DataFrame, m: int) -> DataFrame:
    """``a, b, c, q, s, slack`` of every triple condition: alpha(q) + beta(s) + gamma(q + s) is at most 0."""
    part = lambda kind, q: cert.where(F.col("kind") == kind).select("a", "b", "c", F.col("q").alias(q), F.col("value").alias(kind))
    both = part("alpha", "q").join(part("beta", "s"), ["a", "b", "c"]).where(F.col("q") + F.col("s") != m)
    met = both.withColumn("t", F.pmod(F.col("q") + F.col("s"), F.lit(m))).join(part("gamma", "t"), ["a", "b", "c", "t"])
    return met.select("a", "b", "c", "q", "s", (-(F.col("alpha") + F.col("beta") + F.col("gamma"))).alias("slack"))


def pair_slacks(cert: DataFrame, m: int, scale: int) -> DataFrame:
    """``a, b, q, slack`` of every pair condition. Each triple's coefficient counts against one pair: alpha against its first two
    labels, beta its last two, gamma the outer two; each label's mu counts for all pairs it is in."""
    q = F.explode(F.sequence(F.lit(1), F.lit(m - 1))).alias("q")
    kind = F.col("kind")
    first = F.when(kind == "beta", F.col("b")).otherwise(F.col("a"))
    second = F.when(kind == "alpha", F.col("b")).otherwise(F.col("c"))
    against = cert.where(kind.isin("alpha", "beta", "gamma")).select(first.alias("a"), second.alias("b"), "q", (-F.col("value")).alias("x"))
    own = cert.where(kind == "lambda").select("a", "b", F.col("value").alias("x"), q).select("a", "b", "q", "x")
    pairs = cert.where(kind == "lambda").select(F.col("a").alias("i"), F.col("b").alias("j"))
    mu = cert.where(kind == "mu").select(F.col("a").alias("l"), F.col("q").alias("k"), F.col("value").alias("x"))
    low = pairs.join(mu, F.col("i") == F.col("l")).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("k").alias("q"), "x")
    high = pairs.join(mu, F.col("j") == F.col("l")).select(F.col("i").alias("a"), F.col("j").alias("b"), (m - F.col("k")).alias("q"), "x")
    total = against.unionByName(own).unionByName(low).unionByName(high).groupBy("a", "b", "q").agg(F.sum("x").alias("x"))
    return total.select("a", "b", "q", (scale * kappa(m, F.col("a"), F.col("b"), F.col("q")) - F.col("x")).alias("slack"))


def check(cert: DataFrame, m: int, scale: int) -> DataFrame:
    """A row each for triples and pairs: ``kind, checks, violations, worst, shortfall`` (the sum over all violations)."""
    both = triple_slacks(cert, m).select(F.lit("triple").alias("kind"), "slack").unionByName(pair_slacks(cert, m, scale).select(F.lit("pair").alias("kind"), "slack"))
    bad = F.col("slack") < 0
    return both.groupBy("kind").agg(F.count("*").alias("checks"), F.count(F.when(bad, 1)).alias("violations"), F.min("slack").alias("worst"), F.coalesce(F.sum(F.when(bad, -F.col("slack"))), F.lit(0)).alias("shortfall"))


def expected_checks(m: int) -> int:
    return comb(m, 3) * (m - 1) * (m - 2) + comb(m, 2) * (m - 1)


def repaired(cert: DataFrame, m: int, scale: int) -> DataFrame:
    """The certificate with every violation paid for: a triple's alphas go down by its largest one, then a pair's lambda."""
    by = triple_slacks(cert, m).groupBy("a", "b", "c").agg(F.greatest(F.lit(0), -F.min("slack")).alias("v"))
    lower = cert.where("kind = 'alpha'").join(by, ["a", "b", "c"]).select("kind", "a", "b", "c", "q", (F.col("value") - F.col("v")).alias("value"))
    once = cert.where("kind <> 'alpha'").select("kind", "a", "b", "c", "q", "value").unionByName(lower)
    pay = pair_slacks(once, m, scale).groupBy("a", "b").agg(F.greatest(F.lit(0), -F.min("slack")).alias("v"))
    pairs = once.where("kind = 'lambda'").join(pay, ["a", "b"]).select("kind", "a", "b", "c", "q", (F.col("value") - F.col("v")).alias("value"))
    return once.where("kind <> 'lambda'").unionByName(pairs)


def epsilon(cert: DataFrame, m: int, scale: int) -> Fraction:
    """What a valid certificate proves the objective to be at most: exact."""
    total = cert.where("kind IN ('lambda', 'mu')").agg(F.sum("value")).first()[0] or 0
    return Fraction(-int(total), scale * m) - 4 * comb(m, 3)
