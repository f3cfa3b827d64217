"""Tail probabilities that Spark SQL has no built-in for, as Arrow functions, and their registration for SQL."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _each(f, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*series, strict=True)], dtype="float64")


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def binomial_p(k: int, n: int) -> float:
    """Two-sided exact test of a fair coin: min(1, 2 P(X <= k))."""
    if n <= 0:
        return 1.0
    if n > 2000:  # exact integers grow long; lgamma is good to ten digits here
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(int(k) + 1)]
        top = max(logs)
        return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(v - top) for v in logs))
    return min(1.0, 2 * sum(math.comb(int(n), i) for i in range(int(k) + 1)) / 2 ** int(n))


def signed_rank_p(n: int, w: float, ties: float) -> float:
    """Two-sided: exact by counting subsets of ranks up to 50 untied differences, else normal with tie correction."""
    n = int(n)
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0 and w == int(w):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0


def _udf(f):
    return F.pandas_udf(f, "double")


def erfc(x: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return _each(math.erfc, v)

    return _udf(run)(x)


def chi2_tail(x: Column, df: Column | int = 1) -> Column:
    def run(v: pd.Series, k: pd.Series) -> pd.Series:
        return _each(lambda a, b: gamma_q(b / 2, a / 2), v, k)

    return _udf(run)(x.cast("double"), (df if isinstance(df, Column) else F.lit(df)).cast("double"))


def binomial_two_sided(k: Column, n: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(binomial_p, a, b)

    return _udf(run)(k, n)


def wilcoxon_p(n: Column, w: Column, ties: Column) -> Column:
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _each(signed_rank_p, a, b, c)

    return _udf(run)(n, w, ties)


def register(spark: SparkSession) -> None:
    """Make the functions and table functions of the engine callable from SQL."""
    from ..sources.qasm import qasm_ops

    def one(v: pd.Series) -> pd.Series:
        return _each(math.erfc, v)

    def chi(v: pd.Series, k: pd.Series) -> pd.Series:
        return _each(lambda a, b: gamma_q(b / 2, a / 2), v, k)

    def binom(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(binomial_p, a, b)

    def ranks(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _each(signed_rank_p, a, b, c)

    for name, f in (("erfc", one), ("chi2_tail", chi), ("binom_test", binom), ("wilcoxon_p", ranks)):
        spark.udf.register(name, _udf(f))
    spark.udtf.register("qasm_ops", qasm_ops())
