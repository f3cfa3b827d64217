"""Paired and unpaired tests: counts and ranks in DataFrame operations, tail probabilities by Arrow functions of one row a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import binomial_two_sided, chi2_tail, erfc, wilcoxon_p


def contingency(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n00, n01, n10, n11) of two 0/1 columns."""
    cells = [F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"n{x}{y}") for x in (0, 1) for y in (0, 1)]
    return pairs.groupBy(*keys).agg(*cells)


def mcnemar_exact(cells: DataFrame) -> DataFrame:
    return cells.withColumn("p", binomial_two_sided(F.least("n01", "n10"), F.col("n01") + F.col("n10")))


def mcnemar_chi2(cells: DataFrame) -> DataFrame:
    """With continuity correction, odds ratio and its 95 % interval from half-corrected cells."""
    n = F.col("n01") + F.col("n10")
    stat = F.when(n == 0, 0.0).otherwise(F.try_divide(F.pow(F.greatest(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(0)), 2), n))
    log = F.ln((F.col("n10") + 0.5) / (F.col("n01") + 0.5))
    error = F.sqrt(1 / (F.col("n10") + 0.5) + 1 / (F.col("n01") + 0.5))
    return (
        cells.withColumn("statistic", stat).withColumn("odds_ratio", F.exp(log))
        .withColumn("ci_low", F.exp(log - 1.96 * error)).withColumn("ci_high", F.exp(log + 1.96 * error)).withColumn("p", chi2_tail(F.col("statistic")))
    )


def signed_ranks(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, w_plus, w_minus, rank_biserial, ties): average ranks of nonzero differences.

    Equal differences are counted before they are ranked, so a window holds one row for each distinct size.
    """
    d = pairs.withColumn("d", F.round(F.col(a) - F.col(b), 12)).where("d <> 0 AND NOT isnan(d)")
    sizes = d.groupBy(*keys, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("pos"))).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
    )
    return out.withColumn("rank_biserial", F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")))


def wilcoxon(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank test: exact for few untied differences, else normal with tie correction."""
    r = signed_ranks(pairs, keys, a, b)
    return r.withColumn("p", wilcoxon_p(F.col("n"), F.least("w_plus", "w_minus"), F.col("ties")))


def wilcoxon_ordinal(pairs: DataFrame, keys: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """Ranks of ties in the order of rows, normal approximation."""
    d = pairs.withColumn("d", F.col(a) - F.col(b)).where("d <> 0")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs("d"), *order)).cast("double"))
    r = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return r.withColumn("z", z).withColumn("p", erfc(F.abs("z") / F.sqrt(F.lit(2.0))))


def _pooled_ranks(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, group, n, rank_sum) and ties over all groups of a key; distinct values are counted first."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__all"))
    before = F.coalesce(F.sum("__all").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("__all") + 1) / 2)
    mine = rows.where(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("m"))
    return mine.join(ranked, [*keys, value]).groupBy(*keys, group).agg(F.sum("m").alias("n"), F.sum(F.col("rank") * F.col("m")).alias("rank_sum"))


def _ties(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    return sizes.groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.sum("t").alias("total"))


def mann_whitney(rows: DataFrame, keys: list[str], group: str, first, second, value: str) -> DataFrame:
    """(keys, n1, n2, u, dominance, p) of two groups; dominance is P(first > second) - P(first < second)."""
    some = rows.where(F.col(group).isin(first, second))
    r = _pooled_ranks(some, keys, group, value)
    of = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    wide = r.groupBy(*keys).agg(of(first, "n").alias("n1"), of(second, "n").alias("n2"), of(first, "rank_sum").alias("r1")).join(_ties(some, keys, value), keys)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (F.col("total") + 1 - F.try_divide(F.col("ties"), F.col("total") * (F.col("total") - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    return wide.select(*keys, "n1", "n2", u.alias("u"), F.try_divide(2 * u, n1 * n2).alias("twice")).withColumn("dominance", F.col("twice") - 1).drop("twice").join(wide.select(*keys, z.alias("z")), keys).withColumn("p", erfc(F.col("z") / F.sqrt(F.lit(2.0)))).drop("z")


def cliffs_delta(rows: DataFrame, keys: list[str], group: str, first, second, value: str) -> DataFrame:
    """Dominance of all pairs, from ranks instead of the pairs."""
    return mann_whitney(rows, keys, group, first, second, value).select(*keys, F.col("dominance").alias("delta"))


def kruskal(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, n_groups, h, p): Kruskal-Wallis with tie correction."""
    r = _pooled_ranks(rows, keys, group, value).join(_ties(rows, keys, value), keys)
    n = F.col("total")
    s = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.first("total").alias("total"), F.first("ties").alias("ties"))
    h = (12 * F.col("s") / (n * (n + 1)) - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (F.pow(n, 3.0) - n), F.lit(0.0))
    return s.select(*keys, "n_groups", h.alias("h")).withColumn("p", chi2_tail(F.col("h"), F.col("n_groups") - 1))


def cohens_d(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean difference over the pooled sample deviation of both columns."""
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return rows.groupBy(*keys).agg(F.try_divide(F.avg(a) - F.avg(b), F.nullif(pooled, F.lit(0.0))).alias("d"))


def cohens_kappa(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Agreement of two labels beyond chance; null where chance agreement is whole."""
    cells = rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0.0)).alias("same"))
    left = cells.groupBy(*keys, F.col(a).alias("label")).agg(F.sum("n").alias("x"))
    right = cells.groupBy(*keys, F.col(b).alias("label")).agg(F.sum("n").alias("y"))
    chance = left.join(right, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("t"), F.coalesce("xy", F.lit(0.0)) / (F.col("t") * F.col("t"))
    return total.join(chance, keys, "left").select(*keys, F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, mean, ci_low, ci_high): percentile bootstrap of the mean.

    Each row draws Poisson(1) weights for all replicates from a hash of its keys, its value and its number among equal
    rows, so draws depend on the rows alone, not on their order; replicates are sums that combine on the map side, and no
    group is gathered, however large.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    each = counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    reps = each.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    u = F.pmod(F.xxhash64(*keys, value, "__i", "rep", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    acc, term, w = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):  # Poisson(1) by its distribution function
        acc += term
        w = w + (u > acc).cast("int")
        term /= k + 1
    sums = reps.withColumn("w", w).groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    ci = sums.groupBy(*keys).agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ci, keys)
