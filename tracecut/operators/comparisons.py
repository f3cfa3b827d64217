"""The comparison table: pre-specified pairs of methods, tested over paired observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats


def plan(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rq, metric, method_a, method_b) of the comparisons to make."""
    return spark.createDataFrame(rows, "rq string, metric string, method_a string, method_b string")


def compared(observations: DataFrame, plan: DataFrame) -> DataFrame:
    """Paired values of each planned comparison: (rq, metric, method_a, method_b, pair_id, a, b)."""
    mean = observations.groupBy("rq", "metric", "method", "pair_id").agg(F.avg("value").alias("v"))
    a = plan.join(mean.withColumnsRenamed({"method": "method_a", "v": "a"}), ["rq", "metric", "method_a"])
    return a.join(mean.withColumnsRenamed({"method": "method_b", "v": "b"}), ["rq", "metric", "method_b", "pair_id"])


def comparison_table(observations: DataFrame, planned: DataFrame) -> DataFrame:
    """(rq, metric, method_a, method_b, n, mean_a, mean_b, mean_difference, w_plus, w_minus, rank_biserial, p, p_adjusted, stars)."""
    keys = ["rq", "metric", "method_a", "method_b"]
    pairs = compared(observations, planned)
    means = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"))
    tested = means.join(stats.wilcoxon(pairs, keys, "a", "b"), keys, "left").drop("ties", "n")
    total = planned.agg(F.count(F.lit(1)).alias("__k"))
    p = F.coalesce("p", F.lit(1.0))
    return tested.join(F.broadcast(total)).withColumns({"p": p, "p_adjusted": stats.bonferroni(p, F.col("__k")), "stars": stats.stars(p)}).drop("__k")


def derived_observations(observations: DataFrame) -> DataFrame:
    """Incompleteness (1 - completeness) and, by pair, reduction against the causal method, added to the rows."""
    keys = ["rq", "pair_id"]
    less = observations.where("metric = 'completeness'").withColumns({"metric": F.lit("incompleteness"), "value": 1 - F.col("value")})
    size = observations.where("metric = 'size'")
    base = size.where("method = 'causal'").groupBy(*keys).agg(F.avg("value").alias("__base"))
    cut = size.where("method <> 'causal'").join(base, keys).withColumns({"metric": F.lit("reduction"), "value": F.try_divide(F.col("__base") - F.col("value"), F.nullif("__base", F.lit(0.0)))}).drop("__base")
    return observations.unionByName(less).unionByName(cut.select(*observations.columns))


def described(observations: DataFrame, keys: list[str], n_boot: int = 200) -> DataFrame:
    """(keys, n, mean, median, ci_low, ci_high); null keys are a group of their own."""
    base = observations.groupBy(*keys).agg(F.count("value").alias("n"), F.median("value").alias("median"))
    safe = observations.withColumns({k: F.coalesce(F.col(k), F.lit("(none)")) for k in keys})
    ci = stats.bootstrap_interval(safe, keys, "value", n_boot)
    return base.withColumns({k: F.coalesce(F.col(k), F.lit("(none)")) for k in keys}).join(ci, keys)


def percent(rate) -> F.col:
    return F.round(rate * 100, 2)
