"""Metrics of slices against their circuits, and checks of summaries and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import TWO_QUBIT_COUNTED
from .slices import layers
from .tables import flatten_json


def slice_metrics(ops: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """(circuit_id, target, label, size, ssr, cx_reduction), ratios clamped to 0..1 and whole for empty circuits."""
    two = F.col("gate").isin(*TWO_QUBIT_COUNTED)
    total = ops.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(two, F.col("pos")))).alias("cx"))
    one = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    size, kept = F.size("positions"), F.size(F.array_intersect("positions", "cx"))
    n_cx = F.size("cx")
    return found.join(total, "circuit_id").select(
        "circuit_id", "target", label, size.alias("size"), F.when(F.col("n") == 0, 1.0).otherwise(one(size / F.col("n"))).alias("ssr"),
        F.when(n_cx > 0, (n_cx - kept) / n_cx).otherwise(0.0).alias("cx_reduction"),
    )


def depth_ratio(ops: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """(circuit_id, target, label, drr): depth of a slice over that of its circuit."""
    whole = layers(ops).groupBy("circuit_id").agg((F.max("layer") + 1).alias("depth"))
    kept = found.select("circuit_id", "target", label, F.explode("positions").alias("pos")).join(ops, ["circuit_id", "pos"])
    key = F.struct("circuit_id", "target", label)
    part = layers(kept.withColumn("circuit_id", key)).groupBy("circuit_id").agg((F.max("layer") + 1).alias("part"))
    part = part.select("circuit_id.*", "part")
    return part.join(whole, "circuit_id").select("circuit_id", "target", label, F.least(F.lit(1.0), F.col("part") / F.col("depth")).alias("drr"))


def fraction(given: Column, part: Column, whole: Column) -> Column:
    """A given fraction, else that of the counts; nothing of nothing is null."""
    return F.coalesce(given, F.try_divide(part, F.nullif(whole.cast("double"), F.lit(0.0))))


def value_lists(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): finite values of each stratum, sorted; for strata that fit a row."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def accept(summary: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The summary's rows; the query fails with the names of the checks that do not hold."""
    broken = F.concat_ws("; ", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return summary.where(F.when(broken == "", True).otherwise(F.raise_error(broken).cast("boolean")))


def compare_documents(a: DataFrame, b: DataFrame, key: str, column: str, tolerance: float = 1e-9) -> DataFrame:
    """(path, differing, largest) of JSON documents by path; numbers within the tolerance are equal."""
    flat = lambda df, name: df.select(key, F.explode(flatten_json(F.col(column))).alias("path", name))
    both = flat(a, "x").join(flat(b, "y"), [key, "path"], "full")
    gap = F.abs(F.col("x").try_cast("double") - F.col("y").try_cast("double"))
    same = F.col("x").eqNullSafe(F.col("y")) | F.coalesce(gap <= tolerance, F.lit(False))
    return both.groupBy("path").agg(F.count_if(~same).alias("differing"), F.max(gap).alias("largest"))
