"""Two-by-two states and outcome distributions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduced_states(amps: DataFrame) -> DataFrame:
    """(circuit_id, target, r00, r11, re01, im01) of each qubit of real states (circuit_id, amps), bit q of the index being qubit q."""
    n = F.round(F.log2(F.size("amps"))).cast("int")
    rows = amps.withColumn("target", F.explode(F.sequence(F.lit(0), n - 1)))
    bit = F.call_function("shiftleft", F.lit(1), F.col("target"))
    zero = F.lit(0.0)
    at = lambda i: F.element_at("amps", i + 1)
    low = F.filter(F.sequence(F.lit(0), F.size("amps") - 1), lambda i: i.bitwiseAND(bit) == 0)
    total = lambda f: F.aggregate(low, zero, lambda a, i: a + f(i))
    return rows.select(
        "circuit_id", "target", total(lambda i: at(i) * at(i)).alias("r00"), total(lambda i: at(i + bit) * at(i + bit)).alias("r11"),
        total(lambda i: at(i) * at(i + bit)).alias("re01"), zero.alias("im01"),
    )


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _det(s: str) -> Column:
    return F.col(f"{s}.r00") * F.col(f"{s}.r11") - F.col(f"{s}.re01") * F.col(f"{s}.re01") - F.col(f"{s}.im01") * F.col(f"{s}.im01")


def fidelity(a: str, b: str) -> Column:
    """Uhlmann fidelity of the struct columns ``a`` and ``b``, in closed form and clamped to 0..1."""
    trace = F.col(f"{a}.r00") * F.col(f"{b}.r00") + F.col(f"{a}.r11") * F.col(f"{b}.r11") + 2 * (F.col(f"{a}.re01") * F.col(f"{b}.re01") + F.col(f"{a}.im01") * F.col(f"{b}.im01"))
    dets = F.greatest(_det(a), F.lit(0.0)) * F.greatest(_det(b), F.lit(0.0))
    return clamp(trace + 2 * F.sqrt(dets))


def trace_distance(a: str, b: str) -> Column:
    half = (F.col(f"{a}.r00") - F.col(f"{b}.r00") - F.col(f"{a}.r11") + F.col(f"{b}.r11")) / 2
    re, im = F.col(f"{a}.re01") - F.col(f"{b}.re01"), F.col(f"{a}.im01") - F.col(f"{b}.im01")
    return F.sqrt(half * half + re * re + im * im)


def purity(r00: Column, r11: Column, re01: Column, im01: Column) -> Column:
    return r00 * r00 + r11 * r11 + 2 * (re01 * re01 + im01 * im01)


def entropy(r00: Column, r11: Column, re01: Column, im01: Column) -> Column:
    """Von Neumann entropy in bits, from the two eigenvalues."""
    spread = F.sqrt(F.greatest((r00 - r11) * (r00 - r11) + 4 * (re01 * re01 + im01 * im01), F.lit(0.0)))
    part = lambda x: F.when(x > 1e-12, -x * F.log2(x)).otherwise(0.0)
    return part((r00 + r11 + spread) / 2) + part((r00 + r11 - spread) / 2)


def marginals(counts: DataFrame) -> DataFrame:
    """(run_id, qubit, p1) of counts (run_id, bitstring, cnt, n_bits); qubit 0 is the rightmost character; a half where nothing was counted."""
    rows = counts.withColumn("bitstring", F.lpad(F.regexp_replace("bitstring", " ", ""), F.col("n_bits"), F.lit("0")))
    rows = rows.withColumn("qubit", F.explode(F.sequence(F.lit(0), F.col("n_bits") - 1)))
    one = (F.substr("bitstring", F.col("n_bits") - F.col("qubit"), F.lit(1)) == "1").cast("long")
    return rows.groupBy("run_id", "qubit").agg(F.coalesce(F.try_divide(F.sum(F.col("cnt") * one), F.sum("cnt")), F.lit(0.5)).alias("p1"))


def total_variation(a: DataFrame, b: DataFrame, keys: list[str], outcome: str = "bitstring") -> DataFrame:
    """(keys, tvd) of two tables of (keys, outcome, p): half the sum of absolute differences, absent outcomes at 0."""
    both = a.withColumnRenamed("p", "pa").join(b.withColumnRenamed("p", "pb"), [*keys, outcome], "full")
    gap = F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))
    return both.groupBy(*keys).agg(clamp(F.sum(gap) / 2).alias("tvd"))


def empirical_threshold(values: DataFrame, column: str, fallback: float = 0.05, least: int = 3, share: float = 0.95) -> DataFrame:
    """One row: the percentile of what there is, or the fallback where too few values are."""
    return values.agg(F.when(F.count(column) < least, F.lit(fallback)).otherwise(F.percentile(column, share)).alias("threshold"))
