"""Preparation of operation logs: flags from windows over wires, filters, sizes and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gates import MEASURES, PASSIVE, TWO_QUBIT_LOADED
from .edges import wires


def terminal_measures(ops: DataFrame) -> DataFrame:
    """(circuit_id, pos, terminal) of each measure: no later op touches its qubit, no later condition reads its bit."""
    touch = wires(ops).where(~F.col("gate").isin(*PASSIVE))
    last = touch.withColumn("last", F.max("pos").over(Window.partitionBy("circuit_id", "q"))).where(F.col("gate") == "measure")
    reads = ops.where(F.col("cond").isNotNull()).select("circuit_id", F.col("pos").alias("rpos"), F.explode("cond.bits").alias("bit")).groupBy("circuit_id", "bit").agg(F.max("rpos").alias("last_read"))
    bits = ops.where(F.col("gate") == "measure").select("circuit_id", "pos", F.explode_outer("clbits").alias("bit"))
    read = bits.join(reads, ["circuit_id", "bit"], "left").groupBy("circuit_id", "pos").agg(F.max("last_read").alias("last_read"))
    flags = last.groupBy("circuit_id", "pos").agg(F.max("last").alias("last")).join(read, ["circuit_id", "pos"])
    return flags.select("circuit_id", "pos", ((F.col("last") == F.col("pos")) & F.coalesce(F.col("last_read") < F.col("pos"), F.lit(True))).alias("terminal"))


def renumber(ops: DataFrame, by: str = "pos") -> DataFrame:
    """Positions from 0 in the order of ``by``."""
    return ops.withColumn("pos", (F.row_number().over(Window.partitionBy("circuit_id").orderBy(by)) - 1).cast("int"))


def prepared(ops: DataFrame) -> DataFrame:
    """Without barriers and terminal measures, renumbered."""
    gone = terminal_measures(ops).where("terminal").select("circuit_id", "pos")
    return renumber(ops.where(F.col("gate") != "barrier").join(gone, ["circuit_id", "pos"], "left_anti"))


def expand_wide(ops: DataFrame, definitions: DataFrame, widest: int = 8, rounds: int = 16, most_ops: int = 50_000) -> DataFrame:
    """Replace ops wider than ``widest`` by their definitions (gate, step, body_gate, slots, body_params), round by round.

    Stops when no defined op is too wide. Circuits that would pass ``most_ops`` keep their rows and get ``error``.
    """
    now = ops.withColumn("error", F.lit(None).cast("string"))
    body = definitions.groupBy("gate").agg(F.array_sort(F.collect_list(F.struct("step", "body_gate", "slots", "body_params"))).alias("body"))
    for _ in range(rounds):
        todo = now.where((F.size("qubits") > widest) & F.col("error").isNull()).select("gate").distinct().join(body.select("gate"), "gate", "left_semi")
        if todo.limit(1).count() == 0:
            break
        wide = (F.size("qubits") > widest) & F.col("body").isNotNull() & F.col("error").isNull()
        joined = now.join(body, "gate", "left")
        sized = joined.withColumn("total", F.sum(F.when(wide, F.size("body")).otherwise(1)).over(Window.partitionBy("circuit_id")))
        sized = sized.withColumn("error", F.when(F.col("total") > most_ops, F.lit("too many ops")).otherwise(F.col("error")))
        one = F.array(F.struct(F.lit(0).alias("step"), F.col("gate").alias("body_gate"), F.lit(None).cast("array<int>").alias("slots"), F.col("params").alias("body_params")))
        out = sized.withColumn("b", F.explode(F.when(wide & F.col("error").isNull(), F.col("body")).otherwise(one)))
        out = out.withColumn("qubits", F.when(F.col("b.slots").isNull(), F.col("qubits")).otherwise(F.transform("b.slots", lambda s: F.element_at("qubits", s + 1))))
        out = out.withColumn("gate", F.col("b.body_gate")).withColumn("params", F.col("b.body_params")).withColumn("order", F.struct("pos", "b.step"))
        now = renumber(out, "order").select(*now.columns)
    return now


def arity_check(ops: DataFrame, widest: int) -> DataFrame:
    """(circuit_id, arity, reason): circuits with a gate on more qubits than allowed are kept with a reason."""
    return ops.groupBy("circuit_id").agg(F.max(F.size("qubits")).alias("arity")).withColumn("reason", F.when(F.col("arity") > widest, F.concat(F.lit("arity "), "arity")))


def unitary_core(ops: DataFrame) -> DataFrame:
    """Ops with ``core`` (no measure, reset or barrier) and ``pure``: nothing conditioned, nothing measured mid-circuit."""
    last = wires(ops).withColumn("last", F.max("pos").over(Window.partitionBy("circuit_id", "q"))).groupBy("circuit_id", "pos").agg(F.max("last").alias("last"))
    rows = ops.join(last, ["circuit_id", "pos"])
    impure = F.col("cond").isNotNull() | (F.col("gate").isin(*MEASURES) & (F.col("last") > F.col("pos")))
    return rows.withColumn("pure", ~F.bool_or(impure).over(Window.partitionBy("circuit_id"))).withColumn("core", ~F.col("gate").isin(*MEASURES, "barrier")).drop("last")


def measured_then_gated(ops: DataFrame) -> DataFrame:
    """(circuit_id, measured_then_gated): some qubit sees another op than a measure after a measure."""
    order = Window.partitionBy("circuit_id", "q").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max((F.col("gate") == "measure").cast("int")).over(order)
    return wires(ops).withColumn("seen", seen).groupBy("circuit_id").agg(F.bool_or((F.coalesce("seen", F.lit(0)) == 1) & (F.col("gate") != "measure")).alias("measured_then_gated"))


def dynamic(ops: DataFrame) -> DataFrame:
    flag = F.bool_or(F.col("gate").isin(*MEASURES, "if_else") | F.col("cond").isNotNull())
    return ops.groupBy("circuit_id").agg(flag.cast("int").alias("dynamic"))


def controlled(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("cond").isNotNull() | F.col("gate").isin("if_else", "while_loop", "for_loop", "switch_case"))


def size_bin(n: Column, bins: tuple[int, int]) -> Column:
    return F.when(n <= bins[0], "small").when(n <= bins[1], "medium").otherwise("large")


def stratum(n_qubits: Column, n_gates: Column, mid_measure: Column) -> Column:
    """S3 for mid-circuit measurement, S1a and S1b for up to 10 and 20 qubits, S2 beyond; S1c for no gate at all."""
    return F.when(mid_measure, "S3").when(n_gates == 0, "S1c").when(n_qubits <= 10, "S1a").when(n_qubits <= 20, "S1b").otherwise("S2")


def metadata(ops: DataFrame, bins: tuple[int, int] = (50, 500)) -> DataFrame:
    """(circuit_id, n_qubits, n_gates, n_cx, arity, size_bin)."""
    out = ops.groupBy("circuit_id").agg(
        (F.max(F.array_max("qubits")) + 1).alias("n_qubits"),
        F.count(F.lit(1)).alias("n_gates"),
        F.count_if(F.col("gate").isin(*TWO_QUBIT_LOADED)).alias("n_cx"),
        F.max(F.size("qubits")).alias("arity"),
    )
    return out.withColumn("size_bin", size_bin(F.col("n_gates"), bins))


def without_measures(ops: DataFrame) -> DataFrame:
    """Ops without measures, resets and barriers, whatever follows them; for exact outcome distributions."""
    return ops.where(~F.col("gate").isin("measure", "reset", "barrier"))
