"""Slices as ordered folds over an operation log, in JVM expressions; no reachability relation is built.

A fold carries the set of qubits that are needed (or affected) and of classical bits, and decides op by op. Sets are bit
masks: one 64-bit word for up to 62 qubits and bits, arrays of words beyond. One row holds one circuit's log in order, so
the shuffle that collects logs by circuit is the only one, and all targets of a circuit share it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import by_circuit

METHODS = ("causal", "naive", "full")
DIRECTIONS = ("backward", "forward")
WORD = 62


class Masks:
    """Sets of small integers as columns: a long, or an array of ``words`` longs."""

    def __init__(self, words: int = 1):
        self.words = words

    def _word(self, positions: Column, w: int | None) -> Column:
        def add(a: Column, q: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (q % WORD).cast("int"))
            return a.bitwiseOR(bit) if w is None else F.when(F.floor(q / WORD) == w, a.bitwiseOR(bit)).otherwise(a)

        return F.aggregate(positions, F.lit(0).cast("long"), add)

    def of(self, positions: Column) -> Column:
        return self._word(positions, None) if self.words == 1 else F.array(*[self._word(positions, w) for w in range(self.words)])

    def none(self) -> Column:
        return F.lit(0).cast("long") if self.words == 1 else F.array(*[F.lit(0).cast("long")] * self.words)

    def join(self, a: Column, b: Column) -> Column:
        return a.bitwiseOR(b) if self.words == 1 else F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))

    def less(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(F.bitwise_not(b)) if self.words == 1 else F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))

    def meets(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(b) != 0 if self.words == 1 else F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda v: v != 0)

    def members(self, m: Column) -> Column:
        """The set as a sorted array."""
        if self.words == 1:
            return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftright", m, b).bitwiseAND(F.lit(1).cast("long")) != 0)
        return F.filter(F.sequence(F.lit(0), F.lit(WORD * self.words - 1)), lambda b: F.call_function("shiftright", F.element_at(m, F.floor(b / WORD).cast("int") + 1), (b % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0)


def masks_for(ops: DataFrame, n: int | None = None) -> Masks:
    """Masks wide enough for ``n`` qubits and bits; one row of the table says how many where ``n`` is not given."""
    if n is None:
        top = F.greatest(F.array_max("qubits"), F.coalesce(F.array_max("clbits"), F.lit(0)), F.coalesce(F.array_max("cond.bits"), F.lit(0)))
        n = (ops.agg(F.max(top).alias("n")).first()["n"] or 0) + 1
    return Masks(max(1, -(-n // WORD)))


def _mask(positions: Column) -> Column:
    return Masks().of(positions)


def logs(ops: DataFrame, masks: Masks | None = None) -> DataFrame:
    """(circuit_id, n_qubits, n_ops, log): each circuit's ops in order, with their masks."""
    k = masks or Masks()
    arity = F.size("qubits")
    written = F.when((F.col("num_ctrl") > 0) & (F.col("num_ctrl") < arity), F.slice("qubits", F.col("num_ctrl") + 1, arity)).otherwise(F.col("qubits"))
    row = F.struct(
        F.col("pos"),
        k.of(F.col("qubits")).alias("m"),
        k.of(written).alias("w"),
        F.when(F.col("gate") == "measure", k.of(F.col("clbits"))).otherwise(k.none()).alias("d"),
        F.when(F.col("cond").isNotNull(), k.of(F.col("cond.bits"))).otherwise(k.none()).alias("r"),
        F.when(arity == 2, k.of(F.col("qubits"))).otherwise(k.none()).alias("c"),
        (arity == 2).alias("two"),
        F.col("qubits").alias("q"),
    )
    return by_circuit(ops).groupBy("circuit_id").agg(
        (F.max(F.array_max("qubits")) + 1).alias("n_qubits"),
        F.count(F.lit(1)).cast("int").alias("n_ops"),
        F.array_sort(F.collect_list(row)).alias("log"),  # one circuit's ops
    )


def component_masks(log: Column, n_qubits: Column, masks: Masks | None = None) -> Column:
    """Mask of each qubit's component: couplings are merged one gate at a time."""
    k = masks or Masks()
    start = F.transform(F.sequence(F.lit(0), n_qubits - 1), lambda q: k.of(F.array(q)))

    def merge(parts: Column, x: Column) -> Column:
        both = F.aggregate(parts, x["c"], lambda a, p: F.when(k.meets(p, x["c"]), k.join(a, p)).otherwise(a))
        return F.when(~x["two"], parts).otherwise(F.transform(parts, lambda p: F.when(k.meets(p, both), both).otherwise(p)))

    return F.aggregate(log, start, merge)


def qubit_components(ops: DataFrame, n_qubits: int | None = None) -> DataFrame:
    """(circuit_id, q, component): the least qubit that two-qubit gates connect q with; only qubits below the widest used."""
    k = masks_for(ops, n_qubits)
    found = logs(ops, k).select("circuit_id", F.posexplode(component_masks(F.col("log"), F.col("n_qubits"), k)).alias("q", "mask"))
    return found.select("circuit_id", "q", k.members(F.col("mask"))[0].alias("component"))


def _state(need: Column, bits: Column, kept: Column) -> Column:
    return F.struct(need.alias("need"), bits.alias("bits"), kept.alias("kept"))


def _step(method: str, direction: str, k: Masks) -> Callable[[Column, Column], Column]:
    def causal(a: Column, x: Column) -> Column:
        back = direction == "backward"
        enters = x["d"] if back else x["r"]
        keep = k.meets(x["m"], a["need"]) | k.meets(enters, a["bits"])
        need = F.when(keep, k.join(a["need"], x["m"] if method == "causal" else x["e"])).otherwise(a["need"])
        if back:  # a measure is the latest definition for every later reader
            bits = k.less(a["bits"], x["d"])
            bits = F.when(keep, k.join(bits, x["r"])).otherwise(bits)
        else:  # a measure defines its bit anew: affected only if the measure is
            bits = F.when(keep, k.join(a["bits"], x["d"])).otherwise(k.less(a["bits"], x["d"]))
        return _state(need, bits, F.when(keep, F.array_append(a["kept"], x["pos"])).otherwise(a["kept"]))

    def naive(a: Column, x: Column) -> Column:
        tests, adds = (x["w"], x["m"]) if direction == "backward" else (x["m"], x["w"])
        keep = k.meets(tests, a["need"])
        return _state(F.when(keep, k.join(a["need"], adds)).otherwise(a["need"]), a["bits"], F.when(keep, F.array_append(a["kept"], x["pos"])).otherwise(a["kept"]))

    return naive if method == "naive" else causal


def slices(ops: DataFrame, method: str = "causal", direction: str = "backward", n_qubits: int | None = None) -> DataFrame:
    """(circuit_id, target, method, direction, n_ops, positions) for every circuit and qubit.

    "causal" follows state-carry and control, "full" also entanglement (through component masks), "naive" reads and writes
    as a classical slicer does. ``n_qubits`` bounds the qubits and bits of all circuits; without it one row of the table is
    asked for first.
    """
    if method not in METHODS or direction not in DIRECTIONS:
        raise ValueError(f"{method!r}, {direction!r}")
    k = masks_for(ops, n_qubits)
    rows = logs(ops, k)
    if method == "full":
        rows = rows.withColumn("parts", component_masks(F.col("log"), F.col("n_qubits"), k))
        closed = lambda m: F.aggregate("parts", k.none(), lambda a, p: F.when(k.meets(p, m), k.join(a, p)).otherwise(a))
        rows = rows.withColumn("log", F.transform("log", lambda x: x.withField("e", closed(x["m"])))).drop("parts")
    if direction == "backward":
        rows = rows.withColumn("log", F.reverse("log"))
    rows = rows.withColumn("target", F.explode(F.sequence(F.lit(0), F.col("n_qubits") - 1)))
    start = _state(k.of(F.array("target")), k.none(), F.array().cast("array<int>"))
    kept = F.aggregate("log", start, _step(method, direction, k), lambda a: a["kept"])
    return rows.select("circuit_id", "target", F.lit(method).alias("method"), F.lit(direction).alias("direction"), "n_ops", F.array_sort(kept).alias("positions"))


def slice_sizes(found: DataFrame) -> DataFrame:
    return found.select("circuit_id", "target", "method", "direction", "n_ops", F.size("positions").alias("size"), (F.size("positions") / F.greatest("n_ops", F.lit(1))).alias("fraction"))


def materialise(ops: DataFrame, found: DataFrame) -> DataFrame:
    """The ops of each slice, in order, renumbered; one row for each slice and op kept."""
    from pyspark.sql.window import Window

    kept = found.select("circuit_id", "target", "method", F.explode("positions").alias("pos"))
    new = (F.row_number().over(Window.partitionBy("circuit_id", "target", "method").orderBy("pos")) - 1).alias("new_pos")
    return kept.join(ops, ["circuit_id", "pos"]).select("circuit_id", "target", "method", "pos", new, "gate", "qubits", "clbits", "params", "cond")


def layers(ops: DataFrame) -> DataFrame:
    """(circuit_id, pos, layer): as soon as possible, one more than the latest layer on any of an op's wires."""
    rows = by_circuit(ops).groupBy("circuit_id").agg((F.max(F.array_max("qubits")) + 1).alias("n_qubits"), F.array_sort(F.collect_list(F.struct("pos", F.col("qubits").alias("q")))).alias("log"))
    start = F.struct(F.transform(F.sequence(F.lit(0), F.col("n_qubits") - 1), lambda q: F.lit(0)).alias("levels"), F.array().cast("array<struct<pos:int,layer:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        top = F.aggregate(x["q"], F.lit(0), lambda m, q: F.greatest(m, F.element_at(a["levels"], q + 1)))
        levels = F.transform(a["levels"], lambda v, q: F.when(F.array_contains(x["q"], q), top + 1).otherwise(v))
        return F.struct(levels.alias("levels"), F.array_append(a["out"], F.struct(x["pos"].alias("pos"), top.alias("layer"))).alias("out"))

    out = rows.select("circuit_id", F.explode(F.aggregate("log", start, step, lambda a: a["out"])).alias("o"))
    return out.select("circuit_id", "o.pos", "o.layer")


def touched_qubits(ops: DataFrame, found: DataFrame) -> DataFrame:
    """(circuit_id, target, method, touched): qubits of a slice's ops, and the target."""
    kept = found.select("circuit_id", "target", "method", F.explode_outer("positions").alias("pos"))
    on = kept.join(ops.select("circuit_id", "pos", "qubits"), ["circuit_id", "pos"], "left")
    flat = F.array_sort(F.array_distinct(F.array_append(F.flatten(F.collect_list("qubits")), F.first("target"))))
    return on.groupBy("circuit_id", "target", "method").agg(flat.alias("touched"))


def completeness(truth: DataFrame, covered: DataFrame) -> DataFrame:
    """Per (circuit_id, target): truth_size, covered_true, completeness (1 for an empty truth), complete, missed."""
    both = truth.select("circuit_id", "target", F.col("qubits").alias("truth")).join(covered.select("circuit_id", "target", F.col("touched").alias("covered")), ["circuit_id", "target"], "left")
    got = F.array_intersect("truth", F.coalesce("covered", F.array().cast("array<int>")))
    missed = F.array_except("truth", F.coalesce("covered", F.array().cast("array<int>")))
    return both.select(
        "circuit_id", "target", F.size("truth").alias("truth_size"), F.size(got).alias("covered_true"),
        F.when(F.size("truth") == 0, 1.0).otherwise(F.try_divide(F.size(got), F.size("truth"))).alias("completeness"),
        (F.size(missed) == 0).cast("int").alias("complete"), F.array_sort(missed).alias("missed"),
    )
