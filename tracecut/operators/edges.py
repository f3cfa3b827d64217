"""Typed dependence edges of operation logs, from windows over wires and bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gates import MEASURES, touches


def wires(ops: DataFrame) -> DataFrame:
    """One row for each op and qubit: (circuit_id, pos, gate, q, arity)."""
    return ops.select("circuit_id", "pos", "gate", F.explode("qubits").alias("q"), F.size("qubits").alias("arity"), "cond")


def data_edges(ops: DataFrame) -> DataFrame:
    """State-carry: the previous op on each wire, once for each pair of ops."""
    before = F.lag("pos").over(Window.partitionBy("circuit_id", "q").orderBy("pos"))
    return wires(ops).select("circuit_id", before.alias("src"), F.col("pos").alias("dst")).where("src IS NOT NULL").distinct().withColumn("edge_type", F.lit("DATA"))


def _bit_events(ops: DataFrame) -> DataFrame:
    defs = ops.where(F.col("gate") == "measure").select("circuit_id", "pos", F.explode("clbits").alias("bit"), F.lit(True).alias("writes"))
    uses = ops.where(F.col("cond").isNotNull()).select("circuit_id", "pos", F.explode("cond.bits").alias("bit"), F.lit(False).alias("writes"))
    return defs.unionByName(uses)


def control_edges(ops: DataFrame, mode: str = "fixed") -> DataFrame:
    """Measure to conditioned op: the latest earlier definition of each bit read ("fixed"), or the last one anywhere
    ("unchanged"), which may be later than its reader. Pairs that are state-carry edges already are left out."""
    events = _bit_events(ops)
    if mode == "fixed":
        order = Window.partitionBy("circuit_id", "bit").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        found = F.last(F.when(F.col("writes"), F.col("pos")), ignorenulls=True).over(order)
    elif mode == "unchanged":
        found = F.max(F.when(F.col("writes"), F.col("pos"))).over(Window.partitionBy("circuit_id", "bit"))
    else:
        raise ValueError(f"control mode {mode!r}")
    pairs = events.withColumn("src", found).where(~F.col("writes") & F.col("src").isNotNull()).select("circuit_id", "src", F.col("pos").alias("dst")).distinct()
    return pairs.join(data_edges(ops).select("circuit_id", "src", "dst"), ["circuit_id", "src", "dst"], "left_anti").withColumn("edge_type", F.lit("CONTROL"))


def couplings(ops: DataFrame, exactly_two: bool = True) -> DataFrame:
    """(circuit_id, a, b), a < b: qubits that a gate of two (or of two and more) qubits couples directly."""
    two = ops.where(F.size("qubits") == 2 if exactly_two else F.size("qubits") >= 2)
    a = two.select("circuit_id", "qubits", F.explode("qubits").alias("a")).select("circuit_id", "a", F.explode("qubits").alias("b"))
    return a.where("a < b").distinct()


def entanglement_edges(ops: DataFrame, control_mode: str = "fixed") -> DataFrame:
    """All earlier-to-later pairs of ops on different qubits of one component, less the edges of other types.

    The number of rows grows with the square of a component's ops; slices do not need them (see ``slices``).
    """
    from .slices import qubit_components

    w = wires(ops).select("circuit_id", "pos", "q").join(qubit_components(ops), ["circuit_id", "q"])
    a, b = w.select("circuit_id", "component", F.col("pos").alias("src"), F.col("q").alias("qa")), w.select("circuit_id", "component", F.col("pos").alias("dst"), F.col("q").alias("qb"))
    pairs = a.join(b, ["circuit_id", "component"]).where("qa <> qb AND src < dst").select("circuit_id", "src", "dst").distinct()
    taken = data_edges(ops).unionByName(control_edges(ops, control_mode)).select("circuit_id", "src", "dst")
    return pairs.join(taken, ["circuit_id", "src", "dst"], "left_anti").withColumn("edge_type", F.lit("ENTANGLEMENT"))


def dependence_edges(ops: DataFrame, control_mode: str = "fixed", entanglement: bool = False) -> DataFrame:
    """The typed graph; one type for each pair: state-carry, then control, then entanglement."""
    out = data_edges(ops).unionByName(control_edges(ops, control_mode))
    return out.unionByName(entanglement_edges(ops, control_mode)) if entanglement else out


#: The graph variants by the edge types they keep.
GRAPH_VARIANTS = {
    "full": ("DATA", "CONTROL", "ENTANGLEMENT"),
    "no_entanglement": ("DATA", "CONTROL"),
    "no_control": ("DATA", "ENTANGLEMENT"),
    "data_only": ("DATA",),
    "classical": ("DATA", "CONTROL"),
}


def graph_variants(edges: DataFrame) -> DataFrame:
    """Edges of every variant at once: (variant, circuit_id, src, dst, edge_type)."""
    kept = F.array(*[F.struct(F.lit(v).alias("variant"), F.array(*map(F.lit, t)).alias("types")) for v, t in GRAPH_VARIANTS.items()])
    return edges.withColumn("v", F.explode(kept)).where(F.array_contains("v.types", F.col("edge_type"))).select("v.variant", "circuit_id", "src", "dst", "edge_type")


def without_types(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(~F.col("edge_type").isin(*types))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("circuit_id", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def control_share(edges: DataFrame) -> DataFrame:
    """Share of control edges of each circuit; 0 where it has no edge."""
    return edges.groupBy("circuit_id").agg(F.coalesce(F.avg((F.col("edge_type") == "CONTROL").cast("double")), F.lit(0.0)).alias("control_share"))


def four_edges(ops: DataFrame, directed_pairs: DataFrame | None = None) -> DataFrame:
    """The consumer-typed graph: (circuit_id, src, dst, types), types a sorted set.

    On one-qubit ops the wire edge is MD for a measure or reset, CD for a conditioned op, else UED; on wider gates ED. Each
    earlier measure that shares a bit with a conditioned op adds CD. Directly coupled qubits add ED from each op on the
    first to each later op on the second where no edge is; ``directed_pairs`` (circuit_id, qa, qb) gives their order,
    ascending by default.
    """
    before = F.lag("pos").over(Window.partitionBy("circuit_id", "q").orderBy("pos"))
    kind = F.when(F.col("arity") >= 2, "ED").when(F.col("gate").isin(*MEASURES), "MD").when(F.col("cond").isNotNull(), "CD").otherwise("UED")
    wire = wires(ops).where(touches("gate")).select("circuit_id", before.alias("src"), F.col("pos").alias("dst"), kind.alias("type")).where("src IS NOT NULL")
    bits = _bit_events(ops)
    m = bits.where("writes").select("circuit_id", "bit", F.col("pos").alias("src"))
    c = bits.where("NOT writes").select("circuit_id", "bit", F.col("pos").alias("dst"))
    control = m.join(c, ["circuit_id", "bit"]).where("src < dst").select("circuit_id", "src", "dst", F.lit("CD").alias("type"))
    direct = wire.unionByName(control)
    pairs = directed_pairs if directed_pairs is not None else couplings(ops, exactly_two=False).select("circuit_id", F.col("a").alias("qa"), F.col("b").alias("qb"))
    on = wires(ops).select("circuit_id", "pos", "q")
    first = pairs.join(on.select("circuit_id", F.col("q").alias("qa"), F.col("pos").alias("src")), ["circuit_id", "qa"])
    both = first.join(on.select("circuit_id", F.col("q").alias("qb"), F.col("pos").alias("dst")), ["circuit_id", "qb"]).where("src < dst")
    far = both.select("circuit_id", "src", "dst").distinct().join(direct.select("circuit_id", "src", "dst"), ["circuit_id", "src", "dst"], "left_anti")
    every = direct.unionByName(far.withColumn("type", F.lit("ED")))
    return every.groupBy("circuit_id", "src", "dst").agg(F.sort_array(F.collect_set("type")).alias("types"))  # at most four types


def edges_of_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.array_contains("types", kind))
