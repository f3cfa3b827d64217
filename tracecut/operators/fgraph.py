"""Slices of the consumer-typed graph for every edge-type variant, by bit-set reachability of one circuit at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import four_edges, wires
from .gates import MEASURES
from .layout import by_circuit
from .simulate import judged, op_rows

#: Edge types that each slicer variant follows.
VARIANTS = {
    "full": ("UED", "ED", "MD", "CD"),
    "classical_pdg": ("UED",),
    "causal_cone": ("UED", "ED"),
    "qiro": ("UED", "CD"),
    "no_ed": ("UED", "MD", "CD"),
    "no_md": ("UED", "ED", "CD"),
    "no_cd": ("UED", "ED", "MD"),
    "no_ued": ("ED", "MD", "CD"),
}


def criterion_seeds(ops: DataFrame) -> DataFrame:
    """(circuit_id, target, seeds): measures of the qubit where it has any, else all its ops."""
    on = wires(ops)
    m = F.col("gate").isin(*MEASURES)
    both = on.groupBy("circuit_id", F.col("q").alias("target")).agg(F.collect_set(F.when(m, F.col("pos"))).alias("measured"), F.collect_set("pos").alias("every"))
    return both.select("circuit_id", "target", F.when(F.size("measured") > 0, F.col("measured")).otherwise(F.col("every")).alias("seeds"))


def _with_edges(ops: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(circuit_id, seeds, src, dst, types): a circuit's criteria and typed edges in one row."""
    graph = four_edges(ops) if edges is None else edges
    lists = by_circuit(graph).groupBy("circuit_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"), F.collect_list(F.array_join("types", "+")).alias("types"))
    seeds = criterion_seeds(ops).groupBy("circuit_id").agg(F.collect_list(F.struct("target", "seeds")).alias("seeds"))
    return seeds.join(lists, "circuit_id", "left")


def _reach(r: dict) -> Iterator[tuple[int, str, list[int]]]:
    """(target, variant, positions) of one row of ``_with_edges``."""
    src, dst, types = ([] if r["src"] is None else r["src"]), r["dst"], r["types"]
    edges_of = [(int(a), int(b), set(t.split("+"))) for a, b, t in zip(src, dst, types, strict=True)] if len(src) else []
    for variant, enabled in VARIANTS.items():
        kept = set(enabled)
        before: dict[int, list[int]] = {}
        for a, b, t in edges_of:
            if t & kept:
                before.setdefault(b, []).append(a)
        # Edges go from earlier to later ops, so ancestors follow from one pass in program order.
        above: dict[int, int] = {}
        for b in sorted(before):
            bits = 1 << b
            for a in before[b]:
                bits |= above.get(a, 1 << a)
            above[b] = bits
        for s in r["seeds"]:
            bits = 0
            for p in s["seeds"]:
                bits |= above.get(int(p), 1 << int(p))
            yield int(s["target"]), variant, [i for i in range(bits.bit_length()) if bits >> i & 1]


def variant_slices(ops: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(circuit_id, target, variant, positions) of every variant and qubit with ops."""

    def reach(parts):
        for frame in parts:
            out = [(r["circuit_id"], *x) for r in frame.to_dict("records") for x in _reach(r)]
            yield pd.DataFrame(out, columns=["circuit_id", "target", "variant", "positions"])

    kind = dict(ops.dtypes)["circuit_id"]
    return _with_edges(ops, edges).mapInPandas(reach, f"circuit_id {kind}, target int, variant string, positions array<int>")


def variant_states(ops: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``slice_states`` of all variants' slices, named by method, without a shuffle of the slices."""

    def found(r: dict) -> dict:
        return {**r, "slices": [{"target": t, "method": v, "positions": p} for t, v, p in _reach(r)]}

    return judged(op_rows(ops).join(_with_edges(ops, edges), "circuit_id"), dict(ops.dtypes)["circuit_id"], found)
