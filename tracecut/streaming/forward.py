"""Forward slices of operation logs as they arrive, in program order for each circuit.

State for each circuit: the affected qubits and bits of every target, and the last position seen. Ops that come out of
order are told apart instead of being folded wrongly; backward slices need the end of a log and do not stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "circuit_id long, pos int, targets array<int>, late boolean"
STATE = "qubits array<long>, bits array<long>, last int"


def _fold(ops: list[dict], qubits: list[int], bits: list[int], last: int):
    """Targets whose forward slice each op joins, and the new state."""
    out = []
    for o in ops:
        if o["pos"] <= last:
            out.append((o["pos"], [], True))
            continue
        last = o["pos"]
        mask = sum(1 << int(q) for q in o["qubits"])
        reads = sum(1 << int(b) for b in o["reads"])
        defines = sum(1 << int(b) for b in o["clbits"]) if o["gate"] == "measure" else 0
        joined = []
        for t in range(len(qubits)):
            if mask & qubits[t] or reads & bits[t]:
                joined.append(t)
                qubits[t] |= mask
                bits[t] |= defines
            else:
                bits[t] &= ~defines
        out.append((o["pos"], joined, False))
    return out, qubits, bits, last


def forward_slices(ops: DataFrame, n_qubits: int) -> DataFrame:
    """(circuit_id, pos, targets, late) of a stream of ops (circuit_id, pos, gate, qubits, clbits, cond)."""
    reads = F.coalesce("cond.bits", F.array().cast("array<int>"))
    rows = ops.select("circuit_id", "pos", "gate", "qubits", "clbits", reads.alias("reads"))

    def run(key, frames: Iterator[pd.DataFrame], state):
        held = state.get if state.exists else ([1 << t for t in range(n_qubits)], [0] * n_qubits, -1)
        batch = sorted((r for f in frames for r in f.to_dict("records")), key=lambda r: r["pos"])
        out, qubits, bits, last = _fold(batch, [int(x) for x in held[0]], [int(x) for x in held[1]], int(held[2]))
        state.update((qubits, bits, last))
        yield pd.DataFrame([(key[0], p, t, late) for p, t, late in out], columns=["circuit_id", "pos", "targets", "late"])

    return rows.groupBy("circuit_id").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
