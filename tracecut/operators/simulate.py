"""Exact simulation of operation logs, one circuit a row, all branches of its measurements at once.

A circuit's state is an array of branches by amplitudes, bit q of an index being qubit q. Gates act on all branches
together; a measure or reset splits the branches whose outcome is open; a terminal measure only dephases its qubit. Rows
carry a status: no sampling, and no result in place of one that could not be computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import MEASURES, PASSIVE, UnknownGate, matrix
from .layout import by_circuit

MAX_QUBITS, MAX_BRANCHES, TINY = 16, 4096, 1e-14
PREPARE, INFLUENCED, SOUND = 1e-9, 1e-9, 1e-6

LOG = "array<struct<pos:int,gate:string,qubits:array<int>,clbits:array<int>,params:array<double>,cond:struct<bits:array<int>,value:bigint>>>"


class TooLarge(ValueError):
    """Beyond the limit of qubits or branches."""


def op_rows(ops: DataFrame) -> DataFrame:
    """(circuit_id, n_qubits, log): one row for each circuit, its ops in order."""
    row = F.struct("pos", "gate", "qubits", "clbits", "params", "cond")
    width = F.max(F.array_max("qubits")) + 1
    kept = F.sort_array(F.collect_list(F.struct(F.col("pos").alias("k"), row.alias("v"))).cast(f"array<struct<k:int,v:{LOG[6:-1]}>>"))
    return by_circuit(ops).groupBy("circuit_id").agg(width.alias("n_qubits"), F.transform(kept, lambda x: x["v"]).alias("log"))


_places: dict[tuple[int, tuple[int, ...]], np.ndarray] = {}


def places(n: int, qubits: tuple[int, ...]) -> np.ndarray:
    """Indices of all amplitudes: a row for each value of the qubits (the first the lowest bit), a column for the rest."""
    key = (n, qubits)
    if key not in _places:
        if len(_places) > 20_000:
            _places.clear()
        index = np.arange(1 << n)
        value, rest = np.zeros_like(index), index.copy()
        for j, q in enumerate(qubits):
            value |= ((index >> q) & 1) << j
            rest &= ~(1 << q)
        _places[key] = index[np.lexsort((rest, value))].reshape(1 << len(qubits), -1)
    return _places[key]


class Machine:
    """Branches of one run: amplitudes (branch, index), probabilities and classical bits."""

    def __init__(self, n: int, flips: tuple[int, ...] = ()):
        if n > MAX_QUBITS:
            raise TooLarge(f"{n} qubits")
        self.n, self.psi = n, np.zeros((1, 1 << n), complex)
        self.psi[0, sum(1 << q for q in flips)] = 1
        self.prob, self.bits, self.dephased = np.ones(1), [{}], set()
        self.cache: dict[tuple, np.ndarray] = {}

    def _matrix(self, gate: str, params: tuple[float, ...]) -> np.ndarray:
        if (gate, params) not in self.cache:
            self.cache[gate, params] = matrix(gate, params)
        return self.cache[gate, params]

    def gate(self, name: str, qubits: list[int], params: tuple[float, ...], rows: np.ndarray | None = None) -> None:
        m = self._matrix(name, params)
        k = len(qubits)
        if m.shape[0] != 1 << k:
            raise UnknownGate(f"{name} on {k} qubits")
        at = places(self.n, tuple(qubits))
        if rows is None:
            self.psi[:, at] = m @ self.psi[:, at]
        else:
            some = self.psi[rows]
            some[:, at] = m @ some[:, at]
            self.psi[rows] = some

    def project(self, q: int, bit: int | None, flip: bool, rows: np.ndarray | None = None) -> None:
        """Measure ``q`` into ``bit``, or reset it (``flip`` back to 0), on the branches of ``rows``."""
        index = np.arange(1 << self.n)
        one = (index >> q) & 1 == 1
        chosen = np.ones(len(self.psi), bool) if rows is None else rows
        psi, prob, bits = [self.psi[~chosen]], [self.prob[~chosen]], [b for b, c in zip(self.bits, chosen, strict=True) if not c]
        here = self.psi[chosen]
        held = [b for b, c in zip(self.bits, chosen, strict=True) if c]
        for outcome in (0, 1):
            part = np.where(one == bool(outcome), here, 0)
            p = (np.abs(part) ** 2).sum(axis=1)
            ok = p > TINY
            part = part[ok] / np.sqrt(p[ok])[:, None]
            if flip and outcome:
                part = part[:, index ^ (1 << q)]
            psi.append(part)
            prob.append(self.prob[chosen][ok] * p[ok])
            bits += [b if bit is None else {**b, bit: outcome} for b, k in zip(held, ok, strict=True) if k]
        self.psi, self.prob, self.bits = np.concatenate(psi), np.concatenate(prob), bits
        if len(self.psi) > MAX_BRANCHES:
            raise TooLarge(f"{len(self.psi)} branches")

    def run(self, log: list, terminal: set[int]) -> Machine:
        for op in log:
            gate, qubits, params = op["gate"], [int(q) for q in op["qubits"]], tuple(float(p) for p in op["params"])
            if gate in PASSIVE:
                continue
            rows = None
            cond = op["cond"]
            if cond is not None:
                rows = np.array([sum(b.get(int(i), 0) << k for k, i in enumerate(cond["bits"])) == cond["value"] for b in self.bits])
                if not rows.any():
                    continue
            if gate == "measure":
                if op["pos"] in terminal:
                    self.dephased.add(qubits[0])
                else:
                    self.project(qubits[0], int(op["clbits"][0]) if len(op["clbits"]) else None, False, rows)
            elif gate == "reset":
                self.project(qubits[0], None, True, rows)
            else:
                self.gate(gate, qubits, params, rows)
        return self

    def reduced(self, q: int) -> tuple[float, float, complex]:
        """r00, r11 and the upper off-diagonal of one qubit."""
        v = self.psi[:, places(self.n, (q,))]
        zero, one = v[:, 0], v[:, 1]
        off = complex((self.prob * (zero * one.conj()).sum(axis=1)).sum())
        return float((self.prob * (np.abs(zero) ** 2).sum(axis=1)).sum()), float((self.prob * (np.abs(one) ** 2).sum(axis=1)).sum()), 0j if q in self.dephased else off

    def pair(self, a: int, b: int) -> np.ndarray:
        """4x4 reduced state of two qubits of a pure run."""
        v = self.psi[0][places(self.n, (a, b))]
        return v @ v.conj().T


def terminal_measures(log: list) -> set[int]:
    """Positions of measures that no later op touches and no later condition reads."""
    touched: set[int] = set()
    read: set[int] = set()
    out = set()
    for op in reversed(log):
        if op["gate"] in PASSIVE:
            continue
        bits = [int(b) for b in op["clbits"]]
        if op["gate"] == "measure" and op["cond"] is None and not touched & {int(q) for q in op["qubits"]} and not read & set(bits):
            out.add(op["pos"])
        touched |= {int(q) for q in op["qubits"]}
        if op["cond"] is not None:
            read |= {int(b) for b in op["cond"]["bits"]}
    return out


def distance(a: tuple, b: tuple) -> float:
    d, off = (a[0] - b[0] - a[1] + b[1]) / 2, a[2] - b[2]
    return float(np.sqrt(d * d + abs(off) ** 2))


def _row_status(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _map(rows: DataFrame, f, schema: str) -> DataFrame:
    """``f(row)`` yields tuples of the schema for each row; rows are dealt by the cost of their simulation."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            out = [t for r in frame.to_dict("records") for t in f(r)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _n(r: dict) -> int:
    return int(r["n_qubits"])


def reduced_states(ops: DataFrame) -> DataFrame:
    """(circuit_id, qubit, r00, r11, re01, im01, status) of every qubit after the whole log."""
    kind = dict(ops.dtypes)["circuit_id"]

    def states(r: dict):
        try:
            m = Machine(_n(r)).run(r["log"], terminal_measures(r["log"]))
        except (TooLarge, UnknownGate) as e:
            yield (r["circuit_id"], None, None, None, None, None, _row_status(e))
            return
        for q in range(_n(r)):
            a, b, c = m.reduced(q)
            yield (r["circuit_id"], q, a, b, c.real, c.imag, "ok")

    return _map(op_rows(ops), states, f"circuit_id {kind}, qubit int, r00 double, r11 double, re01 double, im01 double, status string")


#: Bytes of amplitudes that a batch of runs starts with, and beyond which it is split by runs.
BATCH_BYTES, SPLIT_BYTES = 4 << 20, 16 << 20


class Batch:
    """Runs of many circuits of one width: all branches of all runs in one array, one op of each run a step.

    The runs and results are those of ``Machine``; ops of a step with the same gate, qubits and condition act together.
    """

    def __init__(self, n: int, ops: list[tuple], programs: list[tuple[int, ...]]):
        """``ops``: (gate, qubits, clbit, params, cond, terminal) by number; ``programs``: numbers of each run's ops."""
        self.n, self.ops, self.index = n, ops, np.arange(1 << n)
        self.states = np.zeros((len(programs), n, 4))
        self.errors: dict[int, str] = {}
        used = sorted({i for p in programs for i in p})
        self.column = {b: k for k, b in enumerate(sorted({b for i in used if ops[i][4] for b in ops[i][4][0]}))}
        groups: dict[tuple, int] = {}
        self.group, self.first = np.full(len(ops) + 1, -1), []
        for i in used:
            gate, qubits, clbit, _, cond, terminal = ops[i]
            key = (gate, qubits, clbit, cond, terminal)
            if key not in groups:
                groups[key] = len(self.first)
                self.first.append(ops[i])
            self.group[i] = groups[key]
        self.length = np.array([len(p) for p in programs], int)
        self.program = np.full((len(programs), max(1, self.length.max(initial=0))), -1)
        for k, p in enumerate(programs):
            self.program[k, : len(p)] = p
        self.dephased = np.zeros((len(programs), n), bool)
        some = max(1, BATCH_BYTES // (16 << n))
        for at in range(0, len(programs) if n <= MAX_QUBITS else 0, some):
            self._run(np.arange(at, min(at + some, len(programs))))
        if n > MAX_QUBITS:
            self.errors = dict.fromkeys(range(len(programs)), _row_status(TooLarge(f"{n} qubits")))

    def _run(self, run: np.ndarray) -> None:
        psi = np.zeros((len(run), 1 << self.n), complex)
        psi[:, 0] = 1
        todo = [(0, psi, np.ones(len(run)), np.zeros((len(run), len(self.column)), bool), run)]
        del psi
        while todo:
            t, *state = todo.pop()
            while len(state[3]) and t < self.length[state[3]].max():
                state = self._step(t, *state)
                t += 1
                runs = np.unique(state[3])
                if state[0].nbytes > SPLIT_BYTES and len(runs) > 1:
                    low = state[3] < runs[len(runs) // 2]
                    todo.append((t, *(x[~low] for x in state)))
                    state = [x[low] for x in state]
            self._reduce(*state)

    def _step(self, t: int, psi: np.ndarray, prob: np.ndarray, bits: np.ndarray, run: np.ndarray) -> list:
        op = self.program[run, t]
        group = self.group[op]
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-2))
        still, split = np.ones(len(run), bool), []
        for at in np.split(order, starts[1:]):
            if not len(at) or group[at[0]] < 0:
                continue
            gate, qubits, clbit, _, cond, terminal = self.first[group[at[0]]]
            if gate in PASSIVE:
                continue
            if cond is not None:
                value = cond[1]
                if value < 0 or value >> len(cond[0]):
                    continue
                want = np.array([value >> k & 1 for k in range(len(cond[0]))], bool)
                at = at[(bits[np.ix_(at, [self.column[b] for b in cond[0]])] == want).all(axis=1)]
                if not len(at):
                    continue
            if gate == "measure" and terminal:
                self.dephased[run[at], qubits[0]] = True
            elif gate in MEASURES:
                still[at] = False
                split += self._project(gate, qubits[0], clbit, psi[at], prob[at], bits[at], run[at])
            else:
                self._gate(gate, qubits, psi, at, op, run)
        if split:
            state = [np.concatenate(x) for x in zip((psi[still], prob[still], bits[still], run[still]), *split, strict=True)]
        else:
            state = [psi, prob, bits, run]
        count = np.bincount(state[3], minlength=1)
        for r in np.flatnonzero(count > MAX_BRANCHES):
            self.errors.setdefault(int(r), _row_status(TooLarge(f"{count[r]} branches")))
        if self.errors:
            here = ~np.isin(state[3], list(self.errors))
            state = state if here.all() else [x[here] for x in state]
        return state

    def _gate(self, gate: str, qubits: tuple[int, ...], psi: np.ndarray, at: np.ndarray, op: np.ndarray, run: np.ndarray) -> None:
        kinds, which = np.unique(op[at], return_inverse=True)
        try:
            m = np.array([matrix(gate, self.ops[i][3]) for i in kinds])
            if m.shape[1] != 1 << len(qubits):
                raise UnknownGate(f"{gate} on {len(qubits)} qubits")
        except UnknownGate as e:
            self.errors |= dict.fromkeys(np.unique(run[at]).tolist(), _row_status(e))
            return
        on = places(self.n, qubits)
        some = psi[at]
        some[:, on] = (m[0] if len(m) == 1 else m[which]) @ some[:, on]
        psi[at] = some

    def _project(self, gate: str, q: int, clbit: int | None, psi: np.ndarray, prob: np.ndarray, bits: np.ndarray, run: np.ndarray) -> Iterator[tuple]:
        one = (self.index >> q) & 1 == 1
        for outcome in (False, True):
            part = np.where(one == outcome, psi, 0)
            p = (np.abs(part) ** 2).sum(axis=1)
            ok = p > TINY
            part = part[ok] / np.sqrt(p[ok])[:, None]
            known = bits[ok]
            if gate == "reset" and outcome:
                part = part[:, self.index ^ (1 << q)]
            if gate == "measure" and clbit in self.column:
                known[:, self.column[clbit]] = outcome
            yield part, prob[ok] * p[ok], known, run[ok]

    def _reduce(self, psi: np.ndarray, prob: np.ndarray, bits: np.ndarray, run: np.ndarray) -> None:
        runs, at = np.unique(run, return_inverse=True)
        for q in range(self.n):
            v = psi[:, places(self.n, (q,))]
            off = (v[:, 0] * v[:, 1].conj()).sum(axis=1)
            parts = ((np.abs(v[:, 0]) ** 2).sum(axis=1), (np.abs(v[:, 1]) ** 2).sum(axis=1), off.real, off.imag)
            for k, x in enumerate(parts):
                self.states[runs, q, k] = np.bincount(at, weights=prob * x, minlength=len(runs))
            self.states[runs[self.dephased[runs, q]], q, 2:] = 0


def _judged(circuits: list[dict], names: list[str]) -> pd.DataFrame:
    """Every slice of the circuits against its whole log; equal logs and slices of all of them are simulated once."""
    numbers: dict[tuple, int] = {}
    programs: dict[int, dict[tuple[int, ...], int]] = {}
    rows, wide, pairs = [], [], []
    for r in circuits:
        n, log = _n(r), r["log"]
        terminal = terminal_measures(log)
        mine = programs.setdefault(n, {})
        placed = []
        for o in log:
            cond = o["cond"]
            if cond is not None:
                cond = (tuple(int(b) for b in cond["bits"]), int(cond["value"]))
            clbit = int(o["clbits"][0]) if len(o["clbits"]) else None
            op = (o["gate"], tuple(int(q) for q in o["qubits"]), clbit, tuple(float(p) for p in o["params"]), cond, o["pos"] in terminal)
            placed.append((o["pos"], numbers.setdefault(op, len(numbers))))
        whole = mine.setdefault(tuple(i for _, i in placed), len(mine))
        seen: dict[tuple, int] = {}
        for s in r["slices"]:
            key = tuple(s["positions"])
            if key not in seen:
                kept = set(key)
                seen[key] = mine.setdefault(tuple(i for p, i in placed if p in kept), len(mine))
            rows.append((r["circuit_id"], int(s["target"]), s["method"]))
            wide.append(n)
            pairs.append((whole, seen[key]))
    wide, pairs, target = np.array(wide, int), np.array(pairs, int).reshape(-1, 2), np.array([t for _, t, _ in rows], int)
    ops, near = list(numbers), np.full((len(rows), 2), np.nan)
    status = np.full(len(rows), "ok", object)
    for n, some in programs.items():
        batch = Batch(n, ops, list(some))
        here = np.flatnonzero(wide == n)
        a, b = (batch.states[pairs[here, k], target[here]] for k in (0, 1))
        off = a[:, 2:] - b[:, 2:]
        d = (a[:, 0] - b[:, 0] - a[:, 1] + b[:, 1]) / 2
        det = [np.maximum(0.0, x[:, 0] * x[:, 1] - x[:, 2] ** 2 - x[:, 3] ** 2) for x in (a, b)]
        f = a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + 2 * (a[:, 2] * b[:, 2] + a[:, 3] * b[:, 3]) + 2 * np.sqrt(det[0] * det[1])
        near[here, 0], near[here, 1] = np.clip(f, 0.0, 1.0), np.sqrt(d * d + (off**2).sum(axis=1))
        if batch.errors:
            for i in here:
                e = batch.errors.get(int(pairs[i, 0])) or batch.errors.get(int(pairs[i, 1]))
                if e:
                    status[i], near[i] = e, np.nan
    out = pd.DataFrame(rows, columns=names[:3])
    return out.assign(fidelity=near[:, 0], trace_distance=near[:, 1], status=status)


def slice_states(ops: DataFrame, slices: DataFrame) -> DataFrame:
    """(circuit_id, target, method, fidelity, trace_distance, status): the target's state after a slice against the whole log.

    Circuits of a batch are simulated together, equal logs and slices once. A slice that passes a limit by itself carries
    its status; where the whole log does, all its slices do.
    """
    wanted = slices.groupBy("circuit_id").agg(F.collect_list(F.struct("target", "method", "positions")).alias("slices"))
    return judged(op_rows(ops).join(wanted, "circuit_id"), dict(ops.dtypes)["circuit_id"])


def judged(rows: DataFrame, kind: str, found: Callable[[dict], dict] = dict) -> DataFrame:
    """``slice_states`` of rows of ``op_rows`` with ``slices``, which ``found`` may add to a row."""

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield _judged([found(r) for r in frame.to_dict("records")], ["circuit_id", "target", "method"])

    return rows.mapInPandas(judge, f"circuit_id {kind}, target int, method string, fidelity double, trace_distance double, status string")


def fidelity(a: tuple, b: tuple) -> float:
    det = lambda s: max(0.0, s[0] * s[1] - abs(s[2]) ** 2)
    f = a[0] * b[0] + a[1] * b[1] + 2 * (a[2] * np.conj(b[2])).real + 2 * np.sqrt(det(a) * det(b))
    return float(min(1.0, max(0.0, f)))


def influence(ops: DataFrame) -> DataFrame:
    """(circuit_id, target, qubits, status): other qubits whose final state changes when the target starts in 1."""
    kind = dict(ops.dtypes)["circuit_id"]

    def truth(r: dict):
        log, n = list(r["log"]), _n(r)
        terminal = terminal_measures(log)
        try:
            base = Machine(n).run(log, terminal)
            before = [base.reduced(q) for q in range(n)]
            for t in range(n):
                m = Machine(n, (t,)).run(log, terminal)
                yield (r["circuit_id"], t, [q for q in range(n) if q != t and distance(before[q], m.reduced(q)) > INFLUENCED], "ok")
        except (TooLarge, UnknownGate) as e:
            yield (r["circuit_id"], None, None, _row_status(e))

    return _map(op_rows(ops), truth, f"circuit_id {kind}, target int, qubits array<int>, status string")


def entropy_bits(rho: np.ndarray) -> float:
    ev = np.linalg.eigvalsh(rho).real
    ev = ev[ev > 1e-12]
    return float(-(ev * np.log2(ev)).sum()) if len(ev) else 0.0


def _as_matrix(s: tuple) -> np.ndarray:
    return np.array([[s[0], s[2]], [np.conj(s[2]), s[1]]])


def mutual_information(m: Machine, a: int, b: int) -> float:
    return entropy_bits(_as_matrix(m.reduced(a))) + entropy_bits(_as_matrix(m.reduced(b))) - entropy_bits(m.pair(a, b))


def pair_information(ops: DataFrame) -> DataFrame:
    """(circuit_id, a, b, bits, status): mutual information of each pair of qubits after a log without open measurements."""
    kind = dict(ops.dtypes)["circuit_id"]

    def informed(r: dict):
        try:
            m = Machine(_n(r)).run(r["log"], set())
            if len(m.psi) > 1:
                raise TooLarge(f"{len(m.psi)} branches, one wanted")
        except (TooLarge, UnknownGate) as e:
            yield (r["circuit_id"], None, None, None, _row_status(e))
            return
        for a in range(m.n):
            for b in range(a + 1, m.n):
                yield (r["circuit_id"], a, b, mutual_information(m, a, b), "ok")

    return _map(op_rows(ops), informed, f"circuit_id {kind}, a int, b int, bits double, status string")


def separable(psi: np.ndarray, n: int, a: int, b: int, eps: float) -> bool:
    """Whether two qubits of a pure state carry less than ``eps`` bits of mutual information.

    The squared distance from the product of both states bounds it from below, which settles most pairs without
    eigenvalues.
    """
    v = psi[places(n, (a, b))]
    rho = v @ v.conj().T
    t = rho.reshape(2, 2, 2, 2)  # (b, a, b', a')
    ra, rb = t[0, :, 0, :] + t[1, :, 1, :], t[:, 0, :, 0] + t[:, 1, :, 1]
    gap = rho - np.kron(rb, ra)
    if (gap.real**2 + gap.imag**2).sum() > 2 * np.log(2) * eps:
        return False
    return entropy_bits(ra) + entropy_bits(rb) - entropy_bits(rho) < eps


#: Bytes of prefix states that one circuit's pruning keeps; beyond, trials start over from the first op.
PREFIX_BYTES = 256 << 20


def _prune(ops: list[tuple[int, np.ndarray, np.ndarray, list[int]]], n: int, cones: dict[int, list[int]], eps: float) -> dict[int, set[int]]:
    """Cones less the ops that separability nominates and a simulation confirms; ops are (pos, matrix, places, qubits)."""

    def run(psi: np.ndarray, some: list) -> np.ndarray:
        psi = psi.copy()
        for _, m, at, _ in some:
            psi[at] = m @ psi[at]
        return psi

    def state(psi: np.ndarray, q: int) -> tuple[float, float, complex]:
        v = psi[places(n, (q,))]
        rho = v @ v.conj().T
        return rho[0, 0].real, rho[1, 1].real, rho[0, 1]

    start = np.zeros(1 << n, complex)
    start[0] = 1
    by_pos = {o[0]: o for o in ops}
    beside = {t: {p for p in c if t not in by_pos[p][3]} for t, c in cones.items()}
    apart: dict[int, set[int]] = {t: set() for t in cones}
    psi = start
    for o in ops:
        psi = run(psi, [o])
        for t in cones:
            if o[0] in beside[t] and all(separable(psi, n, t, q, eps) for q in o[3]):
                apart[t].add(o[0])
    out = {}
    for t, cone in cones.items():
        kept, nominated, order = set(cone), apart[t], sorted(cone)
        want = state(psi, t)
        hold = len(order) * (16 << n) <= PREFIX_BYTES
        before, now = [], start
        if nominated and hold:
            for p in order:
                before.append(now)
                now = run(now, [by_pos[p]])
        after: list = []
        for i in range(len(order) - 1, -1, -1) if nominated else ():
            p = order[i]
            if p in nominated:
                here = before[i] if hold else run(start, [by_pos[x] for x in order[:i]])
                if distance(state(run(here, after), t), want) < eps:
                    kept.discard(p)
                    continue
            after.insert(0, by_pos[p])
        out[t] = kept
    return out


def pruned_slices(ops: DataFrame, causal: DataFrame, eps: float = PREPARE) -> DataFrame:
    """(circuit_id, target, method, direction, n_ops, positions): causal cones less what is separable from the target.

    Ops of the cone beside the target are nominated where all their qubits carry no mutual information with the target
    right after them, then dropped one by one from the end if the target's final state stays. Logs with measures, resets
    or conditions keep their cones. All targets of a circuit share one forward pass, and a trial runs only what follows the
    op it leaves out. ``status`` tells the cones that stay because of a limit or an unknown gate from those that were tried.
    """
    kind = dict(ops.dtypes)["circuit_id"]
    cones = causal.groupBy("circuit_id").agg(F.collect_list(F.struct("target", "positions")).alias("cones"), F.first("n_ops").alias("n_ops"))

    def prune(r: dict):
        log, n = list(r["log"]), _n(r)
        cones = {int(c["target"]): [int(p) for p in c["positions"]] for c in r["cones"]}
        kept = {t: set(c) for t, c in cones.items()}
        status = "ok" if n <= MAX_QUBITS else "too_large"
        if n <= MAX_QUBITS and all(o["gate"] not in MEASURES and o["cond"] is None for o in log):
            try:
                known: dict[tuple, np.ndarray] = {}
                rows = []
                for o in log:
                    if o["gate"] in PASSIVE:
                        continue
                    key, qubits = (o["gate"], tuple(float(p) for p in o["params"])), [int(q) for q in o["qubits"]]
                    if key not in known:
                        known[key] = matrix(*key)
                    rows.append((int(o["pos"]), known[key], places(n, tuple(qubits)), qubits))
                passive = {int(o["pos"]) for o in log if o["gate"] in PASSIVE}
                found = _prune(rows, n, {t: [p for p in c if p not in passive] for t, c in cones.items()}, eps)
                kept = {t: k | (passive & set(cones[t])) for t, k in found.items()}
            except UnknownGate as e:
                status = _row_status(e)
        for t, positions in kept.items():
            yield (r["circuit_id"], t, "pruned", "backward", int(r["n_ops"]), sorted(positions), status)

    return _map(op_rows(ops).join(cones, "circuit_id"), prune, f"circuit_id {kind}, target int, method string, direction string, n_ops int, positions array<int>, status string")


def greedy_slices(ops: DataFrame, start: DataFrame, least: float = 0.999999) -> DataFrame:
    """Delete and simulate again, from the end, while the target's fidelity stays at ``least``: the superseded refinement.
    Where a limit or an unknown gate ends it, ``status`` says so and the slice given stays."""
    kind = dict(ops.dtypes)["circuit_id"]
    given = start.groupBy("circuit_id").agg(F.collect_list(F.struct("target", "positions")).alias("cones"), F.first("n_ops").alias("n_ops"))

    def refine(r: dict):
        log, n = list(r["log"]), _n(r)
        terminal = terminal_measures(log)
        try:
            whole = Machine(n).run(log, terminal)
            for c in r["cones"]:
                t, kept = int(c["target"]), {int(p) for p in c["positions"]}
                want = whole.reduced(t)
                for p in sorted(kept, reverse=True):
                    trial = kept - {p}
                    if fidelity(Machine(n).run([o for o in log if o["pos"] in trial], terminal).reduced(t), want) >= least:
                        kept = trial
                yield (r["circuit_id"], t, "greedy", "backward", int(r["n_ops"]), sorted(kept), "ok")
        except (TooLarge, UnknownGate) as e:
            for c in r["cones"]:
                yield (r["circuit_id"], int(c["target"]), "greedy", "backward", int(r["n_ops"]), sorted(int(p) for p in c["positions"]), _row_status(e))

    return _map(op_rows(ops).join(given, "circuit_id"), refine, f"circuit_id {kind}, target int, method string, direction string, n_ops int, positions array<int>, status string")


def outcome_probabilities(ops: DataFrame) -> DataFrame:
    """(circuit_id, bitstring, p, status): exact distribution over all qubits, the highest leftmost."""
    kind = dict(ops.dtypes)["circuit_id"]

    def outcomes(r: dict):
        try:
            m = Machine(_n(r)).run(r["log"], terminal_measures(r["log"]))
        except (TooLarge, UnknownGate) as e:
            yield (r["circuit_id"], None, None, _row_status(e))
            return
        p = (m.prob[:, None] * np.abs(m.psi) ** 2).sum(axis=0)
        for i in np.flatnonzero(p > TINY):
            yield (r["circuit_id"], format(int(i), f"0{m.n}b"), float(p[i]), "ok")

    return _map(op_rows(ops), outcomes, f"circuit_id {kind}, bitstring string, p double, status string")


def sampled_counts(probabilities: DataFrame, shots: int, seed: int = 7) -> DataFrame:
    """(circuit_id, bitstring, cnt, n_bits): ``shots`` draws of each circuit's exact distribution, from a hash of the shot."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("circuit_id").orderBy("bitstring")
    table = probabilities.where("status = 'ok'").withColumn("high", F.sum("p").over(order)).withColumn("low", F.col("high") - F.col("p")).withColumn("last", F.lead("p").over(order).isNull())
    draws = table.select("circuit_id").distinct().withColumn("shot", F.explode(F.sequence(F.lit(1), F.lit(shots))))
    draws = draws.withColumn("u", F.pmod(F.xxhash64("circuit_id", "shot", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52))
    hit = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | F.col("last"))
    return draws.join(table, "circuit_id").where(hit).groupBy("circuit_id", "bitstring").agg(F.count(F.lit(1)).alias("cnt")).withColumn("n_bits", F.length("bitstring"))
