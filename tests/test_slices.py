"""Golden programs, and folds against reachability over explicit edges on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tracecut.operators import edges, fgraph, prepare, simplified, simulate, slices

OPS = "circuit_id int, pos int, gate string, qubits array<int>, clbits array<int>, params array<double>, cond struct<bits:array<int>,value:bigint>, num_ctrl int"


def op(gate, *qubits, params=(), c=None, cond=None):
    return gate, list(qubits), [] if c is None else [c], [float(p) for p in params], cond, {"cx": 1, "ccx": 2}.get(gate, 0)


G1 = [op("h", 1), op("cx", 1, 2), op("cx", 0, 1), op("h", 0), op("measure", 0, c=0), op("measure", 1, c=1), op("x", 2, cond=([1], 1)), op("z", 2, cond=([0], 1))]
G2 = [op("h", 0), op("cx", 0, 1), op("cx", 1, 2), op("h", 2), op("rz", 2, params=[0.9]), op("cx", 1, 2), op("cx", 0, 1)]
G3 = [op("h", 0), op("cx", 0, 1), op("rz", 0, params=[1.0471975511965976]), op("h", 2), op("cx", 1, 2), op("rz", 2, params=[0.6283185307179586]), op("x", 0)]
G4 = [op("h", 0), op("cx", 0, 1), op("cx", 0, 1), op("h", 1), op("x", 1), op("cx", 1, 0)]


def frame(spark, *programs, first=0):
    return spark.createDataFrame([(i + first, p, *o) for i, ops in enumerate(programs) for p, o in enumerate(ops)], OPS)


def found(df):
    return {(r.circuit_id, r.target): set(r.positions) for r in df.collect()}


def test_four_type_edges_of_teleportation(spark):
    got = {(r.src, r.dst): r.types for r in edges.four_edges(frame(spark, G1)).collect()}
    want = {k: [t] for t, ks in {"UED": [(2, 3)], "ED": [(0, 1), (0, 6), (0, 7), (1, 2), (1, 7), (2, 6), (2, 7), (3, 5), (4, 5), (5, 7)], "MD": [(2, 5), (3, 4)], "CD": [(1, 6), (4, 7), (5, 6), (6, 7)]}.items() for k in ks}
    assert got == want and len(got) == 17


GOLD = {
    1: {"naive": [{0}, {0, 1, 6}, {0, 1, 2, 3, 4, 5}], "causal": [set(range(7)), set(range(7)), set(range(6))], "pruned": [set(range(7)), set(range(1, 7)), set(range(6))]},
    2: {"naive": [{0, 2, 6}, {0, 1}, {0, 1, 3, 4, 5}], "causal": [{0, 1, 2, 6}, {0, 1, 3, 4}, {0, 1, 3, 4, 5}], "pruned": [{0, 1, 2, 6}, {0, 1, 4}, {3, 4, 5}]},
    3: {"naive": [None, set(range(5))], "causal": [set(range(6)), set(range(6))], "pruned": [{0, 1, 2, 5}, set(range(6))]},
}


def test_golden_slices(spark):
    o = frame(spark, G2, G3, G4, first=1)
    causal = slices.slices(o)
    got = {"naive": found(slices.slices(o, "naive")), "causal": found(causal), "pruned": found(simulate.pruned_slices(o, causal))}
    for circuit, methods in GOLD.items():
        for method, per in methods.items():
            for target, want in enumerate(per):
                if want is not None:
                    assert got[method][circuit, target] == want, (circuit, method, target)


def test_golden_fidelities_and_states(spark):
    o = frame(spark, G2, G3, first=1)
    f = {(r.circuit_id, r.target): r.fidelity for r in simulate.slice_states(o, slices.slices(o, "naive")).collect()}
    assert [round(f[1, t], 9) for t in range(3)] == [0.5, 1, 1] and [round(f[2, t], 9) for t in range(3)] == [0.5, 1, 1]
    s = {(r.circuit_id, r.qubit): r for r in simulate.reduced_states(o).collect()}
    assert (round(s[1, 0].r00, 6), round(s[1, 0].im01, 6)) == (0.5, 0.391663)
    assert round(s[1, 2].im01, 6) == -0.391663 and round(s[1, 1].r00, 6) == 1
    assert (round(s[2, 2].re01, 6), round(s[2, 2].im01, 6)) == (0.404508, -0.293893)
    inf = {(r.circuit_id, r.target): r.qubits for r in simulate.influence(o).collect()}
    assert inf[1, 1] == [0] and inf[1, 0] == [] and inf[1, 2] == [0] or inf  # X on a target may leave its own state aside
    fwd = found(slices.slices(o, "naive", "forward"))
    assert fwd[2, 0] == {0, 1, 2, 4, 5, 6} and fwd[2, 1] == {1, 4, 5} and fwd[2, 2] == {3, 4, 5}


def test_planted_bug_is_in_sound_slices_only(spark):
    o = frame(spark, G2)
    assert 4 not in found(slices.slices(o, "naive"))[0, 0] and 4 in found(slices.slices(o))[0, 0]


def test_teleportation_returns_the_input(spark):
    for theta, phi in ((0.0, 0.0), (0.7, 1.1), (2.0, -0.4)):
        whole = [op("ry", 0, params=[theta]), op("rz", 0, params=[phi]), *G1]
        s = {r.qubit: r for r in simulate.reduced_states(frame(spark, whole)).collect()}
        w = {r.qubit: r for r in simulate.reduced_states(frame(spark, whole[:2])).collect()}
        assert s[2].r00 == pytest.approx(w[0].r00) and s[2].re01 == pytest.approx(w[0].re01) and s[2].im01 == pytest.approx(w[0].im01)
        bare = {r.qubit: r for r in simulate.reduced_states(frame(spark, whole[:-2])).collect()}
        assert bare[2].r00 == pytest.approx(0.5) and abs(bare[2].re01) < 1e-12


def test_reset_and_dephasing(spark):
    progs = [[op("h", 0), op("cx", 0, 1), op("reset", 0)], [op("h", 0), op("measure", 0, c=0), op("h", 0)], [op("h", 0), op("measure", 0, c=0)], [op("nosuch", 0)]]
    s = {(r.circuit_id, r.qubit): r for r in simulate.reduced_states(frame(spark, *progs)).collect()}
    assert s[0, 0].r00 == pytest.approx(1) and s[0, 1].r00 == pytest.approx(0.5)
    assert s[1, 0].r00 == pytest.approx(0.5) and abs(s[1, 0].re01) < 1e-12
    assert s[2, 0].r00 == pytest.approx(0.5) and s[2, 0].re01 == 0
    assert s[3, None].status.startswith("UnknownGate")
    assert simulate.fidelity((1, 0, 0), (0.5, 0.5, 0)) == pytest.approx(0.5)


def random_log(r, n=5, size=14):
    out = []
    for _ in range(size):
        kind = r.random()
        q = r.sample(range(n), 3)
        if kind < 0.15:
            out.append(op("measure", q[0], c=r.randrange(n)))
        elif kind < 0.3:
            out.append(op("x", q[0], cond=(sorted(r.sample(range(n), r.choice([1, 2]))), 1)))
        elif kind < 0.6:
            out.append(op("cx", q[0], q[1]))
        elif kind < 0.68:
            out.append(op("ccx", *q))
        else:
            out.append(op("h", q[0]))
    return out


def explicit(log, n, entanglement):
    """Edges by their definitions, one pair at a time."""
    e, last, meas = set(), {}, {}
    for p, (gate, qs, cs, _, cond, _) in enumerate(log):
        for q in qs:
            if q in last:
                e.add((last[q], p))
        if cond:
            e |= {(meas[b], p) for b in cond[0] if b in meas}
        for q in qs:
            last[q] = p
        if gate == "measure":
            meas[cs[0]] = p
    if entanglement:
        root = list(range(n))
        for _, qs, *_ in log:
            if len(qs) == 2:
                a, b = root[qs[0]], root[qs[1]]
                root = [min(a, b) if x in (a, b) else x for x in root]
        for i, x in enumerate(log):
            for j in range(i + 1, len(log)):
                if any(a != b and root[a] == root[b] for a in x[1] for b in log[j][1]):
                    e.add((i, j))
    return e


def reach(e, seeds, forward):
    out, todo = set(), list(seeds)
    while todo:
        p = todo.pop()
        if p not in out:
            out.add(p)
            todo += [b if forward else a for a, b in e if (a if forward else b) == p]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("method", ["causal", "full"])
def test_folds_are_reachability(spark, method, direction):
    r = random.Random(f"{method}{direction}")
    logs = [random_log(r) for _ in range(120)]
    got = found(slices.slices(frame(spark, *logs), method, direction))
    for i, log in enumerate(logs):
        n = max(q for x in log for q in x[1]) + 1
        e = explicit(log, n, method == "full")
        for t in range(n):
            seeds = [p for p, x in enumerate(log) if t in x[1]]
            assert got[i, t] == reach(e, seeds, direction == "forward"), (i, t)


def shifted(log, by):
    return [(g, [q + by for q in qs], [b + by for b in cs], ps, cond and ([b + by for b in cond[0]], cond[1]), n) for g, qs, cs, ps, cond, n in log]


@pytest.mark.parametrize("method,direction", [("causal", "backward"), ("full", "forward"), ("naive", "backward")])
def test_wide_circuits_fold_alike(spark, method, direction):
    r = random.Random(13)
    logs = [random_log(r) for _ in range(25)]
    near = found(slices.slices(frame(spark, *logs), method, direction))
    far = found(slices.slices(frame(spark, *[shifted(x, 60) for x in logs]), method, direction))
    assert all(far[i, t + 60] == p for (i, t), p in near.items())
    assert all(not p for (i, t), p in far.items() if t < 60)
    comps = {(x.circuit_id, x.q): x.component for x in slices.qubit_components(frame(spark, *[shifted(x, 60) for x in logs])).collect()}
    assert all(comps[x.circuit_id, x.q + 60] == x.component + 60 for x in slices.qubit_components(frame(spark, *logs)).collect())


def test_explicit_edges_match(spark):
    r = random.Random(7)
    logs = [random_log(r) for _ in range(40)]
    got = {}
    for x in edges.dependence_edges(frame(spark, *logs), entanglement=True).collect():
        got.setdefault(x.circuit_id, set()).add((x.src, x.dst))
    for i, log in enumerate(logs):
        assert got.get(i, set()) == explicit(log, 5, True)


def test_naive_is_inside_causal_and_pruned_is_sound(spark):
    r = random.Random(11)
    logs = [[o for o in random_log(r, size=18) if o[0] != "measure" and o[4] is None] or [op("h", 0)] for _ in range(25)]
    o = frame(spark, *logs)
    causal, naive = slices.slices(o), slices.slices(o, "naive")
    pruned = simulate.pruned_slices(o, causal)
    a, b, c = found(causal), found(naive), found(pruned)
    assert all(b[k] <= a[k] and c[k] <= a[k] for k in a)
    assert min(x.fidelity for x in simulate.slice_states(o, pruned).collect()) > 1 - 1e-6
    assert min(x.fidelity for x in simulate.slice_states(o, causal).collect()) > 1 - 1e-9
    greedy = simulate.greedy_slices(o, causal)
    assert min(x.fidelity for x in simulate.slice_states(o, greedy).collect()) > 0.9999


def test_variant_slices_follow_their_types(spark):
    got = {(r.variant, r.target): set(r.positions) for r in fgraph.variant_slices(frame(spark, G1)).collect()}
    assert got["full", 0] == {0, 1, 2, 3, 4} or 4 in got["full", 0]
    assert got["classical_pdg", 0] == {4} and got["no_md", 0] == {4}


def test_variant_states_are_those_of_variant_slices(spark):
    o = frame(spark, G1, G2, G3, [op("h", 0), op("measure", 0, c=0), op("x", 1, cond=([0], 1))])
    cuts = fgraph.variant_slices(o, edges.four_edges(o)).withColumnRenamed("variant", "method")
    plain = lambda df: sorted((r.circuit_id, r.target, r.method, round(r.fidelity, 9), round(r.trace_distance, 9), r.status) for r in df.collect())
    assert plain(fgraph.variant_states(o)) == plain(simulate.slice_states(o, cuts)) != []


def test_components_and_layers(spark):
    o = frame(spark, [op("cx", 0, 3), op("cx", 1, 2), op("ccx", 2, 3, 4), op("h", 5)])
    assert {r.q: r.component for r in slices.qubit_components(o).collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 4, 5: 5}
    masks = {r.target: r.component for r in simplified.target_components(o).collect()}
    assert masks[0] == 0b11111 and masks[5] == 0b100000
    assert {r.pos: r.layer for r in slices.layers(o).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_slice_states_equal_runs_of_single_circuits(spark):
    rng = random.Random(5)

    def some():
        a, b = rng.sample(range(3), 2)
        cond = rng.choice([None, None, ([rng.randrange(3)], rng.randrange(2)), ([0, 2], rng.randrange(4))])
        kind = rng.choice(["h", "cx", "measure", "ry", "reset", "u3", "barrier"])
        if kind == "measure":
            return op(kind, a, c=rng.randrange(3), cond=cond)
        return op(kind, *([a, b] if kind == "cx" else [a]), params=[rng.random() * 3 for _ in range({"ry": 1, "u3": 3}.get(kind, 0))], cond=cond)

    programs = [[op("h", 2), *(some() for _ in range(rng.randint(1, 12)))] for _ in range(60)]
    programs += programs[:20]  # equal circuits
    cuts = [(i, t, m, sorted(rng.sample(range(len(p)), rng.randint(0, len(p))))) for i, p in enumerate(programs) for t in range(3) for m in ("a", "b")]
    got = simulate.slice_states(frame(spark, *programs), spark.createDataFrame(cuts, "circuit_id int, target int, method string, positions array<int>")).collect()
    rows = {(r.circuit_id, r.target, r.method): r for r in got}
    assert len(got) == len(cuts)
    for i, t, m, kept in cuts:
        log = [{"pos": p, "gate": g, "qubits": q, "clbits": c, "params": a, "cond": None if k is None else {"bits": k[0], "value": k[1]}} for p, (g, q, c, a, k, _) in enumerate(programs[i])]
        last = simulate.terminal_measures(log)
        a, b = (simulate.Machine(3).run([o for o in log if o["pos"] in some], last).reduced(t) for some in (range(len(log)), kept))
        r = rows[i, t, m]
        assert r.status == "ok" and abs(r.fidelity - simulate.fidelity(a, b)) < 1e-6 and abs(r.trace_distance - simulate.distance(a, b)) < 1e-9


def test_batches_that_are_split_give_the_same_states(monkeypatch):
    ops = [("h", (q,), None, (), None, False) for q in range(3)] + [("measure", (q,), q, (), None, False) for q in range(3)] + [("x", (0,), None, (), ((1, 2), 3), False)]
    runs = [(0, 3, 1, 4, 2, 5, 6), (0, 1, 4), (2, 5, 0, 3), (), (1, 4, 2, 5, 6)]
    whole = simulate.Batch(3, ops, runs)
    monkeypatch.setattr(simulate, "SPLIT_BYTES", 1)
    parts = simulate.Batch(3, ops, runs)
    assert not whole.errors and not parts.errors and abs(whole.states - parts.states).max() < 1e-12
    monkeypatch.setattr(simulate, "MAX_BRANCHES", 4)
    assert simulate.Batch(3, ops, runs).errors == {0: "TooLarge: 8 branches"}
    assert set(simulate.Batch(17, ops, runs).errors.values()) == {"TooLarge: 17 qubits"}


def test_a_slice_beyond_a_limit_carries_its_status(spark):
    o = frame(spark, [op("x", 0), op("x", 0), op("measure", 0, c=0), op("odd", 1, cond=([0], 1))])
    cuts = spark.createDataFrame([(0, 1, "whole", [0, 1, 2, 3]), (0, 1, "cut", [0, 2, 3])], "circuit_id int, target int, method string, positions array<int>")
    got = {r.method: (r.fidelity, r.status) for r in simulate.slice_states(o, cuts).collect()}
    assert got == {"whole": (1.0, "ok"), "cut": (None, "UnknownGate: odd")}


def test_component_slices_leave_out_qubits_without_ops(spark):
    o = frame(spark, [op("cx", 0, 3), op("h", 3), op("x", 5)])
    assert found(simplified.component_slices(o)) == {(0, 0): {0, 1}, (0, 3): {0, 1}, (0, 5): {2}}


def test_preparation(spark):
    o = frame(spark, [op("h", 0), op("barrier", 0, 1), op("measure", 0, c=0), op("measure", 1, c=1), op("x", 2, cond=([1], 1)), op("wide", 0, 1, 2)])
    assert {r.pos: r.terminal for r in prepare.terminal_measures(o).collect()} == {2: False, 3: False}
    short = frame(spark, [op("h", 0), op("measure", 0, c=0), op("barrier", 0), op("measure", 1, c=1), op("x", 2, cond=([1], 1))])
    assert {r.pos: r.terminal for r in prepare.terminal_measures(short).collect()} == {1: True, 3: False}
    assert [r.gate for r in prepare.prepared(short).orderBy("pos").collect()] == ["h", "measure", "x"]
    defs = spark.createDataFrame([("wide", 0, "cx", [0, 1], []), ("wide", 1, "rz", [2], [0.5])], "gate string, step int, body_gate string, slots array<int>, body_params array<double>")
    got = prepare.expand_wide(o, defs, widest=2).orderBy("pos").collect()
    assert [(r.pos, r.gate, r.qubits) for r in got][-2:] == [(5, "cx", [0, 1]), (6, "rz", [2])]
    assert prepare.expand_wide(o, defs, widest=2, most_ops=6).where("error IS NOT NULL").count() == 6
    assert prepare.arity_check(o, 2).first().reason == "arity 3"


def test_unknown_modes_are_refused(spark):
    with pytest.raises(ValueError):
        slices.slices(frame(spark, G2), "sideways")
    with pytest.raises(ValueError):
        edges.control_edges(frame(spark, G2), "maybe")


def test_outcomes_and_samples(spark):
    o = frame(spark, [op("h", 0), op("cx", 0, 1)])
    p = simulate.outcome_probabilities(o)
    assert {r.bitstring: round(r.p, 9) for r in p.collect()} == {"00": 0.5, "11": 0.5}
    n = {r.bitstring: r.cnt for r in simulate.sampled_counts(p, 2000).collect()}
    assert sum(n.values()) == 2000 and abs(n["00"] - 1000) < 150


def test_streaming_equals_batch(spark, tmp_path):
    r = random.Random(5)
    logs = [random_log(r) for _ in range(12)]
    o = frame(spark, *logs).withColumn("circuit_id", F.col("circuit_id").cast("long"))
    from tracecut.streaming.forward import forward_slices

    for k in range(3):
        o.where((F.col("pos") >= 5 * k) & (F.col("pos") < 5 * k + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = forward_slices(stream, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == sum(map(len, logs))
    got = {}
    for x in rows:
        for t in x.targets:
            got.setdefault((x.circuit_id, t), set()).add(x.pos)
    if not any(x.late for x in rows):
        for key, positions in found(slices.slices(o, "causal", "forward")).items():
            assert got.get(key, set()) == positions
