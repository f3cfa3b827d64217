"""The OpenQASM reader, files in and out, and record readers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracecut.functions import tails
from tracecut.sources import files, qasm

PROGRAM = """OPENQASM 2.0;
include "qelib1.inc"; // comment
qreg a[2]; qreg b[1];
creg c[6]; creg d[2];
gate pair(t) x0,x1 { h x0; cx x0,x1; rz(t/2) x1; }
h a; h a[0];cx a[0],b[0];
u3(pi/2,-(pi/4),0.1) b[0];
rz(2^3) a[1];
pair(pi) a[0],b[0];
measure a -> d;
if(c==5) x a[0];
reset b[0];
barrier a;
"""


def test_faithful_reader():
    p = qasm.parse(PROGRAM)
    assert (p.n_qubits, p.n_clbits) == (3, 8)
    assert [o[0] for o in p.ops] == ["h", "h", "h", "cx", "u3", "rz", "pair", "measure", "measure", "x", "reset", "barrier"]
    assert p.ops[3][1] == [0, 2] and p.ops[4][3] == pytest.approx([math.pi / 2, -math.pi / 4, 0.1]) and p.ops[5][3] == [8.0]
    assert p.ops[7][1:3] == ([0], [6]) and p.ops[9][4] == ([0, 1, 2, 3, 4, 5], 5)
    assert [o[0] for o in qasm.parse(PROGRAM, expand_over=0).ops][6:9] == ["h", "cx", "rz"]
    assert qasm.parse(PROGRAM, expand_over=0).ops[8][3] == pytest.approx([math.pi / 2])


@pytest.mark.parametrize("text,problem", [("OPENQASM 3.0; qubit q;", "unsupported version"), ("", "empty"), ("OPENQASM 2.0; qreg q[1]; foo q[0];", "unknown gate"), ("OPENQASM 2.0; qreg q[1]; h q[3];", "index"), ("OPENQASM 2.0; qreg q[2]; cx q[0],q[0];", "repeated"), ("OPENQASM 2.0; qreg q[1]; rz(1/0) q[0];", "zero"), ("OPENQASM 2.0; qreg q[1]; rz(pi q[0];", "statement|bracket|expression")])
def test_errors_are_told(text, problem):
    with pytest.raises(qasm.QasmError, match=problem):
        qasm.parse(text)


@pytest.mark.parametrize("text,value", [("1+2*3", 7), ("-pi/2", -math.pi / 2), ("2^3^2", 512), ("sqrt(4)*cos(0)", 2), ("(1-2)-3", -4), ("1e-3", 0.001), ("-2^2", -4)])
def test_expressions(text, value):
    assert qasm.evaluate(text) == pytest.approx(value)
    assert qasm.evaluate_or_zero("import os") == 0.0
    assert qasm.split_args("u(1,2),3, f(4,(5,6))") == ["u(1,2)", "3", "f(4,(5,6))"]


def test_programs_from_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.qasm").write_text(PROGRAM)
    (tmp_path / "two.qasm").write_text("OPENQASM 3.0;")
    (tmp_path / "big.qasm").write_text("// " + "x" * 900_000)
    rows = qasm.read_ops(spark, str(tmp_path)).collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.pos is not None for r in rows) == 12
    programs = qasm.read_programs(spark, str(tmp_path))
    got = qasm.with_params(qasm.lenient_ops(programs)).orderBy("pos").collect()
    assert [(r.gate, r.qubits) for r in got] == [("h", [0]), ("cx", [0, 2]), ("u3", [2]), ("rz", [1])]
    assert got[2].params == pytest.approx([math.pi / 2, -math.pi / 4, 0.1]) and got[3].params == [8.0]
    peek = {r.path.rsplit("/")[-1]: r.n_qubits for r in qasm.peek(programs).collect()}
    assert peek == {"one.qasm": 3, "two.qasm": 0}
    tails.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM qasm_ops('OPENQASM 2.0; qreg q[3]; h q;')").first().n == 3
    assert spark.sql("SELECT erfc(0D) AS e, binom_test(1, 3) AS b").first()[:] == (1.0, 1.0)


def test_manifest_and_sinks(spark, tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / "a.txt").write_text("a")
    (d / "b.txt").write_text("b")
    have = files.digests(spark, str(d))
    manifest = have.select("path", F.when(F.col("path") == "b.txt", "0").otherwise(F.col("sha256")).alias("sha256")).unionByName(spark.createDataFrame([("c.txt", "1")], "path string, sha256 string"))
    assert sorted(map(tuple, files.verify_manifest(have, manifest).collect())) == [("b.txt", "differs"), ("c.txt", "absent")]
    assert len(files.combined_digest(have).first().sha256) == 64
    df = spark.createDataFrame([(1, 2.0, "x"), (2, float("nan"), "y")], "k int, v double, s string")
    files.write_csv(df, str(tmp_path / "csv"), single=True)
    files.write_json(df, str(tmp_path / "json"), "zero")
    assert {r.v for r in spark.read.json(str(tmp_path / "json")).collect()} == {2.0, 0.0}
    with pytest.raises(Exception, match="not finite"):
        files.write_json(df, str(tmp_path / "bad"))
    files.write_split(df, str(tmp_path / "split"), "s")
    assert (tmp_path / "split" / "s=x").exists()
    files.write_metadata(spark, str(tmp_path / "meta"), seed=3)
    assert spark.read.json(str(tmp_path / "meta")).first().seed == 3


def test_tolerant_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Circuit ID,fid\nc1,0.5\n")
    (tmp_path / "b.jsonl").write_text('{"circuitId": "c2", "extra": 1}\n')
    (tmp_path / "c.json").write_text('{"rows": [{"circuit_id": "c3", "fidelity": 1.0}]}')
    got = files.read_records(spark, [str(tmp_path / n) for n in ("a.csv", "b.jsonl", "c.json", "skip.txt")], {"fid": "fidelity"})
    assert {r.circuit_id for r in got.collect()} == {"c1", "c2", "c3"} and {"fidelity", "extra", "source_file"} <= set(got.columns)
    texts = [json.dumps(x) for x in ([{"a": 1, "b": "x"}], {"results": [{"a": 2, "b": "y"}]}, {"id7": {"a": 3, "b": "z"}})]
    assert sorted(r.a for r in files.raw_results(spark.createDataFrame([(t,) for t in texts], "text string"), "a int, b string").collect()) == [1, 2, 3]


def test_archives_are_unpacked_once(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in.qasm", "OPENQASM 2.0;")
        z.writestr("../out.qasm", "no")
    assert len(files.extract_archives(str(tmp_path))) == 1 and files.extract_archives(str(tmp_path)) == []
    assert (tmp_path / "in.qasm").exists() and not (tmp_path.parent / "out.qasm").exists()


def test_corpus_helpers(spark):
    c = spark.createDataFrame([("r2", "p2", "n", 2, 3, None), ("r1", "p9", "n", 2, 3, "bad"), ("r1", "p1", "m", 4, 5, None)], "root string, path string, name string, n_qubits int, n_ops int, error string")
    assert {r.path for r in files.first_by_stem(c).collect()} == {"p9", "p1"}
    assert [r.path for r in files.select_structural(c).collect()] == ["p2", "p1"]
    assert files.load_counters(c).first()[:] == (2, 1)
    assert files.require_total(c, 3).count() == 3
    with pytest.raises(Exception, match="fewer than 4"):
        files.require_total(c, 4).collect()
    assert files.lookup_fuzzy(spark.createDataFrame([("Grover_n8",)], "name string"), spark.createDataFrame([("grover", "g"), ("zz", "h")], "key string, path string")).first().path == "g"
    ops = files.synthetic_ops(spark, spark.createDataFrame([("ghz", 3), ("bell", 9)], "family string, n int"))
    assert files.with_final_measures(ops).groupBy("circuit_id").count().orderBy("circuit_id").collect()[0][1] == 4


def test_synthetic_circuits_do_what_their_names_say(spark):
    from tracecut.operators import simulate

    ops = files.synthetic_ops(spark, spark.createDataFrame([("teleport", 3), ("grover", 2), ("vqe", 3), ("bell", 2), ("grover", 1)], "family string, n int")).cache()
    states = {(r.circuit_id, r.qubit): r for r in simulate.reduced_states(ops).collect()}
    assert all(r.status == "ok" for r in states.values())
    assert abs(states["teleport_3", 2].r00 - 1) < 1e-9 and abs(states["teleport_3", 0].r00 - 0.5) < 1e-9  # what is sent is 0
    assert abs(states["bell_2", 0].r00 - 0.5) < 1e-9 and abs(states["grover_1", 0].r00 - 0.5) < 1e-9
    assert [(r.gate, list(r.qubits)) for r in ops.where("circuit_id = 'vqe_3'").orderBy("pos").collect()] == [("ry", [0]), ("ry", [1]), ("ry", [2]), ("cx", [0, 1]), ("cx", [1, 2]), ("ry", [0]), ("ry", [1]), ("ry", [2])]
    angles = [r.params[0] for r in ops.where("gate = 'ry'").collect()]
    assert len(set(angles)) == 6
    bits = {(r.circuit_id, r.a, r.b): r for r in simulate.pair_information(ops).collect()}
    assert abs(bits["bell_2", 0, 1].bits - 2) < 1e-9 and "branches" in bits["teleport_3", None, None].status and ("grover_1", 0, 1) not in bits


def test_random_sample_has_no_repeats_and_does_not_move(spark):
    from tracecut.operators import tables

    df = spark.range(100).selectExpr("id % 3 AS g", "id AS x")
    a = sorted(map(tuple, tables.random_sample(df, "g", "x", 8, 5).collect()))
    assert a == sorted(map(tuple, tables.random_sample(df.repartition(7), "g", "x", 8, 5).collect()))
    assert len(set(a)) == 24 and a != sorted(map(tuple, tables.random_sample(df, "g", "x", 8, 6).collect()))
    assert tables.random_sample(df.limit(0), "g", "x", 8).count() == 0
