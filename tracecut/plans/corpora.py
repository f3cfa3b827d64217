"""Queries over corpora of circuits, the simplified lineage, generators and the comparison table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparisons, simplified, slices
from ..sources import files, lenses
from . import graph
from .graph import EDGES
from .registry import ORACLE, query

c = F.col
_CIRC = "circ AS (SELECT c_custkey AS path, c_mktsegment AS corpus, 'c' || (c_custkey % 700) AS name, CAST(c_nationkey + 1 AS INTEGER) AS n_qubits, CAST(c_custkey % 90 AS INTEGER) AS n_ops FROM customer)"


def _circuits(spark, d):
    return lenses.table(spark, d, "customer").select(c("c_custkey").alias("path"), c("c_mktsegment").alias("corpus"), F.concat(F.lit("c"), (c("c_custkey") % 700).cast("string")).alias("name"), (c("c_nationkey") + 1).cast("int").alias("n_qubits"), (c("c_custkey") % 90).cast("int").alias("n_ops"))


@query("smallest_per_corpus", f"WITH {_CIRC} SELECT corpus, path, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n_qubits, n_ops, name, path) AS r FROM circ WHERE n_qubits <= 14 AND n_ops BETWEEN 1 AND 60) WHERE r <= 40")
def smallest_per_corpus(spark, d):
    x = _circuits(spark, d).where((c("n_qubits") <= 14) & c("n_ops").between(1, 60))
    from ..operators.tables import top_per_group

    return top_per_group(x, "corpus", [c("n_qubits"), c("n_ops"), c("name"), c("path")], 40).select("corpus", "path", "rank")


@query("structural_selection", f"WITH {_CIRC} SELECT name, n_qubits, n_ops, min(path) AS path FROM circ WHERE n_qubits BETWEEN 2 AND 20 AND n_ops <= 80 GROUP BY ALL")
def structural_selection(spark, d):
    return files.select_structural(_circuits(spark, d), 2, 20, 80).select("name", "n_qubits", "n_ops", "path")


@query("available_per_category", f"WITH {_CIRC} SELECT corpus AS category, count(*) FILTER (n_qubits <= 10) AS n FROM circ GROUP BY ALL")
def available_per_category(spark, d):
    return files.available_per_category(_circuits(spark, d).withColumnRenamed("corpus", "category"), 10)


@query("first_by_stem", f"WITH {_CIRC} SELECT name, arg_min(path, (corpus, path)) AS path FROM circ GROUP BY ALL")
def first_by_stem(spark, d):
    return files.first_by_stem(_circuits(spark, d).withColumnRenamed("corpus", "root")).select("name", "path")


@query("provenance", f"WITH {_CIRC} SELECT corpus AS source, count(*) AS n, sha256(string_agg(name, chr(10) ORDER BY name)) AS sha256 FROM circ GROUP BY ALL")
def provenance(spark, d):
    return files.provenance(_circuits(spark, d).withColumnRenamed("corpus", "source"))


@query("manifest_check", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 50 = 0 THEN 'absent' ELSE 'differs' END AS problem FROM documents WHERE doc_id % 50 = 0 OR doc_id % 77 = 0")
def manifest_check(spark, d):
    docs = lenses.table(spark, d, "documents").select(c("doc_id").cast("string").alias("path"), F.sha2(c("text").cast("binary"), 256).alias("sha256"), "doc_id")
    manifest = docs.withColumn("sha256", F.when(c("doc_id") % 77 == 0, "0").otherwise(c("sha256"))).select("path", "sha256")
    return files.verify_manifest(docs.where("doc_id % 50 <> 0").select("path", "sha256"), manifest)


@query("synthetic_gate_counts", """WITH w AS (SELECT f AS family, n FROM (SELECT unnest(['ghz', 'bell', 'qft', 'grover', 'teleport', 'vqe']) AS f), (SELECT DISTINCT CAST(n_nationkey % 9 + 2 AS INTEGER) AS n FROM nation)),
g AS (SELECT family || '_' || n AS circuit_id, gate, CAST(CASE family
  WHEN 'ghz' THEN CASE gate WHEN 'h' THEN 1 WHEN 'cx' THEN n - 1 END
  WHEN 'bell' THEN CASE gate WHEN 'h' THEN 1 WHEN 'cx' THEN 1 END
  WHEN 'qft' THEN CASE gate WHEN 'h' THEN n WHEN 'cp' THEN n * (n - 1) // 2 END
  WHEN 'grover' THEN CASE gate WHEN 'h' THEN 3 * n WHEN 'x' THEN 2 * n WHEN 'cz' THEN 2 END
  WHEN 'teleport' THEN CASE gate WHEN 'h' THEN 2 WHEN 'cx' THEN 2 WHEN 'x' THEN 1 WHEN 'z' THEN 1 WHEN 'measure' THEN 3 END
  ELSE CASE gate WHEN 'ry' THEN 2 * n WHEN 'cx' THEN n - 1 END END AS INTEGER) AS cnt FROM w, (SELECT unnest(['h', 'cx', 'cp', 'ry', 'x', 'z', 'cz', 'measure']) AS gate))
SELECT circuit_id, gate, cnt FROM g WHERE cnt IS NOT NULL""")
def synthetic_gate_counts(spark, d):
    n = lenses.table(spark, d, "nation").select((c("n_nationkey") % 9 + 2).cast("int").alias("n")).distinct()
    w = n.withColumn("family", F.explode(F.array(*map(F.lit, ("ghz", "bell", "qft", "grover", "teleport", "vqe")))))
    return files.synthetic_ops(spark, w).groupBy("circuit_id", "gate").agg(F.count(F.lit(1)).cast("int").alias("cnt"))


@query("structural_means", f"""SELECT m.size_bin AS category, count(*) AS n_circuits, round(avg(m.n_qubits), 6) AS mean_qubits, round(avg(s.mean_dropped_2q), 6) AS mean_dropped_2q, round(avg(s.signature), 6) AS signature
FROM ({ORACLE['dropped_two_qubit_signature']}) s JOIN ({ORACLE['circuit_metadata']}) m USING (circuit_id) GROUP BY ALL""")
def structural_means(spark, d):
    known = graph.circuit_metadata(spark, d).select("circuit_id", c("size_bin").alias("category"), "n_qubits")
    out = files.structural_means(graph.dropped_two_qubit_signature(spark, d).join(known, "circuit_id"))
    return out.select("category", "n_circuits", *[F.round(x, 6).alias(x) for x in ("mean_qubits", "mean_dropped_2q", "signature")])


@query("component_slice_size", f"WITH RECURSIVE {EDGES} SELECT t.circuit_id, t.target, CAST(count(DISTINCT w.pos) AS INTEGER) AS size FROM targets t JOIN comp a ON a.circuit_id = t.circuit_id AND a.q = t.target JOIN comp b ON b.circuit_id = t.circuit_id AND b.component = a.component JOIN wires w ON w.circuit_id = t.circuit_id AND w.q = b.q GROUP BY ALL")
def component_slice_size(spark, d):
    return simplified.component_slices(lenses.ops(spark, d)).select("circuit_id", "target", F.size("positions").alias("size"))


@query("own_slice_size", f"WITH {lenses.OPS_SQL} SELECT circuit_id, q AS target, CAST(count(*) AS INTEGER) AS size FROM wires GROUP BY ALL")
def own_slice_size(spark, d):
    return simplified.own_slices(lenses.ops(spark, d)).select("circuit_id", "target", F.size("positions").alias("size"))


@query("predecessor_edges", f"""WITH RECURSIVE {EDGES},
run AS (
  SELECT circuit_id, 0 AS cur, [1, 2, 4, 8, 16, 32]::BIGINT[] AS parts, [-1, -1, -1, -1, -1, -1] AS last, CAST([] AS STRUCT(src INTEGER, kind VARCHAR)[]) AS found FROM width
  UNION ALL SELECT r.circuit_id, r.cur + 1,
    CASE WHEN o.gate = 'cx' THEN list_transform(r.parts, lambda p: CASE WHEN p & (r.parts[o.q0 + 1] | r.parts[o.q1 + 1]) <> 0 THEN r.parts[o.q0 + 1] | r.parts[o.q1 + 1] ELSE p END) ELSE r.parts END,
    list_transform(r.last, lambda v, i: CASE WHEN list_contains(o.qubits, CAST(i - 1 AS INTEGER)) THEN o.pos ELSE v END),
    list_filter(list_transform(r.last, lambda v, i: {{'src': v, 'kind': CASE WHEN list_contains(o.qubits, CAST(i - 1 AS INTEGER)) THEN 'state_carry' WHEN o.gate = 'cx' AND ((r.parts[o.q0 + 1] | r.parts[o.q1 + 1]) >> (i - 1)) & 1 = 1 THEN 'entanglement' ELSE 'none' END}}), lambda e: e.src >= 0 AND e.kind <> 'none')
  FROM run r JOIN ops o ON o.circuit_id = r.circuit_id AND o.pos = r.cur)
SELECT circuit_id, src, dst, max(kind) AS edge_type FROM (SELECT circuit_id, CAST(cur - 1 AS INTEGER) AS dst, e.src AS src, e.kind AS kind FROM (SELECT circuit_id, cur, unnest(found) AS e FROM run WHERE cur > 0)) GROUP BY ALL""")
def predecessor_edges(spark, d):
    return simplified.predecessor_edges(lenses.ops(spark, d))


def _observations(spark, d):
    o = lenses.ops(spark, d)
    sizes = slices.slice_sizes(slices.slices(o, "causal", n_qubits=lenses.N_QUBITS)).unionByName(slices.slice_sizes(slices.slices(o, "naive", n_qubits=lenses.N_QUBITS))).unionByName(slices.slice_sizes(slices.slices(o, "full", n_qubits=lenses.N_QUBITS)))
    return sizes.select(F.lit("RQ2").alias("rq"), F.lit("size").alias("metric"), "method", F.concat_ws(":", "circuit_id", "target").alias("pair_id"), c("fraction").alias("value"))


@query("comparison_table")
def comparison_table(spark, d):
    planned = comparisons.plan(spark, [("RQ2", "size", "causal", "naive"), ("RQ2", "size", "full", "causal"), ("RQ2", "size", "full", "naive")])
    return comparisons.comparison_table(_observations(spark, d), planned)


@query("derived_observations")
def derived_observations(spark, d):
    return comparisons.derived_observations(_observations(spark, d)).groupBy("metric", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("described_observations")
def described_observations(spark, d):
    return comparisons.described(_observations(spark, d), ["metric", "method"])
