"""Queries that simulate: reduced states, slices judged by them, influence, pruning, and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fgraph, prepare, simulate, slices, stats, tables
from ..sources import lenses
from .registry import query

c = F.col

_U = lenses.OPS_SQL.split("wires AS")[0].replace("ops AS", "every_op AS", 1).rstrip().rstrip(",") + """,
uops AS (SELECT circuit_id, CAST(row_number() OVER (PARTITION BY circuit_id ORDER BY pos) - 1 AS INTEGER) AS pos, gate, q0, q1, value, qubits FROM every_op WHERE gate IN ('cx', 'h', 'rz')),
uwires AS (SELECT circuit_id, pos, unnest(qubits) AS q FROM uops),
uwidth AS (SELECT circuit_id, max(q) + 1 AS n_qubits, max(pos) + 1 AS n_ops FROM uwires GROUP BY 1),
utargets AS (SELECT circuit_id, CAST(unnest(range(0, n_qubits)) AS INTEGER) AS target, n_ops FROM uwidth),
udata AS (SELECT DISTINCT circuit_id, src, dst FROM (SELECT circuit_id, pos AS dst, lag(pos) OVER (PARTITION BY circuit_id, q ORDER BY pos) AS src FROM uwires) WHERE src IS NOT NULL),
ureach AS (SELECT DISTINCT circuit_id, q AS target, pos FROM uwires UNION SELECT r.circuit_id, r.target, e.src FROM ureach r JOIN udata e ON e.circuit_id = r.circuit_id AND e.dst = r.pos),
um AS (SELECT circuit_id, pos, CASE WHEN gate = 'cx' THEN (1 << q0) | (1 << q1) ELSE 1 << q0 END AS m, CASE WHEN gate = 'cx' THEN 1 << q1 ELSE 1 << q0 END AS w FROM uops),
unaive AS (
  SELECT circuit_id, target, n_ops - 1 AS cur, CAST(1 << target AS BIGINT) AS need, CAST(NULL AS INTEGER) AS kept FROM utargets
  UNION ALL SELECT r.circuit_id, r.target, r.cur - 1, CASE WHEN (m.w & r.need) <> 0 THEN r.need | m.m ELSE r.need END, CASE WHEN (m.w & r.need) <> 0 THEN m.pos END FROM unaive r JOIN um m ON m.circuit_id = r.circuit_id AND m.pos = r.cur),
ukeep AS (SELECT circuit_id, target, 'causal' AS method, pos FROM ureach UNION ALL SELECT circuit_id, target, 'naive', kept FROM unaive WHERE kept IS NOT NULL)
"""


def _apply(run: str, on: str) -> str:
    """One step of all amplitudes: real and imaginary parts after an op of ``run``, where ``on`` holds."""
    def part(a: str, b: str, sign: str) -> str:
        return f"""CASE WHEN NOT ({on}) THEN {run}.{a} WHEN o.gate = 'cx' THEN list_transform(range(0, 64), lambda i: CASE WHEN (i >> o.q0) & 1 = 1 THEN {run}.{a}[xor(i, CAST(1 << o.q1 AS BIGINT)) + 1] ELSE {run}.{a}[i + 1] END)
WHEN o.gate = 'h' THEN list_transform(range(0, 64), lambda i: CASE WHEN (i >> o.q0) & 1 = 0 THEN {run}.{a}[i + 1] + {run}.{a}[xor(i, CAST(1 << o.q0 AS BIGINT)) + 1] ELSE {run}.{a}[xor(i, CAST(1 << o.q0 AS BIGINT)) + 1] - {run}.{a}[i + 1] END / sqrt(2))
ELSE list_transform(range(0, 64), lambda i: {run}.{a}[i + 1] * cos(o.value / 2) {sign} CASE WHEN (i >> o.q0) & 1 = 1 THEN 1 ELSE -1 END * {run}.{b}[i + 1] * sin(o.value / 2)) END"""

    return part("re", "im", "-") + ", " + part("im", "re", "+")


_START = "list_transform(range(0, 64), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), list_transform(range(0, 64), lambda i: 0.0::DOUBLE)"


def _reduce(re: str, im: str, t: str) -> str:
    pick = lambda e: f"list_sum(list_transform(list_filter(range(0, 64), lambda i: (i >> {t}) & 1 = 0), lambda i: {e}))"
    j = f"(xor(i, CAST(1 << {t} AS BIGINT)) + 1)"
    return f"""{pick(f'{re}[i + 1] * {re}[i + 1] + {im}[i + 1] * {im}[i + 1]')} AS r00, {pick(f'{re}[{j}] * {re}[{j}] + {im}[{j}] * {im}[{j}]')} AS r11,
{pick(f'{re}[i + 1] * {re}[{j}] + {im}[i + 1] * {im}[{j}]')} AS re01, {pick(f'{im}[i + 1] * {re}[{j}] - {re}[i + 1] * {im}[{j}]')} AS im01"""


_WHOLE = f""",
whole AS (SELECT circuit_id, 0 AS cur, {_START} FROM uwidth UNION ALL SELECT r.circuit_id, r.cur + 1, {_apply('r', 'true')} FROM whole r JOIN uops o ON o.circuit_id = r.circuit_id AND o.pos = r.cur),
fin AS (SELECT w.circuit_id, t.target, {_reduce('w.re', 'w.im', 't.target')} FROM whole w JOIN utargets t ON t.circuit_id = w.circuit_id AND w.cur = t.n_ops)"""
_WHOLE = _WHOLE.replace("whole AS (", "whole(circuit_id, cur, re, im) AS (", 1)
_SLICED = f""",
methods(method) AS (VALUES ('causal'), ('naive')),
cut(circuit_id, target, method, cur, re, im) AS (SELECT circuit_id, target, method, 0, {_START} FROM utargets, methods
  UNION ALL SELECT r.circuit_id, r.target, r.method, r.cur + 1, {_apply('r', 'k.pos IS NOT NULL')} FROM cut r JOIN uops o ON o.circuit_id = r.circuit_id AND o.pos = r.cur
  LEFT JOIN ukeep k ON k.circuit_id = r.circuit_id AND k.target = r.target AND k.method = r.method AND k.pos = r.cur),
got AS (SELECT w.circuit_id, w.target, w.method, {_reduce('w.re', 'w.im', 'w.target')} FROM cut w JOIN utargets t ON t.circuit_id = w.circuit_id AND t.target = w.target AND w.cur = t.n_ops),
judged AS (SELECT g.circuit_id, g.target, g.method, least(1.0, greatest(0.0, f.r00 * g.r00 + f.r11 * g.r11 + 2 * (f.re01 * g.re01 + f.im01 * g.im01)
  + 2 * sqrt(greatest(0.0, f.r00 * f.r11 - f.re01 * f.re01 - f.im01 * f.im01) * greatest(0.0, g.r00 * g.r11 - g.re01 * g.re01 - g.im01 * g.im01)))) AS fidelity FROM got g JOIN fin f USING (circuit_id, target)),
sizes AS (SELECT circuit_id, target, method, count(*) AS size FROM ukeep GROUP BY ALL),
rows_ AS (SELECT t.circuit_id, t.target, j.method, coalesce(s.size, 0) / t.n_ops AS fraction, j.fidelity, CAST(j.fidelity < 1 - 1e-6 AS INTEGER) AS invalid
  FROM utargets t JOIN judged j USING (circuit_id, target) LEFT JOIN sizes s USING (circuit_id, target, method))"""


def unitary_ops(spark, d):
    """The unitary core of the lens, renumbered."""
    o = lenses.ops(spark, d)
    return prepare.renumber(o.where(c("gate").isin("cx", "h", "rz")))


@query("unitary_reduced_states", f"WITH RECURSIVE {_U}{_WHOLE} SELECT circuit_id, target AS qubit, CASE WHEN abs(r00) < 5e-7 THEN 0 ELSE round(r00, 6) END AS r00, CASE WHEN abs(r11) < 5e-7 THEN 0 ELSE round(r11, 6) END AS r11, CASE WHEN abs(re01) < 5e-7 THEN 0 ELSE round(re01, 6) END AS re01, CASE WHEN abs(im01) < 5e-7 THEN 0 ELSE round(im01, 6) END AS im01 FROM fin")
def unitary_reduced_states(spark, d):
    s = simulate.reduced_states(unitary_ops(spark, d))
    return s.select("circuit_id", "qubit", *[F.when(F.abs(x) < 5e-7, 0.0).otherwise(F.round(x, 6)).alias(x) for x in ("r00", "r11", "re01", "im01")])


def _records(spark, d, methods=("causal", "naive")):
    o = unitary_ops(spark, d)
    found = tables.union_by_name([slices.slices(o, m, n_qubits=lenses.N_QUBITS) for m in methods])
    judged = simulate.slice_states(o, found)
    sized = slices.slice_sizes(found).select("circuit_id", "target", "method", "fraction")
    return sized.join(judged, ["circuit_id", "target", "method"]).withColumn("invalid", (c("fidelity") < 1 - simulate.SOUND).cast("int"))


@query("slice_records", f"WITH RECURSIVE {_U}{_WHOLE}{_SLICED} SELECT circuit_id, target, method, round(fraction, 6) AS fraction, round(fidelity, 6) AS fidelity, invalid FROM rows_")
def slice_records(spark, d):
    return _records(spark, d).select("circuit_id", "target", "method", F.round("fraction", 6).alias("fraction"), F.round("fidelity", 6).alias("fidelity"), "invalid")


@query("method_summary", f"WITH RECURSIVE {_U}{_WHOLE}{_SLICED} SELECT method, count(DISTINCT circuit_id) AS n_circuits, count(*) AS n_pairs, round(avg(invalid), 6) AS invalid_rate, round(avg(fidelity), 6) AS mean_fidelity, round(avg(fraction), 6) AS mean_fraction FROM rows_ GROUP BY ALL")
def method_summary(spark, d):
    r = lambda x, n: F.round(F.avg(x), 6).alias(n)
    return _records(spark, d).groupBy("method").agg(F.count_distinct("circuit_id").alias("n_circuits"), F.count(F.lit(1)).alias("n_pairs"), r("invalid", "invalid_rate"), r("fidelity", "mean_fidelity"), r("fraction", "mean_fraction"))


@query("method_mcnemar", f"WITH RECURSIVE {_U}{_WHOLE}{_SLICED}, p AS (SELECT circuit_id, target, max(invalid) FILTER (method = 'causal') AS a, max(invalid) FILTER (method = 'naive') AS b FROM rows_ GROUP BY ALL) SELECT count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10 FROM p")
def method_mcnemar(spark, d):
    rec = _records(spark, d)
    of = lambda m: F.max(F.when(c("method") == m, c("invalid")))
    p = rec.groupBy("circuit_id", "target").agg(of("causal").alias("a"), of("naive").alias("b")).withColumn("all_pairs", F.lit(1))
    return stats.mcnemar_exact(stats.contingency(p, ["all_pairs"], "a", "b")).select("n01", "n10")


@query("pruned_slices")
def pruned_slices(spark, d):
    o = unitary_ops(spark, d)
    return slices.slice_sizes(simulate.pruned_slices(o, slices.slices(o, n_qubits=lenses.N_QUBITS)))


@query("pair_information")
def pair_information(spark, d):
    return simulate.pair_information(unitary_ops(spark, d)).withColumn("bits", F.round("bits", 6))


@query("influence_truth")
def influence_truth(spark, d):
    return simulate.influence(unitary_ops(spark, d)).select("circuit_id", "target", F.size("qubits").alias("n_influenced"), "status")


@query("forward_completeness")
def forward_completeness(spark, d):
    o = unitary_ops(spark, d)
    touched = slices.touched_qubits(o, slices.slices(o, "causal", "forward", n_qubits=lenses.N_QUBITS))
    truth = simulate.influence(o).where("status = 'ok'").select("circuit_id", "target", "qubits")
    return slices.completeness(truth, touched).select("circuit_id", "target", "truth_size", "covered_true", "completeness", "complete")


def small_circuits(spark, d):
    """Dynamic circuits of three qubits and bits, one for each order: measures and conditioned gates among few ops."""
    from pyspark.sql.window import Window

    li = lenses.table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    q = (c("l_partkey") % 3).cast("int")
    kind = (c("l_suppkey") % 5).cast("int")
    return li.select(
        c("l_orderkey").alias("circuit_id"), (F.row_number().over(order) - 1).alias("pos"),
        F.when(kind == 0, "h").when(kind == 1, "cx").when(kind == 2, "measure").when(kind == 3, "x").otherwise("ry").alias("gate"),
        F.when(kind == 1, F.array(q, (q + 1) % 3)).otherwise(F.array(q)).alias("qubits"), F.when(kind == 2, F.array(q)).otherwise(F.array().cast("array<int>")).alias("clbits"),
        F.when(kind == 4, F.array(c("l_quantity"))).otherwise(F.array().cast("array<double>")).alias("params"),
        F.when(kind == 3, F.struct(F.array(((q + 1) % 3).cast("int")).alias("bits"), F.lit(1).cast("long").alias("value"))).alias("cond"), F.when(kind == 1, 1).otherwise(0).alias("num_ctrl"),
    )


@query("dynamic_reduced_states")
def dynamic_reduced_states(spark, d):
    return simulate.reduced_states(small_circuits(spark, d))


@query("outcome_probabilities")
def outcome_probabilities(spark, d):
    return simulate.outcome_probabilities(small_circuits(spark, d))


@query("ablation_rates")
def ablation_rates(spark, d):
    """Violation rates of the eight edge-type variants, by pair and by circuit, against the full graph."""
    o = small_circuits(spark, d)
    rec = fgraph.variant_states(o).where("status = 'ok'").withColumn("violated", (c("trace_distance") > simulate.SOUND).cast("int")).withColumn("scope", F.lit("A"))
    return tables.violation_rates(rec.withColumnRenamed("method", "variant"), "scope", "circuit_id", "variant", "violated", "full")
