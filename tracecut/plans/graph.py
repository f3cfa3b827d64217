"""Queries over the operation logs of the ``events`` lens: edges, slices, components, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges, prepare, slices
from ..sources import lenses
from .registry import query

OPS = lenses.OPS_SQL
EDGES = (
    OPS
    + """,
data AS (SELECT DISTINCT circuit_id, src, dst FROM (SELECT circuit_id, pos AS dst, lag(pos) OVER (PARTITION BY circuit_id, q ORDER BY pos) AS src FROM wires) WHERE src IS NOT NULL),
bitev AS (SELECT circuit_id, pos, mbit AS bit, true AS wr FROM ops WHERE mbit IS NOT NULL UNION ALL SELECT circuit_id, pos, rbit, false FROM ops WHERE rbit IS NOT NULL),
ctl AS (
  SELECT DISTINCT circuit_id, src, dst FROM (
    SELECT circuit_id, pos AS dst, wr, last_value(CASE WHEN wr THEN pos END IGNORE NULLS) OVER (PARTITION BY circuit_id, bit ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM bitev)
  WHERE NOT wr AND src IS NOT NULL EXCEPT SELECT * FROM data),
coupled AS (SELECT DISTINCT a.circuit_id, a.q AS a, b.q AS b FROM wires a JOIN wires b USING (circuit_id, pos) WHERE a.q <> b.q AND a.arity = 2),
width AS (SELECT circuit_id, max(q) + 1 AS n_qubits, max(pos) + 1 AS n_ops FROM wires GROUP BY 1),
comp AS (
  SELECT circuit_id, q, min(r) AS component FROM (
    WITH RECURSIVE near AS (
      SELECT circuit_id, CAST(unnest(range(0, n_qubits)) AS INTEGER) AS q, q AS r FROM width
      UNION SELECT n.circuit_id, n.q, c.b FROM near n JOIN coupled c ON c.circuit_id = n.circuit_id AND c.a = n.r)
    SELECT * FROM near) GROUP BY ALL),
ent AS (
  SELECT DISTINCT a.circuit_id, a.pos AS src, b.pos AS dst FROM wires a JOIN comp ca ON ca.circuit_id = a.circuit_id AND ca.q = a.q
  JOIN comp cb ON cb.circuit_id = a.circuit_id AND cb.component = ca.component AND cb.q <> ca.q JOIN wires b ON b.circuit_id = a.circuit_id AND b.q = cb.q
  WHERE a.pos < b.pos EXCEPT (SELECT * FROM data UNION ALL SELECT * FROM ctl)),
targets AS (SELECT circuit_id, CAST(unnest(range(0, n_qubits)) AS INTEGER) AS target, n_ops FROM width),
seeds AS (SELECT DISTINCT circuit_id, q AS target, pos FROM wires)
"""
)


def _reach(near: str, graph: str) -> str:
    """Slice sizes by reachability over edges; ``near`` names the end that is reached from the other."""
    far = "dst" if near == "src" else "src"
    return f"""WITH RECURSIVE {EDGES}, e AS ({graph}),
reach AS (SELECT circuit_id, target, pos FROM seeds UNION SELECT r.circuit_id, r.target, e.{near} FROM reach r JOIN e ON e.circuit_id = r.circuit_id AND e.{far} = r.pos)
SELECT t.circuit_id, t.target, CAST(count(pos) AS INTEGER) AS size, round(count(pos) / n_ops, 9) AS fraction
FROM targets t LEFT JOIN reach r ON r.circuit_id = t.circuit_id AND r.target = t.target GROUP BY t.circuit_id, t.target, t.n_ops"""


_CAUSAL = "SELECT * FROM data UNION ALL SELECT * FROM ctl"
_FULL = _CAUSAL + " UNION ALL SELECT * FROM ent"


def _naive(tests: str, adds: str, first: str, next_: str) -> str:
    return f"""WITH RECURSIVE {EDGES},
m AS (SELECT circuit_id, pos, CASE WHEN gate = 'cx' THEN (1 << q0) | (1 << q1) ELSE 1 << q0 END AS m, CASE WHEN gate = 'cx' THEN 1 << q1 ELSE 1 << q0 END AS w FROM ops),
run AS (
  SELECT circuit_id, target, {first} AS at, CAST(1 << target AS BIGINT) AS need, 0 AS kept FROM targets
  UNION ALL SELECT r.circuit_id, r.target, {next_}, CASE WHEN (m.{tests} & r.need) <> 0 THEN r.need | m.{adds} ELSE r.need END, r.kept + CASE WHEN (m.{tests} & r.need) <> 0 THEN 1 ELSE 0 END
  FROM run r JOIN m ON m.circuit_id = r.circuit_id AND m.pos = r.at)
SELECT r.circuit_id, r.target, CAST(max(kept) AS INTEGER) AS size, round(max(kept) / t.n_ops, 9) AS fraction FROM run r JOIN targets t USING (circuit_id, target) GROUP BY r.circuit_id, r.target, t.n_ops"""


def _sizes(spark, sf_dir, method, direction):
    found = slices.slice_sizes(slices.slices(lenses.ops(spark, sf_dir), method, direction, n_qubits=lenses.N_QUBITS))
    return found.select("circuit_id", "target", "size", F.round("fraction", 9).alias("fraction"))


for _name, _method, _direction, _sql in (
    ("causal_backward_size", "causal", "backward", _reach("src", _CAUSAL)),
    ("causal_forward_size", "causal", "forward", _reach("dst", _CAUSAL)),
    ("full_backward_size", "full", "backward", _reach("src", _FULL)),
    ("full_forward_size", "full", "forward", _reach("dst", _FULL)),
    ("naive_backward_size", "naive", "backward", _naive("w", "m", "n_ops - 1", "r.at - 1")),
    ("naive_forward_size", "naive", "forward", _naive("m", "w", "0", "r.at + 1")),
):
    query(_name, _sql)(lambda spark, d, m=_method, w=_direction: _sizes(spark, d, m, w))


@query("data_edges", f"WITH RECURSIVE {EDGES} SELECT *, 'DATA' AS edge_type FROM data")
def data_edges(spark, d):
    return edges.data_edges(lenses.ops(spark, d))


@query("control_edges", f"WITH RECURSIVE {EDGES} SELECT *, 'CONTROL' AS edge_type FROM ctl")
def control_edges(spark, d):
    return edges.control_edges(lenses.ops(spark, d))


@query(
    "control_edges_unchanged",
    f"""WITH RECURSIVE {EDGES} SELECT *, 'CONTROL' AS edge_type FROM (
SELECT DISTINCT r.circuit_id, w.src, r.pos AS dst FROM bitev r JOIN (SELECT circuit_id, bit, max(pos) AS src FROM bitev WHERE wr GROUP BY ALL) w ON w.circuit_id = r.circuit_id AND w.bit = r.bit WHERE NOT r.wr
EXCEPT SELECT * FROM data)""",
)
def control_edges_unchanged(spark, d):
    return edges.control_edges(lenses.ops(spark, d), "unchanged")


@query("entanglement_edges", f"WITH RECURSIVE {EDGES} SELECT *, 'ENTANGLEMENT' AS edge_type FROM ent")
def entanglement_edges(spark, d):
    return edges.entanglement_edges(lenses.ops(spark, d))


_TYPED = "(SELECT *, 'DATA' AS edge_type FROM data UNION ALL SELECT *, 'CONTROL' FROM ctl UNION ALL SELECT *, 'ENTANGLEMENT' FROM ent)"


@query("edge_type_counts", f"WITH RECURSIVE {EDGES} SELECT circuit_id, edge_type, count(*) AS n FROM {_TYPED} GROUP BY ALL")
def edge_type_counts(spark, d):
    return edges.edge_type_counts(edges.dependence_edges(lenses.ops(spark, d), entanglement=True))


@query("control_share", f"WITH RECURSIVE {EDGES} SELECT circuit_id, round(avg(CASE WHEN edge_type = 'CONTROL' THEN 1.0 ELSE 0 END), 9) AS control_share FROM {_TYPED} GROUP BY ALL")
def control_share(spark, d):
    return edges.control_share(edges.dependence_edges(lenses.ops(spark, d), entanglement=True)).withColumn("control_share", F.round("control_share", 9))


@query(
    "graph_variant_counts",
    f"""WITH RECURSIVE {EDGES}, v(variant, edge_type) AS (VALUES ('full', 'DATA'), ('full', 'CONTROL'), ('full', 'ENTANGLEMENT'), ('no_entanglement', 'DATA'), ('no_entanglement', 'CONTROL'),
('no_control', 'DATA'), ('no_control', 'ENTANGLEMENT'), ('data_only', 'DATA'), ('classical', 'DATA'), ('classical', 'CONTROL'))
SELECT variant, circuit_id, count(*) AS n FROM {_TYPED} JOIN v USING (edge_type) GROUP BY ALL""",
)
def graph_variant_counts(spark, d):
    return edges.graph_variants(edges.dependence_edges(lenses.ops(spark, d), entanglement=True)).groupBy("variant", "circuit_id").agg(F.count(F.lit(1)).alias("n"))


@query("edges_without_type", f"WITH RECURSIVE {EDGES} SELECT circuit_id, count(*) AS n FROM {_TYPED} WHERE edge_type <> 'CONTROL' GROUP BY ALL")
def edges_without_type(spark, d):
    return edges.without_types(edges.dependence_edges(lenses.ops(spark, d), entanglement=True), "CONTROL").groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n"))


@query("qubit_components", f"WITH RECURSIVE {EDGES} SELECT circuit_id, q, CAST(component AS INTEGER) AS component FROM comp")
def qubit_components(spark, d):
    return slices.qubit_components(lenses.ops(spark, d), lenses.N_QUBITS)


@query(
    "component_of_target",
    f"""WITH RECURSIVE {EDGES} SELECT a.circuit_id, a.q AS target, count(*) AS size FROM comp a JOIN comp b ON b.circuit_id = a.circuit_id AND b.component = a.component GROUP BY ALL""",
)
def component_of_target(spark, d):
    c = slices.qubit_components(lenses.ops(spark, d), lenses.N_QUBITS)
    sizes = c.groupBy("circuit_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return c.join(sizes, ["circuit_id", "component"]).select("circuit_id", F.col("q").alias("target"), "size")


_FOUR = (
    EDGES
    + """,
four AS (
  SELECT circuit_id, src, dst, CASE WHEN arity >= 2 THEN 'ED' WHEN gate IN ('measure', 'reset') THEN 'MD' WHEN rbit IS NOT NULL THEN 'CD' ELSE 'UED' END AS type
  FROM (SELECT circuit_id, pos AS dst, gate, arity, rbit, lag(pos) OVER (PARTITION BY circuit_id, q ORDER BY pos) AS src FROM wires) WHERE src IS NOT NULL
  UNION ALL SELECT m.circuit_id, m.pos, c.pos, 'CD' FROM bitev m JOIN bitev c ON c.circuit_id = m.circuit_id AND c.bit = m.bit AND m.wr AND NOT c.wr AND m.pos < c.pos),
far AS (
  SELECT DISTINCT p.circuit_id, x.pos AS src, y.pos AS dst FROM coupled p JOIN wires x ON x.circuit_id = p.circuit_id AND x.q = p.a JOIN wires y ON y.circuit_id = p.circuit_id AND y.q = p.b
  WHERE p.a < p.b AND x.pos < y.pos EXCEPT SELECT circuit_id, src, dst FROM four),
fe AS (SELECT circuit_id, src, dst, list_sort(list(DISTINCT type)) AS types FROM (SELECT * FROM four UNION ALL SELECT *, 'ED' FROM far) GROUP BY ALL)
"""
)


@query("four_type_edges", f"WITH RECURSIVE {_FOUR} SELECT circuit_id, src, dst, array_to_string(types, '+') AS types FROM fe")
def four_type_edges(spark, d):
    return edges.four_edges(lenses.ops(spark, d)).withColumn("types", F.array_join("types", "+"))


@query("four_edges_of_type", f"WITH RECURSIVE {_FOUR} SELECT circuit_id, src, dst FROM fe WHERE list_contains(types, 'CD')")
def four_edges_of_type(spark, d):
    return edges.edges_of_type(edges.four_edges(lenses.ops(spark, d)), "CD").select("circuit_id", "src", "dst")


@query("four_variant_sizes", f"""WITH RECURSIVE {_FOUR},
v(variant, type) AS (VALUES ('full', 'UED'), ('full', 'ED'), ('full', 'MD'), ('full', 'CD'), ('classical_pdg', 'UED'), ('causal_cone', 'UED'), ('causal_cone', 'ED'), ('qiro', 'UED'), ('qiro', 'CD'),
 ('no_ed', 'UED'), ('no_ed', 'MD'), ('no_ed', 'CD'), ('no_md', 'UED'), ('no_md', 'ED'), ('no_md', 'CD'), ('no_cd', 'UED'), ('no_cd', 'ED'), ('no_cd', 'MD'), ('no_ued', 'ED'), ('no_ued', 'MD'), ('no_ued', 'CD')),
ve AS (SELECT DISTINCT variant, circuit_id, src, dst FROM (SELECT circuit_id, src, dst, unnest(types) AS type FROM fe) JOIN v USING (type)),
meas AS (SELECT DISTINCT circuit_id, q AS target, pos FROM wires WHERE gate IN ('measure', 'reset')),
fseeds AS (SELECT * FROM meas UNION ALL SELECT * FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM meas m WHERE m.circuit_id = s.circuit_id AND m.target = s.target)),
reach AS (SELECT variant, circuit_id, target, pos FROM fseeds, (SELECT DISTINCT variant FROM v) UNION SELECT r.variant, r.circuit_id, r.target, e.src FROM reach r JOIN ve e ON e.variant = r.variant AND e.circuit_id = r.circuit_id AND e.dst = r.pos)
SELECT variant, circuit_id, target, CAST(count(*) AS INTEGER) AS size FROM reach GROUP BY ALL""")
def four_variant_sizes(spark, d):
    from ..operators import fgraph

    found = fgraph.variant_slices(lenses.ops(spark, d))
    return found.where(F.size("positions") > 0).select("variant", "circuit_id", "target", F.size("positions").alias("size"))


@query("dropped_two_qubit_signature", f"""WITH RECURSIVE {EDGES},
m AS (SELECT circuit_id, pos, CASE WHEN gate = 'cx' THEN (1 << q0) | (1 << q1) ELSE 1 << q0 END AS m, CASE WHEN gate = 'cx' THEN 1 << q1 ELSE 1 << q0 END AS w FROM ops),
run AS (
  SELECT circuit_id, target, n_ops - 1 AS at, CAST(1 << target AS BIGINT) AS need, CAST(NULL AS INTEGER) AS kept FROM targets
  UNION ALL SELECT r.circuit_id, r.target, r.at - 1, CASE WHEN (m.w & r.need) <> 0 THEN r.need | m.m ELSE r.need END, CASE WHEN (m.w & r.need) <> 0 THEN m.pos END FROM run r JOIN m ON m.circuit_id = r.circuit_id AND m.pos = r.at),
e AS ({_CAUSAL}),
reach AS (SELECT circuit_id, target, pos FROM seeds UNION SELECT r.circuit_id, r.target, e.src FROM reach r JOIN e ON e.circuit_id = r.circuit_id AND e.dst = r.pos),
dropped AS (SELECT circuit_id, target, pos FROM reach EXCEPT SELECT circuit_id, target, kept FROM run),
per AS (SELECT t.circuit_id, t.target, count(x.pos) AS dropped, count(x.pos) FILTER (o.gate = 'cx') AS dropped_2q FROM targets t LEFT JOIN dropped x USING (circuit_id, target) LEFT JOIN ops o ON o.circuit_id = x.circuit_id AND o.pos = x.pos GROUP BY ALL)
SELECT circuit_id, round(avg(dropped), 9) AS mean_dropped, round(avg(dropped_2q), 9) AS mean_dropped_2q, round(avg(CASE WHEN dropped_2q > 0 THEN 1.0 ELSE 0 END), 9) AS signature FROM per GROUP BY ALL""")
def dropped_two_qubit_signature(spark, d):
    o = lenses.ops(spark, d)
    both = slices.slices(o, "causal", n_qubits=lenses.N_QUBITS).select("circuit_id", "target", F.col("positions").alias("causal")).join(slices.slices(o, "naive", n_qubits=lenses.N_QUBITS).select("circuit_id", "target", F.col("positions").alias("naive")), ["circuit_id", "target"])
    gone = both.select("circuit_id", "target", F.array_except("causal", "naive").alias("gone"))
    two = o.where(F.size("qubits") >= 2).groupBy("circuit_id").agg(F.collect_list("pos").alias("two"))
    per = gone.join(two, "circuit_id", "left").select("circuit_id", F.size("gone").alias("dropped"), F.size(F.array_intersect("gone", F.coalesce("two", F.array().cast("array<int>")))).alias("dropped_2q"))
    r = lambda c: F.round(F.avg(c), 9)
    return per.groupBy("circuit_id").agg(r("dropped").alias("mean_dropped"), r("dropped_2q").alias("mean_dropped_2q"), r((F.col("dropped_2q") > 0).cast("double")).alias("signature"))


@query("slice_qubits_touched", f"""WITH RECURSIVE {EDGES}, e AS ({_CAUSAL}),
reach AS (SELECT circuit_id, target, pos FROM seeds UNION SELECT r.circuit_id, r.target, e.src FROM reach r JOIN e ON e.circuit_id = r.circuit_id AND e.dst = r.pos)
SELECT circuit_id, target, CAST(count(DISTINCT q) AS INTEGER) AS n_touched FROM (SELECT circuit_id, target, q FROM reach JOIN wires USING (circuit_id, pos) UNION SELECT circuit_id, target, target FROM targets) GROUP BY ALL""")
def slice_qubits_touched(spark, d):
    o = lenses.ops(spark, d)
    return slices.touched_qubits(o, slices.slices(o, n_qubits=lenses.N_QUBITS)).select("circuit_id", "target", F.size("touched").alias("n_touched"))


@query("materialised_slice", f"""WITH RECURSIVE {EDGES}, e AS ({_CAUSAL}),
reach AS (SELECT circuit_id, target, pos FROM seeds UNION SELECT r.circuit_id, r.target, e.src FROM reach r JOIN e ON e.circuit_id = r.circuit_id AND e.dst = r.pos)
SELECT circuit_id, target, pos, CAST(row_number() OVER (PARTITION BY circuit_id, target ORDER BY pos) - 1 AS INTEGER) AS new_pos, gate FROM reach JOIN ops USING (circuit_id, pos)""")
def materialised_slice(spark, d):
    o = lenses.ops(spark, d)
    return slices.materialise(o, slices.slices(o, n_qubits=lenses.N_QUBITS)).select("circuit_id", "target", "pos", "new_pos", "gate")


@query("asap_layers", f"""WITH RECURSIVE {EDGES},
run AS (
  SELECT circuit_id, 0 AS cur, [0, 0, 0, 0, 0, 0] AS lv, -1 AS layer FROM width
  UNION ALL SELECT r.circuit_id, r.cur + 1, list_transform(r.lv, lambda v, i: CASE WHEN list_contains(o.qubits, CAST(i - 1 AS INTEGER)) THEN list_max(list_transform(o.qubits, lambda q: r.lv[q + 1])) + 1 ELSE v END),
    list_max(list_transform(o.qubits, lambda q: r.lv[q + 1])) FROM run r JOIN ops o ON o.circuit_id = r.circuit_id AND o.pos = r.cur)
SELECT circuit_id, CAST(cur - 1 AS INTEGER) AS pos, CAST(layer AS INTEGER) AS layer FROM run WHERE cur > 0""")
def asap_layers(spark, d):
    return slices.layers(lenses.ops(spark, d))


@query("circuit_depth", f"""WITH RECURSIVE {EDGES},
longest AS (SELECT circuit_id, pos, 1 AS depth FROM ops UNION SELECT l.circuit_id, x.dst, l.depth + 1 FROM longest l JOIN data x ON x.circuit_id = l.circuit_id AND x.src = l.pos)
SELECT circuit_id, CAST(max(depth) AS INTEGER) AS depth FROM longest GROUP BY ALL""")
def circuit_depth(spark, d):
    return slices.layers(lenses.ops(spark, d)).groupBy("circuit_id").agg((F.max("layer") + 1).alias("depth"))


_TERMINAL = """
last AS (SELECT circuit_id, q, max(pos) AS last_pos FROM wires WHERE gate NOT IN ('barrier', 'delay') GROUP BY ALL),
readers AS (SELECT circuit_id, rbit AS bit, max(pos) AS last_read FROM ops WHERE rbit IS NOT NULL GROUP BY ALL),
term AS (SELECT o.circuit_id, o.pos, l.last_pos = o.pos AND coalesce(r.last_read < o.pos, true) AS terminal FROM ops o JOIN last l ON l.circuit_id = o.circuit_id AND l.q = o.q0 LEFT JOIN readers r ON r.circuit_id = o.circuit_id AND r.bit = o.mbit WHERE o.gate = 'measure')
"""


@query("terminal_measure", f"WITH {OPS}, {_TERMINAL} SELECT circuit_id, pos, terminal FROM term")
def terminal_measure(spark, d):
    return prepare.terminal_measures(lenses.ops(spark, d))


@query("prepared_ops", f"""WITH {OPS}, {_TERMINAL} SELECT o.circuit_id, CAST(row_number() OVER (PARTITION BY o.circuit_id ORDER BY o.pos) - 1 AS INTEGER) AS pos, o.gate
FROM ops o LEFT JOIN term t ON t.circuit_id = o.circuit_id AND t.pos = o.pos WHERE o.gate <> 'barrier' AND NOT coalesce(t.terminal, false)""")
def prepared_ops(spark, d):
    return prepare.prepared(lenses.ops(spark, d)).select("circuit_id", "pos", "gate")


@query("unitary_core", f"""WITH {OPS}, last AS (SELECT circuit_id, q, max(pos) AS p FROM wires GROUP BY ALL),
mid AS (SELECT o.circuit_id, bool_or(rbit IS NOT NULL OR (o.gate IN ('measure', 'reset') AND l.p > o.pos)) AS impure FROM ops o JOIN last l ON l.circuit_id = o.circuit_id AND l.q = o.q0 GROUP BY ALL)
SELECT o.circuit_id, count(*) FILTER (gate NOT IN ('measure', 'reset', 'barrier')) AS n_core, NOT any_value(impure) AS pure FROM ops o JOIN mid USING (circuit_id) GROUP BY ALL""")
def unitary_core(spark, d):
    return prepare.unitary_core(lenses.ops(spark, d)).groupBy("circuit_id").agg(F.count_if("core").alias("n_core"), F.bool_and("pure").alias("pure"))


@query("mid_circuit_flag", f"""WITH {OPS}, r AS (SELECT circuit_id, q, pos, gate, max(CASE WHEN gate = 'measure' THEN 1 ELSE 0 END) OVER (PARTITION BY circuit_id, q ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM wires)
SELECT circuit_id, bool_or(coalesce(seen, 0) = 1 AND gate <> 'measure') AS measured_then_gated FROM r GROUP BY ALL""")
def mid_circuit_flag(spark, d):
    return prepare.measured_then_gated(lenses.ops(spark, d))


@query("dynamic_flag", f"WITH {OPS} SELECT circuit_id, CAST(bool_or(gate IN ('measure', 'reset') OR rbit IS NOT NULL) AS INTEGER) AS dynamic FROM ops GROUP BY ALL")
def dynamic_flag(spark, d):
    return prepare.dynamic(lenses.ops(spark, d))


@query("control_readers", f"WITH {OPS} SELECT circuit_id, pos FROM ops WHERE rbit IS NOT NULL")
def control_readers(spark, d):
    return prepare.controlled(lenses.ops(spark, d)).select("circuit_id", "pos")


@query("circuit_metadata", f"""WITH {OPS}, c AS (SELECT circuit_id, CAST(max(greatest(q0, CASE WHEN gate = 'cx' THEN q1 ELSE 0 END)) + 1 AS INTEGER) AS n_qubits, count(*) AS n_gates, count(*) FILTER (gate = 'cx') AS n_cx, max(len(qubits)) AS arity FROM ops GROUP BY ALL)
SELECT circuit_id, n_qubits, n_gates, n_cx, CAST(arity AS INTEGER) AS arity,
  CASE WHEN n_gates <= 60 THEN 'small' WHEN n_gates <= 70 THEN 'medium' ELSE 'large' END AS size_bin FROM c""")
def circuit_metadata(spark, d):
    return prepare.metadata(lenses.ops(spark, d), bins=(60, 70))
