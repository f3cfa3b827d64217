"""Queries over program texts, preparation by definitions, variant metrics and document compares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fgraph, metrics, prepare, simulate, slices, tables
from ..sources import files, lenses, qasm
from .graph import _FOUR, EDGES, four_variant_sizes  # noqa: F401
from .registry import ORACLE, query

c = F.col


def program_texts(spark, d):
    """Each circuit of the lens as OpenQASM 2 text: six qubits and six one-bit registers."""
    o = lenses.ops(spark, d)
    q = lambda i: F.concat(F.lit("q["), c("qubits")[i].cast("string"), F.lit("]"))
    line = (
        F.when(c("gate") == "cx", F.concat(F.lit("cx "), q(0), F.lit(","), q(1)))
        .when(c("gate") == "rz", F.concat(F.lit("rz("), c("params")[0].cast("string"), F.lit(") "), q(0)))
        .when(c("gate") == "measure", F.concat(F.lit("measure "), q(0), F.lit(" -> c"), c("clbits")[0].cast("string"), F.lit("[0]")))
        .when(c("cond").isNotNull(), F.concat(F.lit("if(c"), c("cond.bits")[0].cast("string"), F.lit("==1) x "), q(0)))
        .otherwise(F.concat(F.lit("h "), q(0)))
    )
    head = "OPENQASM 2.0;\ninclude \"qelib1.inc\"; // lens\nqreg q[6];\n" + "".join(f"creg c{i}[1];\n" for i in range(6))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("s")))), lambda x: F.concat(x["s"], F.lit(";"))), "\n")
    return o.groupBy(c("circuit_id").alias("path")).agg(F.concat(F.lit(head), body).alias("text"))


@query("qasm_round_trip", f"""WITH {lenses.OPS_SQL} SELECT circuit_id, pos, gate, array_to_string(qubits, ',') AS qubits, coalesce(CAST(mbit AS VARCHAR), '') AS clbits, coalesce(CAST(rbit AS VARCHAR), '') AS reads,
CASE WHEN gate = 'rz' THEN round(value, 6) ELSE 0 END AS param, CASE WHEN gate = 'cx' THEN 1 ELSE 0 END AS num_ctrl FROM ops""")
def qasm_round_trip(spark, d):
    o = qasm.program_ops(program_texts(spark, d))
    joined = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<int>")), ",")
    return o.select("circuit_id", "pos", "gate", joined(c("qubits")).alias("qubits"), joined(c("clbits")).alias("clbits"), joined(c("cond.bits")).alias("reads"), F.round(F.coalesce(F.try_element_at("params", F.lit(1)), F.lit(0.0)), 6).alias("param"), "num_ctrl")


@query("qasm_lenient", f"""WITH {lenses.OPS_SQL} SELECT circuit_id, CAST(row_number() OVER (PARTITION BY circuit_id ORDER BY pos) - 1 AS INTEGER) AS pos, gate, array_to_string(qubits, ',') AS qubits, CASE WHEN gate = 'rz' THEN round(value, 6) ELSE 0 END AS param
FROM ops WHERE gate IN ('cx', 'h', 'rz')""")
def qasm_lenient(spark, d):
    o = qasm.with_params(qasm.lenient_ops(program_texts(spark, d)))
    return o.select("circuit_id", "pos", "gate", F.array_join("qubits", ",").alias("qubits"), F.round(F.coalesce(F.try_element_at("params", F.lit(1)), F.lit(0.0)), 6).alias("param"))


@query("qasm_peek", f"WITH {lenses.OPS_SQL} SELECT circuit_id AS path, CAST(count(*) FILTER (gate <> 'measure') AS INTEGER) AS n_lines, 6 AS n_qubits FROM ops GROUP BY ALL")
def qasm_peek(spark, d):
    return qasm.peek(program_texts(spark, d))


@query("qasm_errors", f"WITH {lenses.OPS_SQL} SELECT 'text ' || doc_id AS circuit_id, 1 AS failed FROM documents UNION ALL SELECT DISTINCT 'program ' || circuit_id, 0 FROM ops")
def qasm_errors(spark, d):
    """Texts that are no programs are told as rows with their error, beside programs that are read."""
    t = lenses.table(spark, d, "documents").select(F.concat(F.lit("text "), c("doc_id").cast("string")).alias("path"), "text")
    p = program_texts(spark, d).withColumn("path", F.concat(F.lit("program "), c("path").cast("string")))
    return qasm.program_ops(t.unionByName(p)).select("circuit_id", c("error").isNotNull().cast("int").alias("failed")).distinct()


@query("expanded_by_definition", f"WITH {lenses.OPS_SQL} SELECT circuit_id, count(*) + 2 * count(*) FILTER (gate = 'cx') AS n_ops, count(*) FILTER (gate = 'cx') AS n_cz FROM ops GROUP BY ALL")
def expanded_by_definition(spark, d):
    body = spark.createDataFrame([("cx", 0, "h", [1], []), ("cx", 1, "cz", [0, 1], []), ("cx", 2, "h", [1], [])], "gate string, step int, body_gate string, slots array<int>, body_params array<double>")
    o = prepare.expand_wide(lenses.ops(spark, d), body, widest=1)
    return o.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n_ops"), F.count_if(c("gate") == "cz").alias("n_cz"))


@query("arity_check", f"WITH {lenses.OPS_SQL} SELECT circuit_id, CAST(max(len(qubits)) AS INTEGER) AS arity, CASE WHEN max(len(qubits)) > 1 THEN 'arity ' || max(len(qubits)) END AS reason FROM ops GROUP BY ALL")
def arity_check(spark, d):
    return prepare.arity_check(lenses.ops(spark, d), 1)


@query("without_measures", f"WITH {lenses.OPS_SQL} SELECT circuit_id, count(*) AS n FROM ops WHERE gate <> 'measure' GROUP BY ALL")
def without_measures(spark, d):
    return prepare.without_measures(lenses.ops(spark, d)).groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n"))


@query("with_final_measures", f"WITH {lenses.OPS_SQL}, u AS (SELECT circuit_id, count(*) AS n, max(greatest(q0, CASE WHEN gate = 'cx' THEN q1 ELSE 0 END)) + 1 AS w FROM ops WHERE gate IN ('cx', 'h', 'rz') GROUP BY ALL) SELECT circuit_id, n + w AS n_ops FROM u")
def with_final_measures(spark, d):
    from .semantics import unitary_ops

    return files.with_final_measures(unitary_ops(spark, d)).groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n_ops"))


_SIZES = ORACLE["four_variant_sizes"]
_REACH = _SIZES[: _SIZES.rindex("\nSELECT variant, circuit_id, target")]


@query("variant_metrics", f"""{_REACH}, tot AS (SELECT circuit_id, count(*) AS n, count(*) FILTER (gate = 'cx') AS n_cx FROM ops GROUP BY ALL)
SELECT variant, circuit_id, target, round(count(*) / any_value(n), 6) AS ssr, round(CASE WHEN any_value(n_cx) > 0 THEN (any_value(n_cx) - count(*) FILTER (gate = 'cx')) / any_value(n_cx) ELSE 0 END, 6) AS cx_reduction
FROM reach JOIN ops USING (circuit_id, pos) JOIN tot USING (circuit_id) GROUP BY ALL""")
def variant_metrics(spark, d):
    o = lenses.ops(spark, d)
    found = metrics.slice_metrics(o, fgraph.variant_slices(o), "variant").where("size > 0")
    return found.select("variant", "circuit_id", "target", F.round("ssr", 6).alias("ssr"), F.round("cx_reduction", 6).alias("cx_reduction"))


@query("slice_depth_ratio", f"""WITH RECURSIVE {EDGES}, e AS (SELECT * FROM data UNION ALL SELECT * FROM ctl),
reach AS (SELECT circuit_id, target, pos FROM seeds UNION SELECT r.circuit_id, r.target, e.src FROM reach r JOIN e ON e.circuit_id = r.circuit_id AND e.dst = r.pos),
sw AS (SELECT r.circuit_id, r.target, r.pos, w.q FROM reach r JOIN wires w USING (circuit_id, pos)),
sd AS (SELECT DISTINCT circuit_id, target, src, pos AS dst FROM (SELECT *, lag(pos) OVER (PARTITION BY circuit_id, target, q ORDER BY pos) AS src FROM sw) WHERE src IS NOT NULL),
lp AS (SELECT DISTINCT circuit_id, target, pos, 1 AS depth FROM reach UNION SELECT l.circuit_id, l.target, x.dst, l.depth + 1 FROM lp l JOIN sd x ON x.circuit_id = l.circuit_id AND x.target = l.target AND x.src = l.pos),
wl AS (SELECT circuit_id, pos, 1 AS depth FROM ops UNION SELECT l.circuit_id, x.dst, l.depth + 1 FROM wl l JOIN data x ON x.circuit_id = l.circuit_id AND x.src = l.pos),
whole AS (SELECT circuit_id, max(depth) AS depth FROM wl GROUP BY ALL)
SELECT l.circuit_id, l.target, round(max(l.depth) / any_value(w.depth), 6) AS drr FROM lp l JOIN whole w USING (circuit_id) GROUP BY ALL""")
def slice_depth_ratio(spark, d):
    o = lenses.ops(spark, d)
    return metrics.depth_ratio(o, slices.slices(o, n_qubits=lenses.N_QUBITS), "method").select("circuit_id", "target", F.round("drr", 6).alias("drr"))


@query("metric_lists", "SELECT c_mktsegment AS stratum, count(*) AS n, round(list_sum(list_transform(list(c_acctbal), lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) / count(*), 6) AS positive FROM customer GROUP BY ALL")
def metric_lists(spark, d):
    cu = lenses.table(spark, d, "customer")
    return metrics.value_lists(cu, ["c_mktsegment"], "c_acctbal").select(c("c_mktsegment").alias("stratum"), F.size("values").cast("long").alias("n"), F.round(F.size(F.filter("values", lambda x: x > 0)) / F.size("values"), 6).alias("positive"))


@query("fraction_fallback", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax > 0 THEN l_tax ELSE l_linenumber / nullif(CAST(l_quantity AS DOUBLE), 0) END, 9) AS fraction FROM lineitem")
def fraction_fallback(spark, d):
    li = lenses.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(metrics.fraction(F.when(c("l_tax") > 0, c("l_tax")), c("l_linenumber"), c("l_quantity")), 9).alias("fraction"))


@query("synonym_columns", "SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, c_mktsegment) AS name FROM customer")
def synonym_columns(spark, d):
    cu = lenses.table(spark, d, "customer").select(c("c_custkey").alias("Cust Key"), F.when(c("c_acctbal") > 0, c("c_name")).alias("custName"), c("c_mktsegment").alias("Customer-Label"))
    return tables.rename_synonyms(cu, {"cust_key": "id", "cust_name": "name", "customer_label": "name"})


@query("method_from_name", "SELECT page_id, CASE WHEN lower(url) LIKE '%blog%' THEN 'blog' WHEN lower(url) LIKE '%www%' THEN 'www' END AS method FROM pages")
def method_from_name(spark, d):
    return lenses.table(spark, d, "pages").select("page_id", files.method_from_name(c("url"), [("blog", "blog"), ("www", "www")]).alias("method"))


@query("document_compare", "SELECT 'a_k' AS path, count(*) FILTER (event_id % 7 = 0) AS differing FROM events UNION ALL SELECT 'n', 0")
def document_compare(spark, d):
    """Flattened JSON documents of two versions, compared path by path."""
    e = lenses.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    doc = lambda k: F.concat(F.lit('{"a": {"k": '), k.cast("string"), F.lit('}, "n": 1}'))
    a, b = e.select("event_id", doc(c("k")).alias("j")), e.select("event_id", doc(c("k") + F.when(c("event_id") % 7 == 0, 1).otherwise(0)).alias("j"))
    return metrics.compare_documents(a, b, "event_id", "j").select("path", "differing")


@query("accepted_summary", "SELECT count(*) AS n, 1 AS accepted FROM orders")
def accepted_summary(spark, d):
    """Acceptance checks fail the query where a summary breaks them."""
    s = lenses.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"))
    return metrics.accept(s, {"no rows": c("n") > 0, "negative price": c("low") >= 0}).select("n", F.lit(1).alias("accepted"))


@query("greedy_slices")
def greedy_slices(spark, d):
    from .semantics import unitary_ops

    o = unitary_ops(spark, d)
    return slices.slice_sizes(simulate.greedy_slices(o, slices.slices(o, n_qubits=lenses.N_QUBITS))).select("circuit_id", "target", "size")


@query("sampled_counts")
def sampled_counts(spark, d):
    from .semantics import small_circuits

    return simulate.sampled_counts(simulate.outcome_probabilities(small_circuits(spark, d)), 64)
