"""Queries that clean, reshape, aggregate and compare record tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import prepare, tables
from ..sources import lenses
from .registry import ORACLE, query

t = lenses.table
REC = f"WITH {lenses.RECORDS_SQL}"
c = F.col


def r6(x, name):
    return F.round(x, 6).alias(name)


@query("rates_grouping_sets", REC + """ SELECT coalesce(corpus, 'ALL') AS scope, flag_b AS method, count(*) AS n_pairs, count(DISTINCT circuit) AS n_circuits, round(avg(flag_a), 6) AS rate, round(avg(size_a), 6) AS mean_size
FROM rec GROUP BY GROUPING SETS ((flag_b), (flag_b, corpus))""")
def rates_grouping_sets(spark, d):
    rec = lenses.paired_records(spark, d).withColumn("method", c("flag_b"))
    return tables.all_and_each(rec, "corpus", ["method"], [F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("circuit").alias("n_circuits"), r6(F.avg("flag_a"), "rate"), r6(F.avg("size_a"), "mean_size")])


_SCOPES = ", s AS (SELECT *, unnest(list_filter([CASE WHEN corpus = 'A' THEN 'A' END, CASE WHEN corpus = 'N' THEN 'B' END, CASE WHEN corpus IN ('A', 'N') THEN 'A+B' END, CASE WHEN quantity > 25 THEN 'dynamic' END], lambda x: x IS NOT NULL)) AS scope FROM rec), v AS (SELECT scope, circuit, 'v' || flag_b AS variant, flag_a AS bad FROM s)"


@query("svr_pair_circuit", REC + _SCOPES + """, x AS (SELECT scope, 'pair' AS unit, variant, count(*) AS n, avg(bad) AS svr FROM v GROUP BY ALL
UNION ALL SELECT scope, 'circuit', variant, count(*), avg(m) FROM (SELECT scope, variant, circuit, max(bad) AS m FROM v GROUP BY ALL) GROUP BY scope, variant)
SELECT x.scope, x.unit, x.variant, x.n, round(x.svr, 4) AS svr, CASE WHEN x.variant <> 'v0' THEN round(x.svr - b.svr, 4) END AS delta_svr FROM x LEFT JOIN x b ON b.scope = x.scope AND b.unit = x.unit AND b.variant = 'v0'""")
def svr_pair_circuit(spark, d):
    rec = lenses.paired_records(spark, d)
    s = tables.scoped(rec, {"A": c("corpus") == "A", "B": c("corpus") == "N", "A+B": c("corpus").isin("A", "N"), "dynamic": c("quantity") > 25})
    return tables.violation_rates(s.withColumn("variant", F.concat(F.lit("v"), "flag_b")), "scope", "circuit", "variant", "flag_a", "v0")


@query("ablation_rollup", f"SELECT scope, unit, count(*) AS n_variants, round(avg(abs(delta_svr)), 6) AS mean_delta, round(max(abs(delta_svr)), 6) AS max_delta FROM ({ORACLE['svr_pair_circuit']}) WHERE delta_svr IS NOT NULL GROUP BY ALL")
def ablation_rollup(spark, d):
    out = tables.ablation_rollup(svr_pair_circuit(spark, d), ["scope", "unit"], "delta_svr")
    return out.select("scope", "unit", "n_variants", r6(c("mean_delta"), "mean_delta"), r6(c("max_delta"), "max_delta"))


@query("pivot_methods", "SELECT l_orderkey % 1000 AS circuit, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A__q, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N__q, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R__q FROM lineitem GROUP BY ALL")
def pivot_methods(spark, d):
    li = t(spark, d, "lineitem").select((c("l_orderkey") % 1000).alias("circuit"), "l_returnflag", c("l_quantity").alias("q"))
    wide = tables.long_to_wide(li, ["circuit"], "l_returnflag", ["q"], ["A", "N", "R"])
    return wide.select("circuit", *[F.round(x, 6).alias(x) for x in ("A__q", "N__q", "R__q")])


@query("unpivot_metrics", REC + " SELECT circuit, target, 'a' AS method, size_a AS size, flag_a AS flag FROM rec UNION ALL SELECT circuit, target, 'b', size_b, flag_b FROM rec")
def unpivot_metrics(spark, d):
    rec = lenses.paired_records(spark, d)
    wide = rec.select("circuit", "target", c("size_a").alias("a_size"), c("size_b").alias("b_size"), c("flag_a").alias("a_flag"), c("flag_b").alias("b_flag"))
    return tables.wide_to_long(wide, ["circuit", "target"], ["a", "b"], ["size", "flag"])


@query("observations", REC + " SELECT rq, metric, value, circuit, target, 'lines' AS source FROM (SELECT 'RQ1' AS rq, 'size_a' AS metric, size_a AS value, circuit, target FROM rec UNION ALL SELECT 'RQ2', 'size_a', size_a, circuit, target FROM rec UNION ALL SELECT 'RQ2', 'size_b', size_b, circuit, target FROM rec)")
def observations(spark, d):
    return tables.observations(lenses.paired_records(spark, d), ["circuit", "target"], {"size_a": ["RQ1", "RQ2"], "size_b": ["RQ2"]}, "lines")


@query("paired_observations", "WITH x AS (SELECT o_custkey AS k, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1) SELECT k, round(a, 8) AS a, round(b, 8) AS b FROM x WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_observations(spark, d):
    obs = t(spark, d, "orders").select(c("o_custkey").alias("k"), c("o_orderstatus").alias("method"), c("o_totalprice").alias("value"))
    return tables.paired(obs, ["k"], "F", "O").select("k", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"))


@query("zscore_outliers", """WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n FROM lineitem JOIN s USING (l_returnflag) WHERE s.n >= 3 AND (abs(l_extendedprice - m) / sd > 1.7 OR abs(l_quantity - mq) / sq > 1.7) GROUP BY 1""")
def zscore_outliers(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return tables.zscore_flags(li, "l_returnflag", ["l_extendedprice", "l_quantity"], 1.7).where("outlier <> ''").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("stratum_median_fill", """WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part), m AS (SELECT p_brand, median(price) AS g FROM x GROUP BY 1)
SELECT p_partkey, round(coalesce(price, g, (SELECT median(price) FROM x)), 4) AS price FROM x LEFT JOIN m USING (p_brand)""")
def stratum_median_fill(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.when(c("p_partkey") % 5 != 0, c("p_retailprice")).alias("price"))
    return tables.fill_group_median(p, "p_brand", ["price"]).select("p_partkey", F.round("price", 4).alias("price"))


@query("completion_summary", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS completed, round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F'), 4) AS median, round(quantile_cont(o_totalprice, 0.95) FILTER (o_orderstatus = 'F'), 4) AS p95, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS largest FROM orders")
def completion_summary(spark, d):
    out = tables.completion(t(spark, d, "orders"), "o_orderstatus", "o_totalprice", "F")
    return out.select("n", "completed", *[F.round(x, 4).alias(x) for x in ("median", "p95", "largest")])


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n, round(median(o_totalprice), 4) AS median FROM orders GROUP BY ALL")
def status_counts(spark, d):
    return t(spark, d, "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("o_totalprice"), 4).alias("median"))


@query("dedup_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def dedup_first(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return tables.first_per_key(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("duplicate_report", "SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_report(spark, d):
    return tables.duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("exact_duplicates", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def exact_duplicates(spark, d):
    return t(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("top_per_group", "SELECT c_nationkey, c_custkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name, c_custkey) AS r FROM customer) WHERE r <= 5")
def top_per_group(spark, d):
    cu = t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_name")
    return tables.top_per_group(cu, "c_nationkey", [c("c_acctbal"), c("c_name"), c("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank")


@query("global_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def global_top(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("custom_order", "SELECT o_orderpriority, count(*) AS n, CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS BIGINT) AS place FROM orders GROUP BY ALL")
def custom_order(spark, d):
    order = F.array(*map(F.lit, ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")))
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.array_position(order, c("o_orderpriority"))).orderBy("place")


@query("sampled_targets", f"WITH {lenses.OPS_SQL} SELECT circuit_id, q FROM (SELECT circuit_id, q, row_number() OVER (PARTITION BY circuit_id ORDER BY md5('0:' || circuit_id || ':' || q), q) AS r FROM (SELECT DISTINCT circuit_id, q FROM wires)) WHERE r <= 3")
def sampled_targets(spark, d):
    return tables.random_sample(prepare.wires(lenses.ops(spark, d)).select("circuit_id", "q").distinct(), "circuit_id", "q", 3)


@query("evenly_spaced_targets", "WITH n AS (SELECT c_custkey AS k, CAST(c_custkey % 23 AS INTEGER) AS n FROM customer) SELECT k, CASE WHEN n <= 0 THEN '' WHEN n <= 8 THEN array_to_string(range(0, n), ',') ELSE array_to_string(list_sort(list_distinct(list_transform(range(0, 8), lambda i: CAST(round_even(i * CAST(n - 1 AS DOUBLE) / 7, 0) AS INTEGER)))), ',') END AS places FROM n")
def evenly_spaced_targets(spark, d):
    n = t(spark, d, "customer").select(c("c_custkey").alias("k"), (c("c_custkey") % 23).cast("int").alias("n"))
    return n.select("k", F.array_join(tables.evenly_spaced(c("n"), 8), ",").alias("places"))


@query("paired_sound_join", REC + ", s AS (SELECT * FROM rec WHERE flag_a = 1) SELECT a.circuit, a.target, a.corpus, a.size_a AS size_q, b.size_b AS size_c FROM s a JOIN s b ON b.circuit = a.circuit AND b.target = a.target AND b.corpus = a.corpus WHERE b.flag_b = 0")
def paired_sound_join(spark, d):
    s = lenses.paired_records(spark, d).where("flag_a = 1")
    keys = ["circuit", "target", "corpus"]
    return s.select(*keys, c("size_a").alias("size_q")).join(s.where("flag_b = 0").select(*keys, c("size_b").alias("size_c")), keys)


@query("aligned_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def aligned_keys(spark, d):
    return t(spark, d, "customer").select(c("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select("s_nationkey"))


@query("except_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def except_keys(spark, d):
    return t(spark, d, "customer").select(c("c_custkey").alias("k")).join(t(spark, d, "orders").where("o_totalprice > 400000").select(c("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("semi_join_keep", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join_keep(spark, d):
    big = t(spark, d, "orders").where("o_totalprice > 200000").select(c("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("exclusion_list", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def exclusion_list(spark, d):
    out = t(spark, d, "lineitem").where("l_quantity >= 49").select(c("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").select("p_partkey").join(out, "p_partkey", "left_anti")


@query("subset_test", """WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS truth FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS cov FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
SELECT k, len(truth) AS truth_size, len(list_intersect(truth, coalesce(cov, []))) AS covered_true, round(len(list_intersect(truth, coalesce(cov, []))) / len(truth), 6) AS completeness, CAST(len(list_intersect(truth, coalesce(cov, []))) = len(truth) AS INTEGER) AS complete FROM a LEFT JOIN b USING (k)""")
def subset_test(spark, d):
    from ..operators import slices

    o = t(spark, d, "orders")
    truth = o.groupBy(c("o_custkey").alias("circuit_id")).agg(F.collect_set("o_orderstatus").alias("qubits")).withColumn("target", F.lit(0))
    cov = o.where("o_totalprice > 100000").groupBy(c("o_custkey").alias("circuit_id")).agg(F.collect_set("o_orderstatus").alias("touched")).withColumn("target", F.lit(0))
    out = slices.completeness(*(x.withColumn(n, F.transform(n, lambda v: F.ascii(v))) for x, n in ((truth, "qubits"), (cov, "touched"))))
    return out.select(c("circuit_id").alias("k"), c("truth_size").cast("long").alias("truth_size"), c("covered_true").cast("long").alias("covered_true"), r6("completeness", "completeness"), "complete")


@query("table_compare", """WITH b AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 100 = 0 THEN 1 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 250 = 0 THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 400 <> 0),
j AS (SELECT a.c_custkey AS ka, b.c_custkey AS kb, a.c_acctbal AS x, b.c_acctbal AS y, a.c_mktsegment AS s, b.c_mktsegment AS u FROM customer a FULL JOIN b USING (c_custkey))
SELECT 'c_acctbal' AS "column", count(*) FILTER (ka IS NULL OR kb IS NULL OR coalesce(abs(x - y) > 1e-9, true)) AS differing, round(max(abs(x - y)), 6) AS largest FROM j UNION ALL SELECT 'c_mktsegment', count(*) FILTER (ka IS NULL OR kb IS NULL OR s IS DISTINCT FROM u), NULL FROM j""")
def table_compare(spark, d):
    a = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    b = a.where("c_custkey % 400 <> 0").withColumn("c_acctbal", c("c_acctbal") + F.when(c("c_custkey") % 100 == 0, 1).otherwise(0)).withColumn("c_mktsegment", F.when(c("c_custkey") % 250 == 0, "x").otherwise(c("c_mktsegment")))
    return tables.compare(a, b, ["c_custkey"], 1e-9).withColumn("largest", F.round("largest", 6))


@query("set_difference", "WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (SELECT r_regionkey AS k FROM region) SELECT k, 'a' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT k, 'b' FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)")
def set_difference(spark, d):
    return tables.set_difference(t(spark, d, "nation").select(c("n_regionkey").alias("k")), t(spark, d, "region").select(c("r_regionkey").alias("k")))


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier")
def union_by_name(spark, d):
    cu = t(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_nationkey").alias("nation"), c("c_mktsegment").alias("segment"))
    su = t(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_nationkey").alias("nation"))
    return tables.union_by_name([cu, su])


@query("quality_report", "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS methods, 'X' AS absent FROM lineitem")
def quality_report(spark, d):
    return tables.quality_report(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R", "X"])


@query("label_distribution", "WITH x AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, (count(*) OVER () <= 1 OR max(n) OVER () / sum(n) OVER () > 0.99) AS degenerate FROM x")
def label_distribution(spark, d):
    return tables.label_distribution(t(spark, d, "labels"), "toxic").withColumn("share", F.round("share", 6))


@query("missing_rates", "WITH x AS (SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS b FROM customer) SELECT 'a' AS \"column\", count(*) FILTER (a IS NULL) AS n_missing, round(count(*) FILTER (a IS NULL) / count(*), 6) AS share FROM x UNION ALL SELECT 'b', count(*) FILTER (b IS NULL), round(count(*) FILTER (b IS NULL) / count(*), 6) FROM x")
def missing_rates(spark, d):
    x = t(spark, d, "customer").select(F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("a"), F.when(c("c_mktsegment") != "BUILDING", c("c_mktsegment")).alias("b"))
    return tables.missing_report(x, ["a", "b"]).withColumn("share", F.round("share", 6))


@query("range_to_null", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS c_acctbal, NOT (c_acctbal BETWEEN 0 AND 5000) AS flag_c_acctbal FROM customer")
def range_to_null(spark, d):
    return tables.null_outside(t(spark, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": (0, 5000)})


@query("range_report", "SELECT 'l_discount' AS \"column\", count(*) FILTER (NOT l_discount BETWEEN 0.01 AND 0.09) AS n_outside FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (NOT l_tax <= 0.05) FROM lineitem")
def range_report(spark, d):
    return tables.range_report(t(spark, d, "lineitem"), {"l_discount": (0.01, 0.09), "l_tax": (None, 0.05)})


@query("exclusion_reasons", "SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS reason, (o_totalprice < 50000 OR o_orderstatus = 'P') AS exclude FROM orders")
def exclusion_reasons(spark, d):
    return tables.exclusion(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"small": c("o_totalprice") < 50000, "pending": c("o_orderstatus") == "P"}).select("o_orderkey", "reason", "exclude")


@query("derived_features", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount - l_tax, 6) AS delta, round((l_discount - l_tax) / nullif(l_tax, 0), 6) AS relative, round(l_extendedprice / nullif(l_quantity, 0), 9) AS speedup,
round(l_quantity / nullif(l_linenumber, 0), 9) AS density, round(ln(1 + CAST(l_linenumber AS DOUBLE)), 6) AS log_size, CAST(coalesce(list_position(['A', 'N'], l_returnflag), 0) - 1 AS BIGINT) AS code FROM lineitem""")
def derived_features(spark, d):
    out = tables.derived(t(spark, d, "lineitem"), "l_discount", "l_tax", "l_extendedprice", "l_quantity", "l_quantity", "l_linenumber", "l_returnflag", ["A", "N"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(x, x) for x in ("delta", "relative", "log_size")], *[F.round(x, 9).alias(x) for x in ("speedup", "density")], "code")


@query("type_coercion", "SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": *([^}]*)', 1) AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad, CASE WHEN event_type = 'view' THEN 'true' WHEN event_type = 'error' THEN 'false' ELSE 'none' END AS flag FROM events")
def type_coercion(spark, d):
    word = F.when(c("event_type") == "view", " Yes ").when(c("event_type") == "error", "NO").otherwise("maybe")
    return t(spark, d, "events").select("event_id", tables.to_number(F.get_json_object("props", "$.k"), "int").alias("k"), tables.to_number(c("event_type")).alias("bad"), F.coalesce(tables.to_bool(word).cast("string"), F.lit("none")).alias("flag"))


@query("canonical_labels", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'metal_b' WHEN lower(p_type) LIKE '%steel%' THEN 'metal_s' ELSE p_type END AS kind FROM part")
def canonical_labels(spark, d):
    return t(spark, d, "part").select("p_partkey", tables.canonical(c("p_type"), {"": "none"}, [("brass", "metal_b"), ("steel", "metal_s")]).alias("kind"))


@query("snake_names", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-z]+', '_', 'g'), '_') AS name FROM part")
def snake_names(spark, d):
    return t(spark, d, "part").select("p_partkey", tables.snake_column(F.lower(F.concat_ws(" ", "p_name", "p_brand"))).alias("name"))


@query("json_flatten", "SELECT event_id, 'a_k' AS key, regexp_extract(props, '\"k\": *([^}]*)', 1) AS value FROM events UNION ALL SELECT event_id, 'u', CAST(user_id AS VARCHAR) FROM events")
def json_flatten(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit('{"a": '), "props", F.lit(', "u": '), c("user_id").cast("string"), F.lit("}")).alias("j"))
    return e.select("event_id", F.explode(tables.flatten_json(c("j"))).alias("key", "value"))


@query("finite_guard", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS v, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) ELSE 0 END AS z FROM customer")
def finite_guard(spark, d):
    x = F.when(c("c_acctbal") > 0, F.ln("c_acctbal")).otherwise(F.lit(float("nan")))
    return t(spark, d, "customer").select("c_custkey", r6(tables.finite(x), "v"), r6(tables.finite(x, "zero"), "z"))


@query("absent_keys", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def absent_keys(spark, d):
    return tables.absent_keys(t(spark, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("k")), "k", t(spark, d, "customer").select(c("c_custkey").alias("k")))


@query("size_stats", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean, round(median(l_discount), 6) AS median, round(stddev_pop(l_discount), 6) AS std, min(l_discount) AS low, max(l_discount) AS high, round(avg(CAST(l_discount > 0.05 AS INTEGER)), 6) AS rate FROM lineitem GROUP BY ALL")
def size_stats(spark, d):
    x = "l_discount"
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(x), "mean"), r6(F.median(x), "median"), r6(F.stddev_pop(x), "std"), F.min(x).alias("low"), F.max(x).alias("high"), r6(F.avg((c(x) > 0.05).cast("int")), "rate"))


@query("circuit_summary", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, count(*) AS n, count(DISTINCT o_orderstatus) AS n_status, round(avg(o_totalprice), 8) AS mean_price FROM orders GROUP BY ALL")
def circuit_summary(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("n_status"), F.round(F.avg("o_totalprice"), 8).alias("mean_price"))


@query("ratio_metrics", "SELECT o_orderkey, round(least(1.0, greatest(0.0, n / 7)), 6) AS ssr, round(CASE WHEN q > 0 THEN (q - h) / q ELSE 0 END, 6) AS reduction FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS h FROM lineitem GROUP BY 1)")
def ratio_metrics(spark, d):
    g = t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.sum(F.when(c("l_returnflag") == "A", c("l_quantity")).otherwise(0.0)).alias("h"))
    return g.select("o_orderkey", r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("n") / 7)), "ssr"), r6(F.when(c("q") > 0, (c("q") - c("h")) / c("q")).otherwise(0.0), "reduction"))


@query("strata", """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'S3' WHEN c_custkey % 50 = 0 THEN 'S1c' WHEN c_nationkey <= 10 THEN 'S1a' WHEN c_nationkey <= 20 THEN 'S1b' ELSE 'S2' END AS stratum, CASE WHEN c_custkey <= 500 THEN 'small' WHEN c_custkey <= 1000 THEN 'medium' ELSE 'large' END AS size_bin FROM customer""")
def strata(spark, d):
    return t(spark, d, "customer").select("c_custkey", prepare.stratum(c("c_nationkey"), c("c_custkey") % 50, c("c_nationkey") == 3).alias("stratum"), prepare.size_bin(c("c_custkey"), (500, 1000)).alias("size_bin"))


@query("text_peek", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS n_lines, list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))) AS digits FROM documents")
def text_peek(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text")
    lines = F.size(F.filter(F.split("text", "\n"), lambda s: F.length(F.trim(s)) > 0)).cast("long")
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return x.select("doc_id", lines.alias("n_lines"), F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("long"), lambda a, s: a + F.length(s))).alias("digits"))


@query("checksums", "SELECT doc_id, sha256(text) AS sha FROM documents")
def checksums(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(c("text").cast("binary"), 256).alias("sha"))


@query("latest_earlier_measure", f"WITH {lenses.OPS_SQL} SELECT circuit_id, pos, q, coalesce(last_value(CASE WHEN gate = 'measure' THEN pos END IGNORE NULLS) OVER (PARTITION BY circuit_id, q ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS measured FROM wires")
def latest_earlier_measure(spark, d):
    from ..operators.edges import wires

    order = Window.partitionBy("circuit_id", "q").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return wires(lenses.ops(spark, d)).select("circuit_id", "pos", "q", F.coalesce(F.last(F.when(c("gate") == "measure", c("pos")), ignorenulls=True).over(order), F.lit(-1)).alias("measured"))


@query("p_value_stars", "SELECT c_custkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, round(least(1.0, p * 8), 6) AS adjusted FROM (SELECT c_custkey, (c_custkey % 1000) / 5000 AS p FROM customer)")
def p_value_stars(spark, d):
    from ..operators import stats

    p = (c("c_custkey") % 1000) / 5000
    return t(spark, d, "customer").select("c_custkey", stats.stars(p).alias("stars"), r6(stats.bonferroni(p, F.lit(8)), "adjusted"))
