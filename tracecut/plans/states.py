"""Queries over states, counts and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linalg, stats
from ..sources import lenses
from .registry import query

RHO = f"WITH {lenses.AMPS_SQL}"
REC = f"WITH {lenses.RECORDS_SQL}"
r = lambda c: F.round(c, 6)


def _states(spark, d):
    return linalg.reduced_states(lenses.amplitudes(spark, d))


def _neighbours(spark, d):
    """Each state with that of the next circuit, on the same qubit."""
    s = _states(spark, d)
    pack = F.struct("r00", "r11", "re01", "im01")
    a = s.select("circuit_id", "target", pack.alias("a"))
    b = s.select((F.col("circuit_id") - 1).alias("circuit_id"), "target", pack.alias("b"))
    return a.join(b, ["circuit_id", "target"])


_PAIR = RHO + ", pr AS (SELECT x.circuit_id, x.target, x.r00 AS a0, x.r11 AS a1, x.re01 AS ar, y.r00 AS b0, y.r11 AS b1, y.re01 AS br FROM rho x JOIN rho y ON y.circuit_id = x.circuit_id + 1 AND y.target = x.target)"


@query("reduced_state", RHO + " SELECT circuit_id, CAST(target AS INTEGER) AS target, round(r00, 6) AS r00, round(r11, 6) AS r11, CASE WHEN abs(re01) < 5e-7 THEN 0 ELSE round(re01, 6) END AS re01, 0.0::DOUBLE AS im01 FROM rho")
def reduced_state(spark, d):
    return _states(spark, d).select("circuit_id", "target", r("r00").alias("r00"), r("r11").alias("r11"), F.when(F.abs("re01") < 5e-7, 0.0).otherwise(r("re01")).alias("re01"), "im01")


@query("purity", RHO + " SELECT circuit_id, CAST(target AS INTEGER) AS target, round(r00 * r00 + r11 * r11 + 2 * re01 * re01, 6) AS purity FROM rho")
def purity(spark, d):
    c = F.col
    return _states(spark, d).select("circuit_id", "target", r(linalg.purity(c("r00"), c("r11"), c("re01"), c("im01"))).alias("purity"))


@query("entropy_2x2", RHO + """, ev AS (SELECT circuit_id, target, (r00 + r11 + s) / 2 AS p, (r00 + r11 - s) / 2 AS q FROM (SELECT *, sqrt((r00 - r11) * (r00 - r11) + 4 * re01 * re01) AS s FROM rho))
SELECT circuit_id, CAST(target AS INTEGER) AS target, round(CASE WHEN p > 1e-12 THEN -p * log2(p) ELSE 0 END + CASE WHEN q > 1e-12 THEN -q * log2(q) ELSE 0 END, 6) AS entropy FROM ev""")
def entropy_2x2(spark, d):
    c = F.col
    return _states(spark, d).select("circuit_id", "target", r(linalg.entropy(c("r00"), c("r11"), c("re01"), c("im01"))).alias("entropy"))


@query("fidelity_pairs", _PAIR + """ SELECT circuit_id, CAST(target AS INTEGER) AS target, round(least(1.0, greatest(0.0, a0 * b0 + a1 * b1 + 2 * ar * br + 2 * sqrt(greatest(0.0, a0 * a1 - ar * ar) * greatest(0.0, b0 * b1 - br * br)))), 6) AS fidelity,
round(least(1.0, greatest(0.0, a0 * b0 + a1 * b1 + 2 * ar * br + 2 * sqrt(greatest(0.0, a0 * a1 - ar * ar) * greatest(0.0, b0 * b1 - br * br)))), 6) < 1 - 1e-6 AS invalid FROM pr""")
def fidelity_pairs(spark, d):
    f = r(linalg.fidelity("a", "b"))
    return _neighbours(spark, d).select("circuit_id", "target", f.alias("fidelity"), (f < 1 - 1e-6).alias("invalid"))


@query("trace_distance", _PAIR + " SELECT circuit_id, CAST(target AS INTEGER) AS target, round(sqrt(pow((a0 - b0 - a1 + b1) / 2, 2) + pow(ar - br, 2)), 6) AS td FROM pr")
def trace_distance(spark, d):
    return _neighbours(spark, d).select("circuit_id", "target", r(linalg.trace_distance("a", "b")).alias("td"))


_MARG = f"WITH {lenses.COUNTS_SQL}, marg AS (SELECT run_id, CAST(q AS INTEGER) AS qubit, sum(CASE WHEN bitstring[8 - q] = '1' THEN cnt ELSE 0 END) / sum(cnt) AS p1 FROM counts, (SELECT unnest(range(0, 8)) AS q) GROUP BY ALL)"


@query("marginal_p1", _MARG + " SELECT run_id, qubit, round(p1, 6) AS p1 FROM marg")
def marginal_p1(spark, d):
    return linalg.marginals(lenses.counts(spark, d)).withColumn("p1", r("p1"))


def _tvd(spark, d):
    c = lenses.counts(spark, d)
    p = c.join(c.groupBy("run_id").agg(F.sum("cnt").alias("total")), "run_id").select("run_id", "bitstring", (F.col("cnt") / F.col("total")).alias("p"))
    runs = c.select("run_id").distinct()
    pair = runs.join(runs.select((F.col("run_id") - 1).alias("run_id")), "run_id")
    a = p.join(pair, "run_id")
    b = p.select((F.col("run_id") - 1).alias("run_id"), "bitstring", "p").join(pair, "run_id")
    return linalg.total_variation(a, b, ["run_id"])


_TVD = f"""WITH {lenses.COUNTS_SQL}, p AS (SELECT run_id, bitstring, cnt / sum(cnt) OVER (PARTITION BY run_id) AS p FROM counts), ids AS (SELECT DISTINCT run_id FROM p),
pairs AS (SELECT a.run_id FROM ids a JOIN ids b ON b.run_id = a.run_id + 1),
tv AS (SELECT run_id, sum(abs(pa - pb)) / 2 AS tvd FROM (SELECT run_id, bitstring, sum(pa) AS pa, sum(pb) AS pb FROM (SELECT run_id, bitstring, p AS pa, 0 AS pb FROM p UNION ALL SELECT run_id - 1, bitstring, 0, p FROM p) GROUP BY ALL) WHERE run_id IN (SELECT run_id FROM pairs) GROUP BY ALL)"""


@query("tvd_pairs", _TVD + " SELECT run_id, round(tvd, 6) AS tvd, round(tvd, 6) < 0.05 AS preserved FROM tv")
def tvd_pairs(spark, d):
    return _tvd(spark, d).select("run_id", r("tvd").alias("tvd"), (r("tvd") < 0.05).alias("preserved"))


@query("empirical_threshold", _TVD + " SELECT round(quantile_cont(tvd, 0.95), 6) AS threshold FROM tv")
def empirical_threshold(spark, d):
    return linalg.empirical_threshold(_tvd(spark, d), "tvd").select(r("threshold").alias("threshold"))


@query("informative_criterion", _MARG + """ SELECT run_id, arg_max(qubit, (round(1 - abs(p1 - 0.5), 9), -qubit)) AS criterion FROM marg WHERE p1 BETWEEN 0.15 AND 0.85 GROUP BY ALL""")
def informative_criterion(spark, d):
    m = linalg.marginals(lenses.counts(spark, d)).where(F.col("p1").between(0.15, 0.85))
    return m.groupBy("run_id").agg(F.max_by("qubit", F.struct(F.round(1 - F.abs(F.col("p1") - 0.5), 9), -F.col("qubit"))).alias("criterion"))


@query("mcnemar_counts", REC + " SELECT corpus, count(*) FILTER (flag_a = 0 AND flag_b = 0) AS n00, count(*) FILTER (flag_a = 0 AND flag_b = 1) AS n01, count(*) FILTER (flag_a = 1 AND flag_b = 0) AS n10, count(*) FILTER (flag_a = 1 AND flag_b = 1) AS n11 FROM rec GROUP BY ALL")
def mcnemar_counts(spark, d):
    return stats.contingency(lenses.paired_records(spark, d), ["corpus"], "flag_a", "flag_b")


@query("mcnemar_exact", REC + """, c AS (SELECT corpus, CAST(circuit % 97 AS INTEGER) AS bucket, count(*) FILTER (flag_a = 0 AND flag_b = 0) AS n00, count(*) FILTER (flag_a = 0 AND flag_b = 1) AS n01, count(*) FILTER (flag_a = 1 AND flag_b = 0) AS n10, count(*) FILTER (flag_a = 1 AND flag_b = 1) AS n11 FROM rec GROUP BY ALL),
tail AS (SELECT *, n01 + n10 AS n, list_sum(list_transform(range(0, least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2)))) AS half FROM c)
SELECT corpus, bucket, n00, n01, n10, n11, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * half) END, 6) AS p FROM tail""")
def mcnemar_exact(spark, d):
    rec = lenses.paired_records(spark, d).withColumn("bucket", (F.col("circuit") % 97).cast("int"))
    return stats.mcnemar_exact(stats.contingency(rec, ["corpus", "bucket"], "flag_a", "flag_b")).withColumn("p", r("p"))


_CELLS = ", c AS (SELECT corpus, count(*) FILTER (flag_a = 0 AND flag_b = 1) AS n01, count(*) FILTER (flag_a = 1 AND flag_b = 0) AS n10 FROM rec GROUP BY ALL)"


@query("mcnemar_chi2", REC + _CELLS + """ SELECT corpus, round(pow(greatest(abs(n01 - n10) - 1, 0), 2) / (n01 + n10), 6) AS statistic, round((n10 + 0.5) / (n01 + 0.5), 6) AS odds_ratio,
round(exp(ln((n10 + 0.5) / (n01 + 0.5)) - 1.96 * sqrt(1 / (n10 + 0.5) + 1 / (n01 + 0.5))), 6) AS ci_low, round(exp(ln((n10 + 0.5) / (n01 + 0.5)) + 1.96 * sqrt(1 / (n10 + 0.5) + 1 / (n01 + 0.5))), 6) AS ci_high FROM c""")
def mcnemar_chi2(spark, d):
    out = stats.mcnemar_chi2(stats.contingency(lenses.paired_records(spark, d), ["corpus"], "flag_a", "flag_b"))
    return out.select("corpus", *[r(c).alias(c) for c in ("statistic", "odds_ratio", "ci_low", "ci_high")])


_RANKS = REC + """, dd AS (SELECT corpus, round(size_a - size_b, 12) AS d FROM rec WHERE round(size_a - size_b, 12) <> 0),
rk AS (SELECT corpus, d, rank() OVER (PARTITION BY corpus ORDER BY abs(d)) + (count(*) OVER (PARTITION BY corpus, abs(d)) - 1) / 2 AS rk FROM dd),
w AS (SELECT corpus, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm FROM rk GROUP BY ALL)"""


@query("wilcoxon_ranks", _RANKS + " SELECT corpus, CAST(n AS BIGINT) AS n, CAST(wp AS DOUBLE) AS w_plus, CAST(wm AS DOUBLE) AS w_minus, round((wp - wm) / (wp + wm), 6) AS rank_biserial FROM w")
def wilcoxon_ranks(spark, d):
    return stats.signed_ranks(lenses.paired_records(spark, d), ["corpus"], "size_a", "size_b").select("corpus", "n", "w_plus", "w_minus", r("rank_biserial").alias("rank_biserial"))


@query("wilcoxon_p")
def wilcoxon_p(spark, d):
    rec = lenses.paired_records(spark, d).withColumn("bucket", (F.col("circuit") % 199).cast("int"))
    return stats.wilcoxon(rec, ["bucket"], "size_a", "size_b")


@query("wilcoxon_ordinal_z", REC + """, dd AS (SELECT corpus, circuit, target, size_a - size_b AS d FROM rec WHERE size_a - size_b <> 0),
rk AS (SELECT corpus, d, row_number() OVER (PARTITION BY corpus ORDER BY abs(d), circuit, target) AS rk FROM dd),
w AS (SELECT corpus, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp FROM rk GROUP BY ALL)
SELECT corpus, round((wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM w""")
def wilcoxon_ordinal_z(spark, d):
    return stats.wilcoxon_ordinal(lenses.paired_records(spark, d), ["corpus"], "size_a", "size_b", ["circuit", "target"]).select("corpus", r("z").alias("z"))


_TWO = REC + ", xy AS (SELECT circuit % 50 AS bucket, corpus, quantity FROM rec WHERE corpus IN ('A', 'R'))"


@query("mann_whitney_u", _TWO + """, rk AS (SELECT *, rank() OVER (PARTITION BY bucket ORDER BY quantity) + (count(*) OVER (PARTITION BY bucket, quantity) - 1) / 2 AS rk FROM xy),
g AS (SELECT bucket, CAST(count(*) FILTER (corpus = 'A') AS DOUBLE) AS n1, CAST(count(*) FILTER (corpus = 'R') AS DOUBLE) AS n2, sum(rk) FILTER (corpus = 'A') AS r1 FROM rk GROUP BY ALL)
SELECT bucket, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS dominance FROM g""")
def mann_whitney_u(spark, d):
    rec = lenses.paired_records(spark, d).withColumn("bucket", F.col("circuit") % 50)
    return stats.mann_whitney(rec, ["bucket"], "corpus", "A", "R", "quantity").select("bucket", "n1", "n2", "u", r("dominance").alias("dominance"))


@query("cliffs_delta", _TWO + " SELECT a.bucket, round(avg(sign(a.quantity - b.quantity)), 6) AS delta FROM xy a JOIN xy b ON b.bucket = a.bucket AND a.corpus = 'A' AND b.corpus = 'R' GROUP BY ALL")
def cliffs_delta(spark, d):
    rec = lenses.paired_records(spark, d).withColumn("bucket", F.col("circuit") % 50)
    return stats.cliffs_delta(rec, ["bucket"], "corpus", "A", "R", "quantity").select("bucket", r("delta").alias("delta"))


@query("kruskal_h", REC + """, rk AS (SELECT corpus, quantity, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS rk, CAST(count(*) OVER () AS DOUBLE) AS n FROM rec),
g AS (SELECT corpus, count(*) AS m, sum(rk) AS s, any_value(n) AS n FROM rk GROUP BY ALL), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM rec GROUP BY quantity))
SELECT count(*) AS n_groups, round((12 * sum(s * s / m) / (any_value(n) * (any_value(n) + 1)) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (pow(any_value(n), 3) - any_value(n))), 4) AS h FROM g, t""")
def kruskal_h(spark, d):
    rec = lenses.paired_records(spark, d).withColumn("all", F.lit(1))
    return stats.kruskal(rec, ["all"], "corpus", "quantity").select("n_groups", F.round("h", 4).alias("h"))


@query("cohens_d", REC + " SELECT corpus, round((avg(size_a) - avg(size_b)) / sqrt((var_samp(size_a) + var_samp(size_b)) / 2), 6) AS d FROM rec GROUP BY ALL")
def cohens_d(spark, d):
    return stats.cohens_d(lenses.paired_records(spark, d), ["corpus"], "size_a", "size_b").select("corpus", r("d").alias("d"))


@query("cohens_kappa", REC + """, t AS (SELECT corpus, CAST(count(*) AS DOUBLE) AS n, sum(CAST(flag_a = flag_b AS INTEGER)) AS same, sum(flag_a) AS a1, sum(flag_b) AS b1 FROM rec GROUP BY ALL)
SELECT corpus, round((same / n - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)), 6) AS kappa FROM t""")
def cohens_kappa(spark, d):
    return stats.cohens_kappa(lenses.paired_records(spark, d), ["corpus"], "flag_a", "flag_b").select("corpus", r("kappa").alias("kappa"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    rec = lenses.paired_records(spark, d)
    return stats.bootstrap_interval(rec.withColumn("row_key", F.xxhash64("circuit", "target")), ["corpus"], "size_a", 200)
