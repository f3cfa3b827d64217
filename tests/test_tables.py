"""Statistics and table operators against hand-made and brute-force values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracecut.functions import tails
from tracecut.operators import comparisons, linalg, stats, tables


def test_mcnemar_and_ranks_by_hand(spark):
    p = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, 0)], "a int, b int").withColumn("k", F.lit(1))
    c = stats.mcnemar_exact(stats.contingency(p, ["k"], "a", "b")).first()
    assert (c.n01, c.n10, c.p) == (2, 1, 1.0)
    d = spark.createDataFrame([(1.0,), (-2.0,), (2.0,), (3.0,), (0.0,)], "a double").withColumns({"b": F.lit(0.0), "k": F.lit(1)})
    r = stats.signed_ranks(d, ["k"], "a", "b").first()
    assert (r.w_plus, r.w_minus, r.rank_biserial) == (7.5, 2.5, 0.5)


def test_tails():
    assert tails.gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.gamma_q(2.5, 11.0705 / 2) == pytest.approx(0.05, abs=1e-5)
    assert tails.binomial_p(2, 10) == pytest.approx(2 * 56 / 1024)
    assert tails.binomial_p(4000, 8200) == pytest.approx(0.0282, abs=2e-3)
    assert tails.signed_rank_p(5, 0, 0) == 2 / 32 and tails.signed_rank_p(0, 0, 0) == 1.0
    assert tails.signed_rank_p(60, 500, 10.0) == pytest.approx(math.erfc(abs(500 - 915) / math.sqrt((60 * 61 * 121 - 5) / 24) / math.sqrt(2)))


def test_unpaired_tests_match_pairs(spark):
    r = random.Random(2)
    rows = [(k, g, float(r.randrange(9))) for k in range(3) for g in "ab" for _ in range(r.randrange(5, 20))]
    df = spark.createDataFrame([*rows, (0, "a", None)], "k int, g string, v double")
    got = {x.k: x for x in stats.mann_whitney(df, ["k"], "g", "a", "b", "v").collect()}
    for k in range(3):
        a, b = [v for i, g, v in rows if (i, g) == (k, "a")], [v for i, g, v in rows if (i, g) == (k, "b")]
        sign = sum((x > y) - (x < y) for x in a for y in b)
        assert got[k].dominance == pytest.approx(sign / len(a) / len(b)) and 0 <= got[k].p <= 1
    assert stats.kruskal(df, ["k"], "g", "v").count() == 3


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(1, float(i % 7)) for i in range(500)], "k int, v double")
    x = stats.bootstrap_interval(df, ["k"], "v", 200).first()
    assert x.ci_low < x.mean < x.ci_high and x.ci_high - x.ci_low < 0.6


def test_counts_marginals_and_tvd(spark):
    c = spark.createDataFrame([("a", "00", 40, 2), ("a", "01", 60, 2), ("b", "00", 50, 2), ("b", "11", 50, 2), ("e", "00", 0, 2)], "run_id string, bitstring string, cnt long, n_bits int")
    m = {(r.run_id, r.qubit): r.p1 for r in linalg.marginals(c).collect()}
    assert m["a", 0] == 0.6 and m["b", 0] == 0.5 and m["e", 0] == 0.5
    p = lambda n: spark.createDataFrame([(1, "0", 1 - n), (1, "1", n)], "k int, bitstring string, p double")
    assert linalg.total_variation(p(0.6), p(0.5), ["k"]).first().tvd == pytest.approx(0.1)
    assert linalg.empirical_threshold(spark.createDataFrame([(0.1,)], "v double"), "v").first().threshold == 0.05


def test_names_labels_and_words(spark):
    df = spark.createDataFrame([("a", None, " YES "), (None, "b", "nope")], "`Circuit ID` string, circuitId string, ok string")
    got = tables.rename_synonyms(df, {}).withColumn("ok", tables.to_bool(F.col("ok"))).collect()
    assert [r.circuit_id for r in got] == ["a", "b"] and [r.ok for r in got] == [True, None]
    assert tables.snake("RunTime (ms)") == "run_time_ms"


def test_cleaning(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", None), ("h", None), ("h", 100.0), ("h", 3.0), (None, None)], "s string, v double")
    filled = sorted(r.v for r in tables.fill_group_median(df, "s", ["v"]).collect())
    assert filled == [1.0, 1.0, 3.0, 3.0, 51.5, 100.0]
    assert tables.drop_sparse(df.withColumn("z", F.lit(None).cast("int"))).columns == ["s"]
    assert tables.require_columns(df, {"v": "double", "w": "int"})[1] == ["w"]
    z = tables.zscore_flags(spark.createDataFrame([("g", float(i)) for i in [0] * 30 + [99]], "s string, v double"), "s", ["v"])
    assert z.where("outlier = 'v'").count() == 1


def test_compare_reports_one_sided_rows(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, 2.5, None)], "k int, v double, s string")
    got = {r.column: (r.differing, r.largest) for r in tables.compare(a, b, ["k"], 1e-9).collect()}
    assert got == {"v": (2, 0.5), "s": (1, None)}


def test_shapes(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (None, "a", 5.0)], "k int, m string, x double")
    wide = tables.long_to_wide(long, ["k"], "m", ["x"], ["a", "b"]).collect()
    assert {(r.k, r.a__x, r.b__x) for r in wide} == {(1, 1.0, 3.0), (None, 5.0, None)}
    assert [r.places for r in spark.range(1).select(tables.evenly_spaced(F.lit(15), 8).alias("places")).collect()] == [[0, 2, 4, 6, 8, 10, 12, 14]]
    flat = spark.createDataFrame([('{"a": {"b": 1, "c": "x"}, "d": 2}',)], "j string").select(tables.flatten_json(F.col("j")).alias("m")).first().m
    assert flat == {"a_b": "1", "a_c": "x", "d": "2"}


def test_comparison_table(spark):
    obs = spark.createDataFrame([("RQ", "size", m, str(i), float(i + (m == "b"))) for m in "ab" for i in range(8)], "rq string, metric string, method string, pair_id string, value double")
    row = comparisons.comparison_table(obs, comparisons.plan(spark, [("RQ", "size", "a", "b")])).first()
    assert (row.n_pairs, row.mean_difference, row.w_plus) == (8, -1.0, 0.0) and 0 < row.p < 0.05


def test_violation_rates_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for frame in parts:
            made.add(len(frame))
            yield frame

    rows = [("A", 1, "full", 0), ("A", 1, "full", 1), ("A", 2, "full", 0), ("A", 1, "cut", 1), ("A", 2, "cut", 1), ("A", 2, "cut", None)]
    kind = "scope string, c int, variant string, bad int"
    got = tables.violation_rates(spark.createDataFrame(rows, kind).mapInPandas(count, kind), "scope", "c", "variant", "bad", "full").collect()
    assert {(r.unit, r.variant): (r.n, r.svr, r.delta_svr) for r in got} == {("pair", "full"): (3, 0.3333, None), ("circuit", "full"): (2, 0.5, None), ("pair", "cut"): (3, 1.0, 0.6667), ("circuit", "cut"): (2, 1.0, 0.5)}
    assert made.value == len(rows)
