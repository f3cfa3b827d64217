"""Lenses: the engine's tables read out of general event, vector and line tables, with every tie fixed.

Each lens has a DuckDB counterpart of the same columns, from which the oracle queries start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

N_QUBITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation logs of circuits, one for each user of ``events``, in order of time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    e = e.select(
        F.col("user_id").alias("circuit_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"),
        "event_type",
        "value",
        k.alias("k"),
        (k % N_QUBITS).alias("q0"),
        ((k % N_QUBITS + 1 + F.col("event_id") % 5) % N_QUBITS).cast("int").alias("q1"),
    )
    kind = F.col("event_type")
    gate = F.when(kind == "view", "cx").when(kind == "click", "h").when(kind == "purchase", "rz").when(kind == "signup", "measure").otherwise("x")
    qubits = F.when(kind == "view", F.array("q0", "q1")).otherwise(F.array("q0"))
    return e.select(
        "circuit_id",
        "pos",
        gate.alias("gate"),
        qubits.alias("qubits"),
        F.when(kind == "signup", F.array("q0")).otherwise(F.array().cast("array<int>")).alias("clbits"),
        F.when(kind == "purchase", F.array("value")).otherwise(F.array().cast("array<double>")).alias("params"),
        F.when(~kind.isin("view", "click", "purchase", "signup"), F.struct(F.array("q1").alias("bits"), F.lit(1).cast("long").alias("value"))).alias("cond"),
        F.when(kind == "view", 1).otherwise(0).alias("num_ctrl"),
    )


OPS_SQL = """
ops AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'cx' WHEN 'click' THEN 'h' WHEN 'purchase' THEN 'rz' WHEN 'signup' THEN 'measure' ELSE 'x' END AS gate,
    CASE WHEN event_type = 'view' THEN [q0, q1] ELSE [q0] END AS qubits,
    CASE WHEN event_type = 'signup' THEN q0 END AS mbit,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN q1 END AS rbit
  FROM (
    SELECT circuit_id, pos, event_type, value, k, k % 6 AS q0, CAST((k % 6 + 1 + event_id % 5) % 6 AS INTEGER) AS q1
    FROM (SELECT user_id AS circuit_id, event_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
      coalesce(TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER), 0) AS k FROM events))),
wires AS (SELECT circuit_id, pos, gate, unnest(qubits) AS q, len(qubits) AS arity, mbit, rbit FROM ops)
"""


def amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of six qubits, one for each row of ``embeddings``: (circuit_id, amps) normalised, real."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("circuit_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return e.where(norm > 0).select("circuit_id", F.transform("v", lambda x: x / norm).alias("amps"))


AMPS_SQL = """
vecs AS (SELECT vec_id AS circuit_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
amp AS (
  SELECT circuit_id, i AS idx, v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS a
  FROM (SELECT circuit_id, v, unnest(range(0, 64)) AS i FROM vecs)),
rho AS (
  SELECT circuit_id, t AS target, sum(CASE WHEN (idx >> t) & 1 = 0 THEN a * a ELSE 0 END) AS r00, sum(CASE WHEN (idx >> t) & 1 = 1 THEN a * a ELSE 0 END) AS r11,
    sum(CASE WHEN (idx >> t) & 1 = 0 THEN a * b ELSE 0 END) AS re01
  FROM (SELECT x.circuit_id, t.t, x.idx, x.a, y.a AS b FROM amp x, (SELECT unnest(range(0, 6)) AS t) t JOIN amp y ON y.circuit_id = x.circuit_id AND y.idx = xor(x.idx, CAST(1 << t.t AS BIGINT)))
  GROUP BY ALL)
"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement counts: (run_id, bitstring, cnt, n_bits) of the 8-bit forms of ``k`` of each user's events."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    rows = e.select(F.col("user_id").alias("run_id"), F.lpad(F.bin(k.cast("long")), 8, "0").alias("bitstring"))
    return rows.groupBy("run_id", "bitstring").agg(F.count(F.lit(1)).alias("cnt")).withColumn("n_bits", F.length("bitstring"))


COUNTS_SQL = """
counts AS (
  SELECT user_id AS run_id, lpad(bin(coalesce(TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0)), 8, '0') AS bitstring, count(*) AS cnt
  FROM events GROUP BY ALL)
"""


def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired method outcomes of each order line: (circuit, target, corpus, size_a, size_b, flag_a, flag_b)."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("circuit"),
        F.row_number().over(order).alias("target"),
        F.col("l_returnflag").alias("corpus"),
        F.col("l_discount").alias("size_a"),
        F.col("l_tax").alias("size_b"),
        (F.col("l_discount") > 0.05).cast("int").alias("flag_a"),
        (F.col("l_tax") > 0.04).cast("int").alias("flag_b"),
        F.col("l_quantity").alias("quantity"),
    )


RECORDS_SQL = """
rec AS (
  SELECT l_orderkey AS circuit, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS target,
    l_returnflag AS corpus, l_discount AS size_a, l_tax AS size_b, CAST(l_discount > 0.05 AS INTEGER) AS flag_a, CAST(l_tax > 0.04 AS INTEGER) AS flag_b, l_quantity AS quantity
  FROM lineitem)
"""
