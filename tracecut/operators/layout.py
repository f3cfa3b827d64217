"""How rows are dealt to tasks before work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_circuit(df: DataFrame, key: str = "circuit_id") -> DataFrame:
    """Deal rows by circuit to as many tasks as the session has shuffle partitions, two a core at least.

    Folds and simulations cost far more than their few bytes suggest; a number that is asked for keeps adaptive execution
    from merging them into few tasks. The grouping that follows reuses this shuffle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, key)
