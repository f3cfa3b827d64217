"""Cleaning, reshaping, checking and comparing record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words read as true and as false.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def snake(name: str) -> str:
    import re

    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).lower())).strip("_")


def snake_column(c: Column) -> Column:
    """The same rule for names held in rows."""
    cut = F.regexp_replace(F.trim(c), "([a-z0-9])([A-Z])", "$1_$2")
    return F.trim(F.regexp_replace(F.lower(cut), "[^0-9a-z]+", "_"), F.lit("_"))


def rename_synonyms(df: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Snake-case names, map synonyms, and coalesce columns that meet under one name from left to right."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        targets.setdefault(synonyms.get(snake(c), snake(c)), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(t) for t, cs in targets.items()])


def canonical(c: Column, exact: dict[str, str], contains: list[tuple[str, str]]) -> Column:
    """Labels by exact lower-case match, else by the first rule whose text they contain, else as they are."""
    low = F.lower(F.trim(c))
    out = c
    for part, label in reversed(contains):
        out = F.when(low.contains(part), label).otherwise(out)
    for word, label in exact.items():
        out = F.when(low == word, label).otherwise(out)
    return out


def to_number(c: Column, kind: str = "double") -> Column:
    return c.try_cast(kind)


def to_bool(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def within(c: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return ok


def null_outside(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], flag_only: bool = False) -> DataFrame:
    """Values out of range become null (or stay, ``flag_only``), with ``flag_<column>``."""
    out = df
    for c, (low, high) in ranges.items():
        bad = F.coalesce(~within(F.col(c), low, high), F.lit(False))
        out = out.withColumn(f"flag_{c}", bad)
        if not flag_only:
            out = out.withColumn(c, F.when(~bad, F.col(c)))
    return out


def range_report(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, n_outside)."""
    counts = df.agg(*[F.count_if(~within(F.col(c), *r)).alias(c) for c, r in ranges.items()])
    return counts.unpivot([], list(ranges), "column", "n_outside")


def exclusion(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``exclude`` and ``reason``, the reasons that hold joined by semicolons."""
    text = F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in reasons.items()])
    return df.withColumn("reason", text).withColumn("exclude", F.col("reason") != "")


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, share): nulls and not-a-numbers."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    n = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(bad(c)).alias(c) for c in columns])
    long = n.unpivot(["__n"], columns, "column", "n_missing")
    return long.select("column", "n_missing", F.coalesce(F.try_divide("n_missing", "__n"), F.lit(0.0)).alias("share"))


def drop_sparse(df: DataFrame, most: float = 0.3) -> DataFrame:
    """Without the columns whose share of nulls passes ``most``; one row of shares reaches the driver."""
    shares = missing_report(df, df.columns).where(F.col("share") > most).select("column").collect()  # at most one row a column
    return df.drop(*[r["column"] for r in shares])


def fill_group_median(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Nulls take their group's median, then the table's; medians are aggregated, so no group lies in one window."""
    by = df.groupBy(group).agg(*[F.median(c).alias(f"__g_{c}") for c in columns])
    whole = df.agg(*[F.median(c).alias(f"__t_{c}") for c in columns])
    out = df.join(by.withColumnRenamed(group, "__k"), F.col(group).eqNullSafe(F.col("__k")), "left").join(F.broadcast(whole))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__g_{c}"), F.col(f"__t_{c}")) for c in columns}).select(*df.columns)


def zscore_flags(df: DataFrame, group: str, columns: list[str], limit: float = 4.0, least: int = 3) -> DataFrame:
    """``outlier`` columns named where |z| within the group (population deviation, groups of ``least``) passes ``limit``."""
    stats = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    out = df.join(stats, group)
    z = lambda c: F.abs(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))))
    named = F.concat_ws(",", *[F.when((F.col("__n") >= least) & (z(c) > limit), F.lit(c)) for c in columns])
    return out.withColumn("outlier", named).select(*df.columns, "outlier")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[F.col(o) for o in order], *[F.col(c) for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps at most n rows a task and group before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).withColumnRenamed("__r", "rank")


def evenly_spaced(n: Column, most: int) -> Column:
    """At most ``most`` of the places 0..n-1, evenly spaced, halves to even."""
    every = F.sequence(F.lit(0), n - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1).cast("double") / (most - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, every).otherwise(F.array_distinct(some))


def random_sample(df: DataFrame, group: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group without replacement, in the order of a hash of seed, group and item: the same rows
    however the table is dealt."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(item).cast("string")).cast("binary"))
    return top_per_group(df, group, [key, F.col(item)], n).drop("rank")


def long_to_wide(df: DataFrame, keys: list[str], method: str, metrics: list[str], methods: list[str]) -> DataFrame:
    """Means by method as columns method__metric; null keys are kept."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(method) == m, F.col(x))).alias(f"{m}__{x}") for m in methods for x in metrics])


def wide_to_long(df: DataFrame, keys: list[str], methods: list[str], metrics: list[str]) -> DataFrame:
    """Columns method_metric as rows (keys, method, metrics...)."""
    rows = [F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{x}").alias(x) for x in metrics]) for m in methods]
    return df.select(*keys, F.explode(F.array(*rows)).alias("__r")).select(*keys, "__r.*")


def observations(df: DataFrame, keys: list[str], metrics: dict[str, list[str]], source: str) -> DataFrame:
    """Entity-attribute-value rows (rq, metric, value, keys, source): each metric once for each question it answers."""
    rows = [F.struct(F.lit(rq).alias("rq"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, rqs in metrics.items() for rq in rqs]
    return df.select(*keys, F.explode(F.array(*rows)).alias("__o")).select("__o.*", *keys, F.lit(source).alias("source"))


def paired(obs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b) of observations that both methods have."""
    wide = obs.groupBy(*keys).agg(F.avg(F.when(F.col("method") == a, F.col("value"))).alias("a"), F.avg(F.when(F.col("method") == b, F.col("value"))).alias("b"))
    return wide.na.drop(subset=["a", "b"])


def all_and_each(df: DataFrame, scope: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """The aggregates for each scope and for all together, under scope ALL."""
    sets = [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col(scope)]]
    out = df.groupingSets(sets, *[F.col(k) for k in keys], F.col(scope)).agg(F.grouping(scope).alias("__all"), *aggs)
    return out.withColumn("scope", F.when(F.col("__all") == 1, "ALL").otherwise(F.col(scope))).drop(scope, "__all")


def scoped(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """One row for each scope that holds, so a single pass aggregates overlapping scopes."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in scopes.items()]))
    return df.withColumn("scope", F.explode(names))


def violation_rates(df: DataFrame, scope: str, unit: str, variant: str, violated: str, full: str) -> DataFrame:
    """(scope, unit, variant, n, svr, delta_svr): by pair, and by circuit where one violation counts the circuit."""
    # One pass over the rows, which may be costly to make: circuits first, then both units from them.
    v = F.col(violated)
    circuits = df.groupBy(scope, variant, unit).agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("known"), F.sum(v).alias("sum"), F.max(v).alias("any"))
    sums = circuits.groupBy(scope, variant).agg(F.sum("rows").alias("n"), F.try_divide(F.sum("sum"), F.sum("known")).alias("svr"), F.count(F.lit(1)).alias("n_circuits"), F.avg("any").alias("svr_circuits"))
    each = F.array(F.struct(F.lit("pair").alias("unit"), F.col("n"), F.col("svr")), F.struct(F.lit("circuit").alias("unit"), F.col("n_circuits").alias("n"), F.col("svr_circuits").alias("svr")))
    both = sums.select(scope, variant, F.explode(each).alias("e")).select(scope, variant, "e.unit", "e.n", "e.svr")
    base = F.max(F.when(F.col(variant) == full, F.col("svr"))).over(Window.partitionBy(scope, "unit"))
    delta = F.when((F.col(variant) != full) & F.col(scope).isNotNull(), F.round(F.col("svr") - base, 4))
    return both.select(scope, "unit", variant, "n", F.round("svr", 4).alias("svr"), delta.alias("delta_svr"))


def ablation_rollup(rates: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """(keys, n_variants, mean_delta, max_delta): mean and largest size of the change that leaving out each variant makes."""
    return rates.where(F.col(delta).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_variants"), F.avg(F.abs(delta)).alias("mean_delta"), F.max(F.abs(delta)).alias("max_delta"))


def completion(df: DataFrame, status: str, value: str, done: str) -> DataFrame:
    """One row: n, completed, median, p95 and largest of the completed."""
    v = F.when(F.col(status) == done, F.col(value))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("completed"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("largest"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share, degenerate): degenerate with one label at most or one above 99 %."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.max("n").alias("m"))
    return n.join(F.broadcast(whole)).select(F.col(label).alias("label"), "n", (F.col("n") / F.col("t")).alias("share"), ((F.col("k") <= 1) | (F.col("m") / F.col("t") > 0.99)).alias("degenerate"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, n_keys, n_duplicates."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def quality_report(df: DataFrame, key: str, method: str, expected: list[str]) -> DataFrame:
    """One row: n_rows, n_keys, methods present, methods expected and absent."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.array_join(F.array_sort(F.collect_set(method)), ",").alias("methods"),
        F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, expected)), F.collect_set(method))), ",").alias("absent"),
    )


def require_columns(df: DataFrame, required: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Absent columns added as nulls of their type, and their names."""
    absent = [c for c in required if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(required[c]) for c in absent}) if absent else df, absent


def absent_keys(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Expected keys without a row of finite values."""
    return expected.join(df.select(key).distinct(), key, "left_anti")


def finite(c: Column, policy: str = "null") -> Column:
    """Not-a-number and infinities: "null", "zero" or "raise"."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    if policy == "raise":
        return F.when(bad, F.raise_error(F.lit("not finite")).cast("double")).otherwise(c)
    return F.when(~bad, c) if policy == "null" else F.when(bad, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))


def compare(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(column, differing, largest): null-safe differences of two tables by key; rows of one side only differ everywhere."""
    columns = [c for c in a.columns if c not in keys and c in b.columns]
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("__a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("__b"))
    both = left.join(right, keys, "full")
    kinds = {f.name: f.dataType for f in a.schema.fields}
    aggs = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        number = isinstance(kinds[c], NUMERIC)
        near = F.abs(x - y) <= tolerance if number else F.lit(False)
        same = x.eqNullSafe(y) | F.coalesce(near, F.lit(False))
        aggs.append(F.struct(F.count_if(~same | F.col("__a").isNull() | F.col("__b").isNull()).alias("differing"), (F.max(F.abs(x - y)).cast("double") if number else F.lit(None).cast("double")).alias("largest")).alias(c))
    row = both.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.differing").alias("differing"), F.col(f"`{c}`.largest").alias("largest")) for c in columns])).alias("r")).select("r.*")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity: (columns, side)."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def flatten_json(c: Column, depth: int = 8) -> Column:
    """Map of the scalars of a JSON object: keys of the objects on the way joined by underscores. What lies below ``depth``
    levels stays JSON, as lists do."""
    named = "map<string,string>"
    entries = F.map_entries(F.from_json(c, named))
    for _ in range(depth - 1):
        entries = F.flatten(F.transform(entries, lambda e: F.when(
            F.substring(F.trim(e["value"]), 1, 1) == "{",
            F.transform(F.map_entries(F.from_json(e["value"], named)), lambda i: F.struct(F.concat(e["key"], F.lit("_"), i["key"]).alias("key"), i["value"].alias("value"))),
        ).otherwise(F.array(e))))
    return F.map_from_entries(entries)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def derived(df: DataFrame, a: str, b: str, start: str, end: str, count: str, size: str, category: str, order: list[str]) -> DataFrame:
    """Difference, relative change, ratio, density, log1p and category code; zero denominators give null."""
    safe = lambda x, y: F.try_divide(F.col(x), F.nullif(F.col(y).cast("double"), F.lit(0.0)))
    return df.withColumns({
        "delta": F.col(a) - F.col(b), "relative": F.try_divide(F.col(a) - F.col(b), F.nullif(F.col(b).cast("double"), F.lit(0.0))),
        "speedup": safe(start, end), "density": safe(count, size), "log_size": F.log1p(F.col(size).cast("double")),
        "code": F.array_position(F.array(*map(F.lit, order)), F.col(category)) - 1,
    })
