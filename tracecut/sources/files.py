"""Files in and out: corpora of programs, tolerant record readers, manifests, and sinks."""

from __future__ import annotations

import gzip
import math
import os
import shutil
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import first_per_key, rename_synonyms, top_per_group, union_by_name

# --- corpora ---------------------------------------------------------------------------------------------------------


def tagged(programs: DataFrame, source: str, category: Column | str = "", family: Column | str = "") -> DataFrame:
    """Programs with their suite, category and family, as columns of the path or as given."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return programs.withColumns({"source": F.lit(source), "category": as_col(category), "family": as_col(family), "name": stem(F.col("path"))})


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent(path: Column, up: int = 1) -> Column:
    """Name of the folder ``up`` levels above a file."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-1 - up)), F.lit(""))


def smallest_per_corpus(circuits: DataFrame, most: int, max_qubits: int, max_ops: int) -> DataFrame:
    """Circuits within the caps, the smallest ``most`` of each corpus by (n_qubits, n_ops, name)."""
    fit = circuits.where((F.col("n_qubits") <= max_qubits) & (F.col("n_ops") <= max_ops) & (F.col("n_ops") > 0))
    return top_per_group(fit, "corpus", [F.col("n_qubits"), F.col("n_ops"), F.col("name")], most)


def require_total(circuits: DataFrame, least: int) -> DataFrame:
    """The same rows; the query fails where there are fewer than ``least``."""
    enough = F.when(F.col("__n") >= least, True).otherwise(F.raise_error(F.lit(f"fewer than {least} circuits")).cast("boolean"))
    n = circuits.agg(F.count(F.lit(1)).alias("__n")).select(enough.alias("__ok"))
    return circuits.join(F.broadcast(n), F.col("__ok")).drop("__ok")  # one row


def shortest_paths_first(programs: DataFrame, limit: int) -> DataFrame:
    return programs.orderBy(F.length("path"), "path").limit(limit)


def load_counters(circuits: DataFrame) -> DataFrame:
    """One row: loaded, failed."""
    return circuits.agg(F.count_if(F.col("error").isNull()).alias("loaded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def select_structural(circuits: DataFrame, low: int = 2, high: int = 200, max_ops: int = 4000) -> DataFrame:
    """Circuits within the limits, one for each (name, n_qubits, n_ops): the first in path order; sorted by size."""
    fit = circuits.where(F.col("n_qubits").between(low, high) & (F.col("n_ops") <= max_ops))
    return first_per_key(fit, ["name", "n_qubits", "n_ops"], ["path"]).orderBy("n_qubits", "n_ops", "name")


def available_per_category(circuits: DataFrame, max_qubits: int) -> DataFrame:
    return circuits.groupBy("category").agg(F.count_if(F.col("n_qubits") <= max_qubits).alias("n"))


def structural_means(circuits: DataFrame) -> DataFrame:
    """(category, n_circuits, mean_qubits, mean_dropped_2q, signature) of rows (category, n_qubits, mean_dropped_2q, signature)."""
    return circuits.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_circuits"), F.avg("n_qubits").alias("mean_qubits"), F.avg("mean_dropped_2q").alias("mean_dropped_2q"), F.avg("signature").alias("signature"),
    )


def first_by_stem(circuits: DataFrame) -> DataFrame:
    """One circuit for each name: the first root, then the first path."""
    return first_per_key(circuits, ["name"], ["root", "path"])


def combined(suites: dict[str, DataFrame], names: list[str]) -> DataFrame:
    return union_by_name([suites[n] for n in names])


def extract_archives(root: str) -> list[str]:
    """Unpack .zip and .tar archives and .qasm.gz files of a local folder once, each marked when done; members never leave
    the folder."""
    done = []
    for folder, _, files in os.walk(root):
        for name in sorted(files):
            path = os.path.join(folder, name)
            mark = f"{path}.extracted"
            if os.path.exists(mark):
                continue
            if name.endswith(".zip"):
                with zipfile.ZipFile(path) as z:
                    for member in z.namelist():
                        if os.path.realpath(os.path.join(folder, member)).startswith(os.path.realpath(folder) + os.sep):
                            z.extract(member, folder)
            elif name.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
                with tarfile.open(path) as t:
                    t.extractall(folder, filter="data")
            elif name.endswith(".qasm.gz"):
                with gzip.open(path) as packed, open(path[:-3], "wb") as out:
                    shutil.copyfileobj(packed, out)
            else:
                continue
            open(mark, "w").close()
            done.append(path)
    return done


# --- synthetic circuits ----------------------------------------------------------------------------------------------


def _step(gate: str, qubits: list, angle: Column | None = None, clbit: int | None = None, when: int | None = None) -> Column:
    ints = lambda xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]).cast("array<int>")
    cond = F.lit(None) if when is None else F.struct(ints([when]).alias("bits"), F.lit(1).cast("bigint").alias("value"))
    return F.struct(
        F.lit(gate).alias("gate"), ints(qubits).alias("qubits"), ints([] if clbit is None else [clbit]).alias("clbits"),
        F.array(*([] if angle is None else [angle])).cast("array<double>").alias("params"), cond.cast("struct<bits:array<int>,value:bigint>").alias("cond"),
    )


def synthetic_ops(spark: SparkSession, widths: DataFrame) -> DataFrame:
    """Ops of a circuit for each (family, n): ghz, bell, qft, grover, teleport or vqe, whose angles come from a hash.

    bell has two qubits and teleport three, whatever ``n`` says. Only teleport measures and has conditions;
    ``with_final_measures`` measures the others.
    """
    rows = widths.withColumn("circuit_id", F.concat_ws("_", "family", F.col("n").cast("string"))).withColumn("n", F.when(F.col("family") == "bell", 2).otherwise(F.col("n")))
    i, j, layer = F.col("i"), F.col("j"), F.col("layer")
    each = rows.where("family <> 'teleport'").select("family", "circuit_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))

    def placed(df: DataFrame, a: Column, b: Column, step: Column) -> DataFrame:
        return df.select("circuit_id", F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("k"), step.alias("s"))

    chain = each.where("family IN ('ghz', 'bell')")
    ghz = placed(chain, i, F.lit(0), F.when(i == 0, _step("h", [0])).otherwise(_step("cx", [i - 1, i])))
    pairs = each.where("family = 'qft'").withColumn("j", F.explode(F.sequence(i, F.col("n") - 1)))
    qft = placed(pairs, i, j, F.when(i == j, _step("h", [i])).otherwise(_step("cp", [i, j], F.lit(math.pi) / F.pow(F.lit(2.0), j - i))))
    # Layers of grover: h, cz, h, x, cz, x, h; cz links the first two qubits.
    walls = each.where("family = 'grover'").withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(6)))).where(~layer.isin(1, 4) | ((i == 0) & (F.col("n") >= 2)))
    grover = placed(walls, layer, i, F.when(layer.isin(1, 4), _step("cz", [0, 1])).when(layer.isin(3, 5), _step("x", [i])).otherwise(_step("h", [i])))
    carried = [_step("h", [1]), _step("cx", [1, 2]), _step("cx", [0, 1]), _step("h", [0]), _step("measure", [0], clbit=0), _step("measure", [1], clbit=1), _step("x", [2], when=1), _step("z", [2], when=0), _step("measure", [2], clbit=2)]
    teleport = rows.where("family = 'teleport'").select("circuit_id", F.posexplode(F.array(*carried)).alias("p", "s")).select("circuit_id", F.struct(F.col("p").alias("a"), F.lit(0).alias("b")).alias("k"), "s")
    vqe = each.where("family = 'vqe'").withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((layer != 1) | (i > 0))
    angle = F.pmod(F.xxhash64("circuit_id", "layer", "i"), F.lit(1 << 40)).cast("double") / float(1 << 40) * (2 * math.pi)
    turns = placed(vqe, layer, i, F.when(layer == 1, _step("cx", [i - 1, i])).otherwise(_step("ry", [i], angle)))
    out = union_by_name([ghz, qft, grover, teleport, turns]).withColumn("pos", (F.row_number().over(Window.partitionBy("circuit_id").orderBy("k")) - 1).cast("int"))
    return out.select("circuit_id", "pos", "s.gate", "s.qubits", "s.clbits", "s.params", "s.cond", F.when(F.col("s.gate").isin("cx", "cp", "cz"), 1).otherwise(0).alias("num_ctrl"))


def with_final_measures(ops: DataFrame) -> DataFrame:
    """Circuits without a measure get one on each qubit, at the end."""
    bare = ops.groupBy("circuit_id").agg(F.count_if(F.col("gate") == "measure").alias("m"), (F.max("pos") + 1).alias("end"), F.max(F.array_max("qubits")).alias("top")).where("m = 0")
    q = F.col("q")
    new = bare.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("top")))).select(
        "circuit_id", (F.col("end") + q).alias("pos"), F.lit("measure").alias("gate"), F.array(q).alias("qubits"), F.array(q).alias("clbits"), F.array().cast("array<double>").alias("params"),
        F.lit(None).cast("struct<bits:array<int>,value:bigint>").alias("cond"), F.lit(0).alias("num_ctrl"),
    )
    return ops.unionByName(new)


# --- records ---------------------------------------------------------------------------------------------------------


def read_records(spark: SparkSession, paths: list[str], synonyms: dict[str, str] | None = None) -> DataFrame:
    """CSV, TSV, JSON lines and JSON documents as one table by name, with ``source_file``; absent columns are null."""
    frames = []
    for path in paths:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind in ("csv", "tsv"):
            df = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
        elif kind in ("jsonl", "ndjson"):
            df = spark.read.json(path)
        elif kind == "json":
            df = spark.read.json(path, multiLine=True)
            if len(df.columns) == 1 and df.dtypes[0][1].startswith("array<struct"):
                df = df.select(F.inline(df.columns[0]))
        else:
            continue
        frames.append(rename_synonyms(df, synonyms or {}).withColumn("source_file", F.lit(path)))
    if not frames:
        return spark.createDataFrame([], "source_file string")
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, k in f.dtypes:
            kinds.setdefault(c, set()).add(k)
    mixed = {c for c, k in kinds.items() if len(k) > 1}  # one name of several types: text
    return union_by_name([f.withColumns({c: F.col(c).cast("string") for c in mixed & set(f.columns)}) for f in frames])


def raw_results(texts: DataFrame, record: str) -> DataFrame:
    """Records of JSON texts that are a list, a list under one key, or an object of records by id; ``record`` is their DDL."""
    as_list = F.from_json("text", f"array<struct<{record}>>")
    wrapped = F.flatten(F.map_values(F.from_json("text", f"map<string,array<struct<{record}>>>")))
    keyed = F.map_values(F.from_json("text", f"map<string,struct<{record}>>"))
    head = F.substring(F.trim("text"), 1, 1)
    nested = F.regexp_extract("text", r'^\s*\{\s*"[^"]*"\s*:\s*(.)', 1) == "["
    rows = F.when(head == "[", as_list).when(nested, wrapped).otherwise(keyed)
    return texts.select(*[c for c in texts.columns if c != "text"], F.explode_outer(rows).alias("r")).select(*[c for c in texts.columns if c != "text"], "r.*")


def lookup_fuzzy(names: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, key, path): manifest entries whose key and the name contain one another, the shortest key."""
    low = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    a, b = names.select("name", low(F.col("name")).alias("__n")), manifest.select("key", "path", low(F.col("key")).alias("__k"))
    hit = a.join(F.broadcast(b), F.col("__n").contains(F.col("__k")) | F.col("__k").contains(F.col("__n")))  # a manifest is one row a data file
    return first_per_key(hit.withColumn("__l", F.length("__k")), ["name"], ["__l", "key"]).select("name", "key", "path")


def method_from_name(path: Column, rules: list[tuple[str, str]]) -> Column:
    """A label from the file's name: the first rule whose key it contains."""
    out = F.lit(None).cast("string")
    for key, label in reversed(rules):
        out = F.when(F.lower(path).contains(key), label).otherwise(out)
    return out


# --- checksums -------------------------------------------------------------------------------------------------------


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, length) of every file below a folder, the path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    start = F.expr(f"instr(path, '{os.path.normpath(folder)}') + {len(os.path.normpath(folder)) + 1}")
    return files.select(F.substr("path", start).alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of manifest entries that are absent or differ."""
    have = found.select("path", F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "absent").when(F.col("have") != F.col("sha256"), "differs")
    return manifest.join(have, "path", "left").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def combined_digest(found: DataFrame) -> DataFrame:
    """One row: a digest of all files' digests in path order. One row a file is gathered."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return found.agg(F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["path"], F.lit("\t"), p["sha256"])), "\n").cast("binary"), 256).alias("sha256"))


def provenance(circuits: DataFrame) -> DataFrame:
    """(source, n, sha256): circuits of each source and a digest of their names."""
    names = F.array_join(F.array_sort(F.collect_list("name")), "\n")
    return circuits.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sha2(names.cast("binary"), 256).alias("sha256"))


# --- sinks -----------------------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, not_finite: str = "raise") -> None:
    """JSON lines; numbers that are not finite raise, or become 0 ("zero") or null ("null")."""
    from ..operators.tables import finite

    clean = {c: finite(F.col(c), not_finite) for c, k in df.dtypes if k in ("double", "float")}
    df.withColumns(clean).write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_metadata(spark: SparkSession, path: str, **values) -> None:
    """One row of what a run was given, with the session's version and time."""
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(spark.version).alias("spark"), F.current_timestamp().alias("at")).write.mode("overwrite").json(path)
