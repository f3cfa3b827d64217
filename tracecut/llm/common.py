"""Shared folders, cut lineage, and the word rule that several operators use."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to lower case, a-z, digits and all bytes of characters beyond ASCII kept, every other byte a space: on UTF-8
#: bytes this splits exactly at what lies outside [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one where none is named and all runs in
    one process; an error on a cluster, whose executors could not read each other's rows."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tracecut-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs no more than the step that is running.

    ``keep`` writes a frame and returns it as read back; ``drop`` deletes one that no later step reads. What is left
    goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._end)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tracecut_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        forget(self.spark, df._tracecut_path)

    def _end(self) -> None:
        try:
            forget(self.spark, self.root)
        except Exception:  # the session may have ended before the process
            pass


def give_back() -> None:
    """Return memory that a worker has freed to the system; idle workers stay alive beside new ones."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def fold(column, n: int):
    """crc32 of an id as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each key, the least of those that repeat; rows without a key stay.

    Where no key repeats, only keys are shuffled. The row does not depend on the order of rows, so it is the same one
    each time a plan runs.
    """
    twice = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    if twice.limit(1).count() == 0:
        return df
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.where(F.col(key).isNotNull()).distinct().unionByName(df.where(F.col(key).isNull()))
    ordered = [c for c, kind in df.dtypes if c != key and "map<" not in kind and "variant" not in kind]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    least = df.join(twice, key, "left_semi").groupBy(key).agg(F.min_by(row, F.struct(*[F.col(f"`{c}`") for c in ordered] or [F.lit(0)])).alias("__row"))
    once = df.join(twice, key, "left_anti")
    return once.select(df.columns).unionByName(least.select(key, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns))
