"""Secret scans with an incremental blob ledger.

Every version of every file is a row with a text, whose blob is addressed by the SHA-256 of its UTF-8 bytes. The ledger is
a table of (blob, findings, scan) in the folder that the caller names, with a part for each version of the rules, which is a
digest of the rules themselves. A scan reads only the blobs that the ledger lacks for its rules, each once for a task,
appends them, and findings join back to every path and version that has the blob. A first scan moves no text; a later one
moves one text for each blob and task, to leave out those that are known.

Base kinds are ``assign``, ``access`` and ``hex``; the method adds ``github``, ``jwt`` and ``pem``, whose spans never replace
a base one.

Defined cases: null text is the empty blob; empty blobs have no findings; blobs that many rows share are told once; rows
that repeat are joined each; an empty table adds nothing; a ledger path that does not exist yet is an empty ledger; columns
of the caller named as those added (``blob``, ``findings``) are replaced by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds in their order, each with its pattern, the group that is measured and its least length.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 30),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
)
BASE = ("assign", "access", "hex")
#: A text without the mark of a kind has no match of it; cheap to look for. Hex has its own pattern.
_MARKS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "github": ("gh",), "jwt": ("eyJ",), "pem": ("-----BEGIN ",)}
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of RULES."""
    text = text or ""
    out = []
    low = ""
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        marks = _MARKS.get(kind)
        if kind == "assign":
            low = text.lower()
            if not any(m in low for m in marks):
                continue
        elif marks and not any(m in text for m in marks):
            continue
        if kind == "hex":  # greedy runs: those of 24 and more are found alike by asking for 24
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), rank, kind, m.end()))
    out.sort()
    return [(kind, start, end) for start, _, kind, end in out]


def rule_version(rules=RULES) -> str:
    """Digest of the rules: another pattern, order or length is another version, under which all blobs are new."""
    told = [(kind, pattern.pattern, int(pattern.flags), group, least) for kind, pattern, group, least in rules]
    return hashlib.sha256(repr(told).encode()).hexdigest()[:16]


def blobs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))


def read_ledger(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(blob, findings, scan) of the blobs that have been scanned under these rules; empty where nothing has been written."""
    part = f"{path}/rules={version or rule_version()}"
    schema = f"blob binary, findings {FINDINGS}, scan string"
    p = spark._jvm.org.apache.hadoop.fs.Path(part)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(part)


def scan_new(rows: DataFrame, ledger_path: str, version: str | None = None, scan: str = "") -> None:
    """Scan the blobs of ``rows`` (text) that the ledger lacks under the rules, and append them to it, marked as ``scan``."""
    spark = rows.sparkSession
    version = version or rule_version()
    known = read_ledger(spark, ledger_path, version).select("blob")
    new = blobs(rows.select("text"))
    if known.limit(1).count():
        # Copies meet in their task before one text for each blob moves.
        new = new.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for frame in parts:
            frame = frame[~frame["blob"].duplicated() & ~frame["blob"].isin(done)]
            if frame.empty:
                continue
            if len(done) < 1_000_000:
                done.update(frame["blob"])
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in frame["text"]]
            yield pd.DataFrame({"blob": frame["blob"].to_numpy(), "findings": found})

    told = new.select("blob", "text").mapInPandas(find, f"blob binary, findings {FINDINGS}")
    told = told.groupBy("blob").agg(F.first("findings").alias("findings"))  # equal texts have equal findings
    told.withColumn("scan", F.lit(scan)).write.mode("append").parquet(f"{ledger_path}/rules={version}")


def secret_findings(rows: DataFrame, ledger_path: str, version: str | None = None, scan: str = "") -> DataFrame:
    """``rows`` (text and the columns that name its path and version) without the text, with ``blob`` and ``findings``, after
    a scan of what is new. Only blobs with findings are joined back."""
    scan_new(rows, ledger_path, version, scan)
    told = read_ledger(rows.sparkSession, ledger_path, version).where(F.size("findings") > 0).dropDuplicates(["blob"]).select("blob", "findings")
    names = [c for c in rows.columns if c not in ("text", "blob", "findings")]
    out = blobs(rows.select(*[F.col(f"`{c}`") for c in names], "text")).drop("text").join(told, "blob", "left")
    return out.select(*[F.col(f"`{c}`") for c in names], "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
