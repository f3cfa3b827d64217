"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Items and documents are normalised to words (A-Z lowered, split at ASCII other than letters and digits); a window is
``WINDOW`` consecutive words of an item, or the whole of a shorter one. The automaton is built over word numbers, so that
its size follows the benchmark's words and each document is scanned once. Hits map back to words and to code points of the
original text.

The benchmark goes to the workers in blocks of at most ``BLOCK_CHARS`` characters; a larger benchmark takes several
scans, whose hits are merged by row.

Defined cases: null and empty texts and items have no words and never match; an empty benchmark leaves all documents
clean; items without an id are left out; items that repeat a window all count; repeated rows are judged alike; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, words_of

WINDOW = 13
#: Share of hit words from which on a document is contaminated: 1 in SHARE.
SHARE = 20
BLOCK_CHARS = 8_000_000
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class Scanner:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                owners.setdefault(ids[i : i + window], set()).add(item)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(who))))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None, spans: bool = False) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, numbers of the words hit, items with a window in the text."""
        words = words_of(text)
        hit, items = np.zeros(len(words) + 1, dtype=np.int32), set()
        if self.any and words:
            get = self.number.get
            ids = tuple([get(w, 0) for w in words])
            for end, (n, who) in self.automaton.iter(ids):
                hit[end - n + 1] += 1
                hit[end + 1] -= 1
                items.update(who)
        return len(words), np.flatnonzero(np.cumsum(hit[:-1]) > 0), items


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code points of each run of hit words in the original text."""
    if not len(hit):
        return []
    wanted, out, last = set(hit.tolist()), [], -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if k == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out


def benchmark_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> list[list[tuple[str, str]]]:
    """Items in blocks of bounded size; the benchmark is the stated query set of the scan."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for r in items.toLocalIterator():
        if size and size + len(r["text"]) > most:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item"], r["text"]))
        size += len(r["text"])
    return blocks


def scan_column(text: Column, items: list[tuple[str, str]], spark, window: int = WINDOW) -> Column:
    """Struct of RESULT for each text, scanned for one block of items."""
    sent = spark.sparkContext.broadcast(items)

    @F.pandas_udf(RESULT)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(sent.value, window)
        for s in parts:
            rows = []
            for t in s:
                n, hit, items = scanner.scan(t)
                rows.append((n, len(hit), sorted(items), _spans(t or "", hit)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])
        del scanner
        give_back()

    return scan(text)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, name: str = "found") -> DataFrame:
    """``docs`` with a struct column ``name`` of RESULT; all columns of ``docs`` stay."""
    spark = docs.sparkSession
    blocks = benchmark_blocks(benchmark, block_chars)
    if len(blocks) == 1:
        return docs.withColumn(name, scan_column(F.col("text"), blocks[0], spark, window))
    # Several scans in one pass over the rows: spans of words meet by array functions.
    cols = [f"__{name}_{i}" for i in range(len(blocks))]
    out = docs
    for c, block in zip(cols, blocks, strict=True):
        out = out.withColumn(c, scan_column(F.col("text"), block, spark, window))
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{c}.spans") for c in cols])))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{c}.items") for c in cols]))))
    out = out.withColumn(name, F.struct(F.col(f"{cols[0]}.n_words").alias("n_words"), count_hit(F.col("text"), spans).alias("n_hit"), items.alias("items"), spans.alias("spans")))
    return out.drop(*cols)


def count_hit(text: Column, spans: Column) -> Column:
    """Words inside any span; for spans of several scans, which may overlap."""

    @F.pandas_udf("long")
    def count(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, some in zip(texts, found, strict=True):
            starts = [m.start() for m in _WORD.finditer(t or "")]
            inside = np.zeros(len(starts), dtype=bool)
            for s in some:
                inside[np.searchsorted(starts, s["start"]) : np.searchsorted(starts, s["end"])] = True
            out.append(int(inside.sum()))
        return pd.Series(out, dtype="int64")

    return count(text, spans)


def contaminated(found: Column) -> Column:
    return (found["n_hit"] > 0) & (found["n_hit"] * SHARE >= found["n_words"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
