"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without the characters [\\x20\\x09-\\x0D] is cut where its own content says: after at least ``MIN_CHUNK`` code
points, at the next sentence mark, or after ``MAX_CHUNK``. Each chunk gets an identifier from its content; identifiers are
verified by comparing the chunks themselves (one shuffle in which equal chunks of a task are merged first), and chunks
that share a digest without being equal get ranks. A text's recipe is the ordered list of its verified identifiers; two
texts are equal exactly when their recipes are, and only recipes are grouped and joined.

Defined cases: null counts as empty; empty texts are equal to each other; the row that stays has the most code points in
its original text, then the smallest doc_id, a null doc_id last; rows that repeat an id and a text are all marked kept
(``first_rows`` takes one); an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_CHUNK, MAX_CHUNK = 512, 4096
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks, in order; they join to the text again."""
    rule = f"(?s).{{{least}}}[^.!?;:|]{{0,{most - least - 1}}}.?|.+"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def _chunk_rows(docs: DataFrame, chunk_digest, **sizes) -> DataFrame:
    """(chunk_id, chunk): each chunk once, compared byte by byte."""
    every = docs.select(F.explode(chunks(normalised(F.col("text")), **sizes)).alias("chunk")).select(chunk_digest(F.col("chunk")).alias("chunk_id"), "chunk")
    return every.groupBy("chunk_id", "chunk").agg(F.count(F.lit(1)).alias("n")).select("chunk_id", "chunk")


def clashing_ids(docs: DataFrame, chunk_digest=digest, **sizes) -> DataFrame:
    """Digests that stand for more than one chunk; none, but for a clash."""
    return _chunk_rows(docs, chunk_digest, **sizes).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("chunk_id")


def clashing_ranks(docs: DataFrame, clash: DataFrame, chunk_digest=digest, **sizes) -> DataFrame:
    """(chunk_id, chunk, rank from 1) of the chunks whose digest is not theirs alone."""
    both = _chunk_rows(docs, chunk_digest, **sizes).join(clash, "chunk_id")
    less = both.select("chunk_id", F.col("chunk").alias("other"))
    return both.join(less, "chunk_id").groupBy("chunk_id", "chunk").agg(F.sum((F.col("other") <= F.col("chunk")).cast("int")).alias("rank"))


def recipes(docs: DataFrame, scratch: Scratch, chunk_digest=digest, **sizes) -> DataFrame:
    """(doc_id, n_chars, text_sha256, recipe) of every row; equal recipes, equal normalised texts."""
    clash = scratch.keep(clashing_ids(docs, chunk_digest, **sizes))
    base = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    base = base.select("doc_id", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm"), **sizes).alias("parts"))
    if clash.limit(1).count() == 0:
        return scratch.keep(base.select("doc_id", "n_chars", "text_sha256", F.transform("parts", chunk_digest).alias("recipe")))
    # Some digest stands for several chunks: their rows take the ranks along.
    ranks = scratch.keep(clashing_ranks(docs, clash, chunk_digest, **sizes))
    numbered = scratch.keep(base.withColumn("row", F.monotonically_increasing_id()))
    apart = numbered.select("row", F.posexplode("parts").alias("pos", "chunk")).withColumn("chunk_id", chunk_digest(F.col("chunk")))
    ranked = apart.join(ranks, ["chunk_id", "chunk"], "left").select("row", "pos", F.concat("chunk_id", F.coalesce("rank", F.lit(0)).cast("string").cast("binary")).alias("id"))
    lists = ranked.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("recipe"))  # one document's list
    return scratch.keep(numbered.join(lists, "row", "left").select("doc_id", "n_chars", "text_sha256", F.coalesce("recipe", F.array().cast("array<binary>")).alias("recipe")))


def exact_groups(docs: DataFrame, chunk_digest=digest, **sizes) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    scratch = Scratch(docs.sparkSession, "recipes")
    rows = recipes(docs, scratch, chunk_digest, **sizes)
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    # Written, so that the join shuffles both sides itself and a recipe that many rows share can be split among tasks.
    groups = scratch.keep(rows.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    joined = rows.join(groups, "recipe")
    return joined.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"),
        "text_sha256",
    )
