"""A corpus pipeline of five stages over ``documents``: what each keeps is written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Rows
that repeat a doc_id count as one document from the exact dedup on; rows without a doc_id or a text are kept where a stage
cannot judge them. No stage looks at columns other than doc_id and text, so tables with more columns keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecut.llm import decontaminate, exact, ngram, pieces, toxicity
from tracecut.llm.common import Scratch, first_rows, fold, table

#: Score from which on a document is rejected as toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose score reaches TOXIC; labels are learnt as in op1, from the folds that are not held out."""
    learn = docs.where(F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(False)))
    model = toxicity.train_toxicity(learn, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(F.col("text"), model, spark) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each group of texts that are equal but for white space; empty texts are such a group."""
    rows = first_rows(docs)
    gone = exact.exact_groups(rows.select("doc_id", "text")).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return rows.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group that links of the n-gram join lead through."""
    rows = first_rows(docs)
    gone = ngram.jaccard_classes(rows.select("doc_id", "text")).where("doc_id <> class_id").select("doc_id")
    return rows.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of which windows of benchmark items cover one word in twenty or more."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), name="__found")
    return found.where(~decontaminate.contaminated(F.col("__found"))).drop("__found")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_pieces, pieces): sampled pieces of each document, and the text decoded from them."""
    import public_tokenizers

    coded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "text", (F.length("pieces") / 4).cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: No SQL says a compression distance, an automaton or a sampled lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
