"""The queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, langid, linededup, ngram, pieces, secrets, tokenfile, toxicity, urlfilter
from .common import Scratch, fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    model = toxicity.train_toxicity(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", "held_out", toxicity.toxicity_score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), all_holders=True)
    return out.select("doc_id", "n_lines", "n_deleted", F.length(F.coalesce("clean_text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


#: Vocabulary file of the piece sampler.
PIECE_VOCABULARY = "piece_bpe_32k.model"


@_query
def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))
    return coded.select("doc_id", (F.length("pieces") / 4).cast("long").alias("n_pieces"), F.crc32("pieces").alias("pieces_crc32"), "lossless")


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("found.items")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("found")).alias("contaminated"),
    )


ORACLE["op4_decontamination"] = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item, w[i:least(i + 12, len(w))] AS words FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)),
grams AS (SELECT len(words) AS n, array_to_string(words, ' ') AS g, list(DISTINCT item) AS items FROM win GROUP BY ALL),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
pos AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, lens WHERE len(w) >= n),
hits AS (SELECT p.r, p.i, p.n, g.items FROM pos p JOIN grams g ON g.n = p.n AND g.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
hitw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
hiti AS (SELECT r, list(DISTINCT item) AS items FROM (SELECT r, unnest(items) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hitw USING (r) LEFT JOIN hiti USING (r)
"""


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op5_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id)
"""


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Path of a vocabulary file and the id that ends a document.
WORD_VOCABULARY, END_ID = "word_bpe_49k.json", 2


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = tokenfile.write_tokens(docs, public_tokenizers.path(WORD_VOCABULARY), END_ID, Scratch(spark, "tokens"))
    return tokenfile.read_tokens(shards)


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = langid.fit_languages(langid.language_counts(docs.where(~F.col("held_out"))))
    found = docs.select("doc_id", "held_out", langid.predict_language(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.n_spans")


@_query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Scratch(spark, "ledger").path()
    # An earlier history of half the documents first; the scan of all of them reads only the blobs that are new.
    secrets.scan_new(docs.where(fold(F.col("doc_id"), 2) == 0), ledger, scan="earlier")
    found = secrets.secret_findings(docs, ledger, scan="later")
    read = secrets.read_ledger(spark, ledger).agg(F.count_if(F.col("scan") == "earlier").alias("blobs_earlier"), F.count_if(F.col("scan") == "later").alias("blobs_later"))  # one row
    found = found.join(F.broadcast(read))
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = listed(F.filter("findings", lambda s: s["kind"].isin(*secrets.BASE)))
    return found.select("doc_id", *map(of, secrets.BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"), "blobs_earlier", "blobs_later")


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages are those of the documents of the same id: of low quality or toxic is bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return urlfilter.judge_urls(pages, labels).withColumn("share", F.round("share", 9))


@_query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the URL filter that SQL can say: host, path and rule. The tree is tested against a plain one."""
    cut = table(spark, sf_dir, "pages").select("page_id", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    rule, verdict = urlfilter.matching_rule(F.col("host"), F.col("path"))
    return cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


ORACLE["url_rules"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(what, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT t.host, t.path, arg_max(h || p, length(h || p)) AS rule, arg_max(what, length(h || p)) AS what FROM (SELECT DISTINCT host, path FROM p) t JOIN r ON (t.host = r.h OR t.host LIKE '%.' || r.h) AND starts_with(t.path, r.p) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, f.what AS ruled FROM p LEFT JOIN fit f ON f.host = p.host AND f.path = p.path
"""
