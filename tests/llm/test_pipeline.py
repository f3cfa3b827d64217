"""The pipeline's stages on small documents: what each keeps, against a plain reading of its rule."""

import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class_id long, keep_id long, pieces string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    out = str(tmp_path_factory.mktemp("sf"))
    syll = ["an", "er", "th", "on", "ou", "ea", "in", "re", "st", "ly"]
    word = lambda: "".join(r.choices(syll, k=r.randrange(2, 5)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(r.randrange(40, 90))]
        if i % 7 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["zqidiot", "kwerpul"])
        rows.append((i, " ".join(w), "en", "s", 1, 5, 6, "p"))
        labels.append((i, 1, int(i % 7 == 0)))
    bench = [(k, " ".join(word() for _ in range(25))) for k in range(5)]
    rows.append((700, rows[1][1].replace(" ", "  "), "en", "s", 1, 5, 6, "p"))  # copy of 1 with more code points
    w = rows[2][1].split()
    w[3] = "changed"
    rows.append((701, " ".join([*w, "tail"]), "en", "s", 1, 5, 6, "p"))  # near copy of 2
    rows.append((702, bench[0][1] + " " + rows[3][1], "en", "s", 1, 5, 6, "p"))  # contaminated
    rows += [(703, None, None, None, None, None, None, None), (704, "", "en", "s", 0, 5, 6, "p"), (None, "lonely text", "en", "s", 1, 5, 6, "p"), rows[8]]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_are_the_five(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "sentencepiece"]


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in cp.STAGES[:4]:
        new = stage(spark, docs, folder)
        assert new.columns == docs.columns
        rows = new.collect()
        left[name] = [r.doc_id for r in rows]
        docs = spark.createDataFrame(rows, docs.schema)
    toxic = {i for i in range(0, 600, 7)}
    assert not toxic & set(left["toxicity"]) and len(set(range(600)) - toxic - set(left["toxicity"])) <= 3
    assert 1 not in left["exact_dedup"] and 700 in left["exact_dedup"] and left["exact_dedup"].count(8) == 1
    assert (703 in left["exact_dedup"]) != (704 in left["exact_dedup"])
    assert 701 not in left["ngram_jaccard_join"] and 2 in left["ngram_jaccard_join"]
    assert 702 in left["ngram_jaccard_join"] and 702 not in left["decontamination"]
    assert None in left["decontamination"]
    assert len(left["exact_dedup"]) - len(left["ngram_jaccard_join"]) == 1
    assert len(left["ngram_jaccard_join"]) - len(left["decontamination"]) == 1
    last = cp.encode(spark, docs, folder)
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.text for r in last.collect()} == want
    assert {r.doc_id for r in cp.run(spark, folder).select("doc_id").collect()} == set(want)


def test_no_document_is_toxic_without_labels(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
