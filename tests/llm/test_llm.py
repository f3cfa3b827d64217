"""Corpus operators against brute force, round trips and held-out labels, with the odd cases of their docstrings."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracecut.llm import common, decontaminate, exact, langid, linededup, ngram, pieces, secrets, tokenfile, toxicity, urlfilter
from tracecut.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, found string, blob string, rep string, pieces string"
LONG = "word " * 30_000 + "end."


def docs(spark, texts, first=0):
    rows = [(i + first if t != "NO ID" else None, None if t == "NULL" else t, "en", "s", 1, "x", "y", "z", "b", "r", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["NULL", "", " \n\t", LONG, "same text here", "same text here", "NO ID", "ünï 日本 text", "a"]


def odd(spark):
    """Nulls, empty and very long texts, ties, a repeated row and columns with clashing names."""
    d = docs(spark, ODD)
    return d.unionByName(d.where("doc_id = 4"))


def empty(spark):
    return docs(spark, []) if False else spark.createDataFrame([], DOCS)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("text", ["", "Hello, WORLD_9", "É t日本-x", "a\x00b", None])
def test_words_follow_the_pattern(text):
    assert [w.decode() for w in common.words_of(text)] == words(text)


# --- exact dedup


def test_exact_groups_match_brute_force(spark):
    texts = ["a b", "ab", "a\tb\n", "abc", "NULL", "", LONG, LONG + " ", "x" * 5000, "x" * 5000 + "y", "\x0b\x0ca b\r"]
    got = {r.doc_id: r for r in exact.exact_groups(docs(spark, texts)).collect()}
    norm = {i: re.sub("[\x20\x09-\x0d]", "", "" if t == "NULL" else t) for i, t in enumerate(texts)}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        best = min(same, key=lambda j: (-len("" if texts[j] == "NULL" else texts[j]), j))
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(same), best == i, hashlib.sha256(t.encode()).hexdigest())


def test_exact_groups_survive_clashing_digests(spark):
    texts = ["".join(random.Random(i).choices("abc. ", k=300)) for i in range(20)]
    texts += texts[:5]
    weak = lambda c: F.substring(c.cast("binary"), 1, 1)
    d = docs(spark, texts)
    fine = {tuple(r) for r in exact.exact_groups(d).collect()}
    assert {tuple(r) for r in exact.exact_groups(d, weak, least=8, most=32).collect()} == fine


def test_exact_groups_of_odd_and_empty_tables(spark):
    rows = exact.exact_groups(odd(spark)).collect()
    assert len(rows) == len(ODD) + 1
    assert {r.keep_id for r in rows if r.doc_id in (0, 1, 2)} == {2}
    assert [r.group_size for r in rows if r.doc_id == 4] == [3, 3]
    assert exact.exact_groups(empty(spark)).count() == 0


def test_chunks_join_to_the_text(spark):
    t = spark.createDataFrame([(LONG,), ("",), ("x" * 10_000,), ("a. b. c.",), ("🙂" * 700 + ".",)], "t string")
    assert all(r.j == r.t for r in t.select("t", F.array_join(exact.chunks(F.col("t")), "").alias("j")).collect())


# --- n-gram join


def brute_links(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([("", i)])
        sets[i] = s
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    ids = sorted(rep.values())
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    count = {i: sum(i in p for p in links) for i in ids}
    return {i: (root[rep[sets[i]]], rep[sets[i]], count[rep[sets[i]]]) for i in texts}


def near_texts(n=120, seed=5):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(20, 90))] for _ in range(n // 6)]
    out = {}
    for i in range(n):
        w = list(base[i % len(base)])
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"z{r.randrange(99)}"
        out[i] = " ".join(w) if i % 17 else " ".join(w).upper()
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_ngram_classes_match_brute_force(spark, block):
    texts = near_texts()
    got = {r.doc_id: (r.class_id, r.set_id, r.n_links) for r in ngram.jaccard_classes(docs(spark, list(texts.values())), block=block).collect()}
    assert got == brute_links(texts)


def test_ngram_odd_and_empty(spark):
    rows = {r.doc_id: r for r in ngram.jaccard_classes(odd(spark)).collect()}
    assert len(rows) == len(ODD)  # the repeated row counts once
    assert rows[5].class_id == 4 and rows[4].n_copies == 2 and rows[0].n_links == 0 and rows[0].class_id == 0
    assert rows[None].class_id is None
    assert ngram.jaccard_classes(empty(spark)).count() == 0


def test_first_rows_takes_the_least_of_those_that_repeat(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1), (None, "x", 1), (None, "x", 1), (1, "a", 3)], "doc_id long, text string, score long")
    assert sorted(map(tuple, common.first_rows(df).collect()), key=str) == sorted([(1, "a", 3), (2, None, 1), (None, "x", 1), (None, "x", 1)], key=str)
    assert common.first_rows(df.where("doc_id = 2")).collect() == df.where("doc_id = 2").collect()
    near = ngram.jaccard_classes(spark.createDataFrame([(1, "q w e r t y u"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_copies) for r in near} == {(1, 1, 2), (2, 1, 2)}


def test_missed_links_are_estimated():
    s = np.array([0.8, 0.9, 1.0])
    stands, lost = ngram.missed(s, 4)
    assert stands * ngram.TREES * s**4 == pytest.approx(1)  # a link matches in that many trees, on average
    assert lost / stands == pytest.approx((1 - s**4) ** ngram.TREES) and lost[-1] == 0


def test_prefixes_are_shortened_by_what_is_found(spark, monkeypatch):
    depths = []
    plain = ngram.likely_edges
    monkeypatch.setattr(ngram, "likely_edges", lambda h, s, depth, *more: depths.append(depth) or plain(h, s, depth, *more))
    ngram.jaccard_classes(docs(spark, [f"{x} " + " ".join(f"w{k}" for k in range(400)) for x in "abcdefgh"])).count()
    assert depths == [ngram.DEPTH]  # links of 0.98: whole signatures do
    depths.clear()
    ngram.jaccard_classes(docs(spark, list(near_texts().values()))).count()
    assert depths[0] == ngram.DEPTH and len(depths) > 1 and depths == sorted(depths, reverse=True)


def test_overlaps_are_exact():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 80))).astype(np.uint64) for _ in range(30)]
    assert (ngram.overlaps(sets, columns=37) == [[len(np.intersect1d(a, b)) if i != j else len(a) - sum(all(v not in s for k, s in enumerate(sets) if k != i) for v in a) for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def test_components(spark):
    from tracecut.llm.common import Scratch

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: x for v, x in root.items() if any(a != b and v in (a, b) for a, b in edges)}


def test_components_do_not_end_unfinished(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), common.Scratch(spark, "t"), most_rounds=1)


# --- decontamination


def brute_hits(text, items, n=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - n + 1)) if iw else ():
            win = iw[k : k + n]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10**6, 60])
def test_contamination_matches_brute_force(spark, block):
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(5)}" for _ in range(r.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)]
    texts = [", ".join(f"W{r.randrange(5)}" for _ in range(60)) + (" " + items[r.randrange(12)][1]) * 2 for _ in range(40)] + ["", "NULL", LONG]
    bench = spark.createDataFrame([*items, (99, None), (None, "w1")], "item_id long, text string")
    got = decontaminate.contamination(docs(spark, texts), bench, block_chars=block, name="__f").select("doc_id", "text", "__f.*").collect()
    for x in got:
        assert (x.n_words, x.n_hit, x["items"]) == brute_hits(x.text, [(str(i), t) for i, t in items]), x.doc_id
        if block > 60 and x.n_hit:
            inside = " ".join(x.text[s.start : s.end] for s in x.spans)
            assert len(words(inside)) == x.n_hit


def test_contamination_odd_and_empty(spark):
    bench = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    got = decontaminate.contamination(odd(spark), bench, name="__f")
    assert sorted(r.doc_id for r in got.where(decontaminate.contaminated(F.col("__f"))).collect()) == [4, 4, 5]
    assert decontaminate.contamination(odd(spark), bench.limit(0), name="__f").where("__f.n_hit > 0").count() == 0
    assert decontaminate.contamination(empty(spark), bench, name="__f").count() == 0


# --- toxicity


def toxic_corpus(n, seed):
    r = random.Random(seed)
    syll = ["an", "er", "th", "on", "ou", "ea", "in", "re", "st", "ly"]
    out = []
    for i in range(n):
        w = ["".join(r.choices(syll, k=r.randrange(1, 4))) for _ in range(r.randrange(30, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["zqidiot", "zqmoron", "kwerpul"]) + r.choice(["", "s", "ing"])
        out.append((" ".join(w), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    train, test = toxic_corpus(900, 1), toxic_corpus(300, 2)
    model = toxicity.fit_toxicity(train)
    d = docs(spark, [t for t, _ in test])
    got = {r.doc_id: r.s for r in d.select("doc_id", toxicity.toxicity_score(F.col("text"), model, spark).alias("s")).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(test))
    assert right / len(test) > 0.97
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_odd_empty_and_single_class(spark):
    model = toxicity.fit_toxicity(toxic_corpus(300, 3))
    rows = odd(spark).select("doc_id", toxicity.toxicity_score(F.col("text"), model, spark).alias("s")).collect()
    by = {r.doc_id: r.s for r in rows}
    assert len(rows) == len(ODD) + 1 and by[0] == by[1] == by[2] and by[4] == by[5]
    assert empty(spark).select(toxicity.toxicity_score(F.col("text"), model, spark)).count() == 0
    none = toxicity.fit_toxicity([])
    assert none.score(5.0) == pytest.approx(none.score(0.0))
    assert toxicity.fit_toxicity([("only ordinary words here", 0)] * 9).score(0.0) < 0.5


def test_every_toxic_word_saves_bytes_and_ordinary_ones_do_not():
    train = toxic_corpus(900, 1)
    model = toxicity.fit_toxicity(train)
    measure = toxicity.Measure(model)
    plain = [t for t, y in toxic_corpus(200, 7) if not y]
    for word in ("zqidiot", "zqmoron", "kwerpul"):
        assert word.encode() in model.toxic
        hit = [w.replace(b" ", b" " + word.encode() + b" ", 4).replace(word.encode() + b" ", b"", 3) for t in plain[:40] for w in toxicity.windows(t)[:1]]
        saved = measure.saved(hit)
        assert np.median(saved) >= 3 and (saved > 0).mean() > 0.85, word
    saved, owner = measure.by_text(plain)
    assert (saved > 0).mean() < 0.01 and len(set(owner.tolist())) == len(plain)


def test_phrases_of_ordinary_words_are_seen():
    r = random.Random(5)
    words = ["".join(r.choices(["an", "er", "th", "on"], k=3)) for _ in range(60)]
    make = lambda bad: " ".join(x for _ in range(60) for x in (["ander", "thonan"] if bad and r.random() < 0.05 else [r.choice([*words, "ander"]), r.choice(["thonan", *words])]))
    sample = [(make(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    clean = [(t.replace("ander thonan", "ander erer thonan") if not y else t, y) for t, y in sample]
    assert any(b"ander thonan" in b"".join(p) for p in toxicity.toxic_passages(clean))


def test_windows_hold_every_word():
    text = " ".join(f"w{i}" for i in range(100))
    for size in (1, 2, 5, 16):
        got = [w.split() for w in toxicity.windows(text, size)]
        assert {x for w in got for x in w} == {f"w{i}".encode() for i in range(100)} and max(map(len, got)) == size
    assert toxicity.windows("") == toxicity.windows(None) == [] and len(toxicity.windows("one")) == 1


def test_training_sample_counts_a_repeated_id_once(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_sample(d, labels) == [("a", 1), ("c", 0)]


def test_training_sample_is_bounded(spark):
    d = docs(spark, [t for t, _ in toxic_corpus(60, 4)])
    labels = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(60)] + [(0, 1, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.training_sample(d, labels, max_toxic=3, max_ordinary=5)
    assert sum(y for _, y in got) == 3 and len(got) == 8
    assert len(toxicity.training_sample(d, labels, max_chars=1000)) < 10


def test_toxicity_without_evidence_rejects_nothing(spark):
    for sample in ([], [("only toxic words here", 1)] * 9, [("one", 1), ("two", 0)]):
        assert toxicity.fit_toxicity(sample).score(0.0) < 0.5
    assert toxicity._bounded(((3.0, 0.9),), True) == ((0.0, toxicity.NO_EVIDENCE), (3.0, 0.9))
    assert toxicity._bounded(((0.0, 0.2), (4.0, 0.9)), True) == ((0.0, 0.2), (4.0, 0.9))


def test_training_sample_skips_what_passes_the_bound(spark):
    ids = [r.id for r in spark.range(9).orderBy(F.xxhash64("id")).collect()]
    texts = {i: "long " * 100 if k == 0 else f"short {i}" for k, i in enumerate(ids)}  # the long one comes first
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.training_sample(docs(spark, [texts[i] for i in range(9)]), labels, max_chars=200)
    assert got == sorted((texts[i], i % 2) for i in ids[1:])


# --- line dedup


def test_patience_is_increasing_and_equal():
    r = random.Random(9)
    for _ in range(200):
        a, b = [r.randrange(9) for _ in range(r.randrange(15))], [r.randrange(9) for _ in range(r.randrange(15))]
        pairs = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_line_dedup_deletes_blocks_of_later_documents(spark):
    block = "This passage is long enough to be a block.\nAnd it goes on for a second line of text."
    texts = ["own start\n" + block + "\nown end", "other start\n" + block + "\nother end", "short\nlines", "short\nother", block]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].clean_text == texts[0] and got[0].n_deleted == 0
    assert got[1].clean_text == "other start\nother end" and got[1].n_deleted == 2
    assert got[2].clean_text == texts[2] and got[3].clean_text == texts[3]  # too short for a block
    assert got[4].clean_text == "" and got[4].n_deleted == 2


def test_line_dedup_keeps_every_line_once(spark):
    r = random.Random(4)
    pool = [f"line number {i} with quite some characters in it" for i in range(30)]
    texts = ["\n".join(r.choices(pool, k=r.randrange(1, 12))) for _ in range(40)]
    got = {x.doc_id: x.clean_text for x in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert {line for t in texts for line in t.split("\n")} == {line for t in got.values() for line in t.split("\n") if line}
    lines = [t.split("\n") for t in texts]
    for i, t in enumerate(texts):
        owners = {next(k for k, ls in enumerate(lines) if x in ls) for x in lines[i]} - {i}
        df = lambda x: sum(x in ls for ls in lines)
        mine = [(k, x, len(x)) for k, x in enumerate(lines[i]) if df(x) > 1]
        gone = {p for o in owners for p in linededup.deleted_lines([(k, x) for k, x in enumerate(lines[o]) if df(x) > 1], mine)}
        assert got[i] == "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)


def test_line_dedup_aligns_with_all_earlier_holders(spark):
    r = random.Random(8)
    pool = [f"line {i} " + "x" * r.choice([5, 12, 18, 45]) for i in range(25)]
    texts = ["\n".join(r.choices(pool, k=r.randrange(1, 14))) for _ in range(60)]
    lines = [t.split("\n") for t in texts]
    df = {x: sum(x in ls for ls in lines) for x in pool}
    mine = [[(k, x, len(x)) for k, x in enumerate(ls) if df[x] > 1] for ls in lines]
    want = [{p for o in range(i) for p in linededup.deleted_lines([(k, x) for k, x, _ in mine[o]], mine[i])} for i in range(60)]
    got = {x.doc_id: x for x in linededup.dedup_lines(docs(spark, texts), all_holders=True).collect()}
    once = {x.doc_id: x for x in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i].clean_text for i in range(60)] == ["\n".join(x for k, x in enumerate(ls) if k not in want[i]) for i, ls in enumerate(lines)]
    assert sum(x.n_deleted for x in got.values()) > sum(x.n_deleted for x in once.values())


def test_line_dedup_odd_and_empty(spark):
    rows = linededup.dedup_lines(odd(spark).drop("pieces")).collect()
    assert len(rows) == len(ODD) + 1 and all(r.n_deleted == 0 for r in rows if r.doc_id != 5)
    assert linededup.dedup_lines(empty(spark)).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def piece_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_are_lossless_and_reproducible(spark, piece_path):
    texts = ["Hello  world\n\tx", "▁ mark ▁▁", "naïve 日本語 🙂 é_ __a", " " * 50, "x" * 3000, "\x00\x7f퟿"]
    d = docs(spark, texts).unionByName(odd(spark))
    a, b = pieces.encode_documents(d, piece_path).collect(), pieces.encode_documents(d.repartition(3), piece_path).collect()
    assert all(r.lossless for r in a) and sorted(map(str, a)) == sorted(map(str, b))
    assert pieces.encode_documents(empty(spark), piece_path).count() == 0
    back = spark.createDataFrame(a).select(pieces.decode_pieces(F.col("pieces"), piece_path).alias("t"), "text").collect()
    assert all(r.t == r.text for r in back)
    other = pieces.encode_documents(d, piece_path, theta=0.0, seed=9).collect()
    assert all(r.lossless for r in other) and {r.pieces for r in other} != {r.pieces for r in a}


def test_pieces_of_a_slice_that_ends_without_text(piece_path):
    s = pieces.Sampler(piece_path)
    for texts in (["a text of several units", None, ""], ["first words here", "", "naïve 日本語 🙂 end", "", None], ["", "x y z"]):
        found = s.encode(list(range(len(texts))), texts)
        assert [s.vocabulary.decode(p) for p in found] == [t or "" for t in texts]
        assert [len(p) > 0 for p in found] == [bool(t) for t in texts]


@pytest.mark.parametrize("unit", ["nation", " the", "aaa", "ing日"])
def test_pieces_are_drawn_in_proportion(piece_path, unit):
    s = pieces.Sampler(piece_path, theta=0.3)
    weight, fallback, size = s.vocabulary.weight, s.vocabulary.fallback, s.vocabulary.size

    def ways(x):
        if not x:
            yield (), 1.0
        for k in range(1, len(x) + 1):
            found = weight.get(x[:k]) or ((size + ord(x), fallback) if k == 1 and x[:1] not in weight else None)
            for rest, w in ways(x[k:]) if found else ():
                yield (found[0], *rest), found[1] * w

    every = {s._bytes(np.array(p), np.array([len(p)]))[0].tobytes(): w for p, w in ways(unit)}
    total, n = sum(every.values()), 20_000
    counts = {}
    for p in s.encode(list(range(n)), [unit] * n):
        counts[p.astype(np.int64).tobytes()] = counts.get(p.astype(np.int64).tobytes(), 0) + 1
    assert set(counts) <= set(every)
    assert max(abs(counts.get(k, 0) / n - w / total) for k, w in every.items()) < 0.015


# --- language id


def test_language_id(spark):
    r = random.Random(6)
    make = {"xx": ["ka", "zu", "mi"], "yy": ["ber", "tor", "sen"], "gr": ["αβ", "γδ"]}
    rows = []
    for i in range(150):
        lang = list(make)[i % 3]
        rows.append((i, " ".join("".join(r.choices(make[lang], k=3)) for _ in range(20)), lang))
    d = spark.createDataFrame([*rows, (900, None, "xx"), (901, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit_languages(langid.language_counts(d))
    assert model.languages == ("gr", "xx", "yy")
    got = d.select("doc_id", "lang", langid.predict_language(F.col("text"), model, spark).alias("f")).where("doc_id < 900").collect()
    assert all(x.f.lang_pred == x.lang and 0 <= x.f.score <= 1 for x in got)
    mixed = "kazumi " * 20 + "bertor " * 20 + "αβγδ " * 9
    (spans,) = spark.createDataFrame([(mixed,)], "t string").select(langid.language_spans(F.col("t"), model, spark).alias("s")).first()
    assert [(s.lang, mixed[s.start : s.end].split()[0]) for s in spans] == [("xx", "kazumi"), ("yy", "bertor"), ("gr", "αβγδ")]


def test_language_id_odd_and_empty(spark):
    model = langid.fit_languages(langid.language_counts(spark.createDataFrame([(1, "aa bb", "en")], "doc_id long, text string, lang string")))
    got = {x.doc_id: x.f for x in odd(spark).select("doc_id", langid.predict_language(F.col("text"), model, spark).alias("f")).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[4].lang_pred == "en"
    signs = langid.Labeller(model).predict(["日本", "² ³ 12 --", "x²", "_"])
    assert [x[0] for x in signs] == ["en", "und", "en", "und"]
    none = langid.fit_languages(langid.language_counts(empty(spark)))
    assert none.languages == () and {x.f.lang_pred for x in odd(spark).select(langid.predict_language(F.col("text"), none, spark).alias("f")).collect()} == {"und"}
    assert empty(spark).select(langid.predict_language(F.col("text"), model, spark)).count() == 0


@pytest.mark.parametrize("few", [0, 2, 50])
def test_viterbi_of_many_texts(few):
    r = np.random.default_rng(4)
    lengths = np.array([1, 7, 3, 20, 11])
    s = r.normal(size=(lengths.sum(), 3)) * 4
    path = langid.viterbi_all(s, lengths, 5.0, few)
    at = 0
    for n in lengths:
        v = {(k,): s[at, k] for k in range(3)}
        best = s[at].copy()
        for t in range(1, n):
            best = np.array([max(best[i] - (5.0 if i != k else 0) for i in range(3)) + s[at + t, k] for k in range(3)])
        p = path[at : at + n]
        assert s[np.arange(at, at + n), p].sum() - 5.0 * (p[1:] != p[:-1]).sum() == pytest.approx(best.max())
        at += n


def test_viterbi_of_many_languages():
    s = np.full((4, 200), -50.0)
    s[:2, 150], s[2:, 199] = 0.0, 0.0
    for few in (0, 9):
        assert langid.viterbi_all(s, np.array([4]), 5.0, few).tolist() == [150, 150, 199, 199]


def test_paths_without_the_best_single_language():
    class Model:
        languages = ("x", "y", "z")

        def scores(self, words):
            return np.array([{"a": (17, -100, 0), "b": (-100, 17, 0), "c": (9, 3, 0)}[w] for w in words], np.float32)

    labeller = langid.Labeller(Model(), 18.0)
    r = random.Random(5)
    texts = [["a", "b"], *(r.choices("abc", k=r.randrange(1, 9)) for _ in range(200))]
    for words, path in zip(texts, labeller.paths(texts), strict=True):
        s = Model().scores(words).astype(float)
        worth = [s[np.arange(len(s)), p].sum() - 18.0 * (p[1:] != p[:-1]).sum() for p in (path.astype(int), langid.viterbi(s, 18.0).astype(int))]
        assert worth[0] == pytest.approx(worth[1])


# --- secrets


def brute_secrets(text):
    rules = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    out = [(m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(rules) for m in re.finditer(p, text or "") if len(m.group(g)) >= n]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


SECRETS = ["password = 'hunter22'", "PassWd:abc", "token: token=abcdef1 secret=\"x\"", "AKIA" + "Q" * 16 + " AKIASHORT", "f" * 24 + "g" + "0" * 23, "apikey: aaaaaa API_KEY=bbbbbbb", "ſecret=abcdefgh toKen=abcdefgh", "é password:==abcdef", "", "sha 0123456789abcdef01234567"]


@pytest.mark.parametrize("text", SECRETS)
def test_base_secrets(text):
    assert [x for x in secrets.find_secrets(text) if x[0] in secrets.BASE] == brute_secrets(text)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    d = docs(spark, [*SECRETS, *SECRETS, "NULL"])
    got = {r.doc_id: [tuple(x) for x in r.findings] for r in secrets.secret_findings(d, path, scan="1").collect()}
    assert all([x for x in got[i] if x[0] in secrets.BASE] == brute_secrets("" if t == "NULL" else t) for i, t in enumerate([*SECRETS, *SECRETS, "NULL"]))
    before = secrets.read_ledger(spark, path).count()
    assert before == len(set(SECRETS))
    secrets.scan_new(d, path, scan="2")
    assert secrets.read_ledger(spark, path).count() == before
    again = secrets.secret_findings(docs(spark, [*SECRETS, "brand new password=abcdefg"]), path, scan="3").collect()
    assert [len(r.findings) for r in again if r.doc_id == len(SECRETS)] == [1]
    assert secrets.read_ledger(spark, path).where("scan = '3'").count() == 1
    secrets.scan_new(d, path, version="other")
    assert secrets.read_ledger(spark, path, "other").count() == before
    assert secrets.read_ledger(spark, path).count() == before + 1
    assert secrets.secret_findings(odd(spark), path).count() == len(ODD) + 1
    assert secrets.secret_findings(empty(spark), path).count() == 0


def test_findings_join_back_to_all_paths_and_versions(spark, tmp_path):
    rows = [("a.txt", 1, "token=abcdefgh"), ("a.txt", 2, "nothing"), ("b/a.txt", 1, "token=abcdefgh"), ("c", 7, None), (None, None, "token=abcdefgh")]
    d = spark.createDataFrame(rows, "path string, version int, text string")
    got = {(r.path, r.version): len(r.findings) for r in secrets.secret_findings(d, str(tmp_path / "l")).collect()}
    assert got == {("a.txt", 1): 1, ("a.txt", 2): 0, ("b/a.txt", 1): 1, ("c", 7): 0, (None, None): 1}


def test_rule_version_follows_the_rules():
    other = (*secrets.RULES[:-1], (*secrets.RULES[-1][:3], 2))
    assert secrets.rule_version() == secrets.rule_version(tuple(secrets.RULES)) != secrets.rule_version(other)


# --- urls


def brute_url(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group(2)) if m else ""
    path = m.group(3) if m else ""
    best = None
    for what, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (what, h + p)
    return host, path, best


URLS = ["http://A.Example.COM/en/7", "https://x.org/es/", "http://net/de/1?x#y", "http://example.net/de/8", "http://notexample.net/de/8", None, "", "no scheme", "http://h?u=http://b.com/en/", "ftp://com/en/9#f", "http://x.com", "a://b://c/d", "http://ex.org/es"]


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(URLS * 3)], "page_id long, url string, html string, host string, bad string")
    labels = spark.createDataFrame([(i, i % 2, "q") for i in range(30)] + [(None, 1, "q"), (3, None, "q")], "page_id long, bad int, host string")
    got = urlfilter.judge_urls(pages, labels).collect()
    assert len(got) == len(URLS) * 3
    for r in got:
        host, path, best = brute_url(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert urlfilter.judge_urls(pages.limit(0), labels).count() == 0
    assert urlfilter.judge_urls(pages, labels.limit(0)).count() == len(URLS) * 3


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://shop.test/{'spam' if i % 2 else 'good'}/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "page_id long, bad int")
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {(r.template, r.verdict) for r in got} == {("/spam/*", "block"), ("/good/*", "allow")}


def plain_tree(pages, bad, fanout, levels):
    """The tree of each host by recursion over lists; shares of every page."""

    def shape(x):
        return "*" + (re.search(r"(\.[A-Za-z]{1,5})$", x) or [""])[0] if re.search("[0-9]", x) else x

    host, nodes = {}, {}
    for i, u in pages.items():
        h, p, _ = brute_url(u)
        s = [shape(x) for x in re.sub("/$", "", re.sub("^/", "", p)).split("/")]
        host[i], nodes[i] = h, s if len(s) <= levels else [*s[:levels], "/".join(s[levels:])]

    def generalise(ids, d):
        here = [i for i in ids if len(nodes[i]) > d]
        if len({nodes[i][d] for i in here}) > fanout:
            for i in here:
                nodes[i] = [*nodes[i][:d], "*", *nodes[i][d + 1 :]]
        for x in {nodes[i][d] for i in here}:
            generalise([i for i in here if nodes[i][d] == x], d + 1)

    share = {}
    every = [bad[i] for i in pages if i in bad]
    base = (sum(every) + 1) / (len(every) + 2)

    def count(ids):
        return float(sum(i in bad for i in ids)), float(sum(bad.get(i, 0) for i in ids))

    def judge(ids, d, p):
        kids = {}
        for i in ids:
            kids.setdefault((nodes[i] + [""])[d], []).append(i)
        order = sorted(kids, key=lambda x: (-1.0 if not count(kids[x])[0] else count(kids[x])[1] / count(kids[x])[0], x))
        groups = []
        for x in order:
            n, k = count(kids[x])
            if groups:
                gn, gk, names = groups[-1]
                q = (gk + k + 1) / (gn + n + 2)
                gap = abs(gk / max(gn, 1) - k / max(n, 1))
                if not n or not gn or gap < urlfilter.MERGE_Z * (q * (1 - q) * (1 / max(gn, 1) + 1 / max(n, 1))) ** 0.5:
                    groups[-1] = (gn + n, gk + k, [*names, x])
                    continue
            groups.append((n, k, [x]))
        for gn, gk, names in groups:
            now = (gk + urlfilter.PRIOR * p) / (gn + urlfilter.PRIOR)
            for x in names:
                ends = [i for i in kids[x] if len(nodes[i]) == d]
                share.update({i: now for i in ends})
                if len(ends) < len(kids[x]):
                    judge([i for i in kids[x] if len(nodes[i]) > d], d + 1, now)

    for h in set(host.values()):
        ids = [i for i in pages if host[i] == h]
        generalise(ids, 0)
        n, k = count(ids)
        judge(ids, 0, (k + urlfilter.PRIOR * base) / (n + urlfilter.PRIOR))
    return {i: ("/" + "/".join(nodes[i]), share[i]) for i in pages}


@pytest.mark.parametrize(("fanout", "levels"), [(64, 12), (4, 12), (4, 3)])
def test_url_tree_matches_a_plain_one(spark, fanout, levels):
    r = random.Random(fanout + levels)
    pages, bad = {}, {}
    for i in range(500):
        depth = r.randrange(0, 7)
        seg = [r.choice(["a", "b", "spam", "x9", "p1.html", f"u{chr(97 + r.randrange(9))}"]) for _ in range(depth)]
        pages[i] = f"http://{r.choice(['h.test', 'h.test', 'k.test'])}/{'/'.join(seg)}" + r.choice(["", "/", "?q=1"])
        if r.random() < 0.7:
            bad[i] = int(r.random() < (0.9 if "spam" in seg else 0.1))
    rows = spark.createDataFrame(list(pages.items()), "page_id long, url string")
    got = urlfilter.judge_urls(rows, spark.createDataFrame(list(bad.items()), "page_id long, bad int"), fanout=fanout, levels=levels).collect()
    want = plain_tree(pages, bad, fanout, levels)
    assert len(got) == len(pages)
    for x in got:
        assert (x.template, pytest.approx(x.share)) == want[x.page_id]
        assert x.verdict == ("block" if x.share >= urlfilter.REJECT else "allow")
    assert {x.verdict for x in got} == {"block", "allow"}


def test_deep_branches_are_told_apart(spark):
    rows = [(i, f"http://shop.test/a/b/{'spam' if i % 2 else 'good'}/c/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "page_id long, bad int")
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {(r.template, r.verdict) for r in got} == {("/a/b/spam/c/*", "block"), ("/a/b/good/c/*", "allow")}


# --- token files


@pytest.mark.parametrize("n", [0, 1, 31, 65_536, 65_537, 200_000])
def test_token_blocks_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.4, n).clip(max=49_000).astype(np.uint32)
    data = tokenfile.encode_tokens(ids)
    assert (tokenfile.decode_tokens(data) == ids).all()
    if n > 65_536:
        assert (tokenfile.decode_tokens(data, only=[1]) == ids[65_536 : 2 * 65_536]).all()
        bad = bytearray(data)
        bad[-1] ^= 1
        with pytest.raises(tokenfile.Corrupt):
            tokenfile.decode_tokens(bytes(bad))


def test_token_files_match_the_tokenizer(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = ["A.B, c.) x\x1c\x1dy \x01 a\x01b É. éa, İ, 日本。 a. b\u0085c <|endoftext|> x", "it's I'LL. ﬁ. ...  á. ́x Σας ΣΑΣ. K.", "x" * 5000 + ".", *near_texts(30).values()]
    d = docs(spark, texts, first=20).unionByName(odd(spark))
    shards = tokenfile.write_tokens(d, path, 2, common.Scratch(spark, "t"), shards=4, shard_tokens=500)
    got = sorted(tokenfile.read_tokens(shards, tokens=True).collect(), key=lambda r: r.start)
    plain = tokenizers.Tokenizer.from_file(path)
    at = 0
    text_of = {}
    for r in d.select("doc_id", "text").collect():
        text_of[r.doc_id] = r.text
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(-1 if k.doc_id is None else k.doc_id for k in d.select("doc_id").collect())
    for r in got:
        ids = [*plain.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids)
        at += len(ids)
    assert shards.count() > 3 and tokenfile.export_shards(shards, str(tmp_path)) == shards.count()
    none = tokenfile.write_tokens(empty(spark), path, 2, common.Scratch(spark, "t"))
    assert tokenfile.read_tokens(none).count() == 0
