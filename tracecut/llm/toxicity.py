"""Toxicity by compression distance: windows of a text compressed under a dictionary of ordinary and one of toxic text.

Both dictionaries are trained by zstandard. The ordinary one is trained on ordinary documents. The toxic one is trained on
the passages of toxic documents that contrast with ordinary ones: runs of characters, and pairs of words, that occur in
toxic documents far more often than chance allows, where a context that copies repeat counts once. A window of ``WINDOW``
words is compressed with the ordinary dictionary alone, and with the toxic one laid before it, so that ordinary words cost
the same in both; parts of toxic passages that ordinary text meets by themselves lie in both, too. What the second saves is
the window's evidence, as a likelihood ratio from the threshold on from which savings speak for toxic text. A document's
evidence is that of all its windows, of which a toxic text has about as many toxic ones however long it is. Ratios,
threshold and the steps from evidence to a probability are calibrated on a third of the sample, which the dictionaries that
score have not seen. Matches are chosen by zstandard's optimal parser: a greedy one takes other matches where a dictionary
has one more, and blurs the difference. A window that holds no run of ``MIN_MATCH`` bytes of the toxic dictionary has no
match there and saves nothing; only the others are compressed.

Defined cases: null and empty texts have no windows and evidence 0; texts of any length are read whole; repeated rows are
scored alike; an empty table gives no rows; a text without evidence never reaches one half, so a model that has learnt
nothing toxic (no labels, one class, or too few) rejects no text. A labelled text that would pass the sample's character
bound is left out of it, and those after it are still taken; an id that repeats counts once in the sample, with its least
text.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, give_back
from .ngram import _mixed

#: Bound of the training sample: rows of each class, in the order of a hash of their ids, and characters in all.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 3000, 6000, 40_000_000
#: Bytes of each dictionary, at most.
ORDINARY_BYTES, TOXIC_BYTES = 400_000, 65_536
#: Words of the windows that the ordinary dictionary is trained on, and their number, evenly spaced over the sample.
TRAINED_WORDS, TRAINED_ON = 16, 120_000
#: Words of a window, and words that the next window repeats, so that a phrase across their border is seen.
WINDOW, OVERLAP = 16, 2
#: Bytes of the shortest match, and sizes of the runs whose counts tell toxic passages from the rest of toxic documents.
MIN_MATCH, UNITS = 6, (5, 7, 9)
#: Times that a contrasting run is more frequent in toxic documents, at least; nats by which chance is ruled out beyond
#: the logarithm of the number of runs compared.
RATIO, MARGIN = 20.0, 0.0
#: Behind windows and dictionaries: the matcher does not look into the last bytes.
PAD = b"\n" * 9
#: Score of a text without evidence, at most.
NO_EVIDENCE = 0.49
#: Bytes saved on a window from which on all count alike.
MOST = 24
#: Bits of the slots of contexts seen, one bit each, and of those of counts of word pairs.
_CONTEXTS, _PAIRS = 27, 22
#: Bits of the slots that tell most runs of a text from those of the toxic dictionary, before they are compared.
_RUNS = 20


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    shared: bytes
    toxic: bytes
    steps: tuple[tuple[float, float], ...]  # evidence from which on, score
    ratios: tuple[float, ...] = (1.0,)  # likelihood ratio of a toxic window by the bytes saved on it, from 0 on
    per_text: float = 1.0  # windows of a toxic text that are toxic, on average
    window: int = WINDOW

    def score(self, evidence: float) -> float:
        got = self.steps[0][1]
        for least, p in self.steps:
            if evidence < least:
                break
            got = p
        return got


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """All windows of a text, each with a space about its words; the last one holds what is left."""
    w = _words(text)
    step = max(1, size - OVERLAP)
    return [b" %b %b" % (b" ".join(w[i : i + size]), PAD) for i in range(0, max(1, len(w) - OVERLAP) if size > OVERLAP else len(w), step)] if w else []


class Measure:
    """Bytes that the toxic dictionary saves on windows."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        par = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
            window_log=20, hash_log=18, chain_log=18, search_log=5, min_match=MIN_MATCH, target_length=16, strategy=zstandard.STRATEGY_BTOPT,
        )
        self.coders = []
        # The same bytes lie behind in both; zeros, which no window has, hold the place of toxic passages in the first.
        for content in (model.ordinary + bytes(len(model.toxic)) + model.shared + PAD, model.ordinary + model.shared + model.toxic + PAD):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=par)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=par))
        self.runs = np.unique(_packed(model.toxic))
        self.slots = np.zeros(1 << _RUNS, bool)
        self.slots[_run_slots(self.runs)] = True

    def _meeting(self, cut: list[bytes]) -> np.ndarray:
        """Places of the windows that hold a run of MIN_MATCH bytes of the toxic dictionary; the others have no match there."""
        v = _packed(b"".join(cut))
        at = np.flatnonzero(self.slots[_run_slots(v)])
        at = at[self.runs[np.minimum(np.searchsorted(self.runs, v[at]), len(self.runs) - 1)] == v[at]] if len(self.runs) else at[:0]
        return np.unique(np.searchsorted(np.cumsum(list(map(len, cut))), at, side="right"))

    def saved(self, cut: list[bytes]) -> np.ndarray:
        if not cut or not self.model.toxic:
            return np.zeros(len(cut), np.int64)
        out = np.zeros(len(cut), np.int64)
        for at in range(0, len(cut), 10_000):
            part = cut[at : at + 10_000]
            met = self._meeting(part)
            if len(met):
                a, b = (c.multi_compress_to_buffer([part[i] for i in met.tolist()]) for c in self.coders)
                out[at + met] = [len(a[i]) - len(b[i]) for i in range(len(met))]
        return out

    def by_text(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved on each window of the texts, and the text of each window."""
        saved, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 200):
            cut = [windows(t, self.model.window) for t in texts[at : at + 200]]
            counts.append(np.array(list(map(len, cut)), np.int64))
            saved.append(self.saved([w for one in cut for w in one]))
        return np.concatenate(saved), np.repeat(np.arange(len(texts)), np.concatenate(counts))

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        return _summed(*self.by_text(texts), len(texts), self.model.ratios, self.model.per_text)


def _summed(saved: np.ndarray, owner: np.ndarray, n: int, ratios: tuple[float, ...], per_text: float) -> np.ndarray:
    """Log-likelihood ratio of each text, of which ``per_text`` windows would be toxic, over all its windows; to the sixth
    place, so that it does not hang on the order of the sum."""
    share = np.minimum(0.5, per_text / np.maximum(1, np.bincount(owner, minlength=n)))[owner]
    return np.round(np.bincount(owner, np.log1p(share * (np.array(ratios)[np.clip(saved, 0, len(ratios) - 1)] - 1)), n), 6)


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """Labelled texts, the first of each class in the order of a hash of doc_id, within the bounds; to the driver."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = docs.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    marked = marked.join(sized, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    chosen = marked.where("toxic > 0").orderBy("h", "doc_id").limit(max_toxic).unionByName(marked.where("toxic <= 0").orderBy("h", "doc_id").limit(max_ordinary))
    ids, used = [], 0
    for r in chosen.orderBy("h", "doc_id").collect():  # at most max_toxic + max_ordinary ids
        if used + r["n"] > max_chars:
            continue
        used += r["n"]
        ids.append((r["doc_id"], int(r["toxic"] > 0)))
    if not ids:
        return []
    spark = docs.sparkSession
    kept = spark.createDataFrame(ids, "doc_id long, toxic int").hint("broadcast")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(kept, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return sorted({(r["text"], r["toxic"]) for r in rows})


def _numbered(part: list[tuple[str, int]]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """Distinct words, and the word numbers of each ordinary and of each toxic text."""
    number: dict[bytes, int] = {}
    groups: tuple[list, list] = ([], [])
    for t, y in part:
        groups[y].append(np.array([number.setdefault(w, len(number) + 1) for w in _words(t)], np.int32))
    return [b"", *number], groups[0], groups[1]


def _seen_first(key: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the contexts that have not been seen; they are from now on."""
    h = (_mixed(key) >> np.uint64(64 - _CONTEXTS)).astype(np.int64)
    h, at = np.unique(h, return_index=True)
    byte, bit = h >> 3, (1 << (h & 7)).astype(np.uint8)
    new = (seen[byte] & bit) == 0
    np.bitwise_or.at(seen, byte[new], bit[new])
    return at[new]


def _word_contexts(texts: list[np.ndarray], n: int) -> np.ndarray:
    """Distinct contexts of each word, which are the words beside it; copies add none."""
    seen, out = np.zeros(1 << _CONTEXTS - 3, np.uint8), np.zeros(n, np.int64)
    for w in texts:
        x = np.concatenate([[0], w, [0]]).astype(np.uint64)
        key = _mixed(_mixed(_mixed(x[:-2]) + x[1:-1]) + x[2:])
        np.add.at(out, w[_seen_first(key, seen)], 1)
    return out


def _pair_contexts(texts: list[np.ndarray], plain: np.ndarray) -> np.ndarray:
    """Distinct contexts of each slot of pairs of ``plain`` words that follow each other."""
    seen, out = np.zeros(1 << _CONTEXTS - 3, np.uint8), np.zeros(1 << _PAIRS, np.int32)
    for w in texts:
        at = np.flatnonzero(plain[w[:-1]] & plain[w[1:]])
        x = np.concatenate([[0], w, [0]]).astype(np.uint64)
        key = _mixed(_mixed(_mixed(_mixed(x[at]) + x[at + 1]) + x[at + 2]) + x[at + 3])
        np.add.at(out, _pair_slots(w)[at[_seen_first(key, seen)]], 1)
    return out


def _pair_slots(w: np.ndarray) -> np.ndarray:
    u = w.astype(np.uint64)
    return (_mixed(_mixed(u[:-1]) + u[1:]) >> np.uint64(64 - _PAIRS)).astype(np.int64)


def _leaning(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Whether counts are RATIO times as frequent in toxic text, of which there is a share ``p``."""
    return a / np.maximum(a + b, 1) >= RATIO * p / (1 + (RATIO - 1) * p)


def _contrast(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Whether counts ``a`` in toxic text, of which there is a share ``p``, stand out against ``b`` in ordinary text, by a
    likelihood ratio."""
    out = np.zeros(len(a), bool)
    if not 0 < p < 1:
        return out
    least = math.log(max(1, int(((a > 0) | (b > 0)).sum()))) + MARGIN
    at = np.flatnonzero(a > 1)  # one context never stands out
    a, b = a[at].astype(float), b[at].astype(float)
    n = a + b
    gain = a * np.log(a / n / p) + b * np.log(np.maximum(b, 1) / n / (1 - p))
    out[at] = _leaning(a, b, p) & (gain >= least)
    return out


def _units(word: bytes) -> list[tuple[int, bytes]]:
    """Runs of a word with its borders, with their places; a short word is one run."""
    p = b" " + word + b" "
    return [(i, p[i : i + k]) for k in UNITS for i in range(len(p) - k + 1)] or [(0, p)]


def _spans(word: bytes, units: set[bytes]) -> list[bytes]:
    """The parts of a word that contrasting runs cover."""
    p, out, end = b" " + word + b" ", [], -1
    for i, u in sorted((i, u) for i, u in _units(word) if u in units):
        if i < end:
            out[-1] += p[end : i + len(u)]
        else:
            out.append(u)
        end = max(end, i + len(u))
    return out


def _runs_met(texts: Iterable[str], passages: list[bytes]) -> tuple[Counter, int]:
    """How often the texts hold each part of a passage, of MIN_MATCH bytes at least, that is part of no longer one there;
    and their bytes."""
    parts = {p[i:j] for p in passages for i in range(len(p)) for j in range(i + MIN_MATCH, len(p) + 1)}
    heads = np.unique(_packed(b"".join(x for x in parts if len(x) == MIN_MATCH))[::MIN_MATCH])
    longest = max(map(len, passages))
    met: Counter = Counter()
    size = 0
    for text in texts:
        t = b" " + b" ".join(_words(text)) + b" "
        size += len(t)
        v = _packed(t)
        at = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, v), len(heads) - 1)] == v)
        end = 0
        for i in at.tolist():
            j = i + MIN_MATCH
            while j < len(t) and j - i < longest and t[i : j + 1] in parts:
                j += 1
            if j > end:
                met[t[i:j]] += 1
                end = j
    return met, size


def _packed(t: bytes) -> np.ndarray:
    """The MIN_MATCH bytes from each place of a text as one number."""
    flat = np.frombuffer(t, np.uint8).astype(np.uint64)
    n = max(0, len(flat) - MIN_MATCH + 1)
    return sum((flat[j : n + j] << np.uint64(8 * j) for j in range(MIN_MATCH)), np.zeros(n, np.uint64))


def _run_slots(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _RUNS)).astype(np.int64)


def toxic_passages(part: list[tuple[str, int]]) -> list[list[bytes]]:
    """What of each toxic text contrasts with ordinary text; texts without any left out."""
    words, ordinary, toxic = _numbered(part)
    a, b = _word_contexts(toxic, len(words)), _word_contexts(ordinary, len(words))
    p = a.sum() / max(1, a.sum() + b.sum())
    # A run that leans to toxic text is part of a word that does.
    number: dict[bytes, int] = {}
    for i in np.flatnonzero((a > 0) & _leaning(a, b, p)).tolist():
        for _, u in _units(words[i]):
            number.setdefault(u, len(number))
    at, of = array("i"), array("i")
    for i in range(1, len(words)):
        for u in {u for _, u in _units(words[i])}:
            k = number.get(u)
            if k is not None:
                at.append(k)
                of.append(i)
    names = list(number)
    at, of = np.array(at, np.int32), np.array(of, np.int32)
    ok = _contrast(np.bincount(at, a[of], len(names)).astype(np.int64), np.bincount(at, b[of], len(names)).astype(np.int64), p) if names else np.zeros(0, bool)
    units = {names[i] for i in np.flatnonzero(ok)}
    spans = {int(i): _spans(words[i], units) for i in np.unique(of[ok[at]]) if a[i]} if len(at) else {}
    marked = np.zeros(len(words), bool)
    marked[list(spans)] = True
    pairs = _contrast(_pair_contexts(toxic, ~marked), _pair_contexts(ordinary, ~marked), p)
    out = []
    for w in toxic:
        found = [s for i in dict.fromkeys(w[marked[w]].tolist()) for s in spans[i]]
        if len(w) > 1:  # pairs of words that do not stand out by themselves
            hit = np.flatnonzero(pairs[_pair_slots(w)] & ~marked[w[:-1]] & ~marked[w[1:]])
            found += dict.fromkeys(b" " + words[w[i]] + b" " + words[w[i + 1]] + b" " for i in hit.tolist())
        if found:
            out.append(found)
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; the samples' own end where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(part: list[tuple[str, int]]) -> tuple[bytes, bytes, bytes]:
    """The ordinary dictionary of a labelled sample, what toxic passages share with ordinary text, and the toxic one; empty
    where there is nothing to train one on."""
    plain = [t for t, y in part if not y]
    every = sum(len(range(0, max(1, n - OVERLAP), TRAINED_WORDS - OVERLAP)) for n in (len(_words(t)) for t in plain) if n)
    cut = list(islice((w for t in plain for w in windows(t, TRAINED_WORDS)), 0, None, 1 + every // TRAINED_ON))
    ordinary = _dictionary(cut, min(ORDINARY_BYTES, max(1024, sum(map(len, cut)) // 4))) if cut else b""
    del cut
    passages = toxic_passages(part)
    if not passages:
        return ordinary, b"", b""
    often = Counter(s for p in passages for s in set(p))
    order = sorted(often, key=lambda s: (often[s], s))
    toxic = _dictionary([b"".join(p) for p in passages], min(TOXIC_BYTES, max(1024, 4 * sum(map(len, often)))))
    # What the trainer had no room for goes before it, the rarest first.
    toxic = (b"".join(s for s in order if s not in toxic) + toxic)[-TOXIC_BYTES:]
    # Parts of passages that ordinary text meets by themselves are no savings.
    (plain, a), (met, b) = (_runs_met((t for t, y in part if y == k), order) for k in (0, 1))
    scale = RATIO * max(1, b) / max(1, a)
    shared = sorted((r for r, n in plain.items() if met[r] < scale * n), key=lambda r: (plain[r], r))
    return ordinary, b"\0".join(shared)[-TOXIC_BYTES:], toxic


def _pooled(evidence: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Isotonic steps: pooled shares of toxic documents by evidence, smoothed by the base rate."""
    n, pos = Counter(evidence.tolist()), Counter(evidence[labels > 0].tolist())
    base = (labels.sum() + 0.5) / (len(labels) + 1)
    pools: list[list[float]] = []  # first and last evidence, toxic documents, documents
    for e in sorted(n):
        pools.append([e, e, pos[e], n[e]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, last, a, b = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + a, pools[-1][3] + b]
    smooth = np.maximum.accumulate([(a + base) / (b + 1) for *_, a, b in pools]).tolist()
    starts = [p[0] if k == 0 else (pools[k - 1][1] + p[0]) / 2 for k, p in enumerate(pools)]  # halfway between pools
    return tuple(zip(map(float, starts), smooth, strict=True)) or ((0.0, float(base)),)


def _window_ratios(saved: np.ndarray, toxic: np.ndarray, texts: int) -> tuple[tuple[float, ...], float]:
    """Likelihood ratio of each saving between toxic and ordinary windows, never falling, and 1 up to the threshold from
    which on a saving speaks for toxic text; and how many windows of each of ``texts`` toxic texts are toxic."""
    k = np.clip(saved, 0, MOST)
    n1, n0 = np.bincount(k[toxic], minlength=MOST + 1), np.bincount(k[~toxic], minlength=MOST + 1)
    base = (n1.sum() + 0.5) / (n1.sum() + n0.sum() + 1)
    pools: list[list[float]] = []
    for i in range(MOST + 1):
        pools.append([1, n1[i] + base, n1[i] + n0[i] + 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            c, x, y = pools.pop()
            pools[-1] = [pools[-1][0] + c, pools[-1][1] + x, pools[-1][2] + y]
    # Windows of toxic texts against those of ordinary ones; most of the former are ordinary themselves.
    mixed = [max(1.0, x / (y - x) * (1 - base) / base) for c, x, y in pools for _ in range(c)]
    more = float(np.maximum(0, n1[1:] - n0[1:] / max(1, n0.sum()) * n1.sum()).sum())
    share = min(0.99, max(more, 0.5) / max(1, n1.sum()))
    return (1.0, *(max(1.0, (r - 1 + share) / share) for r in mixed[1:])), max(more, 0.5) / max(1, texts)


def _bounded(steps: tuple[tuple[float, float], ...], learnt: bool) -> tuple[tuple[float, float], ...]:
    """``steps`` with evidence 0 below one half."""
    if not learnt:
        return ((0.0, min(steps[0][1], NO_EVIDENCE)),)
    if steps[0][1] < 0.5:
        return steps
    return ((0.0, NO_EVIDENCE), *((max(e, 1e-6), p) for e, p in steps))


def fit_toxicity(sample: list[tuple[str, int]], window: int = WINDOW) -> ToxicityModel:
    """Train both dictionaries on two thirds of the sample, and calibrate those very dictionaries on the last third."""
    turn, fit = Counter(), []  # of each class by turns: two to train on, one to calibrate
    for _, y in sample:
        fit.append(turn[y] % 3 > 0)
        turn[y] += 1
    ordinary, shared, toxic = dictionaries([x for x, f in zip(sample, fit, strict=True) if f])
    held = [x for x, f in zip(sample, fit, strict=True) if not f]
    labels = np.array([y for _, y in held], np.int64)
    saved, owner = Measure(ToxicityModel(ordinary, shared, toxic, ((0.0, 0.5),), window=window)).by_text([t for t, _ in held])
    ratios, per_text = _window_ratios(saved, labels[owner] > 0, int(labels.sum())) if toxic else ((1.0,), 1.0)
    steps = _pooled(_summed(saved, owner, len(held), ratios, per_text), labels)
    return ToxicityModel(ordinary, shared, toxic, _bounded(steps, max(ratios) > 1), ratios, per_text, window)


def toxicity_score(text: Column, model: ToxicityModel, spark) -> Column:
    """Score in 0..1 of each whole text. The model is a broadcast of at most ORDINARY_BYTES + TOXIC_BYTES and its steps."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        measure = Measure(m)
        for s in parts:
            out: list[float] = []
            for at in range(0, len(s), 200):
                out += [m.score(e) for e in measure.evidence(s.iloc[at : at + 200].tolist()).tolist()]
            yield pd.Series(out, dtype="float64")
        del measure
        give_back()

    return score(text)


def train_toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> ToxicityModel:
    """Fit on the labelled rows of ``docs``; leave held-out rows away before."""
    model = fit_toxicity(training_sample(docs, labels, **bounds))
    give_back()
    return model
