"""Language identification: script ranges, word scores, and Viterbi spans with a switching penalty.

A model holds counts of byte n-grams of whole words (with their ends marked) for each language, hashed to ``BUCKETS``
slots, and the scripts in which each language was seen. The scripts of a word narrow the candidates; the others score by
smoothed log-probabilities of its n-grams. Viterbi over the words of a text, where a change of language costs
``SWITCH``, labels spans of mixed-language text; the text's language is that of most characters.

Only texts that could hold a switch are decoded word by word: where no run of words favours another language by twice the
penalty, the best single language is the best path, which one pass of running sums over all texts of a batch shows.

Defined cases: texts that are null or have no letter are ``und`` with score 0; a word whose script no learned language
uses counts for no language, and a text of such words only is the language with most learned words, with score 0; texts of any length are read whole; ties fall to the alphabetically first language; an empty
model labels everything ``und``; repeated rows are labelled alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .ngram import _mixed

#: Slots of the n-gram table, sizes of the n-grams in bytes, cost of a change of language in nats.
BUCKETS, SIZES, SWITCH = 1 << 16, (1, 2, 3, 4, 5), 18.0
CACHE = 150_000
#: First and last code points of scripts, by the Unicode blocks; other letters are "other".
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
_WORD = re.compile(r"[^\W\d_]+")
_other = len(SCRIPTS)


def script_of(word: str) -> int:
    """Number of the script of a word's first letter."""
    c = ord(word[0])
    if c < 0x250:
        return 0
    for i, ranges in enumerate(SCRIPTS.values()):
        if any(a <= c <= b for a, b in ranges):
            return i
    return _other


def has_letter(word: str) -> bool:
    """Signs such as superscript digits are parts of words, but no letters."""
    return any(map(str.isalpha, word))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the words, and the number of each word's n-grams."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(raw)), lengths)
    left = ends[owner] - np.arange(len(flat))  # bytes from here to the end of the word
    slots, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h[: len(flat) - n + 1] = h[: len(flat) - n + 1] * np.uint64(257) + flat[n - 1 :] + np.uint64(1)
        ok = left >= n
        slots.append((_mixed(h[ok] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[ok])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # languages x BUCKETS, log-probabilities
    allowed: np.ndarray  # scripts x languages
    commonest: int = 0  # the language with most learned words

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, -inf where its script is not the language's."""
        slots, owner = _grams(words)
        out = np.empty((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.weights[k][slots], minlength=len(words))
        out[~self.allowed[np.fromiter(map(script_of, words), np.int64, len(words))]] = -np.inf
        out[[i for i, w in enumerate(words) if not w.isalpha() and not has_letter(w)]] = -np.inf
        return out

    def unread(self, words: list[str]) -> str:
        """Language of a text none of whose words is of a learned script."""
        return self.languages[self.commonest] if self.languages and any(map(has_letter, words)) else "und"


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, slot, n): n-gram counts of all texts by language, and its words by script. Summed in tasks first."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for frame in parts:
            for lang, some in frame.groupby("lang"):
                words: dict[str, int] = {}
                for t in some["text"]:
                    for w in _WORD.findall(t.lower()):
                        words[w] = words.get(w, 0) + 1
                if not words:
                    continue
                keys, n = list(words), np.fromiter(words.values(), np.float64)
                slots, owner = _grams(keys)
                grams[lang] = grams.get(lang, 0) + np.bincount(slots, n[owner], BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(list(map(script_of, keys)), n, _other + 1)
        for kind, found in (("gram", grams), ("script", scripts)):
            for lang, v in found.items():
                at = np.flatnonzero(v)
                yield pd.DataFrame({"lang": lang, "kind": kind, "slot": at, "n": v[at]})
        give_back()

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text").mapInPandas(count, "lang string, kind string, slot long, n double")
    return rows.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


def fit_languages(counts: DataFrame) -> LanguageModel:
    """A model of the counts: at most BUCKETS rows and the scripts for each language come to the driver."""
    got = counts.toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    table, seen = np.zeros((len(languages), BUCKETS)), np.zeros((_other + 1, len(languages)))
    for k, lang in enumerate(languages):
        for kind, into in (("gram", table[k]), ("script", seen[:, k])):
            some = got[(got["lang"] == lang) & (got["kind"] == kind)]
            into[some["slot"].to_numpy(np.int64)] = some["n"].to_numpy()
    weights = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) if len(languages) else table
    share = seen / np.maximum(1, seen.sum(axis=0, keepdims=True))
    return LanguageModel(languages, weights, share >= 1e-4, int(np.argmax(seen.sum(axis=0))) if len(languages) else 0)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best path of languages over the words of one text."""
    return viterbi_all(scores, np.array([len(scores)]), switch)


def viterbi_all(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH, few: int = 24) -> np.ndarray:
    """Best paths of several texts, of 32,767 languages at most, whose words follow each other in ``scores``: a word of every text at a time, and text by
    text once few are left."""
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    back = np.empty((n, k), np.int16)
    path = np.empty(n, np.int16)
    own = np.arange(k, dtype=np.int16)
    v = np.zeros((len(sizes), k))
    deep = int(sizes[few]) if len(sizes) > few else 0  # words that all but a few texts have
    live = np.searchsorted(-sizes, -np.arange(1, deep + 1), side="right")
    for t in range(deep):
        m = live[t]
        at, now = starts[:m] + t, v[:m]
        if t:
            top = now.argmax(axis=1)
            floor = now[np.arange(m), top] - switch
            stay = now >= floor[:, None]
            back[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, floor[:, None])
        v[:m] = now + scores[at]
    for d in range(len(sizes)):
        if sizes[d] <= deep:
            break
        run = v[d].tolist()
        marks = []
        first = starts[d]
        for t, row in enumerate(scores[first + deep : first + sizes[d]].tolist(), deep):
            best = max(run)
            floor = best - switch
            if t:
                top = run.index(best)
                marks.append([i if x >= floor else top for i, x in enumerate(run)])
                run = [(x if x >= floor else floor) + y for x, y in zip(run, row, strict=True)]
            else:
                run = row
        begin = first + max(deep, 1)
        if marks:
            back[begin : first + sizes[d]] = marks
        v[d] = run
    now = v.argmax(axis=1).astype(np.int16)
    for d in range(len(sizes)):
        if sizes[d] <= deep:
            break
        cur, first = int(now[d]), int(starts[d])
        steps = back[first + deep : first + sizes[d]].tolist()
        out = []
        for t in range(len(steps) - 1, -1, -1):
            out.append(cur)
            if t + deep:
                cur = steps[t][cur]
        path[first + deep : first + sizes[d]] = out[::-1]
        now[d] = cur
    for t in range(deep - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        path[at] = now[:m]
        if t:
            now[:m] = back[at, now[:m]]
    return path


class Labeller:
    def __init__(self, model: LanguageModel, switch: float = SWITCH):
        self.model, self.switch, self.kept, self.table, self.n = model, switch, {}, np.empty((1024, len(model.languages)), np.float32), 0

    def _numbers(self, words: list[list[str]]) -> np.ndarray:
        if self.n > CACHE:
            self.kept, self.n = {}, 0
        new = list(set().union(*words).difference(self.kept))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            while self.n + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.n : self.n + len(part)] = self.model.scores(part)
            self.kept.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)
        return np.fromiter(map(self.kept.__getitem__, chain.from_iterable(words)), np.int64)

    def paths(self, words: list[list[str]]) -> list[np.ndarray]:
        """Number of the language of each word of each text; -1 where no language has its script."""
        k = len(self.model.languages)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not k or not lengths.sum():
            return [np.full(n, -1) for n in lengths]
        numbers = self._numbers(words)
        every = self.table[numbers]
        bare = np.isneginf(every)
        lost = bare.all(axis=1)
        every[bare] = -1e4  # below any word that the language could have
        every[lost] = 0
        ends = np.cumsum(lengths)
        path = np.empty(len(every), np.int64)
        hard = []
        for d, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
            if a == b:
                continue
            s = every[a:b]
            best = int(np.argmax(s.sum(axis=0, dtype=np.float64)))
            lead = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
            low = np.minimum.accumulate(lead, axis=0)
            # A path of m runs pays m - 1 penalties: it gains at most what its first and last run do, and each run between.
            outer = max(0.0, float(lead.max())) + max(0.0, float((lead[-1] - low[-1]).max()))
            inner = float((lead[1:] - low[:-1]).max()) if b - a > 1 else 0.0
            if outer < self.switch and inner < self.switch:
                path[a:b] = best
            else:
                hard.append(d)
        if hard:
            hard = np.array(hard)
            rows = np.concatenate([np.arange(ends[d] - lengths[d], ends[d]) for d in hard])
            path[rows] = viterbi_all(every[rows], lengths[hard], self.switch)
        path[lost] = -1
        return np.split(path, ends[:-1])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, share of the letters in it, and spans (start, end, language) in code points of each text."""
        found = [[(m.start(), m.end(), m.group()) for m in _WORD.finditer(t or "")] for t in texts]
        out = []
        for places, path in zip(found, self.paths([[w.lower() for _, _, w in f] for f in found]), strict=True):
            spans: list[tuple[int, int, str]] = []
            size: dict[int, int] = {}
            for (a, b, _), p in zip(places, path.tolist(), strict=True):
                if p < 0:
                    continue
                size[p] = size.get(p, 0) + b - a
                name = self.model.languages[p]
                if spans and spans[-1][2] == name:
                    spans[-1] = (spans[-1][0], b, name)
                else:
                    spans.append((a, b, name))
            if not size:
                out.append((self.model.unread([w for _, _, w in places]), 0.0, []))
                continue
            top = max(sorted(size), key=size.__getitem__)
            out.append((self.model.languages[top], size[top] / sum(size.values()), spans))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, share of the letters in it, and number of spans; no places, so whole words need no search of their own."""
        words = [_WORD.findall((t or "").lower()) for t in texts]
        out = []
        for w, path in zip(words, self.paths(words), strict=True):
            kept = path[path >= 0]
            if not len(kept):
                out.append((self.model.unread(w), 0.0, 0))
                continue
            size = np.bincount(path[path >= 0], np.fromiter(map(len, w), np.int64, len(w))[path >= 0], len(self.model.languages))
            top = int(np.argmax(size))
            out.append((self.model.languages[top], float(size[top] / size.sum()), int((kept[1:] != kept[:-1]).sum()) + 1))
        return out


RESULT = "lang_pred string, score double, n_spans int"
SPANS = "array<struct<start:int,end:int,lang:string>>"


def predict_language(text: Column, model: LanguageModel, spark, switch: float = SWITCH) -> Column:
    """Struct of RESULT for each whole text. The model is a broadcast of 8 * BUCKETS bytes a language."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value, switch)
        for s in parts:
            rows = []
            for at in range(0, len(s), 1000):
                rows += labeller.predict(s.iloc[at : at + 1000].tolist())
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "n_spans"])
        del labeller
        give_back()

    return label(text)


def language_spans(text: Column, model: LanguageModel, spark, switch: float = SWITCH) -> Column:
    """Spans of one language each, in code points of the original text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(sent.value, switch)
        for s in parts:
            yield pd.Series([[{"start": a, "end": b, "lang": w} for a, b, w in spans] for _, _, spans in labeller.label(s.tolist())])

    return label(text)
