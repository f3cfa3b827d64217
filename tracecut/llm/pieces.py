"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text is cut into units that pieces do not cross (an optional space with the word after it, a run of marks, or one white
space character). The lattice of a unit has an edge for each vocabulary piece that fits; its weights follow the piece's
score, or a byte fallback for a character that no piece covers. Forward filtering sums the weights of all ways to each
place; backward sampling draws, from the end of the unit, one edge in proportion to its share. Draws come from a counter
mixed with the row's key, the unit and the step, so that a row's segmentation is the same in every run and on every
machine. All units of a batch step backward together.

Spaces are written as the vocabulary's space mark; a space mark in the text itself goes as bytes, as does any character
that the vocabulary lacks, so decoding gives back the very text.

Defined cases: null text encodes as the empty text; empty texts have no pieces; a null key draws as key 0; repeated rows
give equal pieces; texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .ngram import _mixed

MARK = "▁"
#: Sharpness of the draws: 0 treats all pieces alike, larger values favour frequent pieces.
THETA = 1.0
SEED = 20_240_601
#: Units that a worker keeps, from one task to the next.
CACHE = 80_000
_UNIT = re.compile(r" ?[^\W_]+| ?(?:[^\w\s]|_)+|\s")


class Vocabulary:
    """Pieces of a SentencePiece model with their weights, and the tree of their characters as sorted arrays."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.raw: list[bytes] = []
        plain = []
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(p.replace(MARK, " ").encode())
                if MARK not in p[1:]:
                    plain.append((i, p, sp.get_score(i)))
        # Scores of a merge vocabulary are ranks; weights fall with the rank as frequencies of words do.
        order = sorted(plain, key=lambda x: (-x[2], x[0]))
        weights = (1.0 / (2.7 + np.arange(len(order)))) ** theta
        scale = 1.0 / float(np.median(weights)) ** 0.5 if len(order) else 1.0  # keeps sums over long units near one; the same for each way
        self.weight = {p.replace(MARK, " "): (i, w * scale ** len(p)) for (i, p, _), w in zip(order, weights.tolist(), strict=True)}
        self.fallback = float(weights[-1]) * 1e-3 * scale if len(order) else 1.0
        self.longest = max(map(len, self.weight), default=1)
        node: dict[str, int] = {"": 0}
        for p in self.weight:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        steps = sorted((node[p[:-1]] << 21 | ord(p[-1]), n) for p, n in node.items() if p)
        self.step_key, self.step_to = np.array([k for k, _ in steps], np.int64), np.array([n for _, n in steps], np.int32)
        # Steps over the characters below ``near`` by a table with a row for each node that goes on, and one for the rest.
        self.near = 0x100
        close = (self.step_key & 0x1FFFFF) < self.near
        inner = np.unique(self.step_key[close] >> 21)
        self.row = np.full(len(node), len(inner), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.table = np.full((len(inner) + 1, self.near), -1, np.int32)
        self.table[self.row[self.step_key[close] >> 21], self.step_key[close] & 0x1FFFFF] = self.step_to[close]
        self.node_id, self.node_weight = np.full(len(node), -1, np.int32), np.zeros(len(node))
        for p, (i, w) in self.weight.items():
            self.node_id[node[p]], self.node_weight[node[p]] = i, w

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Node reached from each node by each character, -1 where no piece goes on."""
        far = np.flatnonzero(char >= self.near)
        if not len(far):
            return self.table[self.row[node], char]
        out = self.table[self.row[node], np.minimum(char, self.near - 1)]
        out[far] = self._search(node[far], char[far])
        return out

    def _search(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 21 | char
        at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
        return np.where(self.step_key[at] == key, self.step_to[at], -1)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


class Sampler:
    def __init__(self, path: str, theta: float = THETA, seed: int = SEED):
        self.vocabulary, self.seed = Vocabulary(path, theta), np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        self._clear()

    def _clear(self) -> None:
        self.unit: dict[str, int] = {}  # the unit's last state
        self.states = 0
        self.begin = np.empty(1 << 18, np.int32)  # first edge of each state; its likeliest comes first
        self.draw = np.empty(1 << 18)  # cumulative share of each edge among its state's
        self.prev = np.empty(1 << 18, np.int32)  # state the edge comes from, -1 for the unit's start
        self.piece = np.empty(1 << 18, np.int32)  # vocabulary id, or size + code point for a byte fallback
        self.edges = 0

    def _add(self, units: list[str]) -> None:
        """Lattices and forward sums of new units, all units a place at a time; a unit's states follow each other."""
        v = self.vocabulary
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(chars))  # characters from here to the unit's end
        place = np.repeat(lengths, lengths) - left
        froms, tos, ids, weights = [], [], [], []
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        for d in range(v.longest):
            node = v.step(node, chars[at + d])
            ok = node >= 0
            at, node = at[ok], node[ok]
            whole = v.node_id[node] >= 0
            froms.append(at[whole])
            tos.append(at[whole] + d)
            ids.append(v.node_id[node[whole]])
            weights.append(v.node_weight[node[whole]])
            more = left[at] > d + 1
            at, node = at[more], node[more]
            if not len(at):
                break
        bare = np.ones(len(chars), bool)
        bare[froms[0]] = False
        bare = np.flatnonzero(bare)
        froms.append(bare)
        tos.append(bare)
        ids.append((v.size + chars[bare]).astype(np.int32))
        weights.append(np.full(len(bare), v.fallback))
        first, last, piece, weight = map(np.concatenate, (froms, tos, ids, weights))
        order = np.argsort(last, kind="stable")
        first, last, piece, weight = first[order], last[order], piece[order], weight[order]
        # Forward filtering: ways to each place, relative to the unit's scale so far where it would overflow.
        ways = np.empty(len(chars))
        part = np.empty(len(first))
        by_place = np.argsort(place[last], kind="stable")
        cuts = np.searchsorted(place[last][by_place], np.arange(int(lengths.max()) + 1))
        scale = np.zeros(len(chars))  # natural logarithm of what ways were divided by
        for p in range(len(cuts) - 1):
            e = by_place[cuts[p] : cuts[p + 1]]
            if not len(e):
                continue
            start, end = first[e], last[e]
            heads = np.concatenate([[True], end[1:] != end[:-1]])
            if p:
                came = np.maximum(start - 1, 0)
                inner = place[start] > 0
                base = np.where(inner, ways[came], 1.0)
                ref = scale[end - 1]  # the place before; all earlier ones of a unit are within a few orders of it
                base = base * np.exp(np.clip(np.where(inner, scale[came], 0.0) - ref, -700, 700))
            else:
                base, ref = np.ones(len(e)), np.zeros(len(e))
            c = base * weight[e]
            total = np.add.reduceat(c, np.flatnonzero(heads))
            where = end[heads]
            grown = ref[heads]
            far = (total < 1e-100) | (total > 1e100)
            ways[where] = np.where(far, 1.0, total)
            scale[where] = grown + np.where(far, np.log(np.maximum(total, 1e-300)), 0.0)
            part[e] = c / np.repeat(total, np.diff(np.append(np.flatnonzero(heads), len(e))))
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        sizes = np.diff(np.append(heads, len(last)))
        top = np.flatnonzero(part == np.repeat(np.maximum.reduceat(part, heads), sizes))
        top = top[np.concatenate([[True], last[top[1:]] != last[top[:-1]]])]
        for x in (first, piece, part):  # the likeliest edge of each state to its front
            x[heads], x[top] = x[top], x[heads]
        run = np.cumsum(part)
        run -= np.repeat(run[heads] - part[heads], sizes)
        run[np.append(heads[1:], len(run)) - 1] = 2.0  # the last of a state takes what is left
        end, states = self.edges + len(run), self.states + len(chars)
        while end > len(self.draw):
            self.draw, self.prev, self.piece = (np.concatenate([x, np.empty_like(x)]) for x in (self.draw, self.prev, self.piece))
        while states > len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty_like(self.begin)])
        self.begin[self.states : states] = self.edges + heads
        self.draw[self.edges : end] = run
        self.prev[self.edges : end] = np.where(place[first] > 0, self.states + first - 1, -1)
        self.piece[self.edges : end] = piece
        self.unit.update(zip(units, (self.states + ends - 1).tolist(), strict=True))
        self.states += len(chars)
        self.edges = end

    def encode(self, keys: list[int], texts: list[str | None]) -> list[np.ndarray]:
        """Sampled pieces of each text, drawn for its key."""
        if len(self.unit) > CACHE or self.edges > 20 * CACHE:
            self._clear()
        cut = [_UNIT.findall(t or "") for t in texts]
        new = list(set().union(*cut).difference(self.unit))
        if new:
            self._add(new)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        total = int(counts.sum())
        if not total:
            return [np.zeros(0, np.int32) for _ in texts]
        state = np.fromiter(map(self.unit.__getitem__, chain.from_iterable(cut)), np.int64, total)
        row = np.repeat(np.arange(len(cut)), counts)
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        base = _mixed(np.array(keys, np.int64).astype(np.uint64) + self.seed)
        word = _mixed(base[row] + within.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        begin, draw, prev, piece = self.begin, self.draw, self.prev, self.piece
        live, steps, drawn = np.arange(total), np.zeros(total, np.int64), []
        step = 0
        while len(live):
            u = (_mixed(word[live] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = begin[state[live]]
            over = np.flatnonzero(draw[edge] <= u)
            while len(over):
                edge[over] += 1
                over = over[draw[edge[over]] <= u[over]]
            drawn.append((live, piece[edge]))
            steps[live] += 1
            back = prev[edge]
            go = back >= 0
            state[live] = back
            live = live[go]
            step += 1
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]), np.int64)
        for k, (who, what) in enumerate(drawn):
            out[ends[who] - 1 - k] = what
        sizes = np.bincount(row, weights=steps, minlength=len(cut)).astype(np.int64)
        out, sizes = self._bytes(out, sizes)
        return np.split(out.astype(np.int32), np.cumsum(sizes)[:-1])

    def _bytes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte fallbacks spelled out; sizes of the texts after that."""
        size = self.vocabulary.size
        bare = np.flatnonzero(ids >= size)
        if not len(bare):
            return ids, sizes
        points, which = np.unique(ids[bare] - size, return_inverse=True)
        spelled = [self.vocabulary.byte_id[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in points]
        wide = np.ones(len(ids), np.int64)
        wide[bare] = np.array([len(b) for b in spelled])[which]
        ends = np.cumsum(wide)
        out = np.repeat(ids, wide)
        for k in range(4):
            some = wide[bare] > k
            table = np.array([b[k] if k < len(b) else 0 for b in spelled], np.int64)
            out[(ends - wide)[bare[some]] + k] = table[which[some]]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return out, np.diff(np.concatenate([[0], ends])[cuts])


_samplers: dict = {}


def _sampler(path: str, theta: float, seed: int) -> Sampler:
    """The sampler of this worker, with the lattices it has kept."""
    if (path, theta, seed) not in _samplers:
        _samplers[path, theta, seed] = Sampler(path, theta, seed)
    return _samplers[path, theta, seed]


def encode_documents(docs: DataFrame, path: str, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, pieces, text, lossless) of every row of ``docs`` (doc_id, text).

    ``pieces`` holds the sampled ids as little-endian 32-bit integers, ``text`` what they decode to, and ``lossless``
    whether that is the row's text, null counted as empty.
    """

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(path, theta, seed)
        for batch in parts:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                ids, texts = some.column(0), some.column(1).to_pylist()
                found = sampler.encode([k or 0 for k in ids.to_pylist()], texts)
                back = [sampler.vocabulary.decode(p) for p in found]
                same = [x == (y or "") for x, y in zip(back, texts, strict=True)]
                pieces = [p.astype("<i4").tobytes() for p in found]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(pieces, pa.binary()), pa.array(back, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "pieces", "text", "lossless"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, pieces binary, text string, lossless boolean")


def decode_pieces(pieces: Column, path: str) -> Column:
    """The texts whose pieces these are; null for null."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _sampler(path, THETA, SEED).vocabulary
        for s in parts:
            yield pd.Series([None if p is None else vocabulary.decode(np.frombuffer(p, "<i4")) for p in s], dtype=object)

    return decode(pieces)
