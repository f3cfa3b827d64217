"""N-gram Jaccard join: all links of Jaccard similarity of at least ``THRESHOLD`` between sets of word shingles.

Texts with equal shingle sets form a class and are joined once, as its representative. An LSH forest of ``TREES`` trees
holds a signature of ``DEPTH`` minhashes for each tree, as bytes whose order is that of the tree's sorted prefix trie.
Representatives meet first where whole signatures match; from what is found there, the links that were missed are
estimated (a link of similarity s matches d minhashes in a share of s ** d of the trees), and matched prefixes are shortened
by one minhash, round by round, until the estimated recall reaches the target. Prefixes that only one representative has
are dropped before anything else moves.

Within a shared prefix, sketches (one byte of each minhash) tell the few likely pairs from chance matches; only a
spanning forest of them leaves a task. Its components bring the texts of likely partners together once, where every pair
of a component is verified exactly, on 64-bit hashes of its shingles. Prefixes and components of more than ``BLOCK``
members are dealt as pairs of blocks, so no task holds more than two blocks, and none is left out.

Defined cases: null and empty texts have no shingles, form no class with others and have no links; a text of fewer words
than a shingle is one shingle of all of them; rows that repeat an id count once, with the least of their texts; null ids are given a row with no links; an
empty table gives no rows; ties fall to the smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, Scratch, first_rows, give_back
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Trees of the forest, minhashes of a tree, and the recall that prefixes are shortened for.
TREES, DEPTH, RECALL = 24, 6, 0.99999
#: Members of a prefix or component that one task compares with as many others.
BLOCK = 512
#: Sketch similarity below which a pair is a chance match: five standard deviations under the threshold.
SLACK = 0.2

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for i, base in enumerate((_P, _P_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    up, down = _power_tables(len(flat) + 1)
    run = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(flat * up[: len(flat)], dtype=np.uint64, out=run[1:])
    n = max(1, len(words) - k + 1)
    a, b = starts[:n], ends[min(k, len(words)) - 1 :][:n]
    return np.unique(_mixed((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (raw[:n] | np.uint64(1)).astype(np.uint32), raw[n:].astype(np.uint32)


_A, _B = _permutations(TREES * DEPTH)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of TREES * DEPTH minhashes for each nonempty set."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]])
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((TREES * DEPTH, len(sets)), np.uint32)
    for j in range(TREES * DEPTH):
        out[j] = np.minimum.reduceat(low * _A[j] + _B[j], starts)
    return out.T


def missed(similarity: np.ndarray, depth: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Links that one match in a tree stands for, and those of them that match in no tree, by similarity."""
    one = similarity**depth
    return 1 / (trees * one), (1 - one) ** trees / (trees * one)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, prefixes, sketch) of every row with shingles: digest of the set, signature of each tree, a byte of each minhash."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                sets = [shingles(t) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                m = minhashes([sets[i] for i in full])
                raw = m.astype(">u4").tobytes()  # in this order, bytes sort as the numbers do
                sketch = (_mixed(m.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].iloc[full].to_numpy(),
                        "key": [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in full],
                        "prefixes": [[raw[i : i + 4 * DEPTH] for i in range(at, at + 4 * TREES * DEPTH, 4 * DEPTH)] for at in range(0, len(raw), 4 * TREES * DEPTH)],
                        "sketch": [r.tobytes() for r in sketch],
                    }
                )
        give_back()

    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, key binary, prefixes array<binary>, sketch binary")


def dealt(rows: DataFrame, sizes: DataFrame, on: list[str], member: str, block: int) -> DataFrame:
    """Deal the members of each group to pairs of blocks: columns bi <= bj, and mine, the block of the row.

    A group of at most ``block`` members is the pair (0, 0); a larger one has size / block blocks, by a hash of the
    member, each of which meets every block once.
    """
    wide = rows.join(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).select(*on, "blocks"), on)
    wide = wide.withColumn("mine", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return wide.select("*", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj")).drop("other", "blocks")


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys of a sorted stream."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in parts:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(frame)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(k[a])
            if key != last and held:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[a:b])
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _forest(n: int, a: np.ndarray, b: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges that join what is apart so far; ``known`` edges join first and are not told again."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for told, (x, y) in ((False, known or ((), ())), (True, (a, b))):
        for i, j in zip(np.asarray(x).tolist(), np.asarray(y).tolist(), strict=True):
            p, q = top(i), top(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                if told:
                    out.append((i, j))
    return out


def _sides(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two blocks of a pair; whether they are the same block."""
    mine, bi, bj = frame["mine"].to_numpy(), frame["bi"].iloc[0], frame["bj"].iloc[0]
    left = np.flatnonzero(mine == bi)
    return left, (left if bi == bj else np.flatnonzero(mine == bj)), bool(bi == bj)


def _alike(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different rows whose sketches agree in at least that share of their bytes, with the share."""
    a, b, c = [], [], []
    for i in left.tolist():
        share = (sketch[right] == sketch[i]).mean(axis=1)
        near = (share >= least) & (right != i)
        a.append(np.full(int(near.sum()), i))
        b.append(right[near])
        c.append(share[near])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def likely_edges(heads: DataFrame, sketches: DataFrame, depth: int, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, met, lost): a spanning forest, prefix by prefix, of the pairs whose sketches are near enough where ``depth``
    minhashes match; and, in rows without a pair, the links that a task's matches stand for and those of them missed."""
    cut = heads.select("rep", "tree", F.substring("head", 1, 4 * depth).alias("head"))
    sizes = cut.groupBy("tree", "head").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = dealt(cut, sizes, ["tree", "head"], "rep", block).join(sketches, "rep")
    keys = ["tree", "head", "bi", "bj"]
    least = threshold - SLACK

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        met = lost = 0.0
        for g in _groups(parts, keys):
            left, right, same = _sides(g)
            if not len(left) or not len(right):
                continue
            ids = g["rep"].to_numpy()
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1)
            # What joins inside a block is told by the block's own pair; here it only keeps the edges across few.
            known = None if same else tuple(np.concatenate(x) for x in zip(_alike(sketch, left, left, least)[:2], _alike(sketch, right, right, least)[:2], strict=True))
            i, j, share = _alike(sketch, left, right, least)
            near = share[share >= threshold]
            stands, gone = missed(near, depth)
            met += float(stands.sum()) / (2 if same else 1)
            lost += float(gone.sum()) / (2 if same else 1)
            out += [(ids[p], ids[q], 0.0, 0.0) for p, q in _forest(len(g), i, j, known)]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b", "met", "lost"])
                out = []
        yield pd.DataFrame([*out, (-1, -1, met, lost)], columns=["a", "b", "met", "lost"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(match, "a long, b long, met double, lost double")


def forest_edges(reps: DataFrame, scratch: Scratch, recall: float = RECALL, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): edges between likely partners, from the longest matching prefixes down to those that the recall asks for."""
    heads = scratch.keep(reps.select("rep", F.posexplode("prefixes").alias("tree", "head")))
    sketches = reps.select("rep", "sketch")
    for depth in range(DEPTH, 0, -1):
        found = scratch.keep(likely_edges(heads, sketches, depth, block, threshold))
        got = found.where("met > 0").agg(F.sum("met").alias("met"), F.sum("lost").alias("lost")).first()
        # Without a match there is nothing to judge the depth by; the threshold itself is the worst that a link can be.
        short = got["lost"] / (got["met"] or 1.0) if got["met"] else float((1 - threshold**depth) ** TREES)
        if short <= 1 - recall or depth == 1:
            return found.where("a >= 0").select("a", "b").distinct()
        scratch.drop(found)
    raise AssertionError("a depth of 1 always returns")


def overlaps(sets: list[np.ndarray], columns: int = 20_000) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exactly, a slice of the shingles that repeat at a time."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    ids = np.cumsum(new) - 1
    often = np.bincount(ids)[ids] > 1
    ids, owner = ids[often], owner[often]
    total = np.zeros((n, n), np.float64)
    if not len(ids):
        return total
    ids = np.unique(ids, return_inverse=True)[1]
    at, width = 0, int(ids[-1]) + 1
    for first in range(0, width, columns):
        end = np.searchsorted(ids, first + columns)
        part = np.zeros((n, min(columns, width - first)), np.float32)
        part[owner[at:end], ids[at:end] - first] = 1
        total += part @ part.T
        at = end
    return total


def verified(texts: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links inside the block pairs of components: (a, b, n) with b null and n the links of a, and edges of a forest."""
    keys = ["component", "bi", "bj"]

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int]] = []
        for g in _groups(parts, keys):
            left, right, same = _sides(g)
            if not len(left) or not len(right):
                continue
            ids = g["rep"].to_numpy()
            sets = [shingles(t) for t in g["text"]]
            sizes = np.array([len(s) for s in sets])
            both = overlaps(sets)
            # |A n B| / |A u B| >= threshold, without a division
            linked = both * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
            np.fill_diagonal(linked, False)
            every = linked.copy()
            if not same:
                across = np.zeros_like(linked)
                across[np.ix_(left, right)] = True
                linked &= across | across.T
            count = linked.sum(axis=1)
            out += [(int(ids[i]), -1, int(count[i])) for i in np.flatnonzero(count)]
            known = None if same else np.nonzero(np.triu(every & ~linked))
            i, j = np.nonzero(np.triu(linked))
            out += [(int(ids[p]), int(ids[q]), 0) for p, q in _forest(len(g), i, j, known)]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b", "n"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b", "n"], dtype="int64")

    dealt_rows = texts.repartition(*keys).sortWithinPartitions(*keys)
    return dealt_rows.select(*keys, "mine", "rep", "text").mapInPandas(check, "a long, b long, n long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row of each doc_id: (doc_id, class_id, set_id, n_links, n_copies).

    ``set_id`` is the smallest doc_id with the same shingle set, ``n_copies`` how many share it, ``n_links`` the number of
    other shingle sets that are similar, ``class_id`` the smallest doc_id that links lead to.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    docs = first_rows(docs.select("doc_id", "text"))
    signed = scratch.keep(signatures(docs.where(F.col("doc_id").isNotNull())))
    # Written, so that the join shuffles both sides itself and a set that many rows share can be split among tasks.
    sets = scratch.keep(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n_copies")))
    members = scratch.keep(signed.select("doc_id", "key").distinct().join(sets, "key").select("doc_id", "rep", "n_copies"))
    reps = signed.join(members.where("doc_id = rep").select("doc_id"), "doc_id").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "prefixes", "sketch")
    reps = scratch.keep(reps)
    edges = forest_edges(reps, scratch, recall, block, threshold)
    near = scratch.keep(components(edges, scratch))
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = dealt(near.withColumnRenamed("node", "rep"), sizes, ["component"], "rep", block)
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(near.select(F.col("node").alias("rep")), "rep", "left_semi").dropDuplicates(["rep"])
    found = scratch.keep(verified(placed.join(texts, "rep"), block, threshold))
    links = found.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    classes = components(found.where("b <> -1").select("a", "b"), scratch).select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    facts = scratch.keep(links.join(classes, "rep", "full"))
    known = members.join(facts, "rep", "left")
    none = docs.select("doc_id").join(members.select("doc_id"), "doc_id", "left_anti").distinct()
    return known.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies").unionByName(
        none.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    )
