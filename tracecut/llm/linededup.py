"""Line dedup by pairwise alignment: delete from a document the blocks of lines that an earlier one has in the same order.

Lines are trimmed of spaces, tabs and carriage returns, and hashed. A line that at least two documents hold names its first holder (smallest doc_id) as a partner
of all later holders, so a document has at most as many partners as lines, however many documents share a line, and a
line shared by few is as good as one shared by many. Pairs are aligned by patience diff over the lines that repeat across
documents: lines unique in both ranges whose order agrees anchor the alignment, ranges between anchors are aligned again,
and equal lines next to what is aligned are taken along. Aligned lines that follow each other in both documents form a
block; a block of at least ``MIN_BLOCK`` characters is deleted from the later document. A line's first holder never loses it.

Defined cases: null and empty texts have no lines to share and stay as they are; a trimmed line that is empty never
matches by itself; rows that repeat a doc_id count as one document (of the first text in their order) and each gets its
deletions by position; rows with a null doc_id stay whole; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of a block from which on it is deleted.
MIN_BLOCK = 40


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _unique_anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest run, increasing in both, of values that occur once in each range."""
    in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    where = {a[i]: i for i in range(alo, ahi) if in_a[a[i]] == 1}
    pairs = [(where[b[j]], j) for j in range(blo, bhi) if in_b[b[j]] == 1 and b[j] in where]
    piles: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(piles, i)
        back.append(ends[p - 1] if p else -1)
        if p == len(piles):
            piles.append(i)
            ends.append(k)
        else:
            piles[p], ends[p] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned places of two lists of line hashes, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = _unique_anchors(a, b, alo, ahi, blo, bhi)
        if not anchors:
            continue
        for i, j in anchors:
            out.append((i, j))
            todo.append((alo, i, blo, j))
            alo, blo = i + 1, j + 1
        todo.append((alo, ahi, blo, bhi))
    return sorted(out)


def deleted_lines(earlier: list[tuple[int, int]], later: list[tuple[int, int, int]], least: int = MIN_BLOCK) -> list[int]:
    """Places of ``later`` to delete. Both list what they share with others: (place, hash), later with its characters."""
    pairs = patience([h for _, h in earlier], [h for _, h, _ in later])
    out: list[int] = []
    block: list[int] = []
    size, last = 0, (-2, -2)
    for i, j in [*pairs, (-1, -1)]:
        at = (earlier[i][0], later[j][0]) if i >= 0 else (-9, -9)
        if at != (last[0] + 1, last[1] + 1):
            if size >= least:
                out += block
            block, size = [], 0
        if i >= 0:
            block.append(later[j][0])
            size += later[j][2]
        last = at
    return out


def runs(pos: list[int], h: list[int], n: list[int], least: int = MIN_BLOCK) -> list[tuple[int, int, int]]:
    """(hash, first place, last place) of the shortest runs of following lines that make a block and start or end at each
    place: every line of a block is in one of them that lies in the block."""
    found: set[tuple[int, int]] = set()
    start = size = 0
    for end in range(len(pos)):
        if end and pos[end] != pos[end - 1] + 1:
            start, size = end, 0
        size += n[end]
        while size - n[start] >= least and start < end:  # a run from start has been found at an earlier end
            size -= n[start]
            start += 1
        if size < least:
            continue
        found.add((start, end))
        # Starts whose shortest run ends here: those before, as long as what they reach without this line is too short.
        low, before = start, size - n[end]
        while before < least:
            found.add((low, end))
            if low == 0 or pos[low - 1] + 1 != pos[low]:
                break
            low -= 1
            before += n[low]
    return [(hash(tuple(h[a : b + 1])), pos[a], pos[b]) for a, b in sorted(found)]


def line_deletions(docs: DataFrame, scratch: Scratch, least: int = MIN_BLOCK, all_holders: bool = False) -> DataFrame:
    """(doc_id, gone): places, from 0, of the lines to delete from each document that loses some.

    With ``all_holders``, what the first holders leave is aligned with every other earlier document that holds the same
    run of at least ``least`` characters, which are all that could delete it: some of them by a hash of their ids, and
    four times as many in each further round while any of it is left.
    """
    one = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    lines = one.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r"))).where("line <> ''")
    # Lines meet across documents on 128 bits; two documents that share lines are aligned on the first 64.
    rows = lines.select("doc_id", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.length("line").alias("n"))
    owners = rows.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("h", "g", "owner")
    shared = scratch.keep(rows.join(scratch.keep(owners), ["h", "g"]).drop("g"))
    lists = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "h", "n"))).alias("l"))  # one document's lines
    lists = scratch.keep(lists.select("doc_id", F.col("l.pos").alias("pos"), F.col("l.h").alias("h"), F.col("l.n").alias("n")))
    pairs = shared.where("owner < doc_id").select("doc_id", "owner").distinct()
    first = lists.select(F.col("doc_id").alias("owner"), F.col("pos").alias("pos_a"), F.col("h").alias("h_a"))

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            docs_in = batch.column(0).to_pylist()
            cols = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in map(batch.column, range(1, 6))]
            ids: list[int] = []
            gone: list[list[int]] = []
            for i, doc in enumerate(docs_in):
                pos_a, h_a, pos, h, n = (values[offsets[i] : offsets[i + 1]].tolist() for offsets, values in cols)
                found = deleted_lines(list(zip(pos_a, h_a, strict=True)), list(zip(pos, h, n, strict=True)), least)
                if found:
                    ids.append(doc)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"])

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lists, "doc_id").join(first, "owner").select("doc_id", "pos_a", "h_a", "pos", "h", "n")
        return both.mapInArrow(align, "doc_id long, gone array<int>").select("doc_id", F.explode("gone").alias("pos")).distinct()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = [(d, *x) for d, *l in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in runs(*l, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "w", "a", "b"])

    places = aligned(pairs)
    if all_holders:
        places = scratch.keep(places)
        windows = scratch.keep(lists.mapInArrow(cut, "doc_id long, w long, a int, b int"))
        holders = scratch.keep(windows.select("w", F.col("doc_id").alias("owner")).distinct())
        held = scratch.keep(holders.groupBy("w").agg(F.min("owner").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1"))
        left = windows.join(held, "w").where("least < doc_id").select("doc_id", "w", "held", F.explode(F.sequence("a", "b")).alias("pos"))
        left = scratch.keep(left.join(places, ["doc_id", "pos"], "left_anti"))
        low, high = 0, 4
        while (most := left.agg(F.max("held")).first()[0]) is not None and low < most:
            turn = F.pmod(F.xxhash64("owner"), F.col("held"))
            more = left.select("doc_id", "w", "held").distinct().join(holders, "w").where((F.col("owner") < F.col("doc_id")) & (turn >= low) & (turn < high))
            found = scratch.keep(aligned(more.select("doc_id", "owner").distinct()))
            places = places.unionByName(found)
            left = scratch.keep(left.join(found, ["doc_id", "pos"], "left_anti"))
            low, high = high, 4 * high
        places = places.distinct()
    return places.groupBy("doc_id").agg(F.collect_list("pos").alias("gone"))  # one document's places


def dedup_lines(docs: DataFrame, least: int = MIN_BLOCK, all_holders: bool = False) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_deleted``, which replace columns of those names; other columns and
    all rows stay."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = scratch.keep(line_deletions(docs, scratch, least, all_holders)).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    # A merge join at every size: deletions grow with the table, so they are not to be broadcast.
    joined = docs.join(gone.hint("merge"), docs["doc_id"] == F.col("__id"), "left").drop("__id")
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda line, i: ~F.array_contains("__gone", i))
    clean = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size("__gone"), F.lit(0))
    return joined.withColumns({"clean_text": clean, "n_lines": F.size(lines).cast("long"), "n_deleted": F.when(F.col("__gone").isNull(), 0).otherwise(n).cast("long")}).drop("__gone")
