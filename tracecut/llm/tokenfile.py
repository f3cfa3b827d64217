"""Token-id files coded by a static range asymmetric numeral system.

A shard holds a run of documents in ascending order: an index of ids and lengths, one frequency table that all its blocks
share, and blocks of ``BLOCK`` tokens. Each block is coded on its own by ``LANES`` interleaved states; its directory entry
has the place of its words, the states a decoder starts from (the checkpoint), and a checksum, so blocks decode in any
order and in parallel. Encoding and decoding step all lanes of all blocks of a shard at once.

Shards are rows of a Parquet table in the shared folder: (part, seq, n_docs, n_tokens, shard). Spark's commit protocol
makes a shard whole or absent, so that a lost executor only repeats its own tasks.

Defined cases: null text is empty; an empty text has the end id alone; rows that share an id follow each other in the order
of a hash of their texts; a null id sorts first; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: The format: magic, bits of the frequency scale, tokens of a block, lanes of a block.
MAGIC, SCALE, BLOCK, LANES = b"TCRANS1\n", 20, 65_536, 32
_LOW = np.uint64(1 << 31)
SHARD_TOKENS = 4_000_000
#: Runs that a worker keeps, from one task to the next.
CACHE = 1_500_000
_encoders: dict = {}


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, at least 1 each, that sum to 2**SCALE."""
    every = np.bincount(ids) if len(ids) and int(ids.max()) < 1 << 22 else None
    symbols, counts = np.unique(ids, return_counts=True) if every is None else (np.flatnonzero(every), every[every > 0])
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.uint32)
    total = 1 << SCALE
    f = np.maximum(1, np.floor(counts * (total - len(symbols)) / counts.sum()).astype(np.int64))
    f[np.argmax(f)] += total - f.sum()
    return symbols.astype(np.uint32), f.astype(np.uint32)


def _lanes(n: int) -> tuple[int, int]:
    blocks = -(-n // BLOCK)
    return blocks, BLOCK // LANES


def encode_tokens(ids: np.ndarray) -> bytes:
    """Table, block directory and words of one run of tokens."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    symbols, f = frequencies(ids)
    blocks, steps = _lanes(len(ids))
    head = struct.pack("<QII", len(ids), len(symbols), blocks)
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    if not blocks:
        return head + struct.pack("<I", len(table)) + table
    if int(symbols[-1]) < 1 << 22:
        number = np.zeros(int(symbols[-1]) + 1, np.int32)
        number[symbols] = np.arange(len(symbols))
        rank = number[ids]
    else:
        rank = np.searchsorted(symbols, ids).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(f.astype(np.uint64))[:-1]]).astype(np.uint64)
    wide = f.astype(np.uint64)
    padded = np.zeros(blocks * BLOCK, dtype=np.int32)
    padded[: len(ids)] = rank
    grid = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    x = np.full((blocks, LANES), _LOW, dtype=np.uint64)
    words = np.zeros((steps, blocks, LANES), dtype=np.uint32)
    full = np.zeros((steps, blocks, LANES), dtype=bool)
    shift = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        r = grid[t]
        fr = wide[r]
        m = x >= (fr << shift)
        words[t] = x & np.uint64(0xFFFFFFFF)
        full[t] = m
        x = np.where(m, x >> np.uint64(32), x)
        q = x // fr
        x = (q << np.uint64(SCALE)) + (x - q * fr) + start[r]
    out, directory = [], []
    for b in range(blocks):
        part = words[:, b][full[:, b]].astype("<u4").tobytes()
        state = x[b].astype("<u8").tobytes()
        directory.append(struct.pack("<II", len(part) // 4, zlib.crc32(part, zlib.crc32(state))) + state)
        out.append(part)
    return head + struct.pack("<I", len(table)) + table + b"".join(directory) + b"".join(out)


class Corrupt(ValueError):
    """A checksum or a size that does not fit."""


def decode_tokens(data: bytes, only: list[int] | None = None) -> np.ndarray:
    """The tokens of ``encode_tokens``; ``only`` names the blocks wanted, in order."""
    n, k, blocks = struct.unpack_from("<QII", data)
    (size,) = struct.unpack_from("<I", data, 16)
    raw = np.frombuffer(zlib.decompress(data[20 : 20 + size]), dtype="<u4")
    symbols, f = np.cumsum(raw[:k], dtype=np.uint32), raw[k:].astype(np.uint64)
    at, entry = 20 + size, 8 + 8 * LANES
    places, place = [], at + blocks * entry
    for b in range(blocks):
        count, crc = struct.unpack_from("<II", data, at + b * entry)
        places.append((place, count, crc))
        place += 4 * count
    if place != len(data):
        raise Corrupt("the words do not fill the run")
    chosen = list(range(blocks)) if only is None else only
    if not chosen:
        return np.zeros(0, dtype=np.uint32)
    streams, states = [], []
    for b in chosen:
        place, count, crc = places[b]
        state, part = data[at + b * entry + 8 : at + (b + 1) * entry], data[place : place + 4 * count]
        if zlib.crc32(part, zlib.crc32(state)) != crc:
            raise Corrupt(f"block {b} does not match its checksum")
        states.append(np.frombuffer(state, dtype="<u8"))
        streams.append(np.frombuffer(part, dtype="<u4"))
    ends = np.cumsum([len(s) for s in streams])
    flow = np.append(np.concatenate(streams), np.uint32(0)).astype(np.uint64)
    ptr = (ends - [len(s) for s in streams]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(k, dtype=np.int32), f.astype(np.int64))
    x = np.stack(states).astype(np.uint64)
    steps, mask = BLOCK // LANES, np.uint64((1 << SCALE) - 1)
    got = np.empty((steps, len(chosen), LANES), dtype=np.int32)
    for t in range(steps):
        low = x & mask
        r = slots[low.astype(np.int64)]
        got[t] = r
        x = f[r] * (x >> np.uint64(SCALE)) + low - start[r]
        m = x < _LOW
        place = ptr[:, None] + np.cumsum(m, axis=1) - 1
        x = np.where(m, (x << np.uint64(32)) | flow[np.where(m, place, -1)], x)
        ptr += m.sum(axis=1)
    ids = symbols[got.transpose(1, 0, 2).reshape(len(chosen), BLOCK)]
    last = n - (blocks - 1) * BLOCK
    return np.concatenate([ids[i] if b < blocks - 1 else ids[i][:last] for i, b in enumerate(chosen)])


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard: magic, index of documents with its checksum, tokens."""
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    index = zlib.compress(np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<u4").tobytes() + known.tobytes(), 6)
    return MAGIC + struct.pack("<QII", len(doc_ids), len(index), zlib.crc32(index)) + index + encode_tokens(ids)


def unpack_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of the documents, their lengths, all tokens."""
    if shard[:8] != MAGIC:
        raise Corrupt("not a shard")
    n, size, crc = struct.unpack_from("<QII", shard, 8)
    index = shard[24 : 24 + size]
    if zlib.crc32(index) != crc:
        raise Corrupt("the index does not match its checksum")
    raw = zlib.decompress(index)
    ids, lengths, known = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n : 12 * n], "<u4"), np.frombuffer(raw[12 * n :], np.uint8)
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths.astype(np.int64), decode_tokens(shard[24 + size :])


def _byte_signs() -> dict[int, str]:
    """The signs by which byte-level vocabularies write bytes: printable Latin-1 by itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Whole texts to ids. The vocabulary's tokenizer never joins across white space, so words between white space are
    encoded once each and kept, word to ids, up to a bound; texts with a special token's mark go in whole.

    A word of letters below U+0250, in lower case, is one unit of the tokenizer's rule, so its model encodes it alone; marks
    after such a word are units of their own. All other words go through the whole tokenizer.
    """

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"

    def __init__(self, path: str, end_id: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.runs = Tokenizer.from_file(path), np.array([end_id], dtype="<u4").tobytes(), {"": b""}
        self.model, self.signs = self.tokenizer.model, _byte_signs()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.MARKS)
        low = stem.lower()
        if low.isalpha() and (low.isascii() or max(low) < "\u0250"):
            ids = self.get(low)
            if ids is None:
                unit = low if low.isascii() else low.encode().decode("latin-1").translate(self.signs)
                found = [t.id for t in self.model.tokenize(unit)]
                ids = self[low] = struct.pack(f"<{len(found)}I", *found)
            marks = word[len(stem) :]
            if marks:
                if marks not in self.runs:
                    self.runs[marks] = self.whole(marks)
                ids += self.runs[marks]
        else:
            ids = self.whole(word)
        if word != low:
            self[word] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        """Split at white space; of what Python takes for it, the tokenizer keeps four control characters as signs."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return re.findall("[^ \t\n\r]+", text)
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian 32-bit integers."""
        if len(self) > CACHE or len(self.runs) > CACHE:
            self.clear()
            self.runs = {"": b""}
        get, out = self.__getitem__, []
        for t in texts:
            t = t or ""
            if any(s in t for s in self.special):
                out.append(self.whole(t) + self.end)
            else:
                out.append(b"".join(map(get, self._words(t))) + self.end)
        return out


def encoder_of(path: str, end_id: int) -> Encoder:
    """The encoder of this worker, with the runs it has kept."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def dealt_in_order(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with ``part``: ascending ranges of doc_id, each in one partition, in the order of id and a hash of the text.

    Bounds come from the ids alone. Each range's number is sent through an integer whose hash is the range's place, so the
    ranges fill the partitions evenly without a pass over the texts to sample them.
    """
    spark = docs.sparkSession
    wanted = [i / shards for i in range(1, shards)]
    bounds = sorted(set((docs.agg(F.percentile_approx("doc_id", wanted, 100_000).alias("b")).first()["b"] if wanted else None) or []))
    n = len(bounds) + 1
    place = {}
    for r in spark.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect() if n > 1 else []:  # 64 integers a range
        place.setdefault(r["p"], r["id"])
    part = F.coalesce(F.array_size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    rows = docs.select("doc_id", "text", part.alias("part"), F.xxhash64("text").alias("tie"))
    if n > 1:
        keys = F.array(*[F.lit(place.get(i, i)) for i in range(n)])
        rows = rows.repartition(n, F.element_at(keys, F.col("part") + 1))
    else:
        rows = rows.repartition(1)
    return rows.sortWithinPartitions("part", "doc_id", "tie", "text").drop("tie")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch, shards: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order into a table of shards, and return it as read back.

    There are two ranges of ids for each partition that ``docs`` is read in, unless ``shards`` says how many; a range of
    more than ``shard_tokens`` tokens makes several shards.
    """
    ordered = dealt_in_order(docs, shards or min(10_000, max(1, 2 * docs.rdd.getNumPartitions())))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path, end_id)
        ids, runs, n, part, seq = [], [], 0, None, 0

        def shard() -> pd.DataFrame:
            data = pack_shard(ids, [len(r) // 4 for r in runs], np.frombuffer(b"".join(runs), dtype="<u4"))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [n], "shard": [data]})

        for frame in parts:
            keys = [None if pd.isna(k) else int(k) for k in frame["doc_id"]]
            ranges = frame["part"].tolist()
            for at in range(0, len(frame), 500):
                for key, run, mine in zip(keys[at : at + 500], encoder.encode(frame["text"].iloc[at : at + 500].tolist()), ranges[at : at + 500], strict=True):
                    if ids and (mine != part or n >= shard_tokens):
                        yield shard()
                        ids, runs, n, seq = [], [], 0, seq + 1 if mine == part else 0
                    part = mine
                    ids.append(key)
                    runs.append(run)
                    n += len(run) // 4
        if ids:
            yield shard()

    return scratch.keep(ordered.mapInPandas(encode, "part int, seq int, n_docs long, n_tokens long, shard binary"))


def shard_starts(shards: DataFrame, group: int = 1024) -> DataFrame:
    """(part, seq, start): tokens before each shard. Sums of groups of parts first, so no task sees every shard."""
    sizes = shards.select("part", "seq", "n_tokens").withColumn("g", F.floor(F.col("part") / group).cast("long"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("g").agg(F.sum("n_tokens").alias("n_tokens")).select("g", before(Window.orderBy("g")).alias("base"))
    inside = sizes.select("part", "seq", "g", before(Window.partitionBy("g").orderBy("part", "seq")).alias("within"))
    return inside.join(groups, "g").select("part", "seq", (F.col("base") + F.col("within")).alias("start"))


def read_tokens(shards: DataFrame, tokens: bool = False) -> DataFrame:
    """One row for each document, read from the shards: (doc_id, start, n_tokens, ids_crc32), with the ids if asked for."""
    placed = shards.select("part", "seq", "shard").join(shard_starts(shards), ["part", "seq"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * tokens

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for shard, base in zip(frame["shard"], frame["start"], strict=True):
                docs, lengths, ids = unpack_shard(bytes(shard))
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                out = pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "start": base + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]})
                if tokens:
                    out["ids"] = [ids[e - n : e].astype(np.int32) for e, n in zip(ends, lengths, strict=True)]
                yield out

    return placed.mapInPandas(decode, schema)


def export_shards(shards: DataFrame, folder: str) -> int:
    """Copy the shards to plain files of a local folder, one at a time; returns their number."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in shards.orderBy("part", "seq").toLocalIterator():
        with open(os.path.join(folder, f"{r['part']:06d}-{r['seq']:04d}.tcr"), "wb") as f:
            f.write(r["shard"])
        n += 1
    return n
