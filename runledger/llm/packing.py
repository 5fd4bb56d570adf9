"""Packing documents into sequences of a fixed number of tokens by best fit and swap-based local search.

Only documents longer than a sequence are cut.  Pieces are dealt into shards of bounded
size by a hash, so no key and no long run of equal lengths meets in one task.  Within a
shard, pieces are placed by decreasing length into the fullest sequence they fit.  While there are more
sequences than the token count needs, local search takes the emptiest one and moves pieces
out of it, or exchanges one piece for one, one for two or two for one with another underfull sequence, each time
so that the sum of squared fills grows, until it is empty or nothing helps.  The sequences that stay
underfull are taken apart and packed once more across shards.

Defined results: null and empty texts have only the end id; rows that repeat a doc_id are packed each;
a null doc_id is kept; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import ready
from runledger.llm.tokens import encoder

CAPACITY = 4096
END_ID = 1
#: Pieces packed together in one task, about.
SHARD_PIECES = 50_000


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of every piece; ids are little-endian unsigned 32-bit integers."""
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, enc, step = TaskContext.get().partitionId() << 33, encoder(tokenizer_path), capacity * 4
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc_id = enc.ids(text.as_py() or "") + END_ID.to_bytes(4, "little"), doc_id.as_py()
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at:at + step]
                    out.append((uid, doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own)[:len(names)])
                    uid += 1
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    ready(docs.sparkSession)
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: decreasing lengths, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = some >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - need
        if left:
            by_room[left].append(b)
            some |= 1 << left
    return bins


class _Search:
    """Swap-based local search over the underfull bins of a shard."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths.tolist(), capacity
        self.fill = [sum(self.lengths[i] for i in b) for b in bins]
        self.least = -(-sum(self.fill) // capacity)

    def run(self) -> list[list[int]]:
        count, moved = len(self.bins), True
        while moved and count > self.least:  # until a whole pass finds nothing
            moved, order = False, [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            heapq.heapify(order)
            self._index()
            while count > self.least and order:
                f, b = heapq.heappop(order)
                if f != self.fill[b] or not f:
                    continue  # changed meanwhile: its present fill has an entry of its own
                # a bin is given up only after it was tried against entries that are up to date
                while self.fill[b] and (self._improve(b, order) or (not self.fresh and self._index() and self._improve(b, order))):
                    moved = True
                if not self.fill[b]:
                    count -= 1
        return [b for b in self.bins if b]

    def _sums(self, b: int) -> set[int]:
        """Sums of two items of a bin.  A bin has few distinct lengths, however many items: k of them add up to k (k + 1) / 2 at least."""
        counts = Counter(self.lengths[i] for i in self.bins[b])
        return {p + q for p, q in combinations(sorted(counts), 2)} | {2 * p for p, n in counts.items() if n > 1}

    def _pick(self, b: int, total: int, n: int) -> tuple[int, ...]:
        """n items (one or two) of a bin that sum to ``total``, or none."""
        by_length: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_length.setdefault(self.lengths[i], []).append(i)
        if n == 1:
            return tuple(by_length.get(total, ())[:1])
        for p, own in by_length.items():
            if 2 * p == total and len(own) > 1:
                return tuple(own[:2])
            if 2 * p < total and total - p in by_length:
                return own[0], by_length[total - p][0]
        return ()

    def _index(self) -> bool:
        """For each length, and each sum of two, the two bins with most room that have them, so that one is left beside a bin's own.  Entries can be outdated; uses check them."""
        size = self.capacity + 1
        self.room = {n: np.full((2, size), -1) for n in (1, 2)}
        self.bin = {n: np.full((2, size), -1) for n in (1, 2)}
        underfull = [b for b, own in enumerate(self.bins) if own and self.fill[b] < self.capacity]
        for b in sorted(underfull, key=lambda b: self.fill[b], reverse=True):  # most room last, so it stays on top
            for n, found in ((1, [0, *{self.lengths[i] for i in self.bins[b]}]), (2, list(self._sums(b)))):
                for table, value in ((self.room[n], self.capacity - self.fill[b]), (self.bin[n], b)):
                    table[1, found] = table[0, found]
                    table[0, found] = value
        self.fresh = True
        return True

    def _improve(self, b: int, order: list[tuple[int, int]]) -> bool:
        ones = sorted({self.lengths[i] for i in self.bins[b]}, reverse=True)
        for n, sizes in ((1, ones), (2, sorted(self._sums(b), reverse=True))):
            for x in sizes:
                for m in (1, 2) if n == 1 else (1,):
                    other = self.bin[m][0]
                    own = other == b
                    other, room = np.where(own, self.bin[m][1], other), np.where(own, self.room[m][1], self.room[m][0])
                    low = min(x, self.capacity + 1)
                    for y in np.flatnonzero((room[:low] >= 0) & (room[:low] + np.arange(low) >= x)):
                        if self._exchange(b, x, n, int(other[y]), int(y), m, order):
                            return True
        return False

    def _exchange(self, b: int, x: int, n: int, other: int, y: int, m: int, order: list[tuple[int, int]]) -> bool:
        """Give n items that sum to x to the other bin and take m of its items that sum to y (none for y = 0), if that raises the sum of squares."""
        gain = x - y
        if other == b or not self.bins[other] or gain <= 0 or self.fill[other] + gain > self.capacity or self.fill[other] + gain <= self.fill[b]:
            return False
        mine, theirs = self._pick(b, x, n), self._pick(other, y, m) if y else ()
        if not mine or (y and not theirs):
            return False
        self.bins[b] = [i for i in self.bins[b] if i not in mine] + list(theirs)
        self.bins[other] = [i for i in self.bins[other] if i not in theirs] + list(mine)
        self.fill[b] -= gain
        self.fill[other] += gain
        self.fresh = False
        if self.fill[other] < self.capacity:
            heapq.heappush(order, (self.fill[other], other))
        return True


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return _Search(best_fit(lengths, capacity), lengths, capacity).run()


def _round(items: DataFrame, n: int, capacity: int, tag: int, salt: str) -> DataFrame:
    """Adds sequence_id, offset and room (of the whole sequence) to (uid, length)."""
    shards = max(1, -(-n // SHARD_PIECES))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths, base = pdf["length"].to_numpy(), (tag << 56) + (int(pdf["shard"].iloc[0]) << 32)
        seq, offset, room = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for k, own in enumerate(pack_lengths(lengths, capacity)):
            ends = np.cumsum(lengths[own])
            seq[own], offset[own], room[own] = base + k, ends - lengths[own], capacity - ends[-1]
        return pd.DataFrame({"uid": pdf["uid"], "length": lengths, "sequence_id": seq, "offset": offset, "room": room})

    shard = F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(shards))
    return items.select("uid", "length", shard.alias("shard")).groupBy("shard").applyInPandas(
        pack, "uid long, length long, sequence_id long, offset long, room long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    stored = cut(pieces(docs, tokenizer_path, capacity, with_ids), "pieces")
    short = stored.where(F.col("length") < capacity)
    first = cut(_round(short, short.count(), capacity, 1, "a"), "packed")
    again = first.where(F.col("room") > 0)
    second = _round(again, again.count(), capacity, 2, "b").withColumn("round", F.lit(2))
    places = first.where(F.col("room") == 0).withColumn("round", F.lit(1)).unionByName(second).select("uid", "sequence_id", "offset")
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = stored.where(F.col("length") >= capacity).select(*own, (F.lit(3 << 56) + F.col("uid")).alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
    return short.join(places, "uid").select(*own, "sequence_id", "offset", *["ids"] * with_ids).unionByName(full)
