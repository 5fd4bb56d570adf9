"""Cross-tokenizer alignment: which ids of two vocabularies cover the same bytes, and how often over the corpus.

Both vocabularies give the same bytes for a text, so tokens are intervals of one byte line.  Byte
offsets where tokens of both end cut a text into groups; a token of A and a token of B are linked where
their intervals overlap.  An id pair's count is the number of documents that hold it linked.

The counts are kept by minimal perfect hashing:

1. ``encode`` tokenizes each text once and writes the ids.
2. A first pass aligns and writes, for each task, its distinct pairs with the documents that hold them.
3. Pairs are dealt into blocks by their A id.  For each block of distinct pairs a task builds a minimal
   perfect hash: levels of bit arrays, where a pair that is alone in its place takes it and the others go
   on to the next level; a pair's number is the rank of its bit.
4. Dense count vectors, one place for each pair of the block, are filled for shares of the first pass's rows and summed
   as a tree.  Each place also keeps its pair, so a pair that is not there is told apart.
5. The second pass aligns again and looks the counts up, with a bounded number of blocks in memory at a time.

There are at most (ids of A) x (ids of B) pairs, and a block is never larger than its A ids times B's
vocabulary.  A null or empty text, or one whose tokens of either side do not give back blank + text, has no tokens.
Rows keep their doc_id as it is, null or repeated; a repeated row is one more document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import buffers, mixed, ragged, slices
from runledger.llm.tokens import _byte_letters, encoder

#: Pairs in a block, about; a block's hash, pairs and counts take some 20 bytes for each.
BLOCK_PAIRS = 1 << 21
#: Blocks that the second pass holds at a time.
BLOCKS_AT_ONCE = 4
#: Distinct pairs a task of the first pass holds before it writes them.
HELD_PAIRS = 1 << 22
#: Rows of the first pass that one count vector is filled from.
SHARE_ROWS = 1 << 22
#: Count vectors that are added at a time.
FAN_IN = 16
#: Places in a level for each pair that is still without one.
PLACES = 2
#: Characters of a text that go to the piece model at once, where its vocabulary allows a cut.
PIECE_CHARS = 1 << 16


# --- vocabularies ---------------------------------------------------------------

class Vocabulary:
    """Bytes of the ids: those of id i are data[start[i]:start[i] + size[i]]."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.data[ragged(self.start[ids], self.size[ids])[1]].tobytes()


class _ByteSide:
    def __init__(self, path: str):
        self.encoder = encoder(path, plain=True)
        hidden = {letter: byte for byte, letter in _byte_letters().items()}
        byte_of = {chr(b): b for b in range(256) if b not in hidden.values()} | {chr(k): b for k, b in hidden.items()}
        pieces = sorted((i, p) for p, i in self.encoder.tokenizer.get_vocab().items())
        self.vocabulary = Vocabulary([bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode() for _, p in pieces])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encoder.ids(" " + t), "<u4").astype("<u2") for t in texts]


class _PieceSide:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # no piece goes from another character on to a blank, so a text may be cut there; the model adds the blank back
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def _parts(self, text: str) -> Iterator[str]:
        begin = 0
        while self.cuts and len(text) - begin > PIECE_CHARS:
            at = text.rfind(" ", begin + 1, begin + PIECE_CHARS)
            while at > begin and text[at - 1] in " ▁":
                at = text.rfind(" ", begin + 1, at)
            if at <= begin:
                break
            yield text[begin:at]
            begin = at + 1
        yield text[begin:]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        parts = [list(self._parts(t)) for t in texts]
        found = iter(self.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [np.array([i for _ in ps for i in next(found)], "<u2") for ps in parts]


@cache
def _byte_side(path: str) -> _ByteSide:
    return _ByteSide(path)


@cache
def _piece_side(path: str) -> _PieceSide:
    return _PieceSide(path)


def encode(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """(row, doc_id, a, b) of all rows: ids of both sides as little-endian unsigned 16-bit integers, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _byte_side(byte_vocabulary), _piece_side(piece_vocabulary)
        for batch in batches:
            texts = batch.column("text")
            _, offsets = buffers(texts)
            for i, j in slices(offsets):
                rows = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                a, b = (side.ids(rows) for side in sides)
                for k, text in enumerate(rows):
                    if not text or any(side.vocabulary.joined(ids[k]) != (" " + text).encode() for side, ids in zip(sides, (a, b))):
                        a[k] = b[k] = np.zeros(0, "<u2")
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i),
                                                  *[pa.array([x.tobytes() for x in side], pa.binary()) for side in (a, b)]], ["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "row long, doc_id long, a binary, b binary"), "pair-ids")


# --- alignment -------------------------------------------------------------------

class Aligned:
    """The alignment of some rows, as arrays over their tokens and links."""

    def __init__(self, batch: pa.RecordBatch, size_a: np.ndarray, size_b: np.ndarray):
        sides = []
        for name, size in (("a", size_a), ("b", size_b)):
            cells = batch.column(name)
            ids = np.frombuffer(b"".join(cells.to_pylist()), "<u2").astype(np.int64)
            each = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]) // 2 if len(cells) else np.zeros(0, np.int64)
            end = np.cumsum(size[ids])
            sides.append((ids, each, end, end - size[ids]))
        (self.a, self.n_a, end_a, start_a), (self.b, self.n_b, end_b, start_b) = sides
        self.rows = len(batch)
        self.row_a = np.repeat(np.arange(self.rows), self.n_a)
        first = np.searchsorted(end_b, start_a, "right")
        self.partners = np.searchsorted(start_b, end_a, "left") - first
        self.owner, other = ragged(first, self.partners)
        self.pairs = (self.a[self.owner] << 16) | self.b[other]
        self.ends_a, self.ends_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)

    def per_row(self, of_links: np.ndarray) -> np.ndarray:
        """Sums by row of a value of each link."""
        return np.bincount(self.row_a[self.owner], of_links, self.rows).astype(np.int64)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each row."""
        group_a, group_b = (np.cumsum(e) - e for e in (self.ends_a, self.ends_b))
        many = int(self.ends_a.sum())
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        before_b, upto_a = np.cumsum(np.bincount(group_b, minlength=many)) - np.bincount(group_b, minlength=many), np.cumsum(np.bincount(group_a, minlength=many))
        if many:
            codes[np.arange(len(self.a)) + before_b[group_a]] = self.a * 3 + self.ends_a
            codes[np.arange(len(self.b)) + upto_a[group_b]] = self.b * 3 + self.ends_b * 2
        shown, stops = _shown(), np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return ["".join(map(shown.__getitem__, codes[i:j].tolist()))[:-1] for i, j in zip(stops[:-1], stops[1:])]


@cache
def _shown() -> list[str]:
    """Decimal ids with the three separators."""
    return [f"{i}{s}" for i in range(1 << 16) for s in ",|;"]


def _aligned(batches: Iterator[pa.RecordBatch], size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for batch in batches:
        cells = batch.column("a")
        offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1].astype(np.int64) if len(cells) else np.zeros(1, np.int64)
        for i, j in slices(offsets, 1 << 20):
            part = batch.slice(i, j - i)
            yield part, Aligned(part, size_a, size_b)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def linked_pairs(ids: DataFrame, size_a: np.ndarray, size_b: np.ndarray) -> DataFrame:
    """(pair, n): a task's distinct pairs and how many of its documents hold them; a pair comes from several tasks, or twice from one that met many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for _, al in _aligned(batches, size_a, size_b):
            here = np.unique((al.row_a[al.owner] << 32) | al.pairs) & 0xFFFFFFFF
            distinct, n = np.unique(here, return_counts=True)
            keys.append(distinct)
            counts.append(n)
            held += len(distinct)
            if held > HELD_PAIRS:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["pair", "n"])
                    keys, counts, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(keys, counts)], ["pair", "n"])

    return cut(ids.select("a", "b").mapInArrow(run, "pair long, n long"), "pair-counts")


# --- minimal perfect hashing --------------------------------------------------------

_WORD = np.uint64(6)


def _places(keys: np.ndarray, level: int, places: int) -> np.ndarray:
    h = mixed(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((h >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)


class PerfectHash:
    """Numbers 0 to n - 1 of n distinct keys, by levels of bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, total = levels, [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            places = -(-PLACES * len(left) // 64) * 64
            at = _places(left, len(levels), places)
            alone = np.bincount(at.astype(np.int64), minlength=places) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or that of another key, if it is none of those the hash was built from."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _places(keys[left], level, len(bits) * 64)
            word, bit = at >> _WORD, at & np.uint64(63)
            there = ((bits[word] >> bit) & np.uint64(1)).astype(bool)
            below = bits[word[there]] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[left[there]] = rank[word[there]] + np.bitwise_count(below)
            left = left[~there]
        return out

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes(), *[x.tobytes() for x in self.levels]])

    @classmethod
    def load(cls, data: bytes) -> "PerfectHash":
        many = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, levels, at = np.frombuffer(data, "<u4", many, 4), [], 4 * (many + 1)
        for n in sizes.tolist():
            levels.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        return cls(levels)


def _hashes(pairs: DataFrame) -> DataFrame:
    """(block, hash, pairs): the perfect hash of each block, and its pairs in the order of their numbers."""
    def build(group: pa.Table) -> pa.Table:
        keys = np.sort(group.column("pair").to_numpy())
        made = PerfectHash.of(keys)
        ordered = np.empty(len(keys), "<i8")
        ordered[made.number(keys)] = keys
        return pa.table({"block": group.column("block").slice(0, 1), "hash": pa.array([made.dump()], pa.binary()), "pairs": pa.array([ordered.tobytes()], pa.binary())})

    return pairs.select("block", "pair").distinct().groupBy("block").applyInArrow(build, "block long, hash binary, pairs binary")


def pair_table(pairs: DataFrame) -> tuple[DataFrame, int]:
    """((block, hash, pairs, counts, best), number of blocks) of the written (pair, n) rows.

    ``best`` marks the pairs whose count is the highest of their A id; all pairs of an A id are in one block.
    """
    rows, distinct = pairs.agg(F.count("*"), F.approx_count_distinct("pair")).first()
    blocks = max(1, -(-int(distinct * 1.1) // BLOCK_PAIRS))
    shares = max(1, -(-rows // (blocks * SHARE_ROWS)))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64(F.shiftright("pair", 16)), F.lit(blocks)))
    hashes = cut(_hashes(dealt), "pair-hashes")

    def fill(rows: pa.Table, table: pa.Table) -> pa.Table:
        made = PerfectHash.load(table.column("hash")[0].as_py())
        vector = np.zeros(made.size, "<i8")
        if len(rows):
            keys, n = rows.column("pair").to_numpy(), rows.column("n").to_numpy()
            vector = np.bincount(made.number(keys), n, made.size).astype("<i8")
        return pa.table({"block": table.column("block"), "share": table.column("share"), "counts": pa.array([vector.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(0, "<i8")
        for cell in group.column("counts"):
            part = np.frombuffer(cell.as_buffer(), "<i8")
            total = part + total if len(total) else part.copy()
        return pa.table({"block": group.column("block").slice(0, 1), "share": group.column("share").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    shape = "block long, share long, counts binary"
    shared = dealt.withColumn("share", F.pmod(F.xxhash64("pair", "n", F.monotonically_increasing_id()), F.lit(shares)))
    each = hashes.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")))
    vectors = shared.groupBy("block", "share").cogroup(each.groupBy("block", "share")).applyInArrow(fill, shape)
    while shares > 1:
        shares = -(-shares // FAN_IN)
        vectors = vectors.withColumn("share", F.col("share") % shares).groupBy("block", "share").applyInArrow(add, shape)

    def finish(group: pa.Table) -> pa.Table:
        owner = np.frombuffer(group.column("pairs")[0].as_buffer(), "<i8") >> 16
        counts = np.frombuffer(group.column("counts")[0].as_buffer(), "<i8")
        highest = np.zeros(1 << 16, np.int64)
        np.maximum.at(highest, owner, counts)
        return group.append_column("best", pa.array([(counts == highest[owner]).tobytes()], pa.binary()))

    whole = hashes.join(vectors.select("block", "counts"), "block").select("block", "hash", "pairs", "counts")
    return cut(whole.groupBy("block").applyInArrow(finish, "block long, hash binary, pairs binary, counts binary, best binary"), "pair-table"), blocks


class _Lookup:
    """Some blocks of the pair table, in memory."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes, bytes]]):
        self.blocks = [(PerfectHash.load(h), np.frombuffer(p, "<i8"), np.frombuffer(c, "<i8"), np.frombuffer(b, bool)) for _, h, p, c, b in rows]
        #: In which of these blocks the pairs of each A id are; -1 if in another.
        self.where = np.full(1 << 16, -1, np.int64)
        for k, (_, pairs, _, _) in enumerate(self.blocks):
            self.where[pairs >> 16] = k

    def counts(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the A id's highest) of each pair; 0 and no if it is not in these blocks."""
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        block = self.where[pairs >> 16]
        for k, (made, known, n, is_best) in enumerate(self.blocks):
            here = np.flatnonzero(block == k)
            number = made.number(pairs[here])
            number[number < 0] = 0
            true = known[number] == pairs[here]
            here, number = here[true], number[true]
            counts[here], best[here] = n[number], is_best[number]
        return counts, best


_loaded: dict[str, _Lookup] = {}


def _lookup(name: str, shared) -> _Lookup:
    """The blocks of a round; a worker builds them once and keeps those of the latest round only."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = _Lookup(shared.value)
    return _loaded[name]


# --- the operator --------------------------------------------------------------------

def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): one row for each row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (empty without tokens); ``n_best`` counts links whose pair is
    the most frequent of its A id, ``count_sum`` adds the counts of all links.  Other columns of ``docs`` are not read.
    """
    ids = encode(docs, byte_vocabulary, piece_vocabulary)
    size_a, size_b = _byte_side(byte_vocabulary).vocabulary.size, _piece_side(piece_vocabulary).vocabulary.size
    table, blocks = pair_table(linked_pairs(ids, size_a, size_b))
    spark = docs.sparkSession

    def held(k: int):
        """Blocks of the k-th round, shipped to the executors: at most BLOCKS_AT_ONCE of a bounded size."""
        return spark.sparkContext.broadcast([tuple(map(_plain, r)) for r in table.where((F.col("block") >= k) & (F.col("block") < k + BLOCKS_AT_ONCE)).collect()])

    def counted(shared):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, al in _aligned(batches, size_a, size_b):
                counts, best = _lookup(name, shared).counts(al.pairs)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(al.per_row(best)), pa.array(al.per_row(counts))], ["row", "n_best", "count_sum"])
        return run

    def whole(shared):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, al in _aligned(batches, size_a, size_b):
                counts, best = _lookup(name, shared).counts(al.pairs)
                numbers = [al.n_a, al.n_b, np.bincount(al.row_a[al.ends_a], minlength=al.rows), al.per_row(np.ones(len(al.pairs))), al.per_row(best), al.per_row(counts)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(al.groups(), pa.string())],
                                                 ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
        return run

    more = []
    for k in range(BLOCKS_AT_ONCE, blocks, BLOCKS_AT_ONCE):
        shared = held(k)
        more.append(cut(ids.mapInArrow(counted(shared), "row long, n_best long, count_sum long"), "pair-sums"))
        shared.destroy()
    out = ids.mapInArrow(whole(held(0)), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    if more:
        rest = more[0]
        for df in more[1:]:
            rest = rest.unionByName(df)
        rest = rest.groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_count"))
        out = out.join(rest, "row").withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more_count"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value
