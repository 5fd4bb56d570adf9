"""Removal of long repeated byte strings by external induced sorting of sampled suffixes.

A byte is removed if a string of ``WIDTH`` bytes that covers it also starts anywhere else in the corpus.
Full suffix arrays of a corpus do not fit on disk, so suffixes are sampled and the others induced from them:

1. *Sample.*  In every window of ``WIDTH`` bytes the leftmost ``GRAM`` bytes with the least fingerprint are its
   anchor.  Equal strings have equal anchors at equal offsets, so each string is a suffix tuple (anchor, offset).  Only anchors
   whose gram is found again are followed.
2. *Recursion on names.*  The offsets of an anchor are taken in blocks of ``BLOCK``.  All strings of a block share a
   core, and together span a frame.  Cores and frames are named by fingerprint and counted: a core of one
   occurrence has no repeats in its block; in a frame found again, all strings are repeats; only
   the rest, at the ends of repeats, is carried on as tuples with the bytes on both sides of the core.
3. *Induction.*  Spark's spilling sort by (core, bytes to the right) is the disk-backed queue that hands out tuples in suffix
   order, so a shard may be far larger than memory.  The order of suffixes that start one byte further left is induced from
   it: stable by the byte on the left within each bucket.  Common-prefix values of neighbours are carried along,
   and found anew only where the order brought other tuples together.  Neighbours that share what is left to
   share of ``WIDTH`` bytes are repeats; buckets of one tuple are done.

A core with very many different ends goes another exact way: its strings are named one by one, and names are counted.

Strings count by fingerprints of 64 bits for the core and 64 for the frame, or byte by byte.

Defined results: null texts are empty; rows with equal doc_id and text each count as an occurrence and get equal
results; a null doc_id is kept; texts shorter than ``WIDTH`` are never touched; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import buffers, mixed, ragged, ready, running, slices
from runledger.llm.urls import BITS_PER_KEY, BLOCK_BYTES, _held, _level

WIDTH, GRAM, BLOCK = 400, 32, 62
#: Text bytes looked at together; a worker holds some 20 arrays of 8 times as many.
SLICE_BYTES = 1 << 18
#: Tuples of one core sorted in one task; cores with more go the way of single names.
CORE_TUPLES = 20_000
#: Tuples induced at a time.
CHUNK = 8_000
#: Tuples whose strings are named at a time, up to ``BLOCK`` each.
NAMED = 250


class Sizes(NamedTuple):
    width: int = WIDTH
    gram: int = GRAM
    block: int = BLOCK


class Blocks(NamedTuple):
    """Blocks of offsets of all anchors of some texts; places are absolute in the byte array."""
    row: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    base: np.ndarray
    core: np.ndarray
    frame: np.ndarray
    framed: np.ndarray


def anchor_grams(part: np.ndarray, sums: np.ndarray, scale: np.ndarray, z: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each gram, place of the anchor of the window at each place)."""
    grams = mixed((sums[z.gram:] - sums[:-z.gram]) * scale[:len(part) - z.gram + 1])
    bits = np.uint64(max(21, len(part).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span = z.width - z.gram + 1
    blocks = -(-len(keys) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    padded = padded.reshape(blocks, span)
    up = np.minimum.accumulate(padded, axis=1).reshape(-1)
    down = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(part) - z.width + 1
    return grams, (np.minimum(down[:n], up[span - 1:span - 1 + n]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def blocks_of(data: np.ndarray, offsets: np.ndarray, z: Sizes) -> Blocks | None:
    """The blocks of all texts; ``row`` counts texts, ``base`` is the place from which offsets of the block go left."""
    start = int(offsets[0])
    part, cuts = data[start:int(offsets[-1])], np.asarray(offsets) - start
    if len(part) < z.width:
        return None
    sums, scale = running(part)
    grams, anchor = anchor_grams(part, sums, scale, z)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[:len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + z.width <= cuts[row + 1])
    if not len(valid):
        return None
    at = anchor[valid]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[valid][1:] != row[valid][:-1])))
    last = np.append(first[1:], len(valid)) - 1
    place, low, high = at[first], (at[first] - valid[last]) // z.block, (at[first] - valid[first]) // z.block
    owner, number = ragged(low, high - low + 1)
    place, row = place[owner], row[valid[first]][owner]
    base = place - number * z.block  # start of the core: the least offset
    end = base - (z.block - 1) + z.width
    salt = (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    core = mixed((sums[end] - sums[base]) * scale[base] + salt)
    left, right = base - (z.block - 1), base + z.width
    framed = (left >= cuts[row]) & (right <= cuts[row + 1])
    left, right = np.where(framed, left, 0), np.where(framed, right, 0)
    frame = mixed((sums[right] - sums[left]) * scale[left] + salt)
    return Blocks(row, place, grams[place], base, core, frame, framed)


def _ids(batch: pa.RecordBatch, a: int, rows: np.ndarray) -> dict[str, pa.Array]:
    at = pa.array(a + rows)
    return {"doc_id": batch.column("doc_id").take(at), "print": batch.column("print").take(at)}


def _each(batches: Iterator[pa.RecordBatch], z: Sizes):
    """(batch, first row, bytes, offsets, blocks) for slices of the texts."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in slices(offsets, SLICE_BYTES):
            found = blocks_of(data, offsets[a:b + 1], z)
            if found is not None:
                yield batch, a, data, offsets[a:b + 1], found


def _filter(keys: DataFrame):
    """A filter for a column of 64-bit keys if it has a bounded size, else None: it only leaves out rows early."""
    n = keys.count()
    if n * BITS_PER_KEY // 8 > BLOCK_BYTES:
        return None
    hashed = keys.select(F.col(keys.columns[0]).alias("h1"), F.col(keys.columns[0]).alias("h2"))
    return keys.sparkSession.sparkContext.broadcast(_level(hashed, 0, max(n, 1)))


def _passes(sent, keys: np.ndarray) -> np.ndarray:
    return np.ones(len(keys), bool) if sent is None else _held(0, sent.value, keys, keys)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")


def repeated_grams(docs: DataFrame, z: Sizes) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, found in _each(batches, z):
            new = np.append(True, found.anchor[1:] != found.anchor[:-1])  # an anchor once, not for each block
            grams, n = np.unique(found.gram[new], return_counts=True)
            yield pa.record_batch({"gram": pa.array(grams.view(np.int64)), "n": pa.array(n)})

    counted = _texts(docs).mapInArrow(find, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return cut(counted.where("n > 1").select("gram"), "grams")


def named_blocks(docs: DataFrame, grams, z: Sizes) -> DataFrame:
    """(core, frame, doc_id, print, base): blocks of repeated grams by names; frame is null where the text ends within it."""
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, _, offsets, found in _each(batches, z):
            keep = np.flatnonzero(_passes(grams, found.gram))
            row = found.row[keep]
            yield pa.record_batch({
                "core": pa.array(found.core[keep].view(np.int64)), "frame": pa.array(found.frame[keep].view(np.int64), mask=~found.framed[keep]),
                **_ids(batch, a, row), "base": pa.array((found.base[keep] - (offsets[row] - offsets[0])).astype(np.int32))})

    return cut(_texts(docs).mapInArrow(name, "core long, frame long, doc_id long, print long, base int"), "blocks")


def suffix_tuples(docs: DataFrame, cores, z: Sizes) -> DataFrame:
    """(core, doc_id, print, base, lefts, rights): blocks of the given cores with the bytes around; lefts are read leftwards."""
    side = z.block - 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, data, offsets, found in _each(batches, z):
            keep = np.flatnonzero(_passes(cores, found.core))
            row, base = found.row[keep], found.base[keep] + offsets[0]
            end = base - side + z.width
            lefts = [data[max(lo, p - side):p][::-1].tobytes() for lo, p in zip(offsets[row].tolist(), base.tolist(), strict=True)]
            rights = [data[p:min(hi, p + side)].tobytes() for hi, p in zip(offsets[row + 1].tolist(), end.tolist(), strict=True)]
            yield pa.record_batch({"core": pa.array(found.core[keep].view(np.int64)), **_ids(batch, a, row), "base": pa.array((base - offsets[row]).astype(np.int32)),
                                   "lefts": pa.array(lefts, pa.binary()), "rights": pa.array(rights, pa.binary())})

    return _texts(docs).mapInArrow(take, "core long, doc_id long, print long, base int, lefts binary, rights binary")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers_of_binary(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    owner, at = ragged(offsets[:-1], size)
    out[owner, at - offsets[owner]] = data[at]
    return out, size


def buffers_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]


def induce(core: np.ndarray, lefts: pa.Array, rights: pa.Array, side: int) -> np.ndarray:
    """For tuples sorted by (core, rights): bit s is set if another tuple has the same s bytes to the left and side - s to the right."""
    left, n_left = _matrix(lefts, side)
    right, n_right = _matrix(rights, side)
    marks = np.zeros(len(core), np.int64)

    def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = right[i] != right[j]
        lcp = np.where(differ.any(1), differ.argmax(1), side)
        return np.minimum(lcp, np.minimum(n_right[i], n_right[j]))

    order = np.arange(len(core))
    bucket = np.cumsum(np.append(0, core[1:] != core[:-1])) if len(core) else order
    common = np.append(-1, shared(order[:-1], order[1:])) if len(core) else order  # with the tuple before
    for s in range(side + 1):
        common[np.append(True, bucket[1:] != bucket[:-1])] = -1  # no tuple before it in its bucket
        hit = common >= side - s
        hit[:-1] |= hit[1:]
        marks[order[hit]] |= np.int64(1) << s
        if s == side:
            break
        # buckets of one tuple are done, and so are tuples whose text begins here
        more = (np.append(bucket[1:] == bucket[:-1], False) | np.append(False, bucket[1:] == bucket[:-1])) & (n_left[order] > s)
        kept = np.flatnonzero(more)
        if not len(kept):
            break
        key = bucket[kept] * 256 + left[order[kept], s]
        move = np.argsort(key, kind="stable")
        key, place = key[move], kept[move]
        together = np.append(False, place[1:] == place[:-1] + 1)
        carried = common[place]
        new_order = order[place]
        fresh = np.flatnonzero(~together[1:]) + 1
        carried[fresh] = shared(new_order[fresh - 1], new_order[fresh])
        order, bucket, common = new_order, np.cumsum(np.append(0, key[1:] != key[:-1])), carried
    return marks


def _induced(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """(doc_id, print, base, mask) of the tuples with repeats; whole cores are taken together, as many as make a chunk."""
    held: list[pa.RecordBatch] = []

    def work(tuples: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = induce(tuples.column("core").to_numpy(), tuples.column("lefts"), tuples.column("rights"), z.block - 1)
        some = pa.array(np.flatnonzero(marks))
        if len(some):
            yield pa.record_batch({**{c: tuples.column(c).take(some) for c in ("doc_id", "print", "base")}, "mask": pa.array(marks[marks != 0])})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            whole = pa.concat_batches(held)
            core = whole.column("core").to_numpy()
            end = int(np.searchsorted(core, core[-1]))  # the last core may go on
            if end:
                yield from work(whole.slice(0, end))
            held = [whole.slice(end)]
    if held:
        yield from work(pa.concat_batches(held))


def _named(batches: Iterator[pa.RecordBatch], z: Sizes) -> Iterator[pa.RecordBatch]:
    """(name, doc_id, print, base, s) of each string of the tuples, ``NAMED`` tuples at a time."""
    side = z.block - 1
    for batch in (b.slice(at, NAMED) for b in batches for at in range(0, b.num_rows, NAMED)):
        out: dict[str, list] = {"name": [], "row": [], "s": []}
        for i, (core, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("core", "lefts", "rights")), strict=True)):
            for s in range(max(0, side - len(right)), min(len(left), side) + 1):
                out["name"].append(hashlib.blake2b(b"%d:%d:" % (core, s) + left[:s] + right[:side - s], digest_size=16).digest())
                out["row"].append(i)
                out["s"].append(s)
        at = pa.array(out["row"], pa.int64())
        yield pa.record_batch({"name": pa.array(out["name"], pa.binary()), **{c: batch.column(c).take(at) for c in ("doc_id", "print", "base")}, "s": pa.array(out["s"], pa.int32())})


def _single_names(tuples: DataFrame, z: Sizes) -> DataFrame:
    """(doc_id, print, base, mask) of tuples with repeats, by naming each string on its own."""
    named = tuples.mapInArrow(lambda it: _named(it, z), "name binary, doc_id long, print long, base int, s int")
    again = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return named.join(again, "name").groupBy("doc_id", "print", "base").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("mask"))


def repeats(docs: DataFrame, z: Sizes = Sizes()) -> DataFrame:
    """(doc_id, print, base, mask): bit s says that the string at base - s is found elsewhere."""
    ready(docs.sparkSession)
    blocks = named_blocks(docs, _filter(repeated_grams(docs, z)), z)
    frames = cut(blocks.groupBy("core", "frame").agg(F.count(F.lit(1)).alias("n")), "frames")
    cores = frames.groupBy("core").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("frame").isNull() | (F.col("n") == 1), F.col("n")).otherwise(0)).alias("open"))
    # a block is settled if its core is alone, or if its frame is found again
    open_cores = cut(cores.where("size > 1 AND open > 0").select("core", "size"), "open-cores")
    settled = blocks.join(frames.where("n > 1 AND frame IS NOT NULL").select("core", "frame"), ["core", "frame"]).select(
        "doc_id", "print", "base", F.lit((1 << z.block) - 1).cast("long").alias("mask"))
    tuples = suffix_tuples(docs, _filter(open_cores.select("core")), z)
    crowded = cut(open_cores.where(F.col("size") > CORE_TUPLES).select("core"), "crowded")
    few = open_cores.join(crowded, "core", "left_anti").select("core")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    induced = tuples.join(few, "core").repartition(n, "core").sortWithinPartitions("core", "rights").mapInArrow(
        lambda it: _induced(it, z), "doc_id long, print long, base int, mask long")
    out = settled.unionByName(induced)
    return out if crowded.isEmpty() else out.unionByName(_single_names(tuples.join(crowded, "core"), z))


def _spans(size: int, places: np.ndarray, masks: np.ndarray, z: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs covered by strings at base - s."""
    edge = np.zeros(size + 1, np.int64)
    for s in range(z.block):
        at = places[(masks >> s & 1).astype(bool)] - s
        np.add.at(edge, at, 1)
        np.add.at(edge, at + z.width, -1)
    covered = np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8)
    return np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)


def deduplicate(docs: DataFrame, z: Sizes = Sizes()) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed [begin, end) byte ranges), kept (the remaining bytes)."""
    marks = repeats(docs, z).groupBy(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).agg(F.collect_list(F.struct("base", "mask")).alias("marks"))  # a document's own

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            found = batch.column("marks")
            for first, last in slices(offsets):
                spans, kept = [], []
                for i in range(first, last):
                    text = data[offsets[i]:offsets[i + 1]]
                    if found[i].is_valid:
                        own = found[i].values
                        starts, ends = _spans(len(text), own.field("base").to_numpy(), own.field("mask").to_numpy(), z)
                        spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(starts, ends, strict=True)])
                        edges = np.concatenate([[0], np.stack([starts, ends], 1).reshape(-1), [len(text)]])
                        kept.append(b"".join(text[x:y].tobytes() for x, y in edges.reshape(-1, 2)))
                    else:
                        spans.append([])
                        kept.append(text.tobytes())
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(first, last - first), "n_bytes": pa.array(np.diff(offsets[first:last + 1])),
                                       "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})

    joined = _texts(docs).join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")), "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
