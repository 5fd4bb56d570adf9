"""Line deduplication by a segment-partition edit join.

Two lines are near if at most ``EDITS`` code points are inserted, deleted or replaced between them.  Each
line is split into ``EDITS + 1`` segments of even length; if two lines are near, at least one segment of the shorter is in the
longer one unchanged, and shifted no more than the edits on its left and right allow.  So a line is indexed
under (length, number, fingerprint) of its segments and probes the indexes of all lengths
within reach with the few substrings that can match.  Lines that meet are verified by a
bit-parallel edit distance in a band of ``2 * EDITS + 1`` diagonals, for many pairs at a time.

Copies of a line are one class from the start.  A segment that very many different lines share
is not paired in one task: its lines are dealt into blocks, and pairs of blocks are verified apart.

A line of a class that occurs in an earlier place (by doc_id, then place in the text) is a duplicate.

Edits count from ``MIN_CHARS`` code points on: two different lines can be near if the longer has as many.  Copies are
one class at any length.

Defined results: a blank line of fewer than ``MIN_CHARS`` is never a duplicate; null and empty texts have one empty line;
rows with equal doc_id and text are one document, and each gets its result; a null doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import _power, buffers, mixed, ragged, ready, slices
from runledger.llm.links import components, grouped
from runledger.llm.urls import BITS_PER_KEY, BLOCK_BYTES, _held, _level

EDITS = 2
#: Least length of the longer of two near lines.
MIN_CHARS = 20
#: Lines that share a segment are paired in one go up to this number, and dealt into blocks beyond.
PAIRED, BLOCK_LINES = 64, 256
#: Code points worked on at a time.  Arrays derived from them take about 45 bytes each in every worker,
#: and a worker keeps the powers for its largest chunk.
CHUNK = 1 << 19


def split_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, print, line, id, text): every line; its id is null if it has fewer than ``least`` code points or is short and blank.

    The text is there once per batch, and only of lines that are long enough to be near another.
    """
    shortest = MIN_CHARS - EDITS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for first, end in slices(buffers(batch.column(1))[1]):
                owner, number, ids, texts = [], [], [], []
                for row in range(first, end):
                    for k, line in enumerate((batch.column(1)[row].as_py() or "").split("\n")):
                        owner.append(row)
                        number.append(k)
                        if len(line) < least or len(line) < MIN_CHARS and not line.strip():
                            ids.append(None)
                            texts.append(None)
                            continue
                        own = xxhash.xxh3_64_intdigest(line.encode()) >> 2
                        ids.append(own)
                        texts.append(None if own in seen or len(line) < shortest else line)
                        seen.add(own)
                at = pa.array(owner, pa.int64())
                yield pa.record_batch({"doc_id": batch.column(0).take(at), "print": batch.column(2).take(at), "line": pa.array(number, pa.int32()),
                                       "id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})

    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")).mapInArrow(
        split, "doc_id long, print long, line int, id long, text string")
    return cut(rows, "lines")


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _segment(lengths: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the k-th segment of lines of these lengths."""
    size, more = np.divmod(lengths, edits + 1)
    late = np.maximum(0, k - (edits + 1 - more))
    return k * size + late, size + (k >= edits + 1 - more)


def segment_keys(texts: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the text, indexed) of all segments to index and substrings to probe.

    An indexed segment is also a probe, as substrings at the same place of lines of equal length have the same key.
    Lines of fewer than ``MIN_CHARS`` are only indexed, for longer ones to meet.
    """
    points, offsets = _points(texts)
    lengths = np.diff(offsets)
    up, down = _power(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    keys, owners, indexed = [], [], []
    for less in range(edits + 1):
        target = lengths - less
        for k in range(edits + 1):
            start, size = _segment(target, k, edits)
            # edits before the segment and after it bound its shift
            for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                at = start + shift
                fits = np.flatnonzero((target >= MIN_CHARS - edits) & ((lengths >= MIN_CHARS) | (less == 0 and shift == 0)) & (at >= 0) & (at + size <= lengths))
                a = offsets[fits] + at[fits]
                prints = mixed((sums[a + size[fits]] - sums[a]) * down[a])
                keys.append(mixed(prints + (target[fits] * (edits + 1) + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                owners.append(fits)
                indexed.append(np.full(len(fits), less == 0 and shift == 0))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(indexed)


def _keyed(lines: DataFrame) -> DataFrame:
    """(key, line) with line = 2 * id + whether it is indexed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK):
                    chars += len(texts[end])
                    end += 1
                keys, owners, indexed = segment_keys(texts[at:end])
                yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "line": pa.array(ids[at:end][owners] * 2 + indexed)})
                at = end

    return lines.where("text IS NOT NULL").select("id", "text").mapInArrow(work, "key long, line long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, key) from (key, line) sorted by key: pairs that meet with key null; for keys of many lines, (line, null, key)."""
    held_key, held, hot = None, np.zeros(0, np.int64), False

    def crowd(key: int, lines: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array(np.unique(lines)), "b": pa.nulls(len(np.unique(lines)), pa.int64()), "key": pa.array([key] * len(np.unique(lines)), pa.int64())})

    def pairs(lines: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        run = np.repeat(np.arange(len(starts)), sizes)
        first = np.flatnonzero(lines & 1)
        owner, other = ragged(starts[run[first]], sizes[run[first]])
        a, b = lines[first[owner]] >> 1, lines[other] >> 1
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
        return pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "key": pa.nulls(len(both), pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        key, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held_key is not None:
            if hot and key[0] == held_key:  # the rest of a key already seen to be hot
                n = int(np.searchsorted(key, held_key, side="right"))
                yield crowd(held_key, line[:n])
                key, line = key[n:], line[n:]
                if not len(key):
                    continue
            elif not hot:
                key, line = np.append(np.full(len(held), held_key), key), np.append(held, line)
            hot = False
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        for k in np.flatnonzero(sizes > PAIRED):
            yield crowd(int(key[starts[k]]), line[starts[k]:starts[k] + sizes[k]])
        held_key, hot = int(key[-1]), bool(sizes[-1] > PAIRED)
        held = line[starts[-1]:] if not hot else line[:0]
        ready_runs = (sizes > 1) & (sizes <= PAIRED)
        ready_runs[-1] = False
        if ready_runs.any():
            _, at = ragged(starts[ready_runs], sizes[ready_runs])
            size = sizes[ready_runs]
            yield pairs(line[at], np.cumsum(size) - size, size)
    if held_key is not None and not hot and len(held) > 1:
        yield pairs(held, np.zeros(1, np.int64), np.asarray([len(held)]))


def within(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair of texts is within so many edits; band of a bit-parallel edit distance, for all pairs at once."""
    out = np.zeros(len(left), bool)
    size = np.asarray([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64)
    apart = np.asarray([abs(len(a) - len(b)) for a, b in zip(left, right, strict=True)], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[apart[order] <= edits]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (size[order[end]] + 1) <= CHUNK:
            end += 1
        own = order[at:end]
        out[own] = _band([left[i] for i in own], [right[i] for i in own], edits)
        at = end
    return out


def _padded(texts: list[str], before: int, width: int, fill: int) -> np.ndarray:
    points, offsets = _points(texts)
    out = np.full((width, len(texts)), fill, np.int64)
    owner, at = ragged(offsets[:-1], np.diff(offsets))
    out[at - offsets[owner] + before, owner] = points[at]
    return out


def _band(left: list[str], right: list[str], k: int) -> np.ndarray:
    """Vertical differences of the band around the diagonal are two bit vectors per pair; bit t of column j is row j - k + t."""
    rows, columns = np.asarray([len(t) for t in left]), np.asarray([len(t) for t in right])
    width = int(columns.max())
    a = _padded(left, k, max(width, int(rows.max())) + 2 * k + 2, -1)  # row i is at i + k
    b = _padded(right, 0, width, -2)
    mask = np.int64((1 << (2 * k + 1)) - 1)
    plus = np.full(len(left), mask & ~((1 << k) - 1), np.int64)  # rows from 0 on rise by one each in the column before the first
    minus = np.zeros(len(left), np.int64)
    score = np.minimum(rows, k)  # distance at the band's lowest row, or in the last row once that is inside
    for j in range(width):
        match = np.zeros(len(left), np.int64)
        for t in range(2 * k + 1):
            match |= (a[j + t] == b[j]).astype(np.int64) << t
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        h_plus, h_minus = (minus | ~(zero | plus)) & mask, zero & plus
        live = j < columns
        last = rows - 1 - j + k  # bit of the last row
        below = last >= 2 * k
        score += live & below & ((zero >> (2 * k) & 1) == 0)
        bit = np.clip(last, 0, 2 * k)
        score += (live & ~below) * ((h_plus >> bit & 1) - (h_minus >> bit & 1))
        down = zero >> 1
        plus, minus = (h_minus | ~(down | h_plus)) & mask, down & h_plus
    return score <= k


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([max(len(a), len(b)) >= MIN_CHARS for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)], pa.bool_()))
            yield batch.select(["a", "b"]).filter(pa.array(within(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())))

    return pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _blocks(crowds: DataFrame, texts: DataFrame) -> DataFrame:
    """Near pairs within crowded keys: all pairs of bounded blocks, those of unlike letters left out before the distance."""
    def work(cell: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, where = np.unique(cell.column("id").to_numpy(), return_index=True)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        block, text = cell.column("block").to_numpy()[where], cell.column("text").take(pa.array(where)).to_pylist()
        points, offsets = _points(text)
        owner, at = ragged(offsets[:-1], np.diff(offsets))
        letters = np.bincount(owner * 64 + points[at] % 64, minlength=len(text) * 64).reshape(-1, 64).astype(np.int32)
        long = np.diff(offsets) >= MIN_CHARS
        one, two = [], []
        for x in np.flatnonzero(block == i):
            others = np.flatnonzero((block == j) & ((ids > ids[x]) if i == j else True) & (long | long[x]))
            others = others[np.abs(letters[others] - letters[x]).sum(1) <= 2 * EDITS]  # an edit changes two counts by one
            one += [x] * len(others)
            two += others.tolist()
        near = within([text[x] for x in one], [text[y] for y in two])
        a, b = ids[np.asarray(one, np.int64)[near]], ids[np.asarray(two, np.int64)[near]]
        if len(a):
            yield pa.record_batch({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    sizes = crowds.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).cast("int").alias("blocks"))
    dealt = crowds.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(texts, "id")
    cells = dealt.select("key", "id", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "text")
    n = int(crowds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda it: grouped(it, ["key", "i", "j"], work), "a long, b long")


def _texts_of(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, text) of the lines with these ids, stored.  A filter of bounded size leaves out most others before the join."""
    hashed = lambda df: df.select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), "*")
    n, own = ids.count(), lines.where("text IS NOT NULL").select("id", "text")
    if n and n * BITS_PER_KEY // 8 <= BLOCK_BYTES:
        sent = ids.sparkSession.sparkContext.broadcast(_level(hashed(ids), 0, n))

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_held(0, sent.value, *(batch.column(c).to_numpy().view(np.uint64) for c in (0, 1)))))

        own = hashed(own).mapInArrow(likely, "h1 long, h2 long, id long, text string").select("id", "text")
    return cut(own.join(ids, "id").groupBy("id").agg(F.first("text").alias("text")), "line-texts")


def near_pairs(lines: DataFrame) -> DataFrame:
    """(a, b): all pairs of different lines within ``EDITS`` edits, by id, stored."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut(_keyed(lines).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long, key long"), "met")
    pairs = met.where("key IS NULL").select("a", "b").distinct()
    crowds = met.where("key IS NOT NULL").select("key", F.shiftright("a", 1).alias("id")).distinct()
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowds.select("id")).distinct(), "line-ids")
    texts = _texts_of(ids, lines)
    return cut(_verified(pairs, texts).unionByName(_blocks(crowds, texts)).distinct(), "near-lines")


def deduplicate(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Per document (by doc_id and print of its text): n_lines, n_links, line_classes and removed (numbers of duplicate lines).

    ``line_classes`` has a class for each line, null for those of fewer than ``least`` code points and for short blank ones;
    ``n_links`` counts, over its lines, the other occurrences in all documents that are equal or near.
    """
    lines = split_lines(docs, least)
    pairs = near_pairs(lines)
    # rows with equal doc_id and text are one document
    occurrences = lines.select("doc_id", "print", "line", "id").distinct()
    classable = cut(occurrences.where("id IS NOT NULL"), "classable-lines")
    label = components(pairs).toDF("id", "class")
    copies = cut(classable.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "print", "line")).alias("first")), "line-copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("linked"))
    classed = copies.join(label, "id", "left").join(linked, "id", "left").select(
        "id", "first", F.coalesce("class", "id").alias("class"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    classed = cut(classed, "line-classes")
    # most lines are alone and need no join: only classes that occur again have a row here
    again = classed.groupBy("class").agg(F.min("first").alias("keep"))
    again = cut(classed.where("links > 0").select("id", "class", "links").join(again, "class"), "repeated")
    place = F.struct("doc_id", "print", "line")
    marked = occurrences.join(again, "id", "left").select(
        "doc_id", "print", "line", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"),
        (F.col("class").isNotNull() & ~place.eqNullSafe(F.col("keep"))).alias("duplicate"))
    return marked.groupBy("doc_id", "print").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.struct("line", "class", "duplicate"))).alias("own")).select(
        "doc_id", "print", "n_lines", "n_links", F.transform("own", lambda x: x["class"]).alias("line_classes"),
        F.transform(F.filter("own", lambda x: x["duplicate"]), lambda x: x["line"]).alias("removed"))
