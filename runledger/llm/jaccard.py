"""Self-join of documents on the Jaccard similarity of their 5-word shingles, by a MinHash LSH forest.

Every set of shingles gets ``TREES`` labels of ``DEPTH`` MinHash values, of which 16 bits are kept.  A tree is the prefix
trie of its sorted labels: sets that share the first d values are below one node.  The join starts
at the longest prefix whose recall for pairs at the threshold reaches ``FLOOR``, looks at how similar
the pairs found are, and from the chance of each to be found at this depth estimates the recall over all pairs;
while that is below ``TARGET`` the prefixes are shortened by one value.

Sets below one node are compared by 128-bit sketches and linked to the leaders of their node, which gives
groups of candidates.  Each set's text travels once to its group (large groups are dealt into pairs of blocks of bounded
size), where all pairs are verified on their full shingle sets.  Documents with
equal sets are one class from the start and count with their number, so copies are never paired.

A node with very many sets is salted: parts elect leaders, and the leaders are compared once more.

Defined results: a text of one to four words is one shingle; null texts and texts without words have no
shingles, no links, and a class of their own; rows that repeat a doc_id are separate documents; the class id is the
least doc_id of the class (null if all are null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import buffers, mixed, ready, slices, words
from runledger.llm.links import Union, components, grouped, run_starts

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
FLOOR, TARGET = 0.999, 0.9995
#: Estimated similarities from which two sets are candidates, and from which a set needs no leader of its own.
NEAR, COVERED = 0.5, 0.75
#: Sets of a node compared in one go, and sets and shingles of a block of verified pairs.
NODE_SETS, BLOCK_SETS, BLOCK_SHINGLES = 4096, 2048, 2_000_000

_rng = np.random.default_rng(41)
_STEP = _rng.integers(1, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**32, (TREES * DEPTH, 1), np.uint32)
_MUL = _rng.integers(0, 2**32, (TREES * DEPTH, 1), np.uint32) | np.uint32(1)
_LABEL = _rng.integers(1, 2**64, DEPTH, np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    prints, counts = words(data, offsets)
    at = np.cumsum(counts) - counts
    n = len(prints)
    sums = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE if len(sums) else 0):
        sums += prints[k:k + len(sums)] * _STEP[k]
    sums = mixed(sums)
    out = []
    for begin, c in zip(at.tolist(), counts.tolist(), strict=True):
        if c >= SHINGLE:
            out.append(np.unique(sums[begin:begin + c - SHINGLE + 1]))
        elif c:
            out.append(mixed(np.asarray([np.sum(prints[begin:begin + c] * _STEP[:c]) + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(out, ((x[a:a + 2048] ^ _XOR) * _MUL).min(1), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, print, set1, set2, n, sketch1, sketch2, labels) of every document, stored."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                sets = shingle_sets(data, offsets[a:b + 1])
                hashes = np.stack([min_hashes(s) for s in sets])
                hashes *= np.uint32(0x9E3779B1)  # minima are small numbers; this spreads them over all bits
                bits = np.packbits((hashes[:, ::2] >> np.uint32(31)).astype(bool), axis=1)
                sketch = np.ascontiguousarray(bits).view(np.int64)
                yield pa.record_batch({
                    "uid": pa.array(np.arange(uid, uid + b - a)), "doc_id": batch.column(0).slice(a, b - a), "print": batch.column(2).slice(a, b - a),
                    "set1": pa.array([int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    "set2": pa.array([int(mixed(s ^ _STEP[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()), "sketch1": pa.array(sketch[:, 0]), "sketch2": pa.array(sketch[:, 1]),
                    "labels": pa.array([h.tobytes() for h in (hashes >> np.uint32(16)).astype(np.uint16)], pa.binary())})
                uid += b - a

    ready(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")).mapInArrow(
        sign, "uid long, doc_id long, print long, set1 long, set2 long, n long, sketch1 long, sketch2 long, labels binary"), "signatures")


def found_at(similarity: float, depth: int) -> float:
    """Chance that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def _nodes(sets: DataFrame, depth: int) -> DataFrame:
    """(node, uid, sketch1, sketch2): the node of each set in each tree."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                if not part.num_rows:
                    continue
                labels = np.frombuffer(b"".join(part.column("labels").to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)[:, :, :depth].astype(np.uint64)
                node = mixed((labels * _LABEL[:depth]).sum(2, dtype=np.uint64) + (np.arange(TREES, dtype=np.uint64) * np.uint64(DEPTH + 1) + np.uint64(depth)) * _LABEL[0])
                repeat = lambda c: pa.array(np.repeat(part.column(c).to_numpy(), TREES))  # noqa: B023, E731
                yield pa.record_batch({"node": pa.array(node.reshape(-1).view(np.int64)), **{c: repeat(c) for c in ("uid", "sketch1", "sketch2")}})

    return sets.select("uid", "sketch1", "sketch2", "labels").mapInArrow(walk, "node long, uid long, sketch1 long, sketch2 long")


def _similar(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: their bits agree with chance (1 + J) / 2."""
    return 1 - np.bitwise_count((one ^ many).view(np.uint64)).sum(1) / 64


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out sets that are alone below their node, which are most; the ends of a batch may go on in the next."""
    for batch in batches:
        new = np.append(run_starts(batch, ["node", "part"]), True)
        alone = new[:-1] & new[1:] & (batch.column("part").to_numpy() == 0)
        alone[:1] = alone[-1:] = False
        yield batch.filter(pa.array(~alone))


def _elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, near): links between sets of a node and its leaders; with a = b, a leader of a part of a large node.

    Small nodes compare all their sets.  In large ones, a set is compared with the leaders so far and becomes one
    unless it is covered; as similarity is a metric, two sets at the threshold meet at the leader that covers one of them.
    """
    def work(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uid = group.column("uid").to_numpy()
        part = group.column("part")[0].as_py()
        if len(uid) == 1 and not part:
            return
        if len(uid) == 2 and not part:
            near = _similar(sketch_of(group, 0), sketch_of(group, 1)[None])
            if near[0] >= NEAR:
                yield pa.record_batch({"node": group.column("node").slice(0, 1), "a": group.column("uid").slice(0, 1), "b": group.column("uid").slice(1, 1), "near": pa.array(near)})
            return
        sketch = np.stack([group.column("sketch1").to_numpy(), group.column("sketch2").to_numpy()], 1)
        small = len(uid) <= 64
        a, b, near = [], [], []
        leaders: list[int] = []
        lead = np.zeros((len(uid), 2), np.int64)
        tree = np.zeros(len(uid), np.int64)  # number of the tree each leader is in
        for i in range(len(uid)):
            n = len(leaders)
            score = _similar(sketch[i], lead[:n])
            meets = np.flatnonzero(score >= (NEAR if small else NEAR - 0.15))
            # one link to each tree that the set meets, at its most similar leader, joins them all
            meets = meets[np.argsort(-score[meets], kind="stable")]
            trees, best = np.unique(tree[meets], return_index=True)
            a += [uid[i]] * len(best)
            b += [uid[leaders[k]] for k in meets[best]]
            near += score[meets[best]].tolist()
            if len(trees) > 1:
                tree[:n][np.isin(tree[:n], trees)] = trees[0]
            if small or not (score >= COVERED).any():
                lead[n], tree[n] = sketch[i], trees[0] if len(trees) else i
                leaders.append(i)
        if part:
            a, b, near = a + [uid[i] for i in leaders], b + [uid[i] for i in leaders], near + [1.0] * len(leaders)
        if a:
            yield pa.record_batch({"node": pa.array([group.column("node")[0].as_py()] * len(a), pa.int64()),
                                   "a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64)), "near": pa.array(np.asarray(near, float))})

    def sketch_of(group: pa.RecordBatch, i: int) -> np.ndarray:
        return np.asarray([group.column("sketch1")[i].as_py(), group.column("sketch2")[i].as_py()], np.int64)

    yield from grouped(_company(batches), ["node", "part"], work)


_LINK = "node long, a long, b long, near double"


def candidate_links(sets: DataFrame, depth: int) -> DataFrame:
    """(a, b, near): links that connect all sets below a common node whose sketches are near."""
    nodes = _nodes(sets, depth)
    hot = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > NODE_SETS), "hot-nodes")
    parts = F.ceil(F.col("size") / NODE_SETS).cast("int")
    salted = nodes.join(hot, "node", "left").select("node", F.when(F.col("size").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("uid"), parts)).cast("int").alias("part"),
                                                    "uid", "sketch1", "sketch2")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = cut(salted.repartition(n, "node", "part").sortWithinPartitions("node", "part", "uid").mapInArrow(_elect, _LINK), "node-links")
    leaders = first.where("a = b").join(hot, "node", "left_semi").select("node", F.col("a").alias("uid")).join(
        sets.select("uid", "sketch1", "sketch2"), "uid").withColumn("part", F.lit(0))
    second = leaders.repartition(n, "node").sortWithinPartitions("node", "uid").select("node", "part", "uid", "sketch1", "sketch2").mapInArrow(_elect, _LINK)
    return cut(first.where("a <> b").unionByName(second).groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max("near").alias("near")), "links")


def estimated_recall(links: DataFrame, depth: int) -> float:
    """Links found at the threshold or above, divided by how many there are to judge by each one's chance to be found."""
    chance = 1 - F.pow(1 - F.pow(F.least(F.col("near"), F.lit(1.0)), F.lit(depth)), F.lit(TREES))
    n, total = links.where(F.col("near") >= THRESHOLD).agg(F.count(F.lit(1)), F.sum(1 / chance)).first()
    return n / total if n else 1.0


def _intersections(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with the others (or among all if left is their number)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    rows = slice(0, left), slice(0, None) if left == len(sets) else slice(left, None)
    out = np.zeros((left, len(sets) if left == len(sets) else len(sets) - left), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4097, 4096))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[a:b], column[a:b] - 4096 * k] = 1
        out += has[rows[0]] @ has[rows[1]].T
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(uid, links, root) for the sets of each cell: number of documents linked in it, and a set it is connected with."""
    def work(cell: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        uid, where = np.unique(cell.column("uid").to_numpy(), return_index=True)  # documents equal in id and text come more than once
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        block = cell.column("block").to_numpy()[where]
        where = where[np.argsort(block != i, kind="stable")]
        uid, copies = cell.column("uid").to_numpy()[where], cell.column("copies").to_numpy()[where]
        left = int((block == i).sum())
        if i != j and left in (0, len(uid)):
            return
        data, offsets = buffers(cell.column("text").take(pa.array(where)))
        sets = [s for a, b in slices(offsets) for s in shingle_sets(data, offsets[a:b + 1])]
        size = np.asarray([len(s) for s in sets], np.float64)
        both = _intersections(sets, left)
        right = slice(0, None) if i == j else slice(left, None)
        linked = both >= threshold * (size[:left, None] + size[None, right] - both) - 1e-6
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(uid), np.int64)
        links[:left] += linked @ copies[right]
        if i != j:
            links[left:] += linked.T @ copies[:left]
        tree = Union(len(uid))
        for a in range(left):
            for b in np.flatnonzero(linked[a]) + (0 if i == j else left):
                tree.join(a, int(b))
        some = np.flatnonzero(links)
        if len(some):
            yield pa.record_batch({"uid": pa.array(uid[some]), "links": pa.array(links[some]), "root": pa.array(uid[[tree.root(int(k)) for k in some]])})

    yield from grouped(batches, ["grp", "i", "j"], work)


def classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Per document: doc_id, print (of its text), n_shingles, class_id, n_links (documents at the threshold or above), kept (one per class)."""
    spark = docs.sparkSession
    signed = signatures(docs)
    worded = signed.where("n > 0")
    same = cut(worded.groupBy("set1", "set2").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id")), "sets")
    reps = cut(worded.join(same.select(F.col("rep").alias("uid"), "copies"), "uid"), "representatives")
    depth = max([d for d in range(1, DEPTH + 1) if found_at(threshold, d) >= FLOOR], default=1)
    links = candidate_links(reps, depth)
    while depth > 1 and estimated_recall(links, depth) < target:
        depth -= 1
        links = candidate_links(reps, depth)

    groups = components(links)
    sized = groups.join(reps.select(F.col("uid").alias("node"), "n", "doc_id", "print", "copies"), "node")
    blocks = cut(sized.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "group-sizes")
    needed = cut(sized.join(blocks, "label").select("label", F.col("node").alias("uid"), "doc_id", "print", "copies", "blocks",
                                                    F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    # sent by key at every size: a plan that broadcasts small tables would change with the input
    joined = texts.alias("t").join(needed.hint("merge").alias("n"), F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("t.print") == F.col("n.print")))
    cells = joined.select("label", "uid", "copies", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.col("label").alias("grp"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "uid", "copies", "block", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    verified = cut(cells.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(
        lambda it: _verify(it, threshold), "uid long, links long, root long"), "verified")

    label = components(verified.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    per_set = same.join(verified.groupBy(F.col("uid").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left").join(
        label.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "set1", "set2", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("class"))
    per_set = cut(per_set, "per-set")
    least = per_set.groupBy("class").agg(F.min("least_id").alias("class_id"))
    member = worded.select("uid", "doc_id", "print", "n", "set1", "set2").join(per_set, ["set1", "set2"]).join(least, "class")
    member = cut(member.select("uid", "doc_id", "print", F.col("n").alias("n_shingles"), "class_id", "n_links", "class"), "members")
    keeper = member.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("kept"))
    alone = signed.where("n = 0").select("doc_id", "print", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return member.join(keeper, "uid", "left").select("doc_id", "print", "n_shingles", "class_id", "n_links", F.coalesce("kept", F.lit(False)).alias("kept")).unionByName(alone)
