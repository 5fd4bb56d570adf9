"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: a segment holds a few megabytes of whole texts as
one row with a term dictionary, and for each term the ascending positions of its
postings.  Positions run on through a segment with a gap between documents, so a
phrase never matches across two.  A search visits each segment once: terms missing
from a segment's dictionary rule a phrase out, the list of its rarest term gives
candidate starts, and the offset-adjusted lists of its other terms are intersected
with them, rarest first.  What is searched for is dealt into blocks of bounded size,
so a block fits into each task however large the benchmark is.

Defined results: null, empty and wordless texts have no postings and no hits; rows that
repeat a doc_id each get a row of their own; a null doc_id is kept; items without an id
or without words are skipped, items that repeat an id count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import buffers, ragged, ready, slices, words

WINDOW = 10
#: (phrase, item) pairs searched for at a time: at most some 6 MB for each task.
BLOCK_PAIRS = 32_768

#: Segments in a row group of the stored index: writer and reader hold a group at a time, whatever the size of a file.
GROUP_SEGMENTS = 2

INDEX = "segment long, doc_ids array<long>, prints array<long>, first array<int>, n_words array<int>, terms array<long>, starts array<int>, postings array<int>"


def build_index(docs: DataFrame) -> DataFrame:
    """Store all postings of the texts; one row per segment."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                prints, counts = words(data, offsets[a:b + 1])
                first = np.cumsum(counts) - counts + np.arange(len(counts))  # one free position after each text
                position = np.arange(len(prints)) + np.repeat(np.arange(len(counts)), counts)
                order = np.argsort(prints, kind="stable")
                terms, starts = np.unique(prints[order], return_index=True)
                yield pa.record_batch({
                    "segment": pa.array([segment]), "doc_ids": _cell(batch.column(0).slice(a, b - a)), "prints": _cell(batch.column(2).slice(a, b - a)),
                    "first": _cell(first.astype(np.int32)), "n_words": _cell(counts.astype(np.int32)), "terms": _cell(terms.view(np.int64)),
                    "starts": _cell(np.append(starts, len(prints)).astype(np.int32)), "postings": _cell(position[order].astype(np.int32))})
                segment += 1

    ready(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")).mapInArrow(build, INDEX),
               "postings", **{"parquet.block.row.count.limit": GROUP_SEGMENTS})


def _cell(values) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _np(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def benchmark_phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, terms, block): the distinct windows of each item, dealt into blocks."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets):
                prints, counts = words(data, offsets[a:b + 1])
                items, phrases = [], []
                at = np.cumsum(counts) - counts
                for i, (begin, n) in enumerate(zip(at, counts, strict=True)):
                    own = prints[begin:begin + n].view(np.int64)
                    for k in range(max(n - window, 0) + 1 if n else 0):
                        items.append(batch.column(0)[a + i].as_py())
                        phrases.append(own[k:k + window])
                yield pa.record_batch({"item": pa.array(items, pa.string()), "terms": pa.array(phrases, pa.list_(pa.int64()))})

    ready(benchmark.sparkSession)
    named = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    found = cut(named.mapInArrow(split, "item string, terms array<long>").distinct(), "phrases")
    blocks = max(1, -(-found.count() // BLOCK_PAIRS))
    return found.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)))


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(segment, row, spans, items): where phrases occur; spans are disjoint [begin, end) word ranges of one text.

    The result has a row per text and block of phrases that meet.
    """
    spark, out = index.sparkSession, None
    for (block,) in phrases.select("block").distinct().collect():  # one number per block
        pairs = phrases.where(F.col("block") == block).toPandas()  # bounded by BLOCK_PAIRS
        if not len(pairs):
            continue
        query = spark.sparkContext.broadcast(_packed(pairs))
        counted = {r.term: r.n for r in _term_counts(index, query).collect()}  # terms of one block
        ordered = spark.sparkContext.broadcast(_rarest_first(query.value, counted))
        hits = index.mapInArrow(_searcher(ordered), "segment long, row int, spans array<struct<b:int,e:int>>, items array<string>")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], "segment long, row int, spans array<struct<b:int,e:int>>, items array<string>")


def _packed(pairs) -> dict:
    keys = [tuple(t) for t in pairs["terms"]]
    distinct = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    width = max(map(len, distinct))
    terms = np.unique(np.concatenate([np.asarray(k, np.int64) for k in distinct]).view(np.uint64))
    slots = np.full((len(distinct), width), -1, np.int64)
    for k, i in distinct.items():
        slots[i, :len(k)] = np.searchsorted(terms, np.asarray(k, np.int64).view(np.uint64))
    order = np.argsort([distinct[k] for k in keys], kind="stable")
    of = np.asarray([distinct[k] for k in keys])[order]
    return {"terms": terms, "slots": slots, "size": (slots >= 0).sum(1), "items": pairs["item"].to_numpy(object)[order],
            "item_at": np.searchsorted(of, np.arange(len(distinct) + 1))}


def _term_counts(index: DataFrame, query) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = query.value["terms"]
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, starts = _np(batch, "terms", row).view(np.uint64), _np(batch, "starts", row)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    total += np.where(terms[at] == wanted, starts[at + 1] - starts[at], 0)
        yield pa.record_batch({"term": pa.array(np.arange(len(wanted))), "n": pa.array(total)})

    return index.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _rarest_first(query: dict, counted: dict[int, int]) -> dict:
    n = np.asarray([counted.get(i, 0) for i in range(len(query["terms"]))] + [np.iinfo(np.int64).max])
    order = np.argsort(n[query["slots"]], axis=1, kind="stable")  # unused slots come last
    return query | {"offset": order, "slots": np.take_along_axis(query["slots"], order, 1)}


def _searcher(query):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        for batch in batches:
            for row in range(batch.num_rows):
                found = _search_segment(q, *(_np(batch, c, row) for c in ("first", "n_words", "terms", "starts", "postings")))
                if found:
                    found["segment"] = pa.array([batch.column("segment")[row].as_py()] * len(found["row"]), pa.int64())
                    yield pa.record_batch({k: found[k] for k in ("segment", "row", "spans", "items")})

    return search


def _intersect(q: dict, terms: np.ndarray, starts: np.ndarray, postings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of all exact matches in a segment."""
    at = np.minimum(np.searchsorted(terms, q["terms"]), len(terms) - 1)
    local = np.append(np.where(terms[at] == q["terms"], at, -1), -2)  # -2: unused slot
    slots = local[q["slots"]]
    alive = np.flatnonzero((slots != -1).all(1))
    rarest = slots[alive, 0]
    owner, at = ragged(starts[rarest], starts[rarest + 1] - starts[rarest])
    phrase = alive[owner]
    begin = postings[at].astype(np.int64) - q["offset"][phrase, 0]
    keys = (np.repeat(np.arange(len(terms)), np.diff(starts)) << 32) | postings
    for r in range(1, slots.shape[1]):
        slot = slots[phrase, r]
        wanted = (slot << 32) | (begin + q["offset"][phrase, r])
        near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        keep = (slot == -2) | ((begin >= 0) & (keys[near] == wanted))
        phrase, begin = phrase[keep], begin[keep]
        if not len(phrase):
            break
    return phrase, begin


def _search_segment(q: dict, first, n_words, terms, starts, postings) -> dict | None:
    if not len(terms):
        return None
    phrase, begin = _intersect(q, terms.view(np.uint64), starts, postings)
    if not len(phrase):
        return None
    doc = np.searchsorted(first, begin, side="right") - 1
    order = np.lexsort((begin, doc))
    phrase, begin, doc = phrase[order], begin[order] - first[doc[order]], doc[order]
    end = begin + q["size"][phrase]
    rows, cuts = np.unique(doc, return_index=True)
    spans, items = [], []
    for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
        reach = np.maximum.accumulate(end[a:b])
        new = np.flatnonzero(np.append(True, begin[a + 1:b] > reach[:-1]))
        spans.append([{"b": int(x), "e": int(y)} for x, y in zip(begin[a:b][new], reach[np.append(new[1:] - 1, b - a - 1)], strict=True)])
        own = np.unique(phrase[a:b])
        items.append(sorted({q["items"][k] for p in own for k in range(q["item_at"][p], q["item_at"][p + 1])}))
    return {"row": pa.array(rows.astype(np.int32)), "spans": pa.array(spans, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))),
            "items": pa.array(items, pa.list_(pa.string()))}


def index_rows(index: DataFrame) -> DataFrame:
    """(segment, row, doc_id, print, n_words) of every indexed text."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "prints", "n_words")).alias("row", "d")).select(
        "segment", "row", F.col("d.doc_ids").alias("doc_id"), F.col("d.prints").alias("print"), F.col("d.n_words").cast("long").alias("n_words"))


def proximity_hits(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, position): words of the rarest term around which all terms lie within ``within`` words of it, in one text.

    ``position`` counts the words of the text from 0.
    """
    text = pa.array(terms)
    prints, counts = words(*buffers(text))
    if (counts != 1).any():
        raise ValueError("each term must be one word")
    prints = np.unique(prints)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, starts, postings = _np(batch, "terms", row).view(np.uint64), _np(batch, "starts", row), _np(batch, "postings", row)
                if not len(own) or not np.isin(prints, own).all():
                    continue
                at = np.searchsorted(own, prints)
                lists = sorted((postings[starts[i]:starts[i + 1]] for i in at), key=len)
                first, n_words = _np(batch, "first", row), _np(batch, "n_words", row)
                doc = np.searchsorted(first, lists[0], side="right") - 1
                low, high = np.maximum(lists[0] - within, first[doc]), np.minimum(lists[0] + within, first[doc] + n_words[doc] - 1)
                keep = np.ones(len(lists[0]), bool)
                for other in lists[1:]:
                    keep &= np.searchsorted(other, low) < np.searchsorted(other, high, side="right")
                ids = batch.column("doc_ids")[row].values
                yield pa.record_batch({"doc_id": ids.take(pa.array(doc[keep])), "position": pa.array((lists[0] - first[doc])[keep].astype(np.int64))})

    ready(index.sparkSession)
    return index.mapInArrow(search, "doc_id long, position long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, print (of its text), n_words, n_hit, spans, items, contaminated.

    ``spans`` are the disjoint word ranges inside occurrences of benchmark windows.
    """
    index = build_index(docs)
    hits = phrase_hits(index, benchmark_phrases(benchmark, window)).groupBy("segment", "row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans of different blocks may overlap: add what reaches beyond the words already counted
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["upto"], s["b"]))).alias("n"), F.greatest(a["upto"], s["e"]).alias("upto")), lambda a: a["n"])
    return index_rows(index).join(hits, ["segment", "row"], "left").select(
        "doc_id", "print", "n_words", F.coalesce(covered.cast("long"), F.lit(0).cast("long")).alias("n_hit"), "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("contaminated"))
