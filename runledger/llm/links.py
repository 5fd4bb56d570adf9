"""Connected components, and streaming over the groups of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component, for every node that has an edge (a, b).

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its least
    neighbour, then each node's smaller neighbours are.  Only minima are combined per node, so a node
    with very many neighbours is no bottleneck; the number of rounds grows with the logarithm of a path's length.
    """
    own = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return own.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                own.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = now


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to each run of equal integer keys in batches sorted by them; runs must be of bounded size.

    What small runs give is handed on together.
    """
    ready: list[pa.RecordBatch] = []
    for run in _runs(batches, keys):
        ready += work(run)
        if len(ready) >= 256 or ready and ready[-1].num_rows >= rows:
            yield pa.concat_batches(ready)
            ready = []
    if ready:
        yield pa.concat_batches(ready)


def run_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row differs from the one before it in the batch; the first does."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return new


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(run_starts(batch, keys))
        goes_on = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        ends = np.append(cuts[1:], batch.num_rows)
        if goes_on:
            held.append(batch.slice(0, ends[0]))
            cuts, ends = cuts[1:], ends[1:]
        if len(cuts):
            if held:
                yield pa.concat_batches(held)
            for a, b in zip(cuts[:-1], ends[:-1], strict=True):
                yield batch.slice(a, b - a)
            held = [batch.slice(cuts[-1])]
    if held:
        yield pa.concat_batches(held)
