"""Token ids in Arrow IPC files of equal-length sequences.

Each file holds record batches of ``ROWS`` sequences; a sequence is a fixed-size list
of ``LENGTH`` ids with a mask of real tokens (the rest is padding, at a file's end only)
and a mask of documents' first tokens.  As all batches but the last have the same size, the
place of any sequence or token is arithmetic, and on a local disk it is read through a memory map
without copying.  Beside it lies the list of document ids of the file.

Texts are range-partitioned by doc_id, one task writes one pair of files under a name of its own attempt, and
the manifest lists the files of the attempts that succeeded, so retried or lost tasks leave no trace in it.
Files are opened through pyarrow's file systems, so the folder must be one they reach.

Defined results: null and empty texts have only the end id; rows with equal doc_id follow each other by a hash of
their text; null doc_ids come first; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.lineage import checkpoint_root, cut
from runledger.llm.common import ready
from runledger.llm.tokens import encoder

LENGTH, ROWS = 2048, 64
#: Text bytes of one file, about.
FILE_BYTES = 24 << 20
END_ID = 0


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class _Writer:
    """One file: ids go in, whole batches go out."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)), ("first", pa.list_(pa.bool_(), length))])
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.parts: list[np.ndarray] = []
        self.starts: list[int] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.starts.append(self.written + self.held)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.rows * self.length:
            self._flush(self.held // (self.rows * self.length) * self.rows)

    def _flush(self, sequences: int) -> None:
        flat = np.concatenate([*self.parts, np.zeros(0, self.dtype)])
        size = sequences * self.length
        real = min(size, len(flat))
        ids = np.zeros(size, self.dtype)
        ids[:real] = flat[:real]
        mask, first, starts = np.arange(size) < real, np.zeros(size, bool), np.asarray(self.starts, np.int64) - self.written
        first[starts[starts < size]] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, first)]
        whole = pa.record_batch(columns, schema=self.schema)
        for at in range(0, sequences, self.rows):
            self.file.write_batch(whole.slice(at, self.rows))
        self.parts, self.held, self.written = [flat[real:]], len(flat) - real, self.written + real
        self.starts = [s for s in self.starts if s >= self.written]

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length))
        self.file.close()
        self.out.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Write all texts in ascending doc_id order; returns the stored manifest (part, path, docs_path, n_tokens, n_docs)."""
    spark = docs.sparkSession
    ready(spark)
    folder = folder or f"{checkpoint_root(spark).rstrip('/')}/runledger/token-files-{uuid.uuid4().hex}"

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n = TaskContext.get().partitionId(), None, 0
        doc_ids = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    fs, root = _file_system(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
                    enc = encoder(tokenizer_path)
                    writer = _Writer(fs, f"{name}.arrow", np.dtype("<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"), length, rows)
                ids = np.frombuffer(enc.ids(text.as_py() or ""), "<u4").astype(writer.dtype)
                writer.add(np.append(ids, np.asarray([END_ID], writer.dtype)))
                n += len(ids) + 1
                doc_ids.append(doc_id.as_py())
        if writer is not None:
            writer.close()
            listing = pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64())})
            with fs.open_output_stream(f"{name}.docs") as out, pa.ipc.new_file(out, listing.schema) as file:
                file.write_batch(listing)
            full = folder.rstrip("/") + name[len(root):]
            yield pa.record_batch({"part": pa.array([part]), "path": pa.array([f"{full}.arrow"]), "docs_path": pa.array([f"{full}.docs"]),
                                   "n_tokens": pa.array([n]), "n_docs": pa.array([len(doc_ids)])})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        max(1, -(-size // FILE_BYTES)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(write_part, "part long, path string, docs_path string, n_tokens long, n_docs long"), "token-manifest")


class TokenFile:
    """Random access to a written file: sequences and token ranges, without copies where the file is mapped."""

    def __init__(self, path: str, docs_path: str | None = None):
        self.file = pa.ipc.open_file(self._open(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.docs = pa.ipc.open_file(self._open(docs_path)).read_all().column("doc_id") if docs_path else None

    @staticmethod
    def _open(path: str):
        fs, local = _file_system(path)
        return pa.memory_map(local) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(local)

    def _flat(self, batch: int, name: str) -> np.ndarray:
        column = self.file.get_batch(batch).column(name)
        return column.flatten().to_numpy(zero_copy_only=name == "ids")

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of the k-th sequence."""
        batch, row = divmod(k, self.rows)
        at = slice(row * self.length, (row + 1) * self.length)
        return self._flat(batch, "ids")[at], self._flat(batch, "mask")[at]

    def tokens(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids from place start to end, batch by batch."""
        size = self.rows * self.length
        while start < end:
            batch, at = divmod(start, size)
            upto = min(end - batch * size, size)
            yield self._flat(batch, "ids")[at:upto]
            start = batch * size + upto

    def bounds(self) -> np.ndarray:
        """Places of the documents' first tokens, and of the end."""
        size, found, real = self.rows * self.length, [], 0
        for b in range(self.file.num_record_batches):
            found.append(np.flatnonzero(self._flat(b, "first")) + b * size)
            real += int(self._flat(b, "mask").sum())
        return np.append(np.concatenate([*found, np.zeros(0, np.int64)]), real)


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    ready(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs_path, before in zip(*(batch.column(c).to_pylist() for c in ("path", "docs_path", "before")), strict=True):
                file = TokenFile(path, docs_path)
                bounds = file.bounds()
                sums = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    crc = 0
                    for ids in file.tokens(int(a), int(b)):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.record_batch({"doc_id": file.docs.combine_chunks(), "start": pa.array(bounds[:-1] + before), "n_tokens": pa.array(np.diff(bounds)),
                                       "ids_crc32": pa.array(sums, pa.int64())})

    # one row per file: its tokens before it are a running sum over the manifest
    placed = manifest.withColumn("before", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))
    return placed.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
