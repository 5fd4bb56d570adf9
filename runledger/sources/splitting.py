"""Large CSV and JSON files read by many tasks.

Both formats only make sense from their start: a line end may lie inside quotes, a brace inside a string.
So a file is read twice or more.  The first time every split tells what it does to each state it may begin in
(inside quotes or not); these small summaries are chained in file order, one row for each split, and give every split the state it
really begins in.  Then each split cuts out its own records, and the few that reach over an end of a split are put together
from their parts.  Spark's text source deals out the splits, with a line end or a closing brace as separator.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.lineage import cut

#: Bytes of text that are returned to Spark at a time, about.
BATCH_BYTES = 4 << 20


def _chunks(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, block, size, value): the pieces of each file between separators; the rows of a split come in order."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def _splits(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, block, size, more...), its pieces) of each split in a task, one after another."""
    names = ["file", "block", "size", *more]

    def pieces():
        for batch in batches:
            yield from zip(zip(*[batch.column(n).to_pylist() for n in names]), batch.column("value").to_pylist())

    rows = pieces()
    ahead = next(rows, None)
    while ahead is not None:
        now = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0][:2] == now[:2]:
                value = ahead[1]
                ahead = next(rows, None)
                yield value

        left = own()
        yield now, left
        for _ in left:  # what the reader left over
            pass


def _put(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str)) + sum(len(v or "") for v in row[-1:] if isinstance(v, list) for v in v)
        if size > BATCH_BYTES:
            yield _put(out, schema)
            out, size = [], 0
    if out:
        yield _put(out, schema)


def _with_starts(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Pieces with what their split begins with.  Whatever way the join takes, the order within a split is kept."""
    numbered = chunks.withColumn("nth", F.monotonically_increasing_id())
    return numbered.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "nth").drop("nth")


def _chained(summaries: DataFrame, step: Callable[[dict, dict], dict], first: dict, ddl: str) -> DataFrame:
    """(file, block, state...): the state each split begins in, from the summaries of the splits before it in its file."""
    names = list(first)

    def chain(group: pa.Table) -> pa.Table:
        state, out = dict(first), []
        for row in sorted(group.to_pylist(), key=lambda r: r["block"]):
            out.append({"file": row["file"], "block": row["block"], **state})
            state = step(state, row)
        out.append({"file": out[0]["file"], "block": -1, **state})  # how the file ends
        return pa.table({n: [r[n] for r in out] for n in ("file", "block", *names)}, schema=pa.schema(
            [("file", pa.string()), ("block", pa.int64()), *[(n, _ARROW[kind]) for n, kind in (x.split() for x in ddl.split(", "))]]))

    return cut(summaries.groupBy("file").applyInArrow(chain, f"file string, block long, {ddl}"), "split-starts")


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


# --- CSV ---------------------------------------------------------------------------

def _quoted_after(line: str, quoted: bool) -> bool:
    """Whether a line ends inside a quoted field.  A quote only opens a field at its start; a doubled one inside is text."""
    if '"' not in line:
        return quoted
    at, n = 0, len(line)
    while True:
        if not quoted:
            if line.startswith('"', at):
                quoted, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
        at = line.find('"', at) + 1
        if not at:
            return True
        if line.startswith('"', at):
            at += 1
            continue
        quoted = False
        at = line.find(",", at) + 1
        if not at or at > n:
            return False


def _fields(record: str) -> list[str]:
    return next(csv.reader([record.removesuffix("\r")]), [])


_CSV_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("plain_ends", pa.bool_()), ("quoted_ends", pa.bool_()), ("plain_records", pa.int64()), ("quoted_records", pa.int64())])
_CSV_PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("record", pa.int64()), ("part", pa.string()), ("fields", pa.list_(pa.string()))])


def read_csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, fields): all records of CSV files, numbered from 0 in each; blank lines are records without fields.

    Commas, double quotes and line feeds (or carriage return and line feed) as usual; quotes are read as Python's csv module does.
    """
    chunks = _chunks(spark, path, "\n")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (file, block, _), lines in _splits(batches):
                state, records = [False, True], [0, 0]
                for line in lines:
                    state = [_quoted_after(line, s) for s in state]
                    records = [n + (not s) for n, s in zip(records, state)]
                yield file, block, *state, *records
        yield from _emit(rows(), _CSV_SUMMARY)

    def step(state: dict, row: dict) -> dict:
        kind = "quoted" if state["quoted"] else "plain"
        return {"quoted": row[f"{kind}_ends"], "records": state["records"] + row[f"{kind}_records"]}

    summaries = chunks.mapInArrow(summarise, "file string, block long, plain_ends boolean, quoted_ends boolean, plain_records long, quoted_records long")
    starts = _chained(summaries, step, {"quoted": False, "records": 0}, "quoted boolean, records long")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (file, block, _, quoted, number), lines in _splits(batches, "quoted", "records"):
                whole, held = not quoted, []
                for line in lines:
                    held.append(line)
                    quoted = _quoted_after(line, quoted)
                    if not quoted:
                        text = "\n".join(held)
                        yield (file, block, number, None, _fields(text)) if whole else (file, block, number, text, None)
                        whole, held, number = True, [], number + 1
                if held:
                    yield file, block, number, "\n".join(held), None
        yield from _emit(rows(), _CSV_PART)

    parts = cut(_with_starts(chunks, starts).mapInArrow(records, "file string, block long, record long, part string, fields array<string>"), "csv-records")
    whole = parts.where("part IS NULL").select("file", "record", "fields")
    open_ = parts.where("part IS NOT NULL").groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "\n").alias("text"))
    joined = open_.select("file", "record", F.udf(_fields, "array<string>", useArrow=True)("text").alias("fields"))
    return whole.unionByName(joined)


def read_csv(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """((file, row_index, columns as text), column names); the first record of each file names the columns.

    ``row_index`` counts the records of a file from 0.  A short row has nulls, surplus fields are left out, blank lines are no rows.
    """
    records = cut(read_csv_records(spark, path), "csv-fields")
    headers = records.where("record = 0").select("fields").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError("the CSV files have different headers")
    names = list(headers[0][0]) if headers else []
    rows = records.where("record > 0 AND size(fields) > 0")
    return rows.select("file", (F.col("record") - 1).alias("row_index"), *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)]), names


# --- JSON --------------------------------------------------------------------------

_MARK = re.compile(r'"|[\[\]{}]')
_TOKEN = re.compile(r'"|[\[\]{},:]')


def _string_end(text: str, at: int) -> int:
    """Place behind the quote that ends a string, or -1."""
    while True:
        quote = text.find('"', at)
        if quote < 0:
            return -1
        slashes = quote
        while slashes > at and text[slashes - 1] == "\\":
            slashes -= 1
        at = quote + 1
        if (quote - slashes) % 2 == 0:
            return at


def _depth_after(text: str, inside: bool) -> tuple[bool, int]:
    """(ends inside a string, change of depth) of a piece of JSON text."""
    at, depth = 0, 0
    while True:
        if inside:
            at = _string_end(text, at)
            if at < 0:
                return True, depth
            inside = False
        mark = _MARK.search(text, at)
        if not mark:
            return False, depth
        at = mark.end()
        if mark[0] == '"':
            inside = True
        else:
            depth += 1 if mark[0] in "[{" else -1


_JSON_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("first", pa.string()), ("plain_ends", pa.bool_()), ("inside_ends", pa.bool_()),
                           ("plain_depth", pa.int64()), ("inside_depth", pa.int64())])
_JSON_KEYS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("moved", pa.bool_()), ("key", pa.string()), ("entered", pa.bool_()), ("elements", pa.int64()), ("listing", pa.bool_()), ("key_open", pa.bool_()), ("starts_in_key", pa.bool_())])
_JSON_PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("key", pa.string()), ("nth", pa.int64()), ("whole", pa.bool_()), ("part", pa.string())])
_UNKNOWN = "\0?"  #: key of a split that begins inside a member


class _Reader:
    """Walks the text of a split from the state it begins in and hands out the parts of array elements.

    The document is a list, with elements at depth 1, or an object whose members may be lists, with elements at depth 2.
    A split begins behind a closing brace, so a list it begins in already has an element.
    """

    def __init__(self, kind: str, inside: bool, depth: int, key: str | None, elements: int, listing: bool = True):
        self.kind, self.inside, self.depth, self.key, self.elements = kind, inside, depth, key, elements
        self.level = 1 if kind == "list" else 2
        self.listing, self.entered = listing and depth >= self.level, False
        self.filled, self.key_text = self.listing, None  # the text so far of a key that is being read
        self.members: list[tuple[str | None, str]] = []
        self.told = depth > 0

    def _member(self, kind: str) -> None:
        if not self.told:
            self.members.append((self.key, kind))
            self.told = True

    def feed(self, text: str) -> Iterator[tuple[str | None, int, bool, str]]:
        """(key, number, ends, text) of the parts of elements in a piece."""
        at = begin = 0
        while True:
            if self.inside:
                end = _string_end(text, at)
                if self.key_text is not None:
                    self.key_text += text[at:len(text) if end < 0 else end]
                if end < 0:
                    break
                at, self.inside = end, False
                if self.key_text is not None:
                    self.key, self.key_text, self.told = json.loads('"' + self.key_text), None, False
            token = _TOKEN.search(text, at)
            if not token:
                break
            mark, at = token[0], token.end()
            if mark == '"':
                self.inside = True
                if self.kind == "object" and self.depth == 1 and self.key is None:
                    self.key_text = ""
            elif mark in "[{":
                if self.depth == self.level - 1:
                    self._member("list" if mark == "[" else "object")
                    self.listing, self.entered = mark == "[", True
                    self.elements, self.filled, begin = 0, False, at
                self.depth += 1
            elif mark in "]}":
                if self.depth == self.level and self.listing:
                    if self.filled or text[begin:at - 1].strip():
                        yield self.key, self.elements, True, text[begin:at - 1]
                    self.listing = False
                if self.depth == 1 and self.kind == "object" and self.key is not None:
                    self._member("value")
                self.depth -= 1
            elif mark == ",":
                if self.depth == self.level and self.listing:
                    yield self.key, self.elements, True, text[begin:at - 1]
                    self.elements, self.filled, begin = self.elements + 1, True, at
                elif self.depth == 1 and self.kind == "object":
                    if self.key is not None:
                        self._member("value")
                    self.key = None
        if self.listing and (self.inside or self.depth > self.level or text[begin:].strip()):
            self.filled = True
            yield self.key, self.elements, False, text[begin:]


def _walked(size: int, before: int, pieces: Iterator[str], reader: _Reader) -> Iterator[tuple[str | None, int, bool, str]]:
    for piece in pieces:
        before += len(piece.encode()) + 1
        yield from reader.feed(piece + "}" if before <= size else piece)


def _next_key(state: dict, row: dict) -> dict:
    if state["key_open"] and row["starts_in_key"]:
        raise ValueError("the name of a member with a brace in it lies across two splits; choose another spark.sql.files.maxPartitionBytes")
    key = row["key"] if row["moved"] else state["key"]
    if row["entered"]:
        return {"key": key, "elements": row["elements"], "listing": row["listing"], "key_open": row["key_open"]}
    return {"key": key, "elements": state["elements"] + row["elements"], "listing": state["listing"], "key_open": row["key_open"]}


def read_json_elements(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """((file, key, nth, text), (file, key, kind)) of JSON documents, one document a file.

    First the elements of the lists as JSON text: a document is a list (``key`` is null) or an object, whose members that are
    lists give their name as ``key``; ``nth`` counts the elements of a list from 0.  Then the members with their kind: list, object or value.
    Raises ``ValueError`` if a document is neither or does not end where its first bracket closes.
    """
    chunks = _chunks(spark, path, "}")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (file, block, size), pieces in _splits(batches):
                states, depths, length, first = [False, True], [0, 0], 0, ""
                for piece in pieces:
                    first = first or piece.lstrip("\ufeff \t\r\n")[:1]
                    length += len(piece.encode()) + 1
                    for k in (0, 1):
                        states[k], more = _depth_after(piece + "}", states[k])
                        depths[k] += more
                yield file, block, size, length, first, *states, *depths
        yield from _emit(rows(), _JSON_SUMMARY)

    def step(state: dict, row: dict) -> dict:
        kind, before = "inside" if state["inside"] else "plain", state["before"] + row["bytes"]
        return {"kind": state["kind"] or {"[": "list", "{": "object"}.get(row["first"], "neither"), "inside": row[f"{kind}_ends"],
                "depth": state["depth"] + row[f"{kind}_depth"], "before": before, "spare": row["size"] - before}

    summaries = chunks.mapInArrow(summarise, "file string, block long, size long, bytes long, first string, plain_ends boolean, inside_ends boolean, plain_depth long, inside_depth long")
    states = _chained(summaries, step, {"kind": None, "inside": False, "depth": 0, "before": 0, "spare": 0}, "kind string, inside boolean, depth long, before long, spare long")
    kinds = states.where("block = -1").select("file", "kind", "inside", (F.col("depth") + F.when(F.col("spare") < 0, 1).otherwise(0)).alias("depth"))
    # a file that does not end with a brace has one separator less than pieces
    if not kinds.where("inside OR depth <> 0 OR kind = 'neither'").isEmpty():
        raise ValueError("a JSON document is no list or object, is cut off or has surplus brackets")
    known = states.where("block >= 0").select("file", "block", "inside", "depth", "before").join(kinds.select("file", "kind"), "file")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (file, block, size, kind, inside, depth, before), pieces in _splits(batches, "kind", "inside", "depth", "before"):
                reader = _Reader(kind, inside, depth, _UNKNOWN if kind == "object" and depth else None, 0)
                for _ in _walked(size, before, pieces, reader):
                    pass
                yield file, block, kind == "object" and reader.key != _UNKNOWN, reader.key, reader.entered, reader.elements, reader.listing, reader.key_text is not None, inside and depth == 1
        yield from _emit(rows(), _JSON_KEYS)

    found = _with_starts(chunks, known).mapInArrow(keys, "file string, block long, moved boolean, key string, entered boolean, elements long, listing boolean, key_open boolean, starts_in_key boolean")
    begins = _chained(found, _next_key, {"key": None, "elements": 0, "listing": False, "key_open": False}, "key string, elements long, listing boolean, key_open boolean")
    ready = cut(known.join(begins.select("file", "block", "key", "elements", "listing"), ["file", "block"]), "json-starts")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (file, block, size, kind, inside, depth, before, key, elements, listing), pieces in _splits(batches, "kind", "inside", "depth", "before", "key", "elements", "listing"):
                reader = _Reader(kind, inside, depth, key, elements, listing)
                held, reaches_back = [], reader.listing
                for own, nth, ends, text in _walked(size, before, pieces, reader):
                    held.append(text)
                    if ends:
                        yield file, block, own, nth, not reaches_back, "".join(held)
                        held, reaches_back = [], False
                if held:
                    yield file, block, own, nth, False, "".join(held)
                for own, what in reader.members:
                    yield file, block, own, -1, True, what
        yield from _emit(rows(), _JSON_PART)

    cells = cut(_with_starts(chunks, ready).mapInArrow(parts, "file string, block long, key string, nth long, whole boolean, part string"), "json-parts")
    elements = cells.where("nth >= 0")
    joined = elements.where("NOT whole").groupBy("file", "key", "nth").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "").alias("text"))
    return elements.where("whole").select("file", "key", "nth", F.col("part").alias("text")).unionByName(joined), cells.where("nth < 0").select("file", "key", F.col("part").alias("kind"))
