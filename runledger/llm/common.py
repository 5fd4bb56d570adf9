"""What the operators share: table access, Arrow text buffers, word fingerprints.

Words are kept as 64-bit fingerprints computed on the UTF-8 bytes of whole Arrow
buffers.  Two different words agree with probability about 2**-64, and every use
compares several words in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that are worked on at a time; arrays derived from them are up to 8 times as large.
SLICE_BYTES = 2 << 20
#: Text bytes whose words are found at a time; this takes some 60 bytes of memory for each.
WORD_BYTES = (1 << 18) - 1


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package also where the session did not start in its folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), where


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of a single row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = end


_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_M = np.uint64(0x5851F42D4C957F2D)
_M_INV = np.uint64(pow(int(_M), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _M), ("down", _M_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, scale): the fingerprint of data[a:b] is mixed((sums[b] - sums[a]) * scale[a])."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums, down


#: Fixed by the contracts: words are runs of digits, ASCII letters (lower-cased) and all non-ASCII characters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each word, number of words of each text)."""
    start, rows = int(offsets[0]), len(offsets) - 1
    part, cuts = data[start:int(offsets[-1])], np.asarray(offsets) - start
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    prints, begins = [], []
    for a, b in _word_slices(part, cuts):
        inside = _IN_WORD[part[a:b]]
        edge = np.zeros(b - a + 1, bool)
        edge[cuts[np.searchsorted(cuts, a):np.searchsorted(cuts, b, side="right")] - a] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums, scale = running(_LOWER[part[a:b]])
        prints.append(mixed((sums[end] - sums[begin]) * scale[begin]))
        begins.append(begin + a)
    return np.concatenate(prints), np.diff(np.searchsorted(np.concatenate(begins), cuts))


def _word_slices(part: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``WORD_BYTES`` each that end with a text or beside a word, so that no word lies in two; a longer word lies in one range."""
    a = 0
    while a < len(part):
        b = reach = min(a + WORD_BYTES, len(part))
        if reach < len(part):
            b = int(cuts[np.searchsorted(cuts, reach, side="right") - 1])  # the last text that ends within reach
            for low in range(reach - 1024, a - 1024, -1024):
                gaps = np.flatnonzero(~_IN_WORD[part[max(low, a):min(low + 1024, reach)]])
                if len(gaps) or low <= b:
                    b = max(b, max(low, a) + int(gaps[-1]) + 1) if len(gaps) else b
                    break
            if b <= a:
                b = int(cuts[np.searchsorted(cuts, reach, side="right")])  # the end of this text, or the first gap before it
                for low in range(reach, b, WORD_BYTES):
                    gaps = np.flatnonzero(~_IN_WORD[part[low:min(low + WORD_BYTES, b)]])
                    if len(gaps):
                        b = low + int(gaps[0]) + 1
                        break
        yield a, b
        a = b


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index): for each i, lengths[i] consecutive indexes from starts[i]."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    before = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - before[owner] + np.asarray(starts)[owner]
