"""What several operators share: tables, the shared folder, and vectorised word hashing over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.shared import Scratch, remove, shared_dir, written  # noqa: F401  (for the operators)

#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
STEP_BYTES = 1 << 18

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about STEP_BYTES: (first row, end row, bytes, offsets of each row's text); null texts are empty."""
    col = batch.column(column)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def separators(extra: bytes = b"") -> np.ndarray:
    """A table of the bytes between words: space, tab to carriage return, and extra."""
    seps = np.zeros(256, bool)
    seps[list(b"\x20\x09\x0a\x0b\x0c\x0d" + extra)] = True
    return seps


#: Lower case for A to Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 12)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which never cross the offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~seps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    at = np.arange(total) - np.repeat(first, lengths)
    longest = int(lengths.max())
    scale = _POWERS if longest <= len(_POWERS) else powers(longest)
    values = (data[at + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * scale[at]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def chained(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive words; one fewer for each further word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(seed + n))
    for k in range(n):
        out = mixed(out * _BASE + words[k : k + m])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; quicker than np.unique, which hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def doc_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.searchsorted(offsets, starts, "right") - 1


def crc_fold(column: str, n: int):
    """crc32 of the id as text, modulo n: the fixed folds of the trained operators."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % n
