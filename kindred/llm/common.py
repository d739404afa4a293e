"""What the training-data operators share: durable cuts of the lineage, and a numpy text kernel over Arrow buffers.

The kernel works on the bytes of a whole slice of documents at once: it finds the tokens with a 256-entry class table
and gives each token a 64-bit polynomial hash from one cumulative sum, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import durable, shared_folder, small

__all__ = ["Text", "column", "durable", "frugal", "grams", "lean", "mix", "power", "read", "release", "shared_folder", "shuffle_partitions", "slices", "small"]

SLICE_BYTES = 1 << 18
#: Spark bounds what it sends Python at a time by rows and bytes; where the bytes are left at its default, this is taken.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
#: The longest table of powers that a worker keeps.
KEPT_POWERS = 1 << 19

#: A token byte is an ASCII letter or digit, or any byte of a character beyond ASCII.
WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: A token byte is anything but ASCII white space.
NONSPACE = np.array([c not in b" \t\n\r\f\v" for c in range(256)])

_rng = np.random.default_rng(20240229)
_MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX_LOWER = _MIX.copy()
_MIX_LOWER[ord("A") : ord("Z") + 1] = _MIX[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def frugal(df: DataFrame) -> DataFrame:
    """df; where its session has no bound of its own, Python gets no more than some MB at a time, so that a batch of long documents is no more than one of short ones."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == BATCH_DEFAULT:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give back to the system what Arrow and the C library hold without need. Workers live on after a task, and their memory counts against the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow or mapInPandas that gives memory back when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= KEPT_POWERS:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Text:
    """Tokens of a slice of documents. doc[i]:doc[i + 1] are the tokens of document i; start, end are byte places in buf."""

    __slots__ = ("_sum", "buf", "doc", "end", "lower", "off", "start")

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray, lower: bool):
        self.buf, self.off, self.lower, self._sum = buf, off, lower, None
        n = len(buf)
        if n:
            is_in = kind[buf]
            before = np.empty(n, bool)
            before[0], before[1:] = False, is_in[:-1]
            before[off[:-1][off[:-1] < n]] = False
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, is_in[1:]
            after[off[1:][off[1:] > 0] - 1] = False
            self.start, self.end = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.start, off)

    def count(self) -> np.ndarray:
        return np.diff(self.doc)

    def owner(self) -> np.ndarray:
        """The document of each token."""
        return np.repeat(np.arange(len(self.off) - 1), self.count())

    def hash(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each token, or of the bytes start:end."""
        if self._sum is None:
            v = (_MIX_LOWER if self.lower else _MIX)[self.buf] * power(_BASE, len(self.buf) + 1)[: len(self.buf)]
            self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        start, end = (self.start, self.end) if start is None else (start, end)
        return mix((self._sum[end] - self._sum[start]) * power(_INVERSE, len(self.buf) + 1)[start])

    def bytes_where(self, table: np.ndarray) -> np.ndarray:
        """Running count of the bytes in a class: c[e] - c[s] counts those of s:e."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(table[self.buf], dtype=np.int64)])


def slices(column: pa.Array, kind: np.ndarray = WORD, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """(first row, row after the last, tokens) for slices of about size bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, rows + 1, column.offset * 8) if rows else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to, Text(buf[off[at] : off[to]], off[at : to + 1] - off[at], kind, lower)
        at = to


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and where each document's begin. A document of fewer words than n, but some, has one gram of all its words."""
    words = np.diff(doc)
    many = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(many)), many)
    first = doc[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    last = doc[1:][owner]
    out = np.zeros(at[-1], np.uint64)
    for k in range(n):
        there = first + k < last
        w = h[np.minimum(first + k, len(h) - 1)] if len(h) else np.zeros(0, np.uint64)
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(there, w, np.uint64(1))
    return mix(out), at
