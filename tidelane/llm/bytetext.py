"""Vectorised byte-level views of text columns, shared by the corpus operators.

Every helper works on one bounded block of rows inside a Spark task: UTF-8 bytes of
all rows side by side, cut into words by a 256-entry separator table.  Only ASCII
bytes are ever separators or case-folded, so cutting bytes equals cutting code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handed on in blocks of about this many text bytes (a longer text is a block alone).
BLOCK_BYTES = 2 << 20

#: Bytes of a batch between the JVM and a Python worker, about; Spark's own limit holds back far more off the heap.
BATCH_BYTES = 4 << 20

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM_SEP = np.zeros(256, bool)
ALNUM_SEP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

def _low_powers(base: np.uint64) -> np.ndarray:
    steps = np.full(1 << 16, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_LOW, _LOW_INV = _low_powers(_BASE), _low_powers(_BASE_INV)


def _high_powers(low: np.ndarray, n: int) -> np.ndarray:
    """Powers of the base at every 65536th exponent up to n."""
    steps = np.repeat(low[-1:] * low[1], (n >> 16) + 1)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """``data`` holds the bytes of all rows; row i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def row(self, i: int) -> np.ndarray:
        return self.data[self.bounds[i] : self.bounds[i + 1]]


@dataclass
class Words:
    """Byte spans of words in row order; row i has words ``bounds[i]:bounds[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def utf8_block(column: pa.Array) -> Block:
    """Bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Block(raw[bounds[0] : bounds[-1]], bounds - bounds[0])


def small_batches(spark: SparkSession) -> None:
    """Let this session hand rows to Python in batches of ``BATCH_BYTES`` at most (a longer row is a batch alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of ``mapInArrow``, followed by :func:`give_back`."""

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def any_names(*added: str) -> Callable:
    """For an operator that appends ``added`` to the columns of its table: these columns may have any names, dots and all, and those in ``added`` are replaced."""

    def around(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(run)
        def call(docs: DataFrame, *args, text: str = "text", **more) -> DataFrame:
            keep = [c for c in docs.columns if c not in added]
            plain = [F.col("`" + c.replace("`", "``") + "`").alias(text if c == text else f"c{i}") for i, c in enumerate(keep)]
            return run(docs.select(*plain), *args, text=text, **more).toDF(*keep, *added)

        return call

    return around


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no block has many more text bytes than ``limit``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(block: Block, separators: np.ndarray) -> Words:
    """Maximal runs of non-separators; a run never crosses a row's end."""
    data, bounds = block.data, block.bounds
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(block) + 1, np.int64))
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, bounds))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (polynomial prefix sums, then a finaliser)."""
    n = len(data)
    power = (_high_powers(_LOW, n)[:, None] * _LOW).ravel()[:n] if n > len(_LOW) else _LOW[:n]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    h = prefix[end]
    h -= prefix[start]
    h *= _LOW_INV[start & 0xFFFF]
    if n >> 16:
        h *= _high_powers(_LOW_INV, n)[start >> 16]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (the caller drops those that cross rows)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
        out += h[j : j + n]
    return mix(out)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row number of every entry under ``bounds``."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
