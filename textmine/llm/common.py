"""Helpers shared by the operators of this subpackage: texts as flat byte arrays.

Arrow hands a batch of texts to Python as one byte buffer and an array of
offsets. The helpers work on those two arrays, so no Python object is made per
text or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from textmine.sources.package import ship_package as ship_package

Batches = Iterator[pa.RecordBatch]

#: Bytes of text that are worked on at once; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to Python at once; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows that Spark's Parquet reader holds at once.
READER_ROWS = 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Byte tables: white space of the contracts, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most ``BATCH_BYTES``, or less if that is set.

    Spark counts 10,000 rows, so batches of texts would grow with the texts, in the
    memory of the executor and once more in that of its Python workers. Its Parquet reader
    counts 4,096, and keeps their texts in one array that doubles; it gets ``READER_ROWS``
    or less. Rows are the same.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READER_ROWS:
        spark.conf.set(name, READER_ROWS)


def give_back() -> None:
    """Return memory that this worker has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, with what it freed given back to the system at a task's end."""

    def tidy(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return tidy


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes, or with a single text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The powers 0 to n-1 of an odd number (or of its inverse) modulo 2**64."""
    name = "inverse" if inverse else "base"
    if len(_powers.get(name, ())) < n:
        size = max(n, PIECE_BYTES + 64)
        factors = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        factors[0] = 1
        _powers[name] = np.multiply.accumulate(factors)
    return _powers[name][:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` reads the hash of any run of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(len(data))
    np.cumsum(values, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end), equal wherever the run stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def word_spans(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every run of non-space bytes inside one text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # A run that crosses from one text into the next is cut there.
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
    if len(cut):
        start = np.sort(np.concatenate([start, cut]))
        end = np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of the words, A-Z lower-cased."""
    lowered = LOWER[data]
    start, end, owner = word_spans(lowered, offsets, space)
    return span_hash(rolling(lowered), start, end), start, end, owner


def shingle_hashes(
    words: np.ndarray, owner: np.ndarray, n_texts: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``k`` words; a shorter text is one run.

    A run of fewer words than ``k`` never equals one of another length, since
    the length is part of the hash.
    """
    counts = np.bincount(owner, minlength=n_texts)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    whole = len(words) - k + 1
    out, who = [], []
    if whole > 0:
        run = np.zeros(whole, np.uint64)
        for j in range(k):
            run = mix(run + words[j : j + whole] * np.uint64(2 * j + 3))
        keep = owner[:whole] == owner[k - 1 :]
        out.append(run[keep])
        who.append(owner[:whole][keep])
    for length in range(1, k):
        short = np.flatnonzero(counts == length)
        if len(short):
            run = np.full(len(short), length, np.uint64)
            for j in range(length):
                run = mix(run + words[firsts[short] + j] * np.uint64(2 * j + 3))
            out.append(run)
            who.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(who)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 0
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables of whole groups, with the groups' bounds.

    At most one group more than a batch (or ``rows``, if larger) is held.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = group_bounds(table, keys)
        if len(bounds) > 2:
            last = int(bounds[-2])
            yield table.slice(0, last), bounds[:-1]
            held = table.slice(last).to_batches()
            n = table.num_rows - last
        else:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_bounds(table, keys)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal integer keys begin, and the number of rows."""
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        values = table.column(key).to_numpy()
        change |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def list_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
