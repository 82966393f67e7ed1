"""Word, line and character arithmetic on blocks of texts held as one byte buffer.

The functions here run inside tasks, on the Arrow batches that Spark hands over. A block holds whole texts
of a few megabytes together, so the arrays stay small however many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.session import ship

BLOCK_BYTES = 2 << 20
U64 = np.uint64

# A word is a run of anything but these: blank, tab, line feed, vertical tab, form feed, carriage return.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
AS_IS = np.random.default_rng(20_231).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
LOWERED = AS_IS.copy()
LOWERED[65:91] = AS_IS[97:123]
STEP = U64(0x9E3779B97F4A7C15)
BACK = U64(pow(int(STEP), -1, 1 << 64))
UNMIX = [U64(pow(x, -1, 1 << 64)) for x in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
PIECE = 1 << 15  # bytes whose running sums are taken at a time
POWERS, BACKS = (np.cumprod(np.concatenate([[U64(1)], np.full(2 * PIECE, x)])) for x in (STEP, BACK))


def map_batches(df: DataFrame, function: Callable, schema: str, size: int = 16 << 20) -> DataFrame:
    """`mapInArrow` with batches of bounded size, and with this package at hand on every worker."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df.mapInArrow(function, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The numbers that `mix` spread."""
    h = h ^ (h >> U64(31)) ^ (h >> U64(62))
    h *= UNMIX[0]
    h ^= (h >> U64(27)) ^ (h >> U64(54))
    h *= UNMIX[1]
    h ^= (h >> U64(30)) ^ (h >> U64(60))
    return h


class Block:
    """Whole texts lo..hi of a column: their bytes, and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int):
        self.data, self.offsets, self.lo, self.n = data, offsets, lo, len(offsets) - 1

    def words(self, table: np.ndarray = LOWERED) -> Words:
        return Words(self, table)

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions lie in each text."""
        return np.diff(np.searchsorted(positions, self.offsets))

    def char_counts(self) -> np.ndarray:
        return self.counts(np.flatnonzero((self.data & 0xC0) != 0x80))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each line (the text between line feeds), and the first line of each text."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], feeds]), kind="stable")
        first = np.concatenate([[0], np.cumsum(self.counts(feeds) + 1)])
        return starts, ends, first


class Words:
    """The words of a block: 64-bit hash, byte range, and the first word of each text."""

    def __init__(self, block: Block, table: np.ndarray):
        data, offsets = block.data, block.offsets
        inside = ~IS_BLANK.take(data)
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            starts[first] = inside[first]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[last] = inside[last]
        self.block, self.table = block, table
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    @cached_property
    def hash(self) -> np.ndarray:
        return word_hashes(self.block.data, self.start, self.end, self.table)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        """The text each word stands in."""
        return np.repeat(np.arange(self.block.n), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of `size` words that stay inside one text, and a hash of each run."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = np.ones(n, bool)
        for back in range(1, size):
            cut = self.bounds[1:-1] - back
            ok[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), np.uint64)
        for i in range(size):
            h = h * STEP + self.hash[at + i]
        return at, mix(h)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = AS_IS) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint byte ranges; 0 for an empty one."""
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return out
    s, lengths = starts[full], (ends - starts)[full]
    begin = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begin, lengths)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(int(lengths.max()), STEP)]))
    values = table[data[within + np.repeat(s, lengths)]] * power[within]
    out[full] = mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64))
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hashes of `span_hashes` of ascending, not empty ranges that cover most of the data: differences of running sums,
    piece by piece, divided by the power of the place where a range begins."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + 2 * PIECE, "right")))
        if ends[lo] > at + 2 * PIECE:
            out[lo:hi] = span_hashes(data, starts[lo:hi], ends[lo:hi], table)
        else:
            first, last = starts[lo:hi] - at, ends[lo:hi] - at
            total = np.zeros(int(last[-1]) + 1, np.uint64)
            np.cumsum(table.take(data[at : at + last[-1]]) * POWERS[: last[-1]], out=total[1:])
            out[lo:hi] = mix((total[last] - total[first]) * BACKS[first] + (last - first).astype(np.uint64))
        lo = hi
    return out


def sorting(key: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes: their high bits and their places are sorted as one number."""
    low = U64((1 << max(1, len(key)).bit_length()) - 1)
    at = key & ~low
    at |= np.arange(len(key), dtype=np.uint64)
    at.sort()
    at &= low
    at = at.view(np.int64)
    found = key[at]
    return at[np.argsort(found, kind="stable")] if (found[1:] < found[:-1]).any() else at


def firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where a row of sorted columns differs from the one before."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts; a null text is empty. A text longer than the limit makes a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds; 0 for an empty range."""
    out = np.zeros(len(bounds) - 1)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][full])
    return out


def repeats_within(key: np.ndarray, later_only: bool) -> np.ndarray:
    """Marks keys that occur more than once, or only their second and later occurrences."""
    mark = np.zeros(len(key), bool)
    if len(key) < 2:
        return mark
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    mark[order[1:][same]] = True
    if not later_only:
        mark[order[:-1][same]] = True
    return mark
