"""Exact duplicates found by counting quotient filters, then verified on bytes.

Every task puts the 64-bit fingerprints of its rows into counting quotient filters. A filter covers a range of
fingerprints (their highest bits); within it the next bits, the quotient, name a home slot, and the slot holds
the remaining bits, the remainder. Remainders of one quotient stand together in ascending order, in their home
slot or shifted to the right of it; one bit per quotient says that it occurs, one bit per slot that a run ends
there. So a filter gives back its fingerprints in order, exactly, and filters of one range merge without loss:
equal (quotient, remainder) pairs add their counters.

Fingerprints with a counter above one are only suspected copies: the texts behind them are grouped by their
bytes. A fingerprint that two different texts share costs a comparison and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.hot import hot_keys, join_hot
from tallyspark.session import ship, stored

#: Fingerprints that a task holds before it writes its filters.
HELD = 1 << 21
#: Rows of the table for one range of fingerprints, and the fewest ranges.
PER_RANGE, FEWEST = 1 << 18, 1 << 10
LOAD = 0.75


@dataclass
class CountingQuotientFilter:
    """Fingerprints of `bits` bits: `q` bits name the home slot, the others are stored there."""

    bits: int
    q: int
    occupied: np.ndarray  # per quotient: it occurs
    run_end: np.ndarray  # per slot: the last one of its quotient's run
    used: np.ndarray  # per slot
    remainder: np.ndarray  # per used slot
    many: np.ndarray  # per used slot: it has a counter
    counter: np.ndarray  # of those

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From ascending, different fingerprints and how often each occurs."""
        n = len(prints)
        q = min(bits, max(1, int(np.ceil(np.log2(max(n, 1) / LOAD)))))
        home = (prints >> np.uint64(bits - q)).astype(np.int64)
        order = np.arange(n)
        slot = np.maximum.accumulate(home - order) + order  # its home, or right behind the one before
        occupied, size = np.zeros(1 << q, bool), int(max(1 << q, slot[-1] + 1 if n else 0))
        occupied[home] = True
        run_end, used = np.zeros(size, bool), np.zeros(size, bool)
        used[slot] = True
        run_end[slot[np.append(home[1:] != home[:-1], True)[:n]]] = True
        rest = prints & np.uint64((1 << (bits - q)) - 1) if bits > q else np.zeros(n, np.uint64)
        return cls(bits, q, occupied, run_end, used, rest, counts > 1, counts[counts > 1])

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and their counts."""
        ends = self.run_end[self.used]
        run = np.cumsum(ends) - ends  # runs stand in the order of their quotients
        home = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        counts = np.ones(len(home), np.int64)
        counts[self.many] = self.counter
        high = home << np.uint64(self.bits - self.q) if self.bits > self.q else home
        return high | self.remainder, counts

    @property
    def width(self) -> int:
        return -(-(self.bits - self.q) // 8)

    def to_bytes(self) -> bytes:
        stored_rest = self.remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        head = np.array([self.bits, self.q, len(self.used), len(self.remainder), len(self.counter)], "<i8")
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.used, self.many)),
                         stored_rest.tobytes(), self.counter.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, size, n, counted = (int(x) for x in np.frombuffer(raw, "<i8", 5))
        at, flags = 40, []
        for length in (1 << q, size, size, n):
            flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-length // 8), at), count=length).astype(bool))
            at += -(-length // 8)
        width = -(-(bits - q) // 8)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        counter = np.frombuffer(raw, "<i8", counted, at + n * width).astype(np.int64)
        return cls(bits, q, *flags[:3], rest.view("<u8").ravel().astype(np.uint64), flags[3], counter)


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending, different fingerprints with the sums of their counts."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """One filter with the fingerprints of all, equal ones with the sum of their counts."""
    prints, counts = (np.concatenate(x) for x in zip(*(p.entries() for p in parts)))
    return CountingQuotientFilter.of(*_summed(prints, counts), parts[0].bits)


def _sliced(prints: np.ndarray, counts: np.ndarray, range_bits: int) -> pa.RecordBatch:
    """A row (range, filter) for every range of fingerprints that occurs."""
    prints, counts = _summed(prints, counts)
    bits = 64 - range_bits
    part = (prints >> np.uint64(bits)).astype(np.int64)
    low = prints & np.uint64((1 << bits) - 1)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    raw = [CountingQuotientFilter.of(low[i:j], counts[i:j], bits).to_bytes() for i, j in zip(at, [*at[1:], len(part)])]
    return pa.RecordBatch.from_pydict({"range": pa.array(part[at]), "filter": pa.array(raw, pa.binary())})


def filters(prints: DataFrame, range_bits: int) -> DataFrame:
    """(range, filter): the counting quotient filters of every task's fingerprints (`print`, seen `times`)."""
    def build(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("print", "times")])
            size += batch.num_rows
            if size >= HELD:
                yield _sliced(*written(held), range_bits)
                held, size = [], 0
        if size:
            yield _sliced(*written(held), range_bits)

    def written(held):
        codes, times = (np.concatenate(x) for x in zip(*held))
        return codes.view(np.uint64), times

    ship(prints.sparkSession)
    return prints.select("print", "times").mapInArrow(build, "range bigint, filter binary")


def suspected(parts: DataFrame, range_bits: int) -> DataFrame:
    """(print, n) of the fingerprints that the merged filters count more than once.

    A merge holds one range: about PER_RANGE rows of the table at most, for fingerprints are spread evenly and
    copies within a task are one entry.
    """
    def merge(key, table):
        whole = merged([CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()])
        prints, counts = whole.entries()
        high = np.uint64(key[0].as_py()) << np.uint64(whole.bits)
        prints, counts = (prints | high)[counts > 1], counts[counts > 1]
        return pa.table({"print": pa.array(prints.view(np.int64)), "n": pa.array(counts)})

    return parts.groupBy("range").applyInArrow(merge, "print bigint, n bigint")


def copies(docs: DataFrame, print_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept and text_sha256.

    Equal texts form a group; a null text counts as empty, and nothing else is changed. The row with the largest
    doc_id stays; a null id is smaller than any other, and of rows that repeat both id and text one stays. Other
    columns are not read. `print_bits`: how many bits of a fingerprint count (fewer make collisions, for tests).
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    code = F.xxhash64(text)
    if print_bits < 64:
        code = F.shiftleft(F.shiftrightunsigned(code, 64 - print_bits), 64 - print_bits)
    texts = docs.select("doc_id", code.alias("print"), text.alias("text"))
    # Rows with the same id and text are one row with a number, so that exactly one of them stays.
    rows = stored(texts.select("doc_id", "print", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
                  .groupBy("doc_id", "print", "text_sha256").agg(F.count(F.lit(1)).alias("times")), "dedup-rows")
    total = rows.agg(F.sum("times")).first()[0] or 0
    range_bits = max(FEWEST - 1, total // PER_RANGE).bit_length()
    found = stored(suspected(filters(rows, range_bits), range_bits), "dedup-prints")
    hot = stored(hot_keys(found, ["print"], "n", total), "dedup-hot")
    # The bytes decide: only suspected texts are grouped by them.
    met = join_hot(texts, found.select("print"), ["print"], hot)
    groups = stored(met.groupBy("print", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                    .select("print", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"),
                    "dedup-groups")
    keys = ["print", "text_sha256"]
    whole = join_hot(rows, groups, keys, stored(hot_keys(groups, keys, "group_size", total), "dedup-hot"), "left")
    alone = F.col("group_size").isNull()
    chosen = whole.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256", "times")
    # Numbers of equal rows in two steps of at most a million, so that no long array is built.
    step = 1_000_000
    each = chosen.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / step))))
    each = each.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(step), F.col("times") - F.col("lot") * step))))
    first = (F.col("lot") == 0) & (F.col("nth") == 1)
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")
