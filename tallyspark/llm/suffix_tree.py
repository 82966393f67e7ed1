"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words of a text, A-Z as a-z, and one end, which also stands before a text. A context is the last one to
`depth` tokens. It becomes a state of the tree if what follows it differs enough from what follows its longest suffix
(a divergence test). A state's next-token probabilities are absolutely discounted counts, and the mass left over goes
to the suffix; the root is the smoothed word frequency. A token is scored in the longest suffix state of what stands
before it.

Least counts are absolute: a next token needs `least` occurrences after a context, whatever the corpus, and every
context with such an entry is tested. So the tree grows with the corpus; it lives in tables, and nothing of it is
broadcast or collected. Its logarithms are kept as one addend a run of tokens: a run that is a context adds the share
left to its suffix, a run that is an entry adds what it gains over that path. The score of a text is then the sum over
all runs of one to depth + 1 tokens in it, each looked up once.

Runs are known by 64-bit hashes. They travel in packs: a task counts `HELD` tokens, sorts the different runs and cuts
them by ranges of the hash (`ranges`), one row a range. There is a range for every `RANGE` training tokens, so what a
task holds of one is bounded. A run comes once a pack at counting and once a text at scoring, so no frequent run makes
a hot range. Texts are read `passes` times, each for another part of the hashes, to bound the disk that shuffles take.
Training meets runs with their suffixes and contexts in the same packs, dealt by the hash of what they are met with.
The addends of a tree are dealt to their ranges once, when it is trained, and kept in packs of up to `DEALT` addends.
Between Spark and Python packs go a few at a time (`SENT` bytes), since both sides hold a batch whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import blocks as texts_of
from tallyspark.llm.blocks import STEP, U64, Block, blocks, firsts, mix, sorting, unmix
from tallyspark.session import stored

END = np.uint64(0x51F0E3A9C7D2B485)
DISCOUNT = 0.75
HELD = 2_000_000  # tokens that a task counts at a time
RANGE = 3_000_000  # training tokens for each range of hashes
CELL = 40  # ranges begin where the bits above this one change
CHUNK = 4_096  # texts whose sums come back in one row of packs
DEALT = 1 << 16  # addends in a pack at most
SENT = 4 << 20  # bytes of a batch between Spark and Python, or a row more
PAGES = {"parquet.page.size.row.check.min": "1"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Lookup:
    """Places of hashes in a sorted array, or -1: one probe of a table, a search only for crowded slots. Slots are told
    by bits that neither ranges nor passes look at."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        slot = self.slots(self.keys)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        self.crowded = np.bincount(slot, minlength=1 << self.bits) > 1

    def slots(self, x: np.ndarray) -> np.ndarray:
        return (x >> U64(16) & U64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(x):
            return np.full(len(x), -1, np.int64)
        slot = self.slots(x)
        at = self.table[slot].astype(np.int64)
        at[(at >= 0) & (self.keys[at] != x)] = -1
        again = np.flatnonzero((at < 0) & self.crowded[slot])
        if len(again):
            near = np.minimum(np.searchsorted(self.keys, x[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[near] == x[again], near, -1)
        return at


@dataclass
class Tree:
    """`addends`: packs of (key, n, weight), several a run allowed, in rows of one part, their range; n is the count of a word, 0 for longer runs."""

    addends: DataFrame
    tokens: int
    distinct: int
    depth: int

    @property
    def ranges(self) -> int:
        return ranges(self.tokens)

    def root(self, count):
        """Smoothed frequency of a word with the given count; of an array or a column as well."""
        return (count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))


def ranges(tokens: int) -> int:
    return tokens // RANGE + 1


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs inside go when a job ends: their results are written tables."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more: what was made of them is written too."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def token_stream(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts of a block, each text closed by END, and the bounds by text."""
    words = block.words()
    return np.insert(words.hash, words.bounds[1:], END), words.bounds + np.arange(block.n + 1)


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of a run from those of its first and its last tokens, each one token shorter."""
    return mix(prefix * STEP + suffix)


def last(key: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The suffix of a run, from its key and its prefix."""
    return unmix(key) - prefix * STEP


def token_runs(block: Block, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of 1 to `order` tokens: text, prefix, suffix and key of one that ends at each token, and which are real.
    The end before a text counts as its first token; runs do not reach further back."""
    key, bounds = token_stream(block)
    text = np.repeat(np.arange(block.n), np.diff(bounds))
    real = np.ones(len(key), bool)
    yield text, key, key, key, real
    for m in range(2, order + 1):
        prefix = np.concatenate([[END], key[:-1]]) if m == 2 else np.concatenate([key[:1], key[:-1]])
        suffix, key = key, joined(prefix, key)
        if m > 2:
            real = real.copy()
            early = bounds[:-1] + m - 3
            real[early[early < bounds[1:]]] = False
        yield text, prefix, suffix, key, real


def pack(values: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest ones: sorted numbers share their highest, which then compress."""
    rows = values.view(np.uint8).reshape(len(values), values.itemsize)
    out = np.empty(rows.shape[::-1], np.uint8)
    for i in range(values.itemsize):  # byte by byte is several times as fast as a transposed copy
        out[i] = rows[:, i]
    return out.tobytes()


def unpack(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    rows = np.frombuffer(packed, np.uint8).reshape(size, -1)
    out = np.empty(rows.shape[::-1], np.uint8)
    for i in range(size):
        out[:, i] = rows[i]
    return out.view(kind).ravel()


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the ranges in sorted keys."""
    first = np.array([-((-r << 64 - CELL) // parts) << CELL for r in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


def in_pass(keys: np.ndarray, turn: int, passes: int) -> np.ndarray:
    """Keys of one pass, by bits that the ranges do not look at."""
    if passes == 1:
        return np.ones(len(keys), bool)
    first, after = (-(-(t << 16) // passes) for t in (turn, turn + 1))
    return keys.astype(np.uint16) - np.uint16(first) < np.uint16(after - first)


def sliced(part: int, columns: dict[str, np.ndarray], lo: int, hi: int, most: int) -> Iterator[dict]:
    """Rows of packs of one range, one for every `most` rows from `lo` to `hi`."""
    for at in range(lo, hi, most):
        yield {"part": part, **{c: pack(v[at : min(at + most, hi)]) for c, v in columns.items()}}


def ranged(columns: dict[str, np.ndarray], parts: int, by: str = "key") -> Iterator[dict]:
    """A row of packs for each range that holds some of the rows, which are sorted by `by`; one for every HELD rows of it."""
    bounds = cuts(columns[by], parts)
    for r in np.flatnonzero(np.diff(bounds)):
        yield from sliced(int(r), columns, bounds[r], bounds[r + 1], HELD)


def rows_of(packs: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about SENT bytes; packs are made as they go."""
    held, size = [], 0
    for row in packs:
        held.append({c: row[c] for c in schema.names})
        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size >= SENT or len(held) == 256:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def emptied(parts: list[np.ndarray]) -> np.ndarray:
    """One array of the parts, which are let go."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return texts_of.map_batches(df, function, schema, SENT)


def parted(batches) -> Iterator[tuple[int, Iterator[dict]]]:
    """The rows of each range as they come, from batches sorted by it."""
    return groupby((row for batch in batches for row in batch.to_pylist()), itemgetter("part"))


def joint(rows: Iterable[dict], kinds: dict[str, type]) -> list[np.ndarray]:
    """The columns of packs, one array each."""
    rows = list(rows)
    return [np.concatenate([unpack(row[c], kind) for row in rows] or [np.zeros(0, kind)]) for c, kind in kinds.items()]


def table_of(rows: list[dict], column: str) -> tuple[Lookup, np.ndarray]:
    """The different keys of packs, and a column in their order."""
    key, values = joint(rows, {c: OFFERS[c] for c in ("key", column)})
    at = sorting(key)
    return Lookup(key[at]), values[at]


def gathered(found: Iterable[dict[str, np.ndarray]], by: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of HELD rows or a few more at a time, sorted by one of them."""
    held, size = {}, 0

    def together():
        first = emptied(held[by])
        at = sorting(first)
        return {by: first[at], **{c: emptied(v)[at] for c, v in held.items() if c != by}}

    for columns in found:
        for c, v in columns.items():
            held.setdefault(c, []).append(v)
        size += len(columns[by])
        if size >= HELD:
            yield together()
            size = 0
    if size:
        yield together()


def merged(packed: DataFrame, *order: str) -> DataFrame:
    return packed.repartition(order[0]).sortWithinPartitions(*order)


COUNTED = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("prefix", pa.binary()), ("n", pa.binary())])
PACKED = pa.schema([("part", pa.int32()), ("prefix", pa.binary()), ("suffix", pa.binary()), ("n", pa.binary())])


def counted(texts: DataFrame, order: int, least: int, parts: int, turn: int, passes: int) -> DataFrame:
    """The runs of `order` tokens that occur `least` times or more: key and n of words, longer ones as `PACKED` by their
    suffix. A run travels as its key, by which it is sorted, and its prefix; the suffix follows from both."""
    def count(batches):
        keys, prefixes, size = [], [], 0

        def packs():
            key, prefix = emptied(keys), emptied(prefixes)
            at = sorting(key)
            key = key[at]
            first = firsts(key)
            n = np.diff(first, append=len(key)).astype(np.uint32)
            prefix = prefix[at[first]] if order > 1 else prefix
            yield from rows_of(ranged({"key": key[first], "prefix": prefix, "n": n}, parts), COUNTED)

        for batch in batches:
            for block in blocks(batch.column("text")):
                *_, (_, prefix, _, key, real) = token_runs(block, order)
                mine = real & in_pass(key, turn, passes)
                keys.append(key[mine])
                prefixes.append(prefix[mine] if order > 1 else prefix[:0])
                size += len(keys[-1])
                if size >= HELD:
                    yield from packs()
                    size = 0
        if size:
            yield from packs()

    def often(batches):
        for _, rows in parted(batches):
            key, prefix, n = joint(rows, {"key": np.uint64, "prefix": np.uint64, "n": np.uint32})
            at = sorting(key)
            key = key[at]
            first = firsts(key)
            total = np.add.reduceat(n[at], first, dtype=np.uint64)
            kept = total >= least
            first = first[kept]
            yield key[first], prefix[at[first]] if order > 1 else prefix, total[kept]

    def words(batches):
        for key, _, n in often(batches):
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "n": n.view(np.int64)})

    def runs(batches):
        found = ({"prefix": prefix, "suffix": last(key, prefix), "n": n} for key, prefix, n in often(batches))
        for columns in gathered(found, "suffix"):
            yield from rows_of(ranged(columns, parts, by="suffix"), PACKED)

    packed = merged(map_batches(texts.select("text"), count, "part int, key binary, prefix binary, n binary"), "part")
    if order == 1:
        return map_batches(packed, words, "key bigint, n bigint")
    return map_batches(packed, runs, "part int, prefix binary, suffix binary, n binary")


def count_runs(texts: DataFrame, order: int, least: int, parts: int, passes: int) -> DataFrame:
    done = [stored(counted(texts, order, least, parts, turn, passes), "tree-runs", PAGES) for turn in range(passes)]
    return reduce(DataFrame.unionAll, done)


def train(texts: DataFrame, depth: int = 2, least: int = 2, least_gain: float = 6.0, divergence: float = 0.01,
          passes: int = 3) -> Tree:
    """The tree learned from every text given. A context is a state if its entries gain `least_gain` nats over its
    suffix, and `divergence` nats per occurrence. Without texts the tree is a root that knows no word."""
    spark = texts.sparkSession
    with lean(spark):
        # The number of tokens fixes the ranges; words alone are few, so they are counted in ranges by bytes of text.
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        words = stored(counted(texts, 1, 1, ranges(size // 4), 0, 1).select("key", "n"), "tree-words")
        tokens, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
        tree = Tree(words, tokens or 0, distinct, depth)
        level = dealt(offered(words.select("key", "n", F.ln(tree.root(F.col("n"))).alias("weight")), tree.ranges))
        addends = [level]
        forget(words)
        for order in range(2, depth + 2):
            runs = count_runs(texts, order, least, tree.ranges, passes)
            halves = with_suffix(runs, level, tree.ranges)
            found = stored(entries(halves, level, tree.ranges, least_gain, divergence, order <= depth), "tree-entries", PAGES)
            forget(runs)
            if order > 2:
                forget(level)
            level = found
            addends.append(dealt(found.select("part", "key", "who", F.col("gain").alias("value")), words=False))
        forget(level)
        tree.addends = reduce(DataFrame.unionAll, addends)
    return tree


HALVES = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("prefix", pa.binary()), ("key", pa.binary()),
                    ("n", pa.binary()), ("value", pa.binary())])
HALF = {"prefix": np.uint64, "key": np.uint64, "n": np.uint64, "value": np.float64}


def with_suffix(runs: DataFrame, level: DataFrame, parts: int) -> DataFrame:
    """Runs by the ranges of their prefix, with `value`, the log probability after the context's suffix (kind 2). `level`
    has key, who (the count) and value (that logarithm) of runs one token shorter. Before them go the sums of each prefix
    (kind 1): as `key` its entries, as `n` their count, as `value` their nats but for the count of the context. So the
    entries of a frequent context need not be held to judge it."""
    def meet(batches):
        def found():
            for _, rows in parted(batches):
                shorter, lookup = [], None
                for row in rows:
                    if row["kind"] == 0:
                        shorter.append(row)
                        continue
                    if lookup is None:
                        lookup, low = table_of(shorter, "value")
                    prefix, suffix, n = joint([row], {"prefix": np.uint64, "suffix": np.uint64, "n": np.uint64})
                    at = lookup.find(suffix)
                    hit = at >= 0
                    yield {"prefix": prefix[hit], "key": joined(prefix, suffix)[hit], "n": n[hit], "value": low[at[hit]]}

        for columns in gathered(found(), "prefix"):
            first, n = firsts(columns["prefix"]), columns["n"]
            sums = {"prefix": columns["prefix"][first], "key": np.diff(first, append=len(n)).astype(np.uint64)}
            if len(n):
                nats = n * (np.log(n) - columns["value"])
                sums |= {"n": np.add.reduceat(n, first), "value": np.add.reduceat(nats, first)}
                for kind, rows in ((1, sums), (2, columns)):
                    yield from rows_of(({**row, "kind": kind} for row in ranged(rows, parts, by="prefix")), HALVES)

    none = F.lit(None).cast("binary")
    shorter = level.where("value is not null").select(
        "part", F.lit(0).alias("kind"), "key", none.alias("prefix"), none.alias("suffix"), none.alias("n"), "value")
    longer = runs.select("part", F.lit(1).alias("kind"), none.alias("key"), "prefix", "suffix", "n", none.alias("value"))
    return map_batches(merged(shorter.unionAll(longer), "part", "kind"), meet,
                       "part int, kind int, prefix binary, key binary, n binary, value binary")


LEVEL = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("who", pa.binary()), ("value", pa.binary()), ("gain", pa.binary())])


def entries(halves: DataFrame, level: DataFrame, parts: int, least_gain: float, divergence: float, inner: bool) -> DataFrame:
    """Packs of the next level: key, who (the count), value (the log probability along the longest suffix state) and gain
    (what an entry of a state adds to the suffix path, not a number for others); after the last level only entries of
    states. With them packs of the states: as gain the logarithm of the share left to the suffix; count and value null."""
    def states(shorter, sums):
        contexts, seen_in_all = table_of(shorter, "who")
        prefix, entries, seen, gained = joint(sums, HALF)
        at = sorting(prefix)
        prefix = prefix[at]
        first = firsts(prefix)
        entries, seen, gained = (np.add.reduceat(v[at], first) for v in (entries, seen, gained))
        prefix, at = prefix[first], contexts.find(prefix[first])
        total = seen_in_all[at]
        nats = gained - seen * np.log(total)
        kept = (at >= 0) & (nats >= least_gain) & (nats >= divergence * total)
        left = np.maximum(1 - (seen - DISCOUNT * entries) / total, 1e-9)
        return prefix[kept], total[kept], left[kept]

    def judge(batches):
        left = []

        def found():
            for part, rows in parted(batches):
                shorter, sums, lookup = [], [], None
                for row in rows:
                    if row["kind"] < 2:
                        (sums if row["kind"] else shorter).append(row)
                        continue
                    if lookup is None:
                        prefix, total, backoff = states(shorter, sums)
                        shorter, sums, lookup = [], [], Lookup(prefix)
                        left.append({"part": part, "key": pack(prefix), "who": None, "value": None, "gain": pack(np.log(backoff))})
                    prefix, key, n, low = joint([row], HALF)
                    at = lookup.find(prefix)
                    hit = at >= 0
                    if not inner:
                        key, n, low, at, hit = key[hit], n[hit], low[hit], at[hit], hit[hit]
                    at = at[hit]
                    own = np.log((n[hit] - DISCOUNT) / total[at] + backoff[at] * np.exp(low[hit]))
                    gain = np.full(len(key), np.nan)
                    gain[hit] = own - np.log(backoff[at]) - low[hit]
                    value = low.copy()
                    value[hit] = own
                    yield {"key": key, "who": n, "value": value, "gain": gain}

        for columns in gathered(found(), "key"):
            yield from rows_of(ranged(columns, parts), LEVEL)
            yield from rows_of(left, LEVEL)
            left.clear()
        yield from rows_of(left, LEVEL)

    none = F.lit(None).cast("binary")
    contexts = level.where("who is not null").select(
        "part", F.lit(0).alias("kind"), none.alias("prefix"), "key", "who", none.alias("n"), none.alias("value"))
    both = contexts.unionAll(halves.select("part", "kind", "prefix", "key", none.alias("who"), "n", "value"))
    return map_batches(merged(both, "part", "kind"), judge, "part int, key binary, who binary, value binary, gain binary")


OFFERED = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("who", pa.binary()), ("value", pa.binary())])
OFFERS = {"key": np.uint64, "who": np.uint64, "value": np.float64}


def offered(words: DataFrame, parts: int) -> DataFrame:
    """Packs (key, who, value) of rows (key, n, weight)."""
    def offer(batches):
        found = ({"key": batch.column("key").to_numpy().view(np.uint64), "who": batch.column("n").to_numpy().view(np.uint64),
                  "value": batch.column("weight").to_numpy()} for batch in batches)
        for columns in gathered(found, "key"):
            yield from rows_of(ranged(columns, parts), OFFERED)

    return map_batches(words, offer, "part int, key binary, who binary, value binary")


def dealt(packed: DataFrame, words: bool = True) -> DataFrame:
    """Addends, each range whole in packs of up to DEALT, so packs grow as their number does; only words keep their count.
    Pages are closed by their size from the first pack on; else a hundred packs would be one page, held whole by its reader."""
    def deal(batches):
        def packs():
            for part, rows in parted(batches):
                rows = list(rows)
                key, value = joint(rows, {"key": np.uint64, "value": np.float64})
                who = joint(rows, {"who": np.uint64})[0] if words else np.zeros(len(key), np.uint64)
                rows.clear()
                at = sorting(key)
                at = at[~np.isnan(value[at])]
                yield from sliced(part, {"key": key[at], "who": who[at], "value": value[at]}, 0, len(at), DEALT)

        yield from rows_of(packs(), OFFERED)

    return stored(map_batches(merged(packed, "part"), deal, "part int, key binary, who binary, value binary"), "tree-addends", PAGES)


ASKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("key", pa.binary()),
                   ("who", pa.binary()), ("value", pa.binary())])
SUMS = pa.schema([("chunk", pa.int64()), ("who", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary())])


def numbered(batches) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    """Blocks with the number of their first text in the task; equal at every reading of one table."""
    start = 0
    for batch in batches:
        for block in blocks(batch.column("text")):
            yield start + block.lo, batch, block
        start += batch.num_rows


def chunk_of(task: int, number: np.ndarray) -> np.ndarray:
    """Texts of a task in groups of CHUNK, whose sums come back together."""
    return task << 32 | number // CHUNK


def once_a_text(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (key, text), sorted by key, and how often each occurs. Texts of a key must ascend."""
    at = sorting(key)
    key, who = key[at], who[at]
    first = firsts(key, who)
    return key[first], who[first], np.diff(first, append=len(key)).astype(np.uint32)


def looked_up(docs: DataFrame, tree: Tree, turn: int, passes: int) -> DataFrame:
    """Per text (chunk, who) with a run of this pass in the tree: n_known, base and score, in nats."""
    parts, order = tree.ranges, tree.depth + 1

    def ask(batches):
        task, now, keys, whose, size = TaskContext.get().partitionId(), 0, [], [], 0

        def packs():
            key, who, times = once_a_text(emptied(keys), emptied(whose))
            found = ranged({"key": key, "who": who, "value": times}, parts)
            yield from rows_of(({**row, "kind": 1, "chunk": int(chunk_of(task, now * CHUNK))} for row in found), ASKED)

        for start, _, block in numbered(batches):
            runs = [(key[mine], text[mine] + start) for text, _, _, key, real in token_runs(block, order)
                    for mine in [real & in_pass(key, turn, passes)]]
            for chunk in range(start // CHUNK, (start + block.n - 1) // CHUNK + 1):
                if size and (chunk != now or size >= HELD):
                    yield from packs()
                    size = 0
                now = chunk
                for key, who in runs:
                    lo, hi = np.searchsorted(who, [chunk * CHUNK, (chunk + 1) * CHUNK])
                    keys.append(key[lo:hi])
                    whose.append((who[lo:hi] - chunk * CHUNK).astype(np.uint16))
                    size += int(hi - lo)
        if size:
            yield from packs()

    def offer(batches):
        def packs():
            for batch in batches:
                for row in batch.to_pylist():
                    columns = {c: unpack(row[c], kind) for c, kind in OFFERS.items()}
                    mine = in_pass(columns["key"], turn, passes)
                    yield {"part": row["part"], "kind": 0, "chunk": None, **{c: pack(v[mine]) for c, v in columns.items()}}

        yield from rows_of(packs(), ASKED)

    def meet(batches):
        part, offered, lookup = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, offered, lookup = row["part"], [], None
                if row["kind"] == 0:
                    offered.append(tuple(unpack(row[c], kind) for c, kind in OFFERS.items()))
                    continue
                if lookup is None:
                    if not offered:
                        continue
                    key, n, weight = (np.concatenate(c) for c in zip(*offered))
                    offered = []
                    at = sorting(key)
                    key = key[at]
                    first = firsts(key)
                    n, weight = (np.add.reduceat(v[at], first) if len(at) else v for v in (n, weight))
                    base = np.where(n > 0, np.log(tree_root(n)), 0.0)
                    lookup = Lookup(key[first])
                at = lookup.find(unpack(row["key"], np.uint64))
                hit = at >= 0
                at, times = at[hit], unpack(row["value"], np.uint32)[hit]
                texts = unpack(row["who"], np.uint16)[hit]
                if len(texts):
                    who = np.flatnonzero(np.bincount(texts))
                    known, base_sum, score = (np.bincount(texts, v * times)[who] for v in (n[at] > 0, base[at], weight[at]))
                    yield from rows_of([{"chunk": row["chunk"], "who": pack(who.astype(np.uint16)), "known": pack(known.astype(np.uint32)),
                                         "base": pack(base_sum), "score": pack(score)}], SUMS)

    def add(batches):
        now, total = None, None

        def sums():
            who = np.flatnonzero(total[3])
            return pa.RecordBatch.from_pydict({
                "chunk": np.full(len(who), now), "who": who, "known": total[0][who].astype(np.int64), "base": total[1][who],
                "score": total[2][who]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != now:
                    if now is not None:
                        yield sums()
                    now, total = row["chunk"], np.zeros((4, CHUNK))
                who = unpack(row["who"], np.uint16)  # different texts
                for k, (c, kind) in enumerate((("known", np.uint32), ("base", np.float64), ("score", np.float64))):
                    total[k][who] += unpack(row[c], kind)
                total[3][who] = 1
        if now is not None:
            yield sums()

    tokens, distinct = tree.tokens, tree.distinct

    def tree_root(n):
        return (n + 0.1) / (tokens + 0.1 * (distinct + 1))

    schema = "part int, kind int, chunk bigint, key binary, who binary, value binary"
    both = map_batches(docs.select("text"), ask, schema).unionAll(map_batches(tree.addends, offer, schema))
    met = map_batches(merged(both, "part", "kind"), meet, "chunk bigint, who binary, known binary, base binary, score binary")
    return map_batches(merged(met, "chunk"), add, "chunk bigint, who bigint, known bigint, base double, score double")


def score(docs: DataFrame, tree: Tree, passes: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, n_known, base_score and score (log10 probabilities).

    Null and empty texts are an end alone. Repeated rows get equal scores, each its own row; other columns are
    not read. Texts are known by their place in `docs`, so it must be a table or another plan that deals rows alike
    each time it is read, not the raw output of a shuffle.
    """
    def name(batches):
        task = TaskContext.get().partitionId()
        for start, batch, block in numbered(batches):
            number = start + np.arange(block.n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(block.lo, block.n), "chunk": chunk_of(task, number),
                "who": number % CHUNK, "n_tokens": block.words().counts + 1})

    kind = docs.schema["doc_id"].dataType.simpleString()
    with lean(docs.sparkSession):
        done = [stored(looked_up(docs, tree, turn, passes), "tree-sums") for turn in range(passes)]
        named = stored(map_batches(docs.select("doc_id", "text"), name, f"doc_id {kind}, chunk bigint, who bigint, n_tokens bigint"), "tree-texts")
    sums = reduce(DataFrame.unionAll, done).groupBy("chunk", "who").agg(*(F.sum(c).alias(c) for c in ("known", "base", "score")))
    known, base, total = (F.coalesce(c, F.lit(0)) for c in ("known", "base", "score"))
    unknown = (F.col("n_tokens") - known) * float(np.log(tree.root(0)))
    return named.join(sums, ["chunk", "who"], "left").select(
        "doc_id", "n_tokens", known.alias("n_known"), ((base + unknown) / float(np.log(10))).alias("base_score"),
        ((total + unknown) / float(np.log(10))).alias("score"))
