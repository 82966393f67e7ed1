"""Pairs of similar sets, each set told by 64-bit hashes of its words.

Two sets of the wanted similarity have sizes near each other and, with the words in one order, rare ones first, share a
word among the first few of either. So sets go to rooms: a room holds the sets of one block and one band of sizes, those
of the next band as visitors, and, where these have too many words, a part of the words. A set brings to a room the words
of its prefix that belong there and a sketch of itself, once for all of them, so what is written grows with the sets and
not with the pairs. In the room the sizes, the places of the shared words and the sketches leave out nearly all pairs:
a sketch says of bits how many words hash there, odd or even, and two sets differ in at least as many words as their
sketches in bits. The pairs left are settled on the whole sets, which are dealt by the groups that hang together.

The order of the words only matters for the work: it comes from counts of hashes in a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import ship, stored

EPS = 1e-9
TABLE = 22  # bits of a word's hash that tell its place in the table of counts
FLAGS = 24  # bits of a key's hash that tell whether it may be in a pair
SLICE = 1_000  # sets of a batch that are taken at a time
MEETINGS = 1 << 20  # meetings of a room that are looked at at a time
ROOM = 1 << 22  # most words of a room, unless a part of one block, band and hash has more
LAST = (1 << 15) - 1  # later places are written as this one, which rules out less
DEALT = 1 << 21  # about so many words of whole sets are compared in one group
GROUP = 1 << 19  # pairs of a group from which on it is dealt to several
U64 = np.uint64


def bands(same: float, most: int) -> np.ndarray:
    """Least sizes of the bands: a set is no more similar than `same` to one two bands away."""
    out = [1]
    while out[-1] <= most:
        out.append(int(out[-1] / same + EPS) + 1)
    return np.array(out)


def least_size(same: float, n: np.ndarray) -> np.ndarray:
    """Size of the smallest set that can be similar to one of size `n`."""
    return np.ceil(same * n - EPS).astype(np.int64)


def sketch_bits(same: float, band: int) -> int:
    """Bits of the sketches of a room: as many as its largest sets have words, or up to twice as many, within limits."""
    edge = 1
    for _ in range(band + 1):
        edge = int(edge / same + EPS) + 1
        if edge > 1 << 13:
            break
    return 1 << min(13, max(6, int(edge - 1).bit_length()))


def _levels(sets: DataFrame) -> np.ndarray:
    """For every place in the table, how many words hash there, as a multiple of the fourth part of a power of two."""
    def count(batches):
        for batch in batches:
            h = batch.column("a").flatten().to_numpy().view(U64) >> U64(64 - TABLE)
            at, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(n)})

    summed = sets.select("a").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    found = summed.select("at", F.floor(F.log2("n") * 4).cast("tinyint").alias("level")).toArrow()
    out = np.zeros(1 << TABLE, np.uint8)
    out[found.column("at").to_numpy()] = found.column("level").to_numpy()
    return out


def _rooms(block: np.ndarray, n: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) of all rooms the sets go to: first each to that of its own band, then visitors."""
    edges = bands(same, int(n.max(initial=1)))
    own = np.searchsorted(edges, n, "right") - 1
    visits = np.flatnonzero((own > 0) & (least_size(same, n) < edges[own]))
    return np.concatenate([np.arange(len(n)), visits]), np.concatenate([own, own[visits] - 1])


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            yield part, np.diff(part.column("a").offsets.to_numpy()), part.column("a").flatten().to_numpy().view(U64)


def _parts(sets: DataFrame, same: float) -> dict[tuple[int, int], int]:
    """Into how many parts the words of the large rooms are dealt, (block, band) -> parts."""
    def sizes(batches):
        for part, n, _ in _slices(batches):
            block = part.column("block").to_numpy()
            row, band = _rooms(block, n, same)
            words = n - least_size(same, n) + 1
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[row]), "band": pa.array(band), "words": pa.array(words[row])})

    rooms = stored(sets.mapInArrow(sizes, "block bigint, band bigint, words bigint").groupBy("block", "band").agg(F.sum("words").alias("words")), "rooms")
    total = rooms.agg(F.sum("words")).first()[0] or 0
    most = min(ROOM, max(1 << 18, total // 64))
    return {(r["block"], r["band"]): -(-r["words"] // most) for r in rooms.where(F.col("words") > most).collect()}


def _sent(part: pa.RecordBatch, n: np.ndarray, h: np.ndarray, same: float, level: np.ndarray, parts: dict) -> pa.RecordBatch:
    """What the sets bring to their rooms."""
    owner, block = np.repeat(np.arange(len(n)), n), part.column("block").to_numpy()
    order = np.lexsort((h, level[h >> U64(64 - TABLE)], owner))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + 1
    first = place <= np.repeat(n - least_size(same, n) + 1, n)
    words, pos, count = h[order][first], place[first], n - least_size(same, n) + 1
    row, band = _rooms(block, n, same)
    deal = np.array([parts.get(k, 1) for k in zip(block[row].tolist(), band.tolist())])
    begin = (np.cumsum(count) - count)[row]
    size = count[row]
    sent = np.repeat(np.arange(len(row)), size)  # for every word of every visit, the visit
    at = np.repeat(begin, size) + np.arange(len(sent)) - np.repeat(np.cumsum(size) - size, size)
    where = ((words[at] >> U64(32)) % deal[sent].astype(U64)).astype(np.int64)
    by = np.lexsort((pos[at], where, sent))
    sent, at, where = sent[by], at[by], where[by]
    new = np.flatnonzero((np.diff(sent, prepend=-1) != 0) | (np.diff(where, prepend=-1) != 0))
    offsets, visit = pa.array(np.append(new, len(sent)).astype(np.int32)), sent[new]
    sketches = np.empty(len(row), object)
    for b in np.unique(band).tolist():
        bits, own = sketch_bits(same, b), np.flatnonzero(band == b)
        local = np.full(len(n), -1)
        local[row[own]] = np.arange(len(own))
        here = np.flatnonzero(local[owner] >= 0)
        bit = (h[here] & U64(bits - 1)).astype(np.int64)
        odd = np.bincount(local[owner[here]] * bits + bit, minlength=len(own) * bits) & 1
        packed = np.packbits(odd.astype(bool).reshape(len(own), bits), axis=1)
        sketches[own] = [p.tobytes() for p in packed]
    return pa.RecordBatch.from_pydict({
        "block": pa.array(block[row[visit]]), "band": pa.array(band[visit]), "part": pa.array(where[new]),
        "key": part.column("key").take(pa.array(row[visit])), "n": pa.array(n[row[visit]].astype(np.int64)),
        "home": pa.array(visit < len(n)), "sketch": pa.array(sketches[visit].tolist(), pa.binary()),
        "words": pa.ListArray.from_arrays(offsets, pa.array((words[at] & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))),
        "pos": pa.ListArray.from_arrays(offsets, pa.array(np.minimum(pos[at], LAST).astype(np.int16)))})


def meet(room: pa.Table, same: float) -> Iterator[pa.RecordBatch]:
    """(x, y): the pairs of one room that nothing rules out, each once, x with the smaller key."""
    room = room.combine_chunks()
    keys = room.column("key").combine_chunks()
    room = room.take(pa.array(np.unique(keys.dictionary_encode().indices.to_numpy(), return_index=True)[1]))  # copies once
    room = room.take(pc.sort_indices(room, sort_keys=[("n", "ascending"), ("key", "ascending")]))
    n, keys = room.column("n").to_numpy(), room.column("key").combine_chunks()
    homes, sets = int(np.count_nonzero(room.column("home").to_numpy())), len(n)  # visitors are larger
    sketch = np.frombuffer(b"".join(room.column("sketch").to_pylist()), U64).reshape(sets, -1)
    row = np.repeat(np.arange(sets), pc.list_value_length(room.column("words")).to_numpy())
    word, pos = (room.column(c).combine_chunks().flatten().to_numpy() for c in ("words", "pos"))
    pos, lists = pos.astype(np.int64), np.unique(word, return_inverse=True)[1]
    # A smaller set lacks few words of a larger one, so a shorter prefix of it holds a shared word.
    short = n - np.ceil(2 * same / (1 + same) * n - EPS).astype(np.int64) + 1
    small = np.flatnonzero((row < homes) & (pos <= short[row]))
    key = lists[small] * sets + row[small]
    order = np.argsort(key)
    small, key = small[order], key[order]
    lo = np.searchsorted(key, lists * sets + np.searchsorted(n, least_size(same, n))[row])
    many = np.maximum(np.searchsorted(key, lists * sets + np.minimum(row, homes)) - lo, 0)
    # The words of one larger set are looked at together, so that its pairs are told once.
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
    upto, begin = np.cumsum(many)[ends - 1], 0
    for cut in np.append(np.flatnonzero(np.diff(upto // MEETINGS)), len(ends) - 1).tolist():
        end = int(ends[cut])
        m = many[begin:end]
        large = np.repeat(np.arange(begin, end), m)
        other = small[np.repeat(lo[begin:end] - (np.cumsum(m) - m), m) + np.arange(len(large))]
        x, y = row[other], row[large]
        both, possible = n[x] + n[y], 1 + np.minimum(n[x] - pos[other], n[y] - pos[large])
        left = np.flatnonzero(possible + EPS >= same / (1 + same) * both)
        pairs = np.unique(x[left] * sets + y[left])
        x, y = pairs // sets, pairs % sets
        both, apart = n[x] + n[y], np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
        near = both - apart + EPS >= 2 * same / (1 + same) * both
        x, y = (keys.take(pa.array(i[near])) for i in (x, y))
        turn = pc.less(y, x)
        yield pa.RecordBatch.from_pydict({"x": pc.if_else(turn, y, x), "y": pc.if_else(turn, x, y)})
        begin = end


def _flags(keys: DataFrame) -> np.ndarray:
    """For every value of the first bits of a key's hash, whether some key has it."""
    out = np.zeros(1 << FLAGS, bool)
    out[keys.select(F.shiftrightunsigned(F.xxhash64("key"), 64 - FLAGS).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    return out


def shares(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """(x, y, share) of pairs whose sets are at hand."""
    keys = sets.column("key").combine_chunks()
    held = sets.column("a").combine_chunks()
    bounds, h = held.offsets.to_numpy(), held.values.to_numpy()
    own = [np.sort(h[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]
    x, y = (pc.index_in(pairs.column(c).combine_chunks(), keys).to_numpy() for c in ("x", "y"))
    out = np.empty(len(x))
    for i, (j, k) in enumerate(zip(x.tolist(), y.tolist())):
        small, large = (own[j], own[k]) if len(own[j]) < len(own[k]) else (own[k], own[j])
        common = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
        out[i] = common / (len(small) + len(large) - common)
    return pa.table({"x": pairs.column("x"), "y": pairs.column("y"), "share": pa.array(out)})


def similar_sets(sets: DataFrame, same: float) -> DataFrame:
    """(x, y, share): pairs of keys of one block whose sets have a Jaccard similarity of `same` or more, each once.
    `sets`: key, block, and the distinct hashes a, which are stored and read several times; rows with one key are alike."""
    spark, kind = sets.sparkSession, sets.schema["key"].dataType.simpleString()
    ship(spark)
    sets = sets.where(F.size("a") > 0)
    level, parts = _levels(sets), _parts(sets, same)
    sent = spark.sparkContext.broadcast(level)

    def send(batches):
        for part, n, h in _slices(batches):
            yield _sent(part, n, h, same, sent.value, parts)

    brought = sets.mapInArrow(send, f"block bigint, band bigint, part bigint, key {kind}, n bigint, home boolean, sketch binary, words array<int>, pos array<smallint>")
    def met_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meet(pa.Table.from_batches(list(batches)), same)

    room = ["block", "band", "part"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = brought.repartition(tasks, *room).groupBy(*room).applyInArrow(met_in, f"x {kind}, y {kind}")
    pairs = stored(met.distinct(), "pairs")
    # A group is told by the least neighbour of its sets, so that near copies of one text meet in one group.
    either = pairs.select(F.col("x").alias("key"), F.col("y").alias("other")).unionAll(pairs.select(F.col("y").alias("key"), F.col("x").alias("other")))
    heads = either.groupBy("key").agg(F.min(F.least("key", "other")).alias("head"))
    flags = spark.sparkContext.broadcast(np.packbits(_flags(either)))

    def asked(batches):
        held = np.unpackbits(flags.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(held[batch.column("at").to_numpy()])).select(["key", "a"])

    at = F.shiftrightunsigned(F.xxhash64("key"), 64 - FLAGS).cast("int")
    few = sets.select("key", "a", at.alias("at")).mapInArrow(asked, f"key {kind}, a array<bigint>")
    words = few.agg(F.sum(F.size("a"))).first()[0] or 0
    # The pairs of a large group are dealt by both sides, so that no task compares all of them.
    told = stored(pairs.join(heads.withColumnRenamed("key", "x"), "x"), "pairs")
    sizes = told.groupBy("head").agg(F.count(F.lit(1)).alias("pairs"))
    large = sizes.where(F.col("pairs") > GROUP).select("head", F.ceil(F.sqrt(F.col("pairs") / GROUP)).alias("sides"))
    side = lambda c: F.pmod(F.xxhash64(c), F.coalesce("sides", F.lit(1)))
    groups = max(tasks, words // DEALT, told.count() // GROUP)
    home = F.pmod(F.xxhash64("head", side("x"), side("y")), F.lit(groups))
    routed = stored(told.join(large, "head", "left").select("x", "y", home.alias("home")), "pairs")
    visits = routed.select(F.col("home").alias("at_home"), F.col("x").alias("key")).unionAll(routed.select("home", F.col("y").alias("key"))).distinct()
    whole = few.dropDuplicates(["key"]).join(visits, "key").select("at_home", "key", "a")
    found = routed.groupBy("home").cogroup(whole.groupBy("at_home")).applyInArrow(shares, f"x {kind}, y {kind}, share double")
    return found.where(F.col("share") >= same)
