"""Rows that repeat a better row, told by the overlap of their words.

Where a row has one set, similar ones meet in rooms (`rooms`). Where it has two, candidates come from an inverted index
over prefixes: with the words of a set in one order, rare ones first, two sets of the wanted similarity share a word
among the first few of either. The size of the sets and the places of the shared word, and sketches of the sets, leave
out nearly all pairs before any set is compared: a sketch says of bits how many words hash there, odd or even, and two
sets differ in at least as many words as their sketches in bits. Which rows stay is then settled in rounds over the
links alone: a row with no better neighbour left stays, and its neighbours go. That is what going through the rows from
the best to the worst would give, without putting them in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.text import plain_tokens
from tallyspark.operators.rooms import similar_sets
from tallyspark.session import stored

EPS = 1e-9
LARGE = 1400  # words of a set from which on its sketch has 4,096 bits instead of 1,024
MOST = 1 << 31  # words of the largest set there can be


def _sketches(items: DataFrame, words: str, longs: int) -> DataFrame:
    """(key, s0, s1, ..): for every bit of `longs` long integers, whether an odd number of the set's words hash to it."""
    hashed = items.select("key", F.explode(words).alias("word")).withColumn("h", F.xxhash64("word"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))")
    return hashed.groupBy("key").agg(*[
        F.bit_xor(F.when(F.pmod("h", F.lit(longs)) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"s{i}") for i in range(longs)])


def _prefixes(items: DataFrame, words: str, times: DataFrame, same: float, longs: int) -> DataFrame:
    """(key, n, block, word, pos, sketch): the words of each set that a similar set must share one of; pos from 1."""
    each = items.select("key", "block", F.size(words).alias("n"), F.explode(words).alias("word"))
    order = W.partitionBy("key").orderBy("times", "word")
    ranked = each.join(times, "word").withColumn("pos", F.row_number().over(order))
    first = ranked.where(F.col("pos") <= F.col("n") - F.ceil(F.lit(same) * F.col("n") - EPS) + 1).drop("times")
    return first.join(_sketches(items, words, longs), "key")


def _met(items: DataFrame, right: str, times: DataFrame, same: float, longs: int, low: int, high: int) -> DataFrame:
    """(x, y): pairs that share a word of their prefixes and that neither the sizes nor the places of the word nor the
    sketches rule out; the smaller set has more than `low` words and at most `high`. Pairs are ruled out where they
    meet, so only the ones left are written."""
    def side(words: str, end: str) -> DataFrame:
        size = F.size(words)
        rows = _prefixes(items.where((size > low) & (size * F.lit(same) <= high + EPS)), words, times, same, longs)
        return rows.select("block", "word", *[F.col(c).alias(c + end) for c in rows.columns if c not in ("block", "word")])

    nx, ny, px, py = F.col("n_x"), F.col("n_y"), F.col("pos_x"), F.col("pos_y")
    both = nx + ny
    # An equal or smaller set lacks few words of a larger one, so a shorter prefix of it holds a shared word.
    short = lambda n: n - F.ceil(F.lit(2 * same / (1 + same)) * n - EPS) + 1
    needed, possible = F.lit(same / (1 + same)) * both, 1 + F.least(nx - px, ny - py)
    apart = reduce(add, [F.bit_count(F.col(f"s{i}_x").bitwiseXOR(F.col(f"s{i}_y"))) for i in range(longs)])
    other = F.col("key_x") < F.col("key_y") if right == "a" else F.col("key_x") != F.col("key_y")
    left = side("a", "_x")
    met = left.join(side(right, "_y"), ["block", "word"]).where(
        other & (F.least(nx, ny) <= high) & (nx + EPS >= F.lit(same) * ny) & (ny + EPS >= F.lit(same) * nx)
        & F.when(ny <= nx, py <= short(ny)).otherwise(px <= short(nx)) & (possible + EPS >= needed) & (both - apart + EPS >= 2 * needed))
    return met.select(F.col("key_x").alias("x"), F.col("key_y").alias("y")).distinct()


def hashes(words: str | Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def similar_pairs(items: DataFrame, same: float) -> DataFrame:
    """(x, y, share): pairs of keys of one block whose sets a (of x) and b (of y) have a Jaccard similarity of `same`
    or more. `items`: key, block, and the word sets a and b; without b, the sets a are compared, each pair once (`rooms`)."""
    if "b" not in items.columns:
        return similar_sets(stored(items.select("key", F.col("block").cast("bigint").alias("block"), hashes("a").alias("a")), "sets"), same)
    words = items.select(F.explode("a").alias("word")).unionAll(items.select(F.explode("b").alias("word")))
    times = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("times")), "words")
    # Two large sets differ in more words than a small sketch can show.
    pairs = reduce(DataFrame.unionAll, [_met(items, "b", times, same, *c) for c in ((16, 0, LARGE), (64, LARGE, MOST))])
    sets = stored(pairs, "pairs").join(items.select(F.col("key").alias("x"), F.col("a").alias("of_x")), "x").join(
        items.select(F.col("key").alias("y"), F.col("b").alias("of_y")), "y")
    common = F.size(F.array_intersect("of_x", "of_y"))
    share = common / (F.size("of_x") + F.size("of_y") - common)
    return sets.select("x", "y", share.alias("share")).where(F.col("share") >= same)


def beaten(links: DataFrame) -> DataFrame:
    """(key) of the rows that go, for links (worse, better): from the best row to the worst, a row goes if a row that
    stays is a better neighbour. Every round settles all rows that have no better neighbour left."""
    left, gone = stored(links.distinct(), "links"), []
    while not left.isEmpty():
        heads = left.select(F.col("better").alias("key")).join(left.select(F.col("worse").alias("key")), "key", "left_anti").distinct()
        now = stored(left.join(heads.withColumnRenamed("key", "better"), "better", "left_semi").select(F.col("worse").alias("key")).distinct(), "beaten")
        gone.append(now)
        left = stored(left.join(now.withColumnRenamed("key", "worse"), "worse", "left_anti").join(
            now.withColumnRenamed("key", "better"), "better", "left_anti"), "links")
    out = left.select(F.col("worse").alias("key"))
    for one in gone:
        out = out.unionAll(one)
    return out


def without_similar(items: DataFrame, same: float, sets: DataFrame | None = None) -> DataFrame:
    """The items that stay. Columns: key (one a row), block, sets a and b, and place, which orders them, the best
    first. Row x repeats a better row y if a of x and b of y are similar; without b, if the sets a are. Items may
    also have no sets but those of `sets`, as `similar_sets` takes them."""
    items = stored(items, "items")
    found = similar_pairs(items, same) if sets is None else similar_sets(sets, same)
    place = items.select("key", "place")
    both = found.join(place.withColumnsRenamed({"key": "x", "place": "at_x"}), "x").join(
        place.withColumnsRenamed({"key": "y", "place": "at_y"}), "y")
    x, y, ahead = F.col("x"), F.col("y"), F.col("at_y") < F.col("at_x")
    if "b" in items.columns:  # x repeats y only where y is the better one
        links = both.where(ahead).select(x.alias("worse"), y.alias("better"))
    else:
        links = both.select(F.when(ahead, x).otherwise(y).alias("worse"), F.when(ahead, y).otherwise(x).alias("better"))
    return items.join(beaten(links), "key", "left_anti")


def distinct_texts(df: DataFrame, text: str, order: Sequence[Column], same: float, block: Sequence[str] = (),
                   keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of `df` that do not repeat a better one, with the columns `keep` or all: `order` sorts them, the best
    first, and must tell any two rows apart; rows of different `block` values never repeat each other.

    Texts are compared as sets of plain words. Rows with the same words are one item, its best row, however many
    there are. Texts without words and rows with a null in `block` all stay. Words are known by 64-bit hashes, sets of them by 128 bits.
    """
    place = F.struct(*order)
    told = reduce(and_, [F.col(f"`{c}`").isNotNull() for c in block], F.lit(True))
    words = F.when(told, F.array_sort(plain_tokens(F.col(text)))).otherwise(F.array().cast("array<string>"))
    home = F.xxhash64(*block) if block else F.lit(0).cast("bigint")
    block_text = F.to_json(F.struct(*block) if block else F.struct(F.lit(0)))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"), place.alias("place"), words.alias("words"),
                     block_text.alias("home"), home.alias("block"))
    key = F.unhex(F.md5(F.concat(F.col("home"), F.lit("|"), F.array_join("words", " ")).cast("binary")))
    rows = stored(rows.select(key.alias("key"), "block", hashes("words").alias("a"), "place", "row"), "sets")
    best = rows.where(F.size("a") > 0).groupBy("key").agg(F.min(F.struct("place", "row")).alias("best"))
    items = best.select("key", F.col("best.place").alias("place"), F.col("best.row").alias("row"))
    stay = without_similar(items, same, rows.select("key", "block", "a"))
    return stay.select("row.*").unionAll(rows.where(F.size("a") == 0).select("row.*"))
