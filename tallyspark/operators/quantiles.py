"""Exact quantiles over whole tables without gathering a column in one task.

The range of a column is cut into equal buckets, the rows in each are counted where they are read, and the
bucket that holds a wanted rank is cut again, between its least and greatest value, until a bracket holds one
value. Each round divides the range by `BUCKETS`, so a few passes give the exact value for any size and any
distribution; a round moves at most one row per task and bucket, and one row per rank reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.numbers import finite, parsed
from tallyspark.session import small_frame, stored

BUCKETS = 2_048
PLAIN = ("n", "nulls", "sum", "mean", "sd", "min", "max")


def typed_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as c0, c1, ...: numbers, text read as numbers; what does not parse or is not finite is null."""
    kinds = dict(df.dtypes)
    return df.select(*[
        finite(parsed(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`").cast("double")).alias(f"c{i}")
        for i, c in enumerate(columns)])


def bucket(x: Column, low: Column, high: Column) -> Column:
    """The place of x among BUCKETS equal parts of low..high; low is in the first one, high in the last. A range too
    small to be divided has two parts: its least value, and the others."""
    part = F.try_divide(x / 2 - low / 2, high / 2 - low / 2) * BUCKETS
    place = F.when(x == low, 0).when(x == high, BUCKETS - 1).otherwise(F.coalesce(F.floor(part), F.lit(BUCKETS - 1)))
    return F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def values_at(typed: DataFrame, ranks: dict[str, list[tuple[int, float, float]]]) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of the sorted columns; `ranks`: per column (rank, least, greatest value)."""
    open_ = {(slot, rank): (low, high, 0) for slot, wanted in ranks.items() for rank, low, high in wanted}
    found: dict[tuple[str, int], float] = {}
    while open_:
        for key in [k for k, (low, high, _) in open_.items() if low == high]:
            found[key] = open_.pop(key)[0]
        if not open_:
            break
        brackets: dict[tuple[str, float, float, int], list[int]] = {}
        for (slot, rank), bracket in open_.items():
            brackets.setdefault((slot, *bracket), []).append(rank)
        cells, wanted = [], F.lit(False)
        for i, ((slot, low, high, before), own) in enumerate(brackets.items()):
            x = F.col(slot)
            cells.append(F.when(x.between(low, high), F.struct(
                F.lit(i).alias("i"), bucket(x, F.lit(low), F.lit(high)).alias("bucket"), x.alias("x"))))
            for rank in own:
                wanted = wanted | ((F.col("i") == i) & (F.col("upto") > rank - before) & (F.col("upto") - F.col("n") <= rank - before))
        counts = typed.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull()))).groupBy("i", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("n").over(W.partitionBy("i").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        kept = counts.withColumn("upto", upto).where(wanted).collect()
        for i, ((slot, _, _, before), own) in enumerate(brackets.items()):
            for rank in own:
                row = next(r for r in kept if r.i == i and r.upto > rank - before >= r.upto - r.n)
                open_[slot, rank] = (row.low, row.high, before + row.upto - row.n)
    return found


def column_stats(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row per column with values: n, nulls, sum, mean, sd, min, max and one column per named quantile.

    Text is read as numbers; what does not parse or is not finite is null. Quantiles are interpolated linearly.
    """
    # Every round reads the numbers again: a table of them alone, not what they come from.
    typed = stored(typed_numbers(df, columns), "numbers") if columns else typed_numbers(df, columns)

    def summary(slot: str):
        x = F.col(slot)
        n = F.count(x)
        return F.struct(n.alias("n"), (F.count(F.lit(1)) - n).alias("nulls"), F.sum(x).alias("sum"), F.avg(x).alias("mean"),
                        F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max")).alias(slot)

    plain = typed.agg(*[summary(slot) for slot in typed.columns]).first() if columns else {}
    places = {(slot, name): (plain[slot].n - 1) * p for slot in typed.columns if plain[slot].n for name, p in probs.items()}
    ranks: dict[str, list[tuple[int, float, float]]] = {}
    for (slot, _), place in places.items():
        for rank in {floor(place), ceil(place)}:
            ranks.setdefault(slot, []).append((rank, plain[slot].min, plain[slot].max))
    found = values_at(typed, ranks)

    def at(slot: str, name: str) -> float:
        place = places[slot, name]
        low, high = found[slot, floor(place)], found[slot, ceil(place)]
        return low + (high - low) * (place - floor(place))

    rows = [(c, *(plain[slot][f] for f in PLAIN), *(at(slot, name) for name in probs))
            for c, slot in zip(columns, typed.columns) if plain[slot].n]
    return small_frame(df.sparkSession, rows, ", ".join(
        ["column string, n bigint, nulls bigint, sum double, mean double, sd double, min double, max double", *(f"`{name}` double" for name in probs)]))


def group_key(dims: Sequence[Column]) -> Column:
    """One text per combination of values, nulls included."""
    return F.md5(F.to_json(F.struct(*[d.alias(f"d{i}") for i, d in enumerate(dims)])).cast("binary")) if dims else F.lit("")


def values_at_ranks(rows: DataFrame, spans: DataFrame, ranks: DataFrame) -> DataFrame:
    """(group, slot, rank, value): the values at 0-based ranks (group, slot, rank) of the sorted x of each group and slot.
    `rows`: group, slot, x; `spans`: group, slot, low, high, the ends of each.

    All groups go through the same rounds. A bracket, one group's range that still holds a wanted rank, is a row of a
    table; rows meet the brackets of their group, are counted by bucket before they are shuffled, and only those inside a
    bracket are read again. So neither a group nor the brackets of all groups are ever gathered.
    """
    at = ["group", "slot"]
    open_ = ranks.join(spans.select(*at, "low", "high"), at).withColumn("before", F.lit(0).cast("bigint"))
    found, first = None, True
    while True:
        open_ = stored(open_, "brackets")
        closed = open_.where("low = high").select(*at, "rank", F.col("low").alias("value"))
        found = closed if found is None else found.unionAll(closed)
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        brackets = open_.select(*at, "low", "high").distinct()
        inside = rows.join(brackets, at).where(F.col("x").between(F.col("low"), F.col("high")))
        if not first:
            inside = stored(inside, "inside")
            rows = inside.select(*at, "x")
        first = False
        counts = inside.groupBy(*at, "low", bucket(F.col("x"), F.col("low"), F.col("high")).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(W.partitionBy(*at, "low").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        here = F.col("rank") - F.col("before")
        open_ = open_.join(counts.withColumn("upto", upto), [*at, "low"]).where((F.col("upto") > here) & (F.col("upto") - F.col("n") <= here)).select(
            *at, "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
    return found


def group_quantiles(df: DataFrame, key: Column, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(group, and a column per name): exact quantiles of columns within the groups that `key` tells apart, interpolated
    linearly; null for a group without numbers. `wanted`: name -> (column, share of the rows below).
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    numbers = typed_numbers(df, columns).columns
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(n).alias("x")) for i, n in enumerate(numbers)])
    keyed = df.select(key.alias("group"), *[F.col(f"`{c}`") for c in columns])
    typed = stored(keyed.select("group", *[
        finite(parsed(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`").cast("double")).alias(n)
        for n, (c, t) in zip(numbers, keyed.dtypes[1:])]), "numbers")
    rows = typed.select("group", F.inline(cells)).where("x is not null")
    at = ["group", "slot"]
    spans = stored(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "spans")
    named = F.array(*[F.struct(F.lit(columns.index(c)).alias("slot"), F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, (c, p) in wanted.items()])
    places = spans.withColumn("w", F.explode(named)).where("w.slot = slot").select(*at, "w.name", ((F.col("n") - 1) * F.col("w.p")).alias("place"))
    found = values_at_ranks(rows, spans, places.select(*at, F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct())
    value = lambda side: found.select(*at, F.col("rank").alias(f"{side}_rank"), F.col("value").alias(side))
    both = places.withColumn("low_rank", F.floor("place")).withColumn("high_rank", F.ceil("place"))
    both = both.join(value("low"), [*at, "low_rank"]).join(value("high"), [*at, "high_rank"])
    exact = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.col("low_rank"))
    return both.withColumn("exact", exact).groupBy("group").agg(*[F.max(F.when(F.col("name") == name, F.col("exact"))).alias(name) for name in wanted])
