"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many rows; so there are never more hot keys than this.
SHARE = 1_000
#: The rows of a hot key are dealt to so many parts.
PARTS = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The keys with more than total / SHARE rows, of a table (keys, n): at most SHARE rows, whatever its size."""
    return counts.where(F.col(n) * SHARE > F.lit(total)).select(*keys)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has each key once; rows of hot keys are dealt to PARTS parts, and the
    few rows of `right` with those keys stand in each part. Keys are not null. `hot` has at most SHARE rows
    (`hot_keys`), which bounds what is broadcast."""
    # The planner cannot see that bound in a filter; SHARE rows of keys are far below a megabyte.
    few = F.broadcast(hot.withColumn("part_hot", F.lit(True)))
    part = F.when(F.col("part_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(F.col("part_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(few, keys, "left").withColumn("part", part).drop("part_hot")
    copied = right.join(few, keys, "left").withColumn("part", F.explode(parts)).drop("part_hot")
    return dealt.join(copied.hint("merge"), [*keys, "part"], how).drop("part")
