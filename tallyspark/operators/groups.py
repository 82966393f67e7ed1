"""Group sums by several dimensions in one pass, and the ranked heads of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def by_dimension(df: DataFrame, dims: Sequence[str], keep: dict[str, Column]) -> DataFrame:
    """Each row once per dimension: `dimension`, `label` and the kept columns. One pass, no shuffle."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dims])
    return df.select(*[c.alias(name) for name, c in keep.items()], F.inline(cells))


def group_sums(
    df: DataFrame, dims: Sequence[str], measures: Sequence[str], drop_null_groups: bool = True
) -> DataFrame:
    """Rows (dimension, label, column, value): sum per group of each dimension on its own.

    The input is read once however many dimensions there are, and partial sums are built before the
    shuffle, so a group holding most rows costs no more than any other.
    """
    slots = {f"m{i}": m for i, m in enumerate(measures)}
    rows = by_dimension(df, dims, {slot: F.col(m) for slot, m in slots.items()})
    sums = rows.groupBy("dimension", "label").agg(*[F.sum(slot).cast("double").alias(slot) for slot in slots])
    cells = F.array(*[F.struct(F.lit(m).alias("column"), F.col(slot).alias("value")) for slot, m in slots.items()])
    out = sums.select("dimension", "label", F.inline(cells))
    return out.where(F.col("label").isNotNull()) if drop_null_groups else out


def ranked_heads(sums: DataFrame, k: int) -> DataFrame:
    """The k largest groups per (dimension, column) with totals beside them.

    Adds `rank`, `groups`, `total`, `bottom_label`, `bottom_value`. The rank filter prunes to k rows
    per group before the shuffle, totals are a partial aggregate.
    """
    keys = ["dimension", "column"]
    live = sums.where(F.col("value").isNotNull())
    order = W.partitionBy(*keys).orderBy(F.desc("value"), "label")
    heads = live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    low = F.min(F.struct("value", "label"))
    totals = live.groupBy(*keys).agg(
        F.count("*").alias("groups"), F.sum("value").alias("total"), low.alias("low")
    )
    return heads.join(totals, keys).select(
        "*", F.col("low.label").alias("bottom_label"), F.col("low.value").alias("bottom_value")
    ).drop("low")
