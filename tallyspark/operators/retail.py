"""Ratios a shop asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import band
from tallyspark.operators.kpis import number


def discount_effect(df: DataFrame, discount: str, metric: str) -> DataFrame:
    """Correlation of discount and metric, from eight complete rows with three different discounts on.

    Whether there are three different discounts is told by their least, greatest and any third value,
    so no distinct set is built.
    """
    d, m = number(discount), number(metric)
    pairs = df.select(d.alias("d"), m.alias("m")).where(F.col("d").isNotNull() & F.col("m").isNotNull())
    ends = pairs.agg(F.struct(F.min("d").alias("lo"), F.max("d").alias("hi")).alias("e")).scalar()
    stats = pairs.withColumn("e", ends).agg(
        F.corr("d", "m").alias("r"), F.count("*").alias("n"),
        F.count_if((F.col("d") > F.col("e.lo")) & (F.col("d") < F.col("e.hi"))).alias("between"),
        F.min("m").alias("mlo"), F.max("m").alias("mhi"),
    )
    size = F.abs("r")
    return stats.where(
        (F.col("n") >= 8) & (F.col("between") > 0) & (F.col("mlo") < F.col("mhi")) & ~F.isnan("r")
    ).select(
        F.lit(metric).alias("metric"), F.lit(discount).alias("discount_column"),
        F.round("r", 4).alias("correlation"),
        band(size, (0.6, "strong"), (0.35, "moderate"), otherwise="weak").alias("strength"),
    )


def profit_margin(df: DataFrame, revenue: str, profit: str) -> DataFrame:
    s = df.agg(F.sum(number(profit)).alias("p"), F.sum(number(revenue)).alias("r"))
    return s.where(F.abs("r") > 1e-12).select(F.round(F.col("p") / F.col("r") * 100, 2).alias("margin_pct"))


def revenue_per_unit(df: DataFrame, revenue: str, quantity: str) -> DataFrame:
    r, q = number(revenue), number(quantity)
    s = df.where(r.isNotNull() & q.isNotNull()).agg(
        F.count("*").alias("n"), F.sum(r).alias("r"), F.sum(q).alias("q")
    )
    return s.where((F.col("n") >= 5) & (F.col("q") > 0)).select(F.round(F.col("r") / F.col("q"), 4).alias("revenue_per_unit"))
