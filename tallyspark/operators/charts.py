"""Data series behind the charts: heads of groups, time lines, histograms, point clouds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.kpis import number


def category_top(df: DataFrame, dim: str, measures: Sequence[str], top: int = 10, digits: int = 4) -> DataFrame:
    """Sums per group, the `top` groups by the first measure."""
    lead = measures[0]
    return (
        df.where(F.col(dim).isNotNull())
        .groupBy(F.col(dim).cast("string").alias("label"))
        .agg(*[F.sum(number(m)).alias(m) for m in measures])
        .orderBy(F.desc(lead), "label")
        .limit(top)
        .select("label", *[F.round(m, digits).alias(m) for m in measures])
    )


def category_share(df: DataFrame, dim: str, measure: str, digits: int = 2) -> DataFrame:
    """Group sums and shares, only where the dimension has two to six groups."""
    sums = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("label")).agg(
        F.sum(number(measure)).alias("value")
    )
    whole = sums.agg(F.struct(F.count("*").alias("n"), F.sum("value").alias("total")).alias("w")).scalar()
    return (
        sums.withColumn("w", whole).where(F.col("w.n").between(2, 6))
        .select("label", F.round("value", digits).alias("value"),
                F.round(F.try_divide("value", "w.total") * 100, 2).alias("share_pct"))
    )


def category_counts(df: DataFrame, dim: str, top: int = 10) -> DataFrame:
    return (
        df.where(F.col(dim).isNotNull())
        .groupBy(F.col(dim).cast("string").alias("label")).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "label").limit(top)
    )


def radar_series(df: DataFrame, dim: str, measures: Sequence[str], top: int = 8, digits: int = 4) -> DataFrame:
    """Sums of the measures for the most frequent groups, where there are two to eight."""
    sums = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("label")).agg(
        F.count("*").alias("count"), *[F.sum(number(m)).alias(m) for m in measures]
    )
    groups = sums.agg(F.count("*").alias("n")).scalar()
    return (
        sums.where(groups.between(2, 8)).orderBy(F.desc("count"), "label").limit(top)
        .select("label", "count", *[F.round(m, digits).alias(m) for m in measures])
    )


def time_series(df: DataFrame, ts: str, measures: Sequence[str], digits: int = 4) -> DataFrame:
    """Sum per timestamp of the measures; `label` is the timestamp text, which sorts in time."""
    return (
        df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("at"))
        .agg(*[F.sum(number(m)).alias(m) for m in measures])
        .select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("label"),
                *[F.round(F.coalesce(m, F.lit(0.0)), digits).alias(m) for m in measures])
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins from min to max, empty bins kept, the last bin closed; none if constant."""
    x = number(column)
    rng = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("r"))
    width = (F.col("r.hi") - F.col("r.lo")) / bins
    counts = (
        df.select(x.alias("x")).where(F.col("x").isNotNull()).withColumn("r", rng.scalar())
        .where(F.col("r.hi") > F.col("r.lo"))
        .groupBy(F.least(F.floor((F.col("x") - F.col("r.lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("times"))
    )
    edges = rng.where(F.col("r.hi") > F.col("r.lo")).select(
        "r", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )

    def edge(i):
        return F.format_number(F.col("r.lo") + i * width, 1)

    return edges.join(counts, "bin", "left").select(
        "bin", F.concat(edge(F.col("bin")), F.lit("-"), edge(F.col("bin") + 1)).alias("label"),
        F.coalesce("times", F.lit(0)).alias("count"),
    )


def scatter_points(df: DataFrame, x: str, y: str, keys: Sequence[str], top: int = 80) -> DataFrame:
    """The first `top` complete pairs in key order."""
    return df.dropna(subset=[x, y]).orderBy(*keys).limit(top).select(
        *keys, number(x).alias("x"), number(y).alias("y")
    )


def bubble_points(df: DataFrame, x: str, y: str, z: str, keys: Sequence[str], top: int = 60) -> DataFrame:
    """The first `top` complete triples; the radius scales |z| to 2..25 by the largest one shown."""
    pts = df.dropna(subset=[x, y, z]).orderBy(*keys).limit(top).select(
        *keys, number(x).alias("x"), number(y).alias("y"), number(z).alias("z")
    )
    largest = pts.agg(F.max(F.abs("z")).alias("m")).scalar()
    r = F.greatest(F.least(F.try_divide(F.abs("z"), largest) * 25, F.lit(25.0)), F.lit(2.0))
    return pts.where(largest > 0).select(*keys, "x", "y", F.round(r, 4).alias("radius"))
