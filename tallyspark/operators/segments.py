"""Which groups carry a measure, how much measures vary, and what moves together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import band, share_pct
from tallyspark.operators.groups import group_sums, ranked_heads
from tallyspark.operators.kpis import number


def _head_shares(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per (dimension, column): first label and value, sum of the first three, totals."""
    heads = ranked_heads(group_sums(df, dims, measures), 3)
    first = F.col("rank") == 1
    return heads.groupBy("dimension", "column", "groups", "total", "bottom_label", "bottom_value").agg(
        F.max(F.when(first, F.col("label"))).alias("top_label"),
        F.max(F.when(first, F.col("value"))).alias("top_value"),
        F.sum("value").alias("top3_value"),
    )


def segments(df: DataFrame, dims: Sequence[str], measure: str, digits: int = 2) -> DataFrame:
    """Per dimension: group count, leading and weakest group, share of the first and first three."""
    s = _head_shares(df, dims, [measure])
    pos = F.col("total") > 0
    return s.select(
        "dimension", F.lit(measure).alias("measure"), F.col("groups").alias("group_count"), "top_label",
        F.round("top_value", digits).alias("top_value"),
        F.round(F.when(pos, F.col("top_value") / F.col("total") * 100), 2).alias("top_share_pct"),
        "bottom_label", F.round("bottom_value", digits).alias("bottom_value"),
        F.round(F.when(pos, F.col("top3_value") / F.col("total") * 100), 2).alias("top3_share_pct"),
    )


def dominant_segments(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Findings: a group with at least 20 % of a measure, or three of more than three groups with 60 %."""
    s = _head_shares(df, dims, measures).where(F.col("total") != 0)
    top = F.try_divide("top_value", "total") * 100
    top3 = F.try_divide("top3_value", "total") * 100
    lead = F.when(top >= 20, F.struct(
        F.lit("dominant").alias("kind"), F.col("top_label").alias("label"), top.alias("share_pct"),
        band(top, (60, "high"), (35, "medium"), otherwise="low").alias("confidence"),
        (10 + top / 10).alias("score"),
    ))
    few = F.when((top3 >= 60) & (F.col("groups") > 3), F.struct(
        F.lit("concentrated").alias("kind"), F.lit(None).cast("string").alias("label"), top3.alias("share_pct"),
        F.lit("medium").alias("confidence"), F.lit(7.0).alias("score"),
    ))
    found = s.select("dimension", "column", F.inline(F.filter(F.array(lead, few), lambda x: x.isNotNull())))
    return found.select(
        "dimension", "column", "kind", "label", F.round("share_pct", 2).alias("share_pct"), "confidence",
        F.round("score", 2).alias("score"),
    )


def concentration(df: DataFrame, kinds: dict[str, str], measure: str) -> DataFrame:
    """Share of the first and first three groups of each dimension; `kinds` maps signal name to column."""
    names = F.create_map(*[F.lit(v) for kind, dim in kinds.items() for v in (dim, kind)])
    s = _head_shares(df, list(kinds.values()), [measure])
    return s.where((F.col("groups") >= 2) & (F.abs("total") > 1e-12)).select(
        names[F.col("dimension")].alias("type"), "dimension", F.col("top_label").alias("top_segment"),
        F.round(share_pct(F.col("top_value"), F.col("total")), 2).alias("top_share_pct"),
        F.round(share_pct(F.col("top3_value"), F.col("total")), 2).alias("top3_share_pct"),
    )


def volatility(df: DataFrame, measures: Sequence[str], digits: int = 6) -> DataFrame:
    """Coefficient of variation per measure; the widest above 0.5 and the narrowest below 0.15 are named."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("column"), F.try_divide(F.stddev_samp(number(m)), F.abs(F.avg(number(m)))).alias("cv"))
        for m in measures
    ])
    cv = df.agg(cells.alias("c")).select(F.inline("c")).where(F.col("cv").isNotNull())
    ends = cv.agg(F.struct(
        F.max(F.struct("cv", "column")).alias("hi"), F.min(F.struct("cv", "column")).alias("lo"),
        F.count("*").alias("n"),
    ).alias("e")).scalar()
    e = F.col("ends")
    role = (
        F.when((F.col("column") == e["hi"]["column"]) & (F.col("cv") > 0.5) & (F.lit(len(measures)) >= 2), "most_volatile")
        .when((F.col("column") == e["lo"]["column"]) & (F.col("cv") < 0.15) & (e["n"] > 1), "steadiest")
    )
    return cv.withColumn("ends", ends).select(
        "column", F.round("cv", digits).alias("variation"), role.alias("role")
    )


def drivers(df: DataFrame, target: str, features: Sequence[str], top: int = 8, min_rows: int = 5) -> DataFrame:
    """Pearson r of the target with each feature over complete pairs, one aggregate for all features."""
    t = number(target)

    def block(f: str):
        x = number(f)
        both = t.isNotNull() & x.isNotNull()
        tb, xb = F.when(both, t), F.when(both, x)
        return F.struct(
            F.lit(f).alias("feature"), F.corr(t, x).alias("r"), F.count_if(both).alias("pairs"),
            ((F.min(tb) < F.max(tb)) & (F.min(xb) < F.max(xb))).alias("varies"),
        )

    rows = df.agg(F.array(*[block(f) for f in features]).alias("b")).select(F.inline("b"))
    size = F.abs("r")
    return (
        rows.where((F.col("pairs") >= min_rows) & F.col("varies") & F.col("r").isNotNull() & ~F.isnan("r"))
        .orderBy(F.desc(size), "feature").limit(top)
        .select(
            F.lit(target).alias("target"), "feature", F.round("r", 4).alias("correlation"),
            F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"),
            band(size, (0.7, "strong"), (0.4, "moderate"), otherwise="weak").alias("strength"),
        )
    )
