"""Descriptive numbers per measure, outliers and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.names import human
from tallyspark.functions.numbers import band, measure_text, pct_change
from tallyspark.operators.quantiles import column_stats


def number(column: str) -> Column:
    return F.expr(f"try_cast(`{column}` as double)")


def kpis(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Sum, mean, median, min, max, sample deviation, count and nulls; all-null columns are left out."""
    stats = column_stats(df, columns, {"median": 0.5})
    parts = ["sum", "mean", "median", "min", "max"]
    return stats.select(
        "column", *[F.round(p, digits).alias(p) for p in parts],
        F.when(F.col("n") > 1, F.round("sd", digits)).alias("std"), F.col("n").alias("count"), F.col("nulls").alias("null_count"))


def moments(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar struct: per column a struct of count, mean and sample deviation."""
    blocks = [
        F.struct(
            F.count(number(c)).alias("n"), F.avg(number(c)).alias("mean"),
            F.stddev_samp(number(c)).alias("sd"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(F.struct(*blocks).alias("s")).scalar()


def zscore_outliers(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], limit_z: float = 2.0, min_rows: int = 4
) -> DataFrame:
    """Rows more than `limit_z` sample deviations from the mean, with their keys.

    The statistics are one row; only flagged cells are exploded.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), number(c).alias("value"), F.col("_s")[c].alias("s"))
        for c in columns
    ])
    flagged = F.filter(
        cells,
        lambda t: (t["s"]["n"] >= min_rows) & (t["s"]["sd"] > 0)
        & (F.abs(F.try_divide(t["value"] - t["s"]["mean"], t["s"]["sd"])) > limit_z),
    )
    rows = df.withColumn("_s", moments(df, columns)).select(*keys, F.inline(flagged))
    z = F.try_divide(F.col("value") - F.col("s.mean"), F.col("s.sd"))
    return rows.select(*keys, "column", F.round("value", 2).alias("value"), F.round(z, 2).alias("z_score"))


def iqr_fences(df: DataFrame, columns: Sequence[str], min_rows: int = 5) -> DataFrame:
    """One row per column: median and the usual and severe value range.

    1.5 and 3 quartile ranges beyond the quartiles; with a zero quartile range 2.5 and 3.5 sample
    deviations around the mean; constant and short columns have no fence.
    """
    stats = column_stats(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    robust = iqr > 0

    def fence(base: str, sign: int, by_iqr: float, by_sd: float) -> Column:
        return F.when(robust, F.col(base) + sign * by_iqr * iqr).otherwise(
            F.col("mean") + sign * by_sd * F.col("sd")
        )

    return stats.where(
        (F.col("n") >= min_rows) & (robust | (F.col("sd") > 0))
    ).select(
        "column", "median",
        fence("q1", -1, 1.5, 2.5).alias("low"), fence("q3", 1, 1.5, 2.5).alias("high"),
        fence("q1", -1, 3.0, 3.5).alias("severe_low"), fence("q3", 1, 3.0, 3.5).alias("severe_high"),
        F.when(robust, "robust_range").otherwise("fallback_range").alias("method"),
    )


def fence_scalar(fences: DataFrame, columns: Sequence[str]) -> Column:
    """The fence rows as one scalar struct, a null field where a column has none."""
    row = F.struct("median", "low", "high", "severe_low", "severe_high", "method")
    picks = [F.max(F.when(F.col("column") == c, row)).alias(c) for c in columns]
    return fences.agg(F.struct(*picks).alias("f")).scalar()


def flag_outliers(df: DataFrame, fences: Column, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Cells outside their fence as rows; `fences` is a struct column with a field per column."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), number(c).alias("value"), F.col("fences")[c].alias("f"))
        for c in columns
    ])
    outside = F.filter(cells, lambda t: (t["value"] < t["f"]["low"]) | (t["value"] > t["f"]["high"]))
    f = F.col("f")
    gap = pct_change(F.col("value"), f["median"])
    severe = (F.col("value") > f["severe_high"]) | (F.col("value") < f["severe_low"])
    return df.withColumn("fences", fences).select(*keep, F.inline(outside)).select(
        *keep, "column", "value",
        F.when(F.col("value") > f["high"], "high").otherwise("low").alias("direction"),
        F.when(severe, "high").otherwise("medium").alias("severity"),
        f["median"].alias("typical_value"), f["low"].alias("expected_low"), f["high"].alias("expected_high"),
        gap.alias("gap_pct"), f["method"].alias("method"),
    )


def iqr_outliers(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], context: Sequence[str] = (), top: int | None = 30
) -> DataFrame:
    """The `top` strongest outliers, severe ones first, then by distance from the median in percent; all of
    them, in no order, if `top` is None."""
    fences = fence_scalar(iqr_fences(df, columns), columns)
    rows = flag_outliers(df, fences, columns, [*keys, *[c for c in context if c not in keys]])
    text = F.concat_ws(", ", *[
        F.concat(F.lit(f"{human(c)}="), F.col(c).cast("string")) for c in context
    ]) if context else F.lit("")
    first = F.when(F.col("severity") == "high", 0).otherwise(1)
    rows = rows.withColumn("context", F.nullif(text, F.lit("")))
    if top is not None:
        rows = rows.orderBy(first, F.desc(F.abs(F.coalesce("gap_pct", F.lit(0.0)))), "column", *keys).limit(top)
    return (
        rows.select(
            *keys, "column", F.round("value", 2).alias("value"), "direction", "severity",
            F.round("typical_value", 2).alias("typical_value"),
            F.round("expected_low", 2).alias("expected_low"),
            F.round("expected_high", 2).alias("expected_high"),
            F.round("gap_pct", 2).alias("gap_pct"), "method", "context",
        )
    )


def outlier_sentence() -> Column:
    """Plain sentence for a row of `iqr_outliers`."""
    gap = F.col("gap_pct")
    usual = F.when(
        gap.isNotNull(),
        F.concat(
            F.lit("about "), F.format_string("%.0f", F.abs(gap)),
            F.when(gap > 0, F.lit("% over its median")).otherwise(F.lit("% under its median")),
        ),
    ).otherwise(F.concat(F.lit("far from its median of "), measure_text(F.col("typical_value"))))
    intro = F.when(F.col("severity") == "high", "Strong outlier").otherwise(
        "Outlier"
    )
    where = F.when(F.col("context").isNotNull(), F.concat(F.lit(" for "), F.col("context"))).otherwise("")
    return F.concat(
        intro, F.lit(": "), F.replace(F.col("column"), F.lit("_"), F.lit(" ")), F.lit(" is "),
        measure_text(F.col("value")), where, F.lit(", "), usual,
        F.lit(". Look for the cause."),
    )


def outlier_summary(outliers: DataFrame) -> DataFrame:
    """One row: how many outliers, how many severe ones, and the columns they are in."""
    return outliers.agg(
        F.count("*").alias("unusual_values"),
        F.count_if(F.col("severity") == "high").alias("strong_signals"),
        F.count_if(F.col("direction") == "high").alias("above"),
        F.count_if(F.col("direction") == "low").alias("below"),
        F.concat_ws(",", F.array_sort(F.collect_set("column"))).alias("columns"),
    )


def trends(df: DataFrame, ts: str, measures: Sequence[str], slice_points: int = 20_000) -> DataFrame:
    """Direction of the summed measure over time: increasing, decreasing, flat or mixed.

    Neighbouring sums are compared inside time slices of equal length and then across the slice borders.
    There are as many slices as give each `slice_points` timestamps on average, however many there are.
    """
    slots = {f"m{i}": m for i, m in enumerate(measures)}
    sums = df.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("ts")).agg(
        *[F.sum(number(m)).alias(slot) for slot, m in slots.items()]
    )
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    # The counts keep the ends on the same shuffled sums as the comparison below, which then run once.
    ends = sums.agg(F.struct(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.ceil(F.count(F.lit(1)) / slice_points).alias("slices"),
        *[F.count(slot).alias(slot) for slot in slots]).alias("s")).scalar()
    place = F.try_divide(at - F.col("ends.lo"), F.col("ends.hi") - F.col("ends.lo")) * F.col("ends.slices")
    sliced = sums.withColumn("ends", ends).withColumn("slice", F.coalesce(F.floor(place), F.lit(0)))
    cells = F.array(*[
        F.struct(F.lit(m).alias("column"), F.coalesce(slot, F.lit(0.0)).alias("v")) for slot, m in slots.items()
    ])
    long = sliced.select("slice", "ts", F.inline(cells))
    inner = F.col("v") - F.lag("v").over(W.partitionBy("column", "slice").orderBy("ts"))
    per_slice = long.withColumn("d", inner).groupBy("column", "slice").agg(
        F.count("*").alias("points"), F.min("d").alias("dmin"), F.max("d").alias("dmax"),
        F.min_by("v", "ts").alias("first"), F.max_by("v", "ts").alias("last"),
    )
    border = F.col("first") - F.lag("last").over(W.partitionBy("column").orderBy("slice"))
    whole = per_slice.withColumn("d", border).groupBy("column").agg(
        F.sum("points").alias("points"),
        F.min(F.least("dmin", "d")).alias("dmin"), F.max(F.greatest("dmax", "d")).alias("dmax"),
        F.min_by("first", "slice").alias("first"), F.max_by("last", "slice").alias("last"),
    )
    direction = (
        F.when((F.col("dmin") == 0) & (F.col("dmax") == 0), "flat")
        .when(F.col("dmin") >= 0, "increasing").when(F.col("dmax") <= 0, "decreasing").otherwise("mixed")
    )
    change = F.coalesce(pct_change(F.col("last"), F.col("first")), F.lit(0.0))
    return whole.where(F.col("points") >= 3).select(
        F.lit(ts).alias("dimension"), "column", direction.alias("direction"),
        F.round(change, 2).alias("pct_change"), "points",
    )


def trend_sentence() -> Column:
    return F.concat(
        F.replace(F.col("column"), F.lit("_"), F.lit(" ")), F.lit(" has a "), F.col("direction"),
        F.lit(" course over time, with a change of "), F.format_string("%+.1f", F.col("pct_change")),
        F.lit("%."),
    )


def reliability_band(accuracy: Column) -> Column:
    return F.when(accuracy.isNull(), "insufficient_data").otherwise(
        band(accuracy, (90, "excellent"), (80, "good"), (70, "fair"), otherwise="poor")
    )
