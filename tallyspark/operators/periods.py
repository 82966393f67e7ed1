"""Period over period: totals, contribution of segments, and where a change sits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.names import human
from tallyspark.functions.numbers import pct_change, share_pct
from tallyspark.operators.groups import by_dimension, group_sums
from tallyspark.operators.kpis import number

# Smallest span in days for each period length.
YEAR_SPAN, MONTH_SPAN, WEEK_SPAN = 730, 90, 21


def period_start(unit: Column, at: Column) -> Column:
    """Start of the year, month, Monday week or day."""
    return (
        F.when(unit == "year", F.date_trunc("year", at)).when(unit == "month", F.date_trunc("month", at))
        .when(unit == "week", F.date_trunc("week", at)).otherwise(F.date_trunc("day", at))
    )


def period_label(unit: Column, start: Column) -> Column:
    day = F.date_format(start, "yyyy-MM-dd")
    end = F.date_format(F.date_add(start.cast("date"), 6), "yyyy-MM-dd")
    return (
        F.when(unit == "year", F.date_format(start, "yyyy")).when(unit == "month", F.date_format(start, "yyyy-MM"))
        .when(unit == "week", F.concat(day, F.lit("/"), end)).otherwise(day)
    )


def period_totals(df: DataFrame, metric: str, ts: str) -> DataFrame:
    """Rows (granularity, start, value); the period length follows from the span of the data.

    The input is summed to days first, so what is looked at twice has one row per calendar day.
    """
    x = number(metric)
    at = F.col(ts).cast("timestamp_ntz")
    daily = (
        df.select(at.alias("at"), x.alias("x")).where(F.col("at").isNotNull() & F.col("x").isNotNull())
        .groupBy(F.date_trunc("day", "at").alias("day"))
        .agg(F.sum("x").alias("x"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    )
    # Both readers of the daily sums ask for all of their columns, so the sums are made once.
    days = F.timestamp_diff("DAY", F.min("lo"), F.max("hi"))
    span = daily.agg(F.struct(days.alias("d"), F.count("x").alias("x")).alias("s")).scalar()["d"]
    unit = (
        F.when(F.col("span") >= YEAR_SPAN, "year").when(F.col("span") >= MONTH_SPAN, "month")
        .when(F.col("span") >= WEEK_SPAN, "week").otherwise("day")
    )
    return (
        daily.where(F.col("lo") <= F.col("hi")).withColumn("span", span).withColumn("granularity", unit)
        .groupBy("granularity", period_start(F.col("granularity"), F.col("day")).alias("start"))
        .agg(F.sum("x").alias("value"))
    )


def period_comparison(df: DataFrame, metric: str, ts: str, digits: int = 4) -> DataFrame:
    """One row: the last two periods with data, and the change between them. None with one period."""
    # One row per period of the calendar, so these windows stay small.
    whole = W.partitionBy("granularity")
    row = F.struct("value", "start")
    before = (
        period_totals(df, metric, ts).withColumn("period_count", F.count("*").over(whole))
        .withColumn("last", F.max("start").over(whole)).withColumn("prior", F.lag(row).over(whole.orderBy("start")))
        .where((F.col("start") == F.col("last")) & F.col("prior").isNotNull())
        .select("granularity", "period_count", F.col("value").alias("current"), F.col("start").alias("current_start"),
                F.col("prior.value").alias("previous"), F.col("prior.start").alias("previous_start"))
    )
    last = F.col("current_start")
    delta = F.col("current") - F.col("previous")
    return before.select(
        F.lit(metric).alias("metric"), F.lit(ts).alias("date_column"), "granularity",
        period_label(F.col("granularity"), F.col("previous_start")).alias("previous_period"),
        period_label(F.col("granularity"), last).alias("current_period"),
        F.round("previous", digits).alias("previous_value"), F.round("current", digits).alias("current_value"),
        F.round(delta, digits).alias("absolute_change"),
        F.round(pct_change(F.col("current"), F.col("previous")), 2).alias("pct_change"),
        F.when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("was unchanged").alias("direction"),
        "period_count",
    )


def period_series(df: DataFrame, metric: str, ts: str, last: int = 24, digits: int = 4) -> DataFrame:
    """The last periods in order, each with its change from the period before."""
    totals = period_totals(df, metric, ts)
    prior = F.lag("value").over(W.partitionBy("granularity").orderBy("start"))
    return (
        totals.withColumn("prior", prior).orderBy(F.desc("start")).limit(last)
        .select(period_label(F.col("granularity"), F.col("start")).alias("period"),
                F.round("value", digits).alias("value"),
                F.round(F.col("value") - F.col("prior"), digits).alias("change"),
                F.round(pct_change(F.col("value"), F.col("prior")), 2).alias("pct_change"))
    )


@dataclass(frozen=True)
class PeriodWindow:
    """Two neighbouring periods as time bounds; each end is open."""

    granularity: str
    previous_start: datetime
    previous_end: datetime
    current_start: datetime
    current_end: datetime
    change: float | None = None


def resolve_window(df: DataFrame, metric: str, ts: str) -> PeriodWindow | None:
    """The last two periods with data, as literals.

    Two rows reach the driver. With literal bounds the work that follows reads only the files and
    row groups of these two periods.
    """
    rows = (
        period_totals(df, metric, ts)
        .withColumn("end", F.expr(
            "case granularity when 'year' then start + interval 1 year when 'month' then start + interval 1 month "
            "when 'week' then start + interval 7 days else start + interval 1 day end"))
        .orderBy(F.desc("start")).limit(2).select("granularity", "start", "end", "value").collect()
    )
    if len(rows) < 2:
        return None
    cur, prev = rows
    return PeriodWindow(cur["granularity"], prev["start"], prev["end"], cur["start"], cur["end"], cur["value"] - prev["value"])


def in_window(df: DataFrame, ts: str, window: PeriodWindow) -> tuple[DataFrame, Column, Column]:
    """Rows of the two periods, and the predicates that tell them apart."""
    at = F.col(ts)

    def between(lo: datetime, hi: datetime) -> Column:
        kind = dict(df.dtypes)[ts]
        low, high = (F.lit(v.isoformat(sep=" ")).cast(kind) for v in (lo, hi))
        return (at >= low) & (at < high)

    prev = between(window.previous_start, window.previous_end)
    cur = between(window.current_start, window.current_end)
    return df.where(prev | cur), cur, prev


def _both_sums(metric: str, cur: Column, prev: Column) -> list[Column]:
    x = number(metric)
    return [
        F.coalesce(F.sum(F.when(cur, x)), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.when(prev, x)), F.lit(0.0)).alias("previous"),
    ]


def segment_changes(df: DataFrame, metric: str, dims: Sequence[str], ts: str, window: PeriodWindow) -> DataFrame:
    """Rows (dimension, segment, current, previous, delta); a null segment is a segment."""
    rows, cur, prev = in_window(df, ts, window)
    x = number(metric)
    kept = {"cur": F.when(cur, x), "prev": F.when(prev, x)}
    zero = F.lit(0.0)
    sums = by_dimension(rows, dims, kept).groupBy("dimension", F.col("label").alias("segment")).agg(
        F.coalesce(F.sum("cur"), zero).alias("current"), F.coalesce(F.sum("prev"), zero).alias("previous"))
    return sums.withColumn("delta", F.col("current") - F.col("previous"))


def contribution_change(
    df: DataFrame, metric: str, dims: Sequence[str], ts: str, window: PeriodWindow, top: int = 8, digits: int = 4
) -> DataFrame:
    """Per dimension the segments with the largest change, and their share of the change in its direction."""
    changes = segment_changes(df, metric, dims, ts, window)
    up = F.sum(F.when(F.col("delta") > 0, F.col("delta")))
    down = F.sum(F.when(F.col("delta") < 0, -F.col("delta")))
    overall = changes.groupBy("dimension").agg(
        F.sum("delta").alias("overall"), F.coalesce(up, F.lit(0.0)).alias("up"),
        F.coalesce(down, F.lit(0.0)).alias("down"),
    )
    order = W.partitionBy("dimension").orderBy(F.desc(F.abs("delta")), F.col("segment").asc_nulls_first())
    heads = changes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    rising = F.col("overall") >= 0
    aligned = F.when(rising, F.col("delta") > 0).otherwise(F.col("delta") < 0)
    base = F.when(rising, F.col("up")).otherwise(F.col("down"))
    return heads.join(overall, "dimension").select(
        "dimension", "rank", "segment", F.round("current", digits).alias("current"),
        F.round("previous", digits).alias("previous"), F.round("delta", digits).alias("absolute_change"),
        F.round(pct_change(F.col("current"), F.col("previous")), 2).alias("pct_change"),
        F.round(F.when(aligned, F.abs("delta") / base * 100).otherwise(0.0), 2).alias("driver_share_pct"),
    )


def contribution_share(df: DataFrame, metric: str, dims: Sequence[str], top: int = 10, digits: int = 4) -> DataFrame:
    """Per dimension the largest segments and their share of the total; a null segment is a segment."""
    sums = group_sums(df, dims, [metric], drop_null_groups=False)
    order = W.partitionBy("dimension").orderBy(F.desc("value"), F.col("label").asc_nulls_first())
    heads = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = sums.groupBy("dimension").agg(F.sum("value").alias("total"))
    return heads.join(totals, "dimension").select(
        "dimension", "rank", F.col("label").alias("segment"), F.round("value", digits).alias("value"),
        F.round(share_pct(F.col("value"), F.col("total")), 2).alias("share_pct"),
    )


def root_cause_path(
    df: DataFrame, metric: str, dims: Sequence[str], ts: str, window: PeriodWindow, digits: int = 4
) -> DataFrame:
    """One step down per dimension: at each the segment with the largest change in the overall direction.

    One aggregate by all dimensions and period carries every step; a step keeps one segment and sums
    what is left by the next dimension. It stops where nothing changed.
    """
    dims = list(dims)
    rows, cur, prev = in_window(df, ts, window)
    cube = rows.groupBy(*[F.col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)]).agg(
        *_both_sums(metric, cur, prev)
    )
    if window.change is None:
        sign = F.when(cube.agg(F.sum(F.col("current") - F.col("previous"))).scalar() >= 0, 1).otherwise(-1)
    else:
        sign = F.lit(1 if window.change >= 0 else -1)
    left, steps = cube, []
    for i, dim in enumerate(dims):
        sums = left.groupBy(F.col(f"d{i}").alias("segment")).agg(
            F.sum("current").alias("current"), F.sum("previous").alias("previous")
        )
        delta = F.col("current") - F.col("previous")
        best = (
            sums.withColumn("delta", delta)
            .orderBy(F.desc(F.col("delta") * sign), F.desc(F.abs("delta")), F.col("segment").asc_nulls_first())
            .limit(1).where(F.abs("delta") > 1e-12)
        )
        steps.append(best.select(F.lit(i + 1).alias("depth"), F.lit(dim).alias("dimension"), "*"))
        left = left.join(best.select(F.col("segment").alias("chosen")), F.col(f"d{i}").eqNullSafe(F.col("chosen"))).drop("chosen")
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out.select(
        "depth", "dimension", "segment", F.round("current", digits).alias("current"),
        F.round("previous", digits).alias("previous"), F.round("delta", digits).alias("absolute_change"),
        F.round(pct_change(F.col("current"), F.col("previous")), 2).alias("pct_change"),
    )


def business_impact(comparison: DataFrame, contributions: DataFrame, dimension: str) -> DataFrame:
    """The change of the last period with its kind and the leading segment of one dimension."""
    lead = contributions.where((F.col("dimension") == dimension) & (F.col("rank") == 1)).select(
        F.struct("segment", "absolute_change").alias("lead")
    ).scalar()
    change = F.col("absolute_change")
    kind = F.when(change > 0, "uplift").when(change < 0, "gap").otherwise("no_change")
    return comparison.withColumn("lead", lead).select(
        "metric", kind.alias("type"), "absolute_change", "pct_change",
        F.col("lead.segment").alias("leading_segment"), F.col("lead.absolute_change").alias("leading_change"),
    )


def comparison_sentence(metric: str) -> Column:
    pct = F.when(F.col("pct_change").isNotNull(), F.format_string(" (%.1f%%)", F.abs("pct_change"))).otherwise("")
    return F.concat(
        F.lit(human(metric) + " "), F.col("direction"), F.lit(" from "), F.format_string("%,.2f", F.col("previous_value")),
        F.lit(" in "), F.col("previous_period"), F.lit(" to "), F.format_string("%,.2f", F.col("current_value")),
        F.lit(" in "), F.col("current_period"), pct, F.lit("."),
    )
