"""Many time series at once: period, grid, windows, baseline forecasts and model choice.

A series table has the key columns, `at` (date) and `value`; after `indexed` also `t` (0-based place)
and `n` (length). After resampling a series has one row per calendar period, so a window per series
is bounded by the calendar, not by the number of events behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush, heappushpop

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyspark.functions.numbers import clamp
from tallyspark.operators.kpis import number, reliability_band
from tallyspark.session import ship

# The closed-form models, simplest first, and all models in order of preference.
BASELINES = ("naive", "mean", "median", "drift", "moving_average", "linear_trend", "seasonal_naive")
MODELS = ("naive", "mean", "median", "drift", "moving_average", "linear_trend", "exponential_smoothing",
          "holt_linear_damped", "seasonal_naive", "holt_winters_additive")
# Z of the 80 % and 95 % bands, sigma per mean absolute error.
Z80, Z95, MAE_PER_SIGMA = 1.28, 1.96, 0.8
DEFAULT_SEASON, SEASONS = 7, (4, 7, 12)


def infer_period(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """D, W or MS per series from the median gap, in whole days, between its distinct times.

    Gaps inside a day are all zero, so a day needs only its number of times, first and last; the
    gaps between days then come from one row per day.
    """
    at = F.col(ts).cast("timestamp_ntz")
    days = (
        df.where(at.isNotNull()).groupBy(*keys, at.alias("at")).agg(F.lit(1).alias("one"))
        .groupBy(*keys, F.to_date("at").alias("day"))
        .agg(F.count("*").alias("times"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    )
    before = F.lag("hi").over(W.partitionBy(*keys).orderBy("day"))
    gap = F.timestamp_diff("DAY", F.col("before"), F.col("lo"))
    weighted = days.withColumn("before", before).select(
        *keys, F.inline(F.array(
            F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("times") - 1).alias("weight")),
            F.struct(gap.alias("gap"), F.lit(1).cast("bigint").alias("weight")),
        ))
    ).where(F.col("gap").isNotNull())
    middle = weighted.groupBy(*keys).agg(F.expr("percentile(gap, 0.5, weight)").alias("median_gap_days"))
    code = F.when(F.col("median_gap_days") <= 2, "D").when(F.col("median_gap_days") <= 10, "W").otherwise("MS")
    return days.select(*keys).distinct().join(middle, list(keys), "left").select(
        *keys, "median_gap_days", F.coalesce(F.when(F.col("median_gap_days").isNotNull(), code), F.lit("D")).alias("period"))


def period_bin(at: Column, code: Column) -> Column:
    """Grid label of a time: the day, the Sunday that ends the week, or the first of the month."""
    week = F.date_add(F.trunc(at.cast("date"), "week"), 6)
    return F.when(code == "D", at.cast("date")).when(code == "W", week).otherwise(F.trunc(at.cast("date"), "month"))


def step_from(at: Column, code: Column, k: Column) -> Column:
    return (
        F.when(code == "D", F.date_add(at, k.cast("int"))).when(code == "W", F.date_add(at, (k * 7).cast("int")))
        .otherwise(F.add_months(at, k.cast("int")))
    )


def resample_fill(df: DataFrame, ts: str, value: str, keys: Sequence[str], code: Column | str = "MS") -> DataFrame:
    """Sums on the period grid of each series, empty periods 0: rows (keys, period, at, value)."""
    period = F.lit(code) if isinstance(code, str) else code
    sums = (
        df.where(F.col(ts).isNotNull()).withColumn("period", period)
        .groupBy(*keys, "period", period_bin(F.col(ts), F.col("period")).alias("at"))
        .agg(F.coalesce(F.sum(number(value)), F.lit(0.0)).alias("value"))
    )
    # Asking for the values too keeps the ends on the same shuffled sums as the join below.
    ends = sums.groupBy(*keys, "period").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("value").alias("top")).where(
        F.col("top") >= float("-inf"))
    grid = ends.select(*keys, "period", F.explode(
        F.when(F.col("period") == "D", F.sequence("lo", "hi", F.expr("interval 1 day")))
        .when(F.col("period") == "W", F.sequence("lo", "hi", F.expr("interval 7 day")))
        .otherwise(F.sequence("lo", "hi", F.expr("interval 1 month")))).alias("at"))
    return grid.join(sums, [*keys, "period", "at"], "left").select(
        *keys, "period", "at", F.coalesce("value", F.lit(0.0)).alias("value"))


def indexed(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds place `t`, length `n` and season length where the history is long enough."""
    w = W.partitionBy(*keys)
    out = series.withColumn("t", F.row_number().over(w.orderBy("at")) - 1).withColumn("n", F.count("*").over(w))
    season = (
        F.when((F.col("period") == "D") & (F.col("n") >= 21), 7).when((F.col("period") == "MS") & (F.col("n") >= 24), 12)
        .when((F.col("period") == "W") & (F.col("n") >= 12), 4)
    )
    return out.withColumn("season", F.coalesce(season, F.lit(DEFAULT_SEASON)))


def moving_average(series: DataFrame, keys: Sequence[str], window: int = 3) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(-(window - 1), 0)
    return series.withColumn("smoothed", F.avg("value").over(w))


class RunningMedian:
    """The middle of the values so far, from two heaps: the lower half and the upper half."""

    def __init__(self):
        self.low, self.high = [], []  # the lower half is negated

    def add(self, value: float) -> None:
        heappush(self.high, -heappushpop(self.low, -value))
        if len(self.high) > len(self.low):
            heappush(self.low, -heappop(self.high))

    @property
    def value(self) -> float | None:
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else 0.5 * -self.low[0] + 0.5 * self.high[0]


def with_median_before(series: DataFrame, keys: Sequence[str], name: str = "median_before") -> DataFrame:
    """The series with the median of the values before each point, null for the first one.

    Points of a series pass by in order and are added to its heaps, so a series of n points takes n log n steps; a
    null value adds nothing.
    """
    import pyarrow as pa

    keys = list(keys)

    def run(batches):
        last, median = None, None
        for batch in batches:
            out = []
            places = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows
            for place, value in zip(places, batch.column("value").to_pylist()):
                if median is None or place != last:
                    last, median = place, RunningMedian()
                out.append(median.value)
                if value is not None:
                    median.add(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    ship(series.sparkSession)
    schema = T.StructType([*series.schema.fields, T.StructField(name, T.DoubleType())])
    dealt = series.repartition(*keys) if keys else series.coalesce(1)
    return dealt.sortWithinPartitions(*keys, "t").mapInArrow(run, schema)


def baseline_points(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, t, n, actual, model, ahead, fitted): one-step forecasts from the past and in-sample fits."""
    w = W.partitionBy(*keys).orderBy("t")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    v, t = F.col("value"), F.col("t").cast("double")
    first = F.first("value").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    last = F.lag("value").over(w)
    # One lag per season length that there is; before a season has passed, the first value.
    seasonal = F.lit(None).cast("double")
    for length in SEASONS:
        seasonal = F.when(F.col("season") == length, F.lag("value", length).over(w)).otherwise(seasonal)
    seasonal = F.when(F.col("t") == 0, v).otherwise(F.coalesce(seasonal, first))
    slope, icept = F.regr_slope(v, t), F.regr_intercept(v, t)
    final = F.last("value").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))

    def line(frame) -> Column:
        # One earlier value gives no slope; the line is then that value.
        return F.coalesce(icept.over(frame), F.first("value").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))) + F.coalesce(
            slope.over(frame), F.lit(0.0)) * t

    drift_all = F.try_divide(final - first, F.col("n") - 1)
    forecasts = {
        "naive": (last, F.coalesce(last, v)),
        "mean": (F.avg("value").over(past), F.avg("value").over(whole)),
        "median": (F.col("median_before"), F.percentile(v, F.lit(0.5)).over(whole)),
        "drift": (first + F.try_divide(last - first, t - 1) * t, first + drift_all * t),
        "moving_average": (F.avg("value").over(w.rowsBetween(-3, -1)), F.avg("value").over(w.rowsBetween(-2, 0))),
        "linear_trend": (line(past), line(whole)),
        "seasonal_naive": (seasonal, F.when(F.col("t") >= F.col("season"), seasonal).otherwise(v)),
    }
    rows = with_median_before(series, keys)
    for i, (ahead, fitted) in enumerate(forecasts.values()):
        rows = rows.withColumn(f"a{i}", ahead).withColumn(f"f{i}", fitted)
    cells = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"a{i}").alias("ahead"), F.col(f"f{i}").alias("fitted"))
        for i, m in enumerate(forecasts)
    ])
    return rows.select(*keys, "t", "n", v.alias("actual"), F.inline(cells))


def walk_start(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(n / 2))


def model_scores(points: DataFrame, keys: Sequence[str], min_points: int = 5) -> DataFrame:
    """Walk-forward and in-sample errors per (series, model); zero actuals have no percent error."""
    nonzero = F.abs("actual") > 1e-9
    tested = (F.col("t") >= walk_start(F.col("n"))) & nonzero & F.col("ahead").isNotNull()
    miss, fit_miss = F.abs(F.col("actual") - F.col("ahead")), F.abs(F.col("actual") - F.col("fitted"))
    size = F.abs("actual")
    s = points.where(F.col("n") >= min_points).groupBy(*keys, "model").agg(
        (F.avg(F.when(tested, F.try_divide(miss, size))) * 100).alias("mape"), F.avg(F.when(tested, miss)).alias("mae"),
        (F.avg(F.when(nonzero, F.try_divide(fit_miss, size))) * 100).alias("in_sample_mape"),
        F.count_if(tested).alias("tested"),
    )
    ins = F.col("in_sample_mape")
    ratio = F.when(ins > 1e-9, F.try_divide("mape", ins)).when(F.col("mape") <= 1e-9, 1.0).otherwise(float("inf"))
    return s.where(F.col("mape").isNotNull()).withColumn("overfit_ratio", ratio).withColumn("overfit", ratio > 1.5)


def model_order(model: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODELS]), model)


def select_models(points: DataFrame, keys: Sequence[str], min_points: int = 5) -> DataFrame:
    """Chosen model per series: the best one, or an inverse-error blend of the best three if that is better.

    Overfit models and models worse than naive stand back as long as any other is left. Rows: keys,
    model, weight, members, mape, mae, naive_mape; a blend has one row per member.
    """
    keys = list(keys)
    w = W.partitionBy(*keys)
    scores = model_scores(points, keys, min_points)
    naive = F.max(F.when(F.col("model") == "naive", F.col("mape"))).over(w)
    good = ~F.col("overfit") & (F.col("naive_mape").isNull() | (F.col("mape") <= F.col("naive_mape") * 1.01))
    ranked = (
        scores.withColumn("naive_mape", naive).withColumn("good", good)
        .withColumn("any_good", F.max("good").over(w)).where(F.col("good") | ~F.col("any_good"))
        .withColumn("rank", F.row_number().over(w.orderBy("mape", model_order(F.col("model"))))).where(F.col("rank") <= 3)
        .withColumn("inverse", 1 / F.greatest("mape", F.lit(1e-9)))
        .withColumn("weight", F.col("inverse") / F.sum("inverse").over(w))
        .withColumn("members", F.count("*").over(w))
    )
    nonzero = F.abs("actual") > 1e-9
    blend = (
        points.where((F.col("t") >= walk_start(F.col("n"))) & nonzero).join(
            ranked.select(*keys, "model", "weight", "members"), [*keys, "model"])
        .groupBy(*keys, "t", "actual", "members").agg(
            F.sum(F.col("weight") * F.col("ahead")).alias("ahead"), F.count("ahead").alias("have"))
        .where(F.col("have") == F.col("members"))
        .groupBy(*keys).agg(
            (F.avg(F.abs(F.col("actual") - F.col("ahead")) / F.abs("actual")) * 100).alias("blend_mape"),
            F.avg(F.abs(F.col("actual") - F.col("ahead"))).alias("blend_mae"))
    )
    best = F.min("mape").over(w)
    both = ranked.withColumn("best_mape", best).join(blend, keys, "left")
    blended = (F.col("members") >= 2) & F.coalesce(F.col("blend_mape") < F.col("best_mape"), F.lit(False))
    return both.where(blended | (F.col("rank") == 1)).select(
        *keys, "model", "rank", F.when(blended, "ensemble").otherwise("single").alias("kind"),
        F.when(blended, F.col("weight")).otherwise(1.0).alias("weight"),
        F.when(blended, F.col("blend_mape")).otherwise(F.col("mape")).alias("mape"),
        F.when(blended, F.col("blend_mae")).otherwise(F.col("mae")).alias("mae"),
        "naive_mape", "in_sample_mape", "overfit_ratio",
    )


def baseline_futures(series: DataFrame, keys: Sequence[str], horizon: int = 6) -> DataFrame:
    """Rows (keys, model, step, forecast) of the closed-form models beyond the end of each series."""
    v, t = F.col("value"), F.col("t").cast("double")
    ends = series.groupBy(*keys, "n", "season").agg(
        F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"), F.avg("value").alias("mean"),
        F.expr("percentile(value, 0.5)").alias("median"), F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("icept"),
        F.avg(F.when(F.col("t") >= F.col("n") - 3, v)).alias("smooth"),
        F.array_sort(F.collect_list(F.when(F.col("t") >= F.col("n") - F.col("season"), F.struct("t", "value")))).alias("cycle"),
    )
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(horizon), F.col("n")).cast("int"))))
    n, k = F.col("n"), F.col("step")
    drift = F.coalesce(F.try_divide(F.col("last") - F.col("first"), n - 1), F.lit(0.0))
    seasonal = F.expr("try_element_at(cycle, cast((step - 1) % least(season, n) as int) + 1)")["value"]
    out = {
        "naive": F.col("last"), "mean": F.col("mean"), "median": F.col("median"),
        "drift": F.col("first") + drift * (n - 1 + k), "moving_average": F.col("smooth"),
        "linear_trend": F.coalesce("icept", "last") + F.coalesce("slope", F.lit(0.0)) * (n - 1 + k),
        "seasonal_naive": F.coalesce(seasonal, F.col("last")),
    }
    cells = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("forecast")) for m, c in out.items()])
    return steps.select(*keys, "step", F.inline(cells))


def forecast_points(
    series: DataFrame, points: DataFrame, futures: DataFrame, keys: Sequence[str], valid_accuracy: float = 70.0
) -> DataFrame:
    """Forecast steps per series with bands, accuracy and validity.

    Sigma is the walk-forward error over 0.8; a series too short to test uses its line (four points or
    more) or last value, the in-sample deviation, and is never valid.
    """
    keys = list(keys)
    chosen = select_models(points, keys)
    ends = series.groupBy(*keys, "period", "n").agg(
        F.max("at").alias("last_at"), F.max_by("value", "t").alias("last_value"))
    model = F.when(F.col("n") >= 4, "linear_trend").otherwise("naive")
    short = ends.join(chosen.select(*keys).distinct(), keys, "left_anti").select(
        *keys, model.alias("model"), F.lit(1).alias("rank"), F.lit("untested").alias("kind"), F.lit(1.0).alias("weight"),
        F.lit(None).cast("double").alias("mape"), F.lit(None).cast("double").alias("mae"))
    used = chosen.select(*short.columns).unionByName(short)
    resid = points.join(used.select(*keys, "model", "weight"), [*keys, "model"]).groupBy(*keys, "t", "actual").agg(
        F.sum(F.col("weight") * F.col("fitted")).alias("fit")).groupBy(*keys).agg(
        F.stddev_pop(F.col("actual") - F.col("fit")).alias("resid_sd"))
    method = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "model"))), lambda x: x["model"]), "+")
    steps = (
        futures.join(used, [*keys, "model"]).groupBy(*keys, "step", "kind", "mape", "mae").agg(
            F.sum(F.col("weight") * F.col("forecast")).alias("value"), method.alias("method"))
        .join(ends, keys).join(resid, keys, "left")
    )
    sigma = F.when(F.col("mae") > 0, F.col("mae") / MAE_PER_SIGMA).otherwise(F.coalesce("resid_sd", F.lit(0.0)))
    accuracy = F.round(F.greatest(F.lit(0.0), 100 - F.col("mape")), 1)
    final = F.max_by("value", "step").over(W.partitionBy(*keys))
    projected = F.coalesce(F.try_divide(final, F.col("last_value")) * 100 - 100, F.lit(0.0))
    v = F.col("value")
    return steps.withColumn("sigma", sigma).withColumn("accuracy_pct", accuracy).withColumn("projected", projected).select(
        *keys, "step", F.date_format(step_from(F.col("last_at"), F.col("period"), F.col("step")), "yyyy-MM-dd").alias("label"),
        F.round(v, 2).alias("value"), F.round(v - Z80 * F.col("sigma"), 2).alias("lower80"),
        F.round(v + Z80 * F.col("sigma"), 2).alias("upper80"), F.round(v - Z95 * F.col("sigma"), 2).alias("lower95"),
        F.round(v + Z95 * F.col("sigma"), 2).alias("upper95"), "method", "kind", "accuracy_pct",
        reliability_band(F.col("accuracy_pct")).alias("reliability"),
        F.coalesce(F.col("accuracy_pct") >= valid_accuracy, F.lit(False)).alias("valid"),
        F.round("projected", 2).alias("projected_pct_change"),
    )


def forecast_labels(series: DataFrame, keys: Sequence[str], horizon: int = 6) -> DataFrame:
    """Labels of the periods after the end of each series."""
    ends = series.groupBy(*keys, "period").agg(F.max("at").alias("last"))
    return ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, "step", F.date_format(step_from(F.col("last"), F.col("period"), F.col("step")), "yyyy-MM-dd").alias("label"))


def confidence(rows, null_pct, dup_pct, hypotheses, trends, outliers, reliability, warnings) -> Column:
    """Confidence 0..100 in an analysis from its size, data quality and number of signals."""
    boost = F.when(reliability == "high", 8.0).when(reliability == "medium", 4.0).when(reliability == "low", -3.0).otherwise(0.0)
    return clamp(
        45.0 + F.least(F.lit(20.0), F.log10(F.greatest(rows, F.lit(1)).cast("double")) * 7)
        - F.least(F.lit(18.0), null_pct * 0.35) - F.least(F.lit(10.0), dup_pct * 0.25)
        + F.least(F.lit(10.0), hypotheses * 2.0) + F.least(F.lit(5.0), trends * 1.5) + F.least(F.lit(5.0), outliers * 0.5)
        + boost - F.least(F.lit(12.0), warnings * 3.0), 0.0, 100.0)
