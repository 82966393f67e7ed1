"""Forecast queries: monthly order totals per country, weekly event values per type."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import series as S
from tallyspark.operators.joins import Edge, denormalize
from tallyspark.operators.smoothing import smoother_rows
from tallyspark.plans.insight import union_all
from tallyspark.plans.views import table
from tallyspark.session import stored

COUNTRY_SQL = """m AS (SELECT n_name AS country, date_trunc('month', o_orderdate)::DATE AS "at", sum(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
g AS (SELECT country, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS "at"
  FROM (SELECT country, min("at") AS lo, max("at") AS hi FROM m GROUP BY 1)),
s AS (SELECT country, "at", coalesce(value, 0) AS value, row_number() OVER (PARTITION BY country ORDER BY "at") - 1 AS t,
  count(*) OVER (PARTITION BY country) AS n FROM g LEFT JOIN m USING (country, "at")),
ser AS (SELECT *, CASE WHEN n >= 24 THEN 12 ELSE 7 END AS season FROM s)"""


def country_months(spark, sf):
    orders = denormalize(
        table(spark, sf, "orders"),
        [Edge(table(spark, sf, "customer"), "o_custkey", "c_custkey"), Edge(table(spark, sf, "nation"), "c_nationkey", "n_nationkey")],
        ["n_name", "o_orderdate", "o_totalprice"])
    return S.resample_fill(orders.withColumnRenamed("n_name", "country"), "o_orderdate", "o_totalprice", ["country"], "MS")


def indexed_months(spark, sf):
    """The monthly series, kept as a table: 12 rows per country and year, read by every model."""
    return stored(S.indexed(country_months(spark, sf), ["country"]), "months")


def baselines(series):
    return stored(S.baseline_points(series, ["country"]), "points")


def q_infer_period(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    # Every order, and beside them a sparser series per customer (numbered below zero).
    sparse = orders.where("o_orderstatus = 'F'").withColumn("o_custkey", -F.col("o_custkey"))
    return S.infer_period(orders.unionAll(sparse), "o_orderdate", ["o_custkey"])


SQL_INFER_PERIOD = """WITH d AS (SELECT o_custkey, o_orderdate AS "at" FROM orders UNION SELECT -o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT o_custkey, datediff('second', lag("at") OVER (PARTITION BY o_custkey ORDER BY "at"), "at") // 86400 AS gap FROM d)
SELECT o_custkey, quantile_cont(gap, 0.5)::DOUBLE AS median_gap_days,
  CASE WHEN count(gap) = 0 OR quantile_cont(gap, 0.5) <= 2 THEN 'D' WHEN quantile_cont(gap, 0.5) <= 10 THEN 'W' ELSE 'MS' END AS period
FROM g GROUP BY 1"""


def q_infer_period_events(spark, sf):
    return S.infer_period(table(spark, sf, "events"), "ts", ["event_type"])


SQL_INFER_PERIOD_EVENTS = """WITH d AS (SELECT DISTINCT event_type, ts AS "at" FROM events),
g AS (SELECT event_type, datediff('microsecond', lag("at") OVER (PARTITION BY event_type ORDER BY "at"), "at") // 86400000000 AS gap FROM d)
SELECT event_type, quantile_cont(gap, 0.5)::DOUBLE AS median_gap_days,
  CASE WHEN quantile_cont(gap, 0.5) <= 2 THEN 'D' WHEN quantile_cont(gap, 0.5) <= 10 THEN 'W' ELSE 'MS' END AS period FROM g GROUP BY 1"""


def _text(df):
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd"))


def q_resample_fill(spark, sf):
    # All rows of both tables, and beside them series of the large ones only, which have gaps.
    events = table(spark, sf, "events").select("event_type", "ts", "value")
    large = events.where("value > 150").withColumn("event_type", F.concat("event_type", F.lit(" large")))
    rows = S.resample_fill(events.unionAll(large), "ts", "value", ["event_type"], "D")
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("event_type"), "o_orderdate", "o_totalprice")
    large = orders.where("o_totalprice > 450000").withColumn("event_type", F.concat("event_type", F.lit(" large")))
    weeks = S.resample_fill(orders.unionAll(large), "o_orderdate", "o_totalprice", ["event_type"], "W")
    out = _text(rows).unionByName(_text(weeks))
    return out.select("event_type", "period", "at", F.round("value", 4).alias("value"))


SQL_RESAMPLE_FILL = """WITH e AS (SELECT event_type, ts, value FROM events UNION ALL SELECT event_type || ' large', ts, value FROM events WHERE value > 150),
o AS (SELECT o_orderstatus, o_orderdate, o_totalprice FROM orders
  UNION ALL SELECT o_orderstatus || ' large', o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 450000),
d AS (SELECT event_type, ts::DATE AS "at", sum(value) AS value FROM e GROUP BY 1, 2),
w AS (SELECT o_orderstatus AS event_type, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE AS "at", sum(o_totalprice) AS value
  FROM o GROUP BY 1, 2),
gd AS (SELECT event_type, unnest(generate_series(min("at")::TIMESTAMP, max("at")::TIMESTAMP, INTERVAL 1 DAY))::DATE AS "at" FROM d GROUP BY 1),
gw AS (SELECT event_type, unnest(generate_series(min("at")::TIMESTAMP, max("at")::TIMESTAMP, INTERVAL 7 DAY))::DATE AS "at" FROM w GROUP BY 1)
SELECT event_type, 'D' AS period, strftime("at", '%Y-%m-%d') AS "at", round(coalesce(value, 0), 4) AS value FROM gd LEFT JOIN d USING (event_type, "at")
UNION ALL SELECT event_type, 'W', strftime("at", '%Y-%m-%d'), round(coalesce(value, 0), 4) FROM gw LEFT JOIN w USING (event_type, "at")"""


def q_moving_average(spark, sf):
    out = S.moving_average(country_months(spark, sf), ["country"])
    return _text(out).select("country", "at", F.round("value", 2).alias("value"), F.round("smoothed", 4).alias("smoothed"))


SQL_MOVING_AVERAGE = f"""WITH {COUNTRY_SQL} SELECT country, strftime("at", '%Y-%m-%d') AS "at", round(value, 2) AS value,
  round(avg(value) OVER (PARTITION BY country ORDER BY "at" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS smoothed FROM ser"""

_P = "PARTITION BY country ORDER BY t"
PAST = f"({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ALL = "(PARTITION BY country)"
SEASONAL = f"list(value) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
MODEL_SQL = {
    "naive": ("prev", "coalesce(prev, value)"),
    "mean": (f"avg(value) OVER {PAST}", f"avg(value) OVER {ALL}"),
    "median": (f"quantile_cont(value, 0.5) OVER {PAST}", f"quantile_cont(value, 0.5) OVER {ALL}"),
    "drift": ("v0 + (prev - v0) / nullif(t - 1, 0) * t", "v0 + (vn - v0) / nullif(n - 1, 0) * t"),
    "moving_average": (f"avg(value) OVER ({_P} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
                       f"avg(value) OVER ({_P} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "linear_trend": (f"coalesce(regr_intercept(value, t) OVER {PAST}, v0) + coalesce(regr_slope(value, t) OVER {PAST}, 0) * t",
                     f"coalesce(regr_intercept(value, t) OVER {ALL}, v0) + coalesce(regr_slope(value, t) OVER {ALL}, 0) * t"),
    "seasonal_naive": (f"({SEASONAL})[greatest(t - season, 0) + 1]", f"CASE WHEN t >= season THEN ({SEASONAL})[t - season + 1] ELSE value END"),
}
POINTS_SQL = f"""{COUNTRY_SQL}, base AS (SELECT *, lag(value) OVER ({_P}) AS prev, first_value(value) OVER ({_P}) AS v0,
  last_value(value) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vn FROM ser),
points AS ({union_all(f"SELECT country, t, n, value AS actual, '{m}' AS model, {a} AS ahead, {f} AS fitted FROM base" for m, (a, f) in MODEL_SQL.items())}),
scores AS (SELECT country, model, avg(CASE WHEN tested THEN abs(actual - ahead) / abs(actual) END) * 100 AS mape,
    avg(CASE WHEN tested THEN abs(actual - ahead) END) AS mae, avg(CASE WHEN nz THEN abs(actual - fitted) / abs(actual) END) * 100 AS in_sample_mape,
    count(*) FILTER (tested) AS tested
  FROM (SELECT *, abs(actual) > 1e-9 AS nz, t >= greatest(3, n // 2) AND abs(actual) > 1e-9 AND ahead IS NOT NULL AS tested FROM points) WHERE n >= 5
  GROUP BY 1, 2)"""


def q_walk_forward(spark, sf):
    scores = S.model_scores(S.baseline_points(indexed_months(spark, sf), ["country"]), ["country"])
    return scores.select("country", "model", F.round("mape", 4).alias("mape"), F.round("mae", 6).alias("mae"),
                         F.round("in_sample_mape", 4).alias("in_sample_mape"), "tested")


SQL_WALK_FORWARD = f"""WITH {POINTS_SQL} SELECT country, model, round(mape, 4) AS mape, round(mae, 6) AS mae,
  round(in_sample_mape, 4) AS in_sample_mape, tested FROM scores"""

_ORDER = "list_position([" + ", ".join(f"'{m}'" for m in S.MODELS) + "], model)"
SELECT_SQL = f"""{POINTS_SQL}, eligible AS (SELECT *, NOT overfit AND mape <= naive_mape * 1.01 AS good FROM (SELECT *,
    CASE WHEN in_sample_mape > 1e-9 THEN mape / in_sample_mape WHEN mape <= 1e-9 THEN 1 ELSE 1e308 END > 1.5 AS overfit,
    max(mape) FILTER (model = 'naive') OVER (PARTITION BY country) AS naive_mape FROM scores)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY mape, {_ORDER}) AS rank
  FROM (SELECT *, bool_or(good) OVER (PARTITION BY country) AS any_good FROM eligible) WHERE good OR NOT any_good) WHERE rank <= 3),
weighted AS (SELECT *, (1 / mape) / sum(1 / mape) OVER (PARTITION BY country) AS weight, count(*) OVER (PARTITION BY country) AS members,
  min(mape) OVER (PARTITION BY country) AS best_mape FROM top),
blend AS (SELECT country, avg(abs(actual - ahead) / abs(actual)) * 100 AS blend_mape, avg(abs(actual - ahead)) AS blend_mae
  FROM (SELECT country, t, actual, sum(weight * ahead) AS ahead FROM points JOIN weighted USING (country, model)
        WHERE t >= greatest(3, n // 2) AND abs(actual) > 1e-9 GROUP BY 1, 2, 3) GROUP BY 1),
chosen AS (SELECT country, model, rank, CASE WHEN b THEN 'ensemble' ELSE 'single' END AS kind, CASE WHEN b THEN weight ELSE 1 END AS weight,
    CASE WHEN b THEN blend_mape ELSE mape END AS mape, CASE WHEN b THEN blend_mae ELSE mae END AS mae, naive_mape
  FROM (SELECT *, members >= 2 AND blend_mape < best_mape AS b FROM weighted JOIN blend USING (country)) WHERE b OR rank = 1)"""


def q_model_selection(spark, sf):
    chosen = S.select_models(baselines(indexed_months(spark, sf)), ["country"])
    return chosen.select("country", "model", "rank", "kind", F.round("weight", 4).alias("weight"),
                         F.round("mape", 4).alias("mape"), F.round("naive_mape", 4).alias("naive_mape"))


SQL_MODEL_SELECTION = f"""WITH {SELECT_SQL} SELECT country, model, rank, kind, round(weight, 4)::DOUBLE AS weight, round(mape, 4) AS mape,
  round(naive_mape, 4) AS naive_mape FROM chosen"""


def q_forecast_baselines(spark, sf):
    out = S.baseline_futures(indexed_months(spark, sf), ["country"])
    return out.select("country", "model", "step", F.round("forecast", 2).alias("forecast"))


SQL_FORECAST_BASELINES = f"""WITH {COUNTRY_SQL}, e AS (SELECT country, any_value(n) AS n, any_value(season) AS season, arg_min(value, t) AS v0, arg_max(value, t) AS vn,
  avg(value) AS mean, quantile_cont(value, 0.5) AS med, regr_slope(value, t) AS sl, regr_intercept(value, t) AS ic,
  avg(CASE WHEN t >= n - 3 THEN value END) AS sm, list(value ORDER BY t) AS vals FROM ser GROUP BY 1),
k AS (SELECT *, unnest(range(1, 7)) AS step FROM e)
""" + union_all(f"SELECT country, '{m}' AS model, step, round({c}, 2) AS forecast FROM k" for m, c in {
    "naive": "vn", "mean": "mean", "median": "med", "drift": "v0 + (vn - v0) / (n - 1) * (n - 1 + step)", "moving_average": "sm",
    "linear_trend": "ic + sl * (n - 1 + step)", "seasonal_naive": "vals[n - season + (step - 1) % season + 1]"}.items())


def q_forecast_labels(spark, sf):
    return S.forecast_labels(country_months(spark, sf), ["country"])


SQL_FORECAST_LABELS = f"""WITH {COUNTRY_SQL} SELECT country, step, strftime(max_at + to_months(step::INT), '%Y-%m-%d') AS label
FROM (SELECT country, max("at") AS max_at, unnest(range(1, 7)) AS step FROM ser GROUP BY 1)"""


def q_forecast_points_baselines(spark, sf):
    ser = indexed_months(spark, sf)
    points = baselines(ser)
    return S.forecast_points(ser, points, S.baseline_futures(ser, ["country"]), ["country"])


SQL_FORECAST_POINTS_BASELINES = f"""WITH {SELECT_SQL}, f AS ({SQL_FORECAST_BASELINES.replace('round(', '(').replace(', 2) AS forecast', ') AS forecast')}),
b AS (SELECT country, step, kind, any_value(mape) AS mape, any_value(mae) AS mae, sum(weight * forecast) AS v,
  string_agg(model, '+' ORDER BY rank) AS method FROM f JOIN chosen USING (country, model) GROUP BY 1, 2, 3),
l AS (SELECT country, max("at") AS last_at, arg_max(value, t) AS lv FROM ser GROUP BY 1),
r AS (SELECT *, mae / 0.8 AS sigma, round(greatest(0, 100 - mape), 1) AS acc, arg_max(v, step) OVER (PARTITION BY country) AS fin FROM b JOIN l USING (country))
SELECT country, step, strftime(last_at + to_months(step::INT), '%Y-%m-%d') AS label, round(v, 2) AS value,
  round(v - 1.28 * sigma, 2) AS lower80, round(v + 1.28 * sigma, 2) AS upper80, round(v - 1.96 * sigma, 2) AS lower95,
  round(v + 1.96 * sigma, 2) AS upper95, method, kind, acc AS accuracy_pct,
  CASE WHEN acc >= 90 THEN 'excellent' WHEN acc >= 80 THEN 'good' WHEN acc >= 70 THEN 'fair' ELSE 'poor' END AS reliability,
  acc >= 70 AS valid, round(fin / lv * 100 - 100, 2) AS projected_pct_change FROM r"""


def q_forecast_smoothing(spark, sf):
    rows = smoother_rows(indexed_months(spark, sf), ["country"])
    return rows.where("step is not null").select("country", "model", "step", F.round("forecast", 2).alias("forecast"))


def q_forecast_points(spark, sf):
    """All ten models compete; the smoothers run once per series and feed points and futures."""
    ser = indexed_months(spark, sf)
    smooth = stored(smoother_rows(ser, ["country"]), "smoothers")
    points = baselines(ser).unionByName(
        smooth.where("step is null").select("country", "t", "n", "actual", "model", "ahead", "fitted"))
    futures = S.baseline_futures(ser, ["country"]).unionByName(
        smooth.where("step is not null").select("country", "step", "model", "forecast"))
    return S.forecast_points(ser, points, futures, ["country"])


QUERIES = {
    "infer_period": (q_infer_period, SQL_INFER_PERIOD),
    "infer_period_events": (q_infer_period_events, SQL_INFER_PERIOD_EVENTS),
    "resample_fill": (q_resample_fill, SQL_RESAMPLE_FILL),
    "moving_average": (q_moving_average, SQL_MOVING_AVERAGE),
    "walk_forward_baselines": (q_walk_forward, SQL_WALK_FORWARD),
    "model_selection": (q_model_selection, SQL_MODEL_SELECTION),
    "forecast_baselines": (q_forecast_baselines, SQL_FORECAST_BASELINES),
    "forecast_labels": (q_forecast_labels, SQL_FORECAST_LABELS),
    "forecast_points_baselines": (q_forecast_points_baselines, SQL_FORECAST_POINTS_BASELINES),
    "forecast_smoothing": (q_forecast_smoothing, None),
    "forecast_points": (q_forecast_points, None),
}
