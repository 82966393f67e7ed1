"""Tabular prediction and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import kpis, learning
from tallyspark.plans.insight import fence_sql, with_sales
from tallyspark.plans.views import EVENTS_NULLS_SQL, events_nulls, sales_flat, table
from tallyspark.session import scratch_dir, small_frame
from tallyspark.streaming import jobs


def q_feature_plan(spark, sf):
    df = sales_flat(spark, sf, ["order_id", "order_date", "region", "customer", "product", "category", "quantity", "sales"]).withColumn(
        "currency", F.lit("EUR")).withColumn("ship_day", F.date_format("order_date", "yyyy-MM-dd")).withColumn("gone", F.lit(None).cast("string"))
    return learning.feature_plan(df, "sales")


SQL_FEATURE_PLAN = with_sales(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct", {plan} AS plan FROM sales_flat""" for c, plan in {
        "order_id": "'drop: identifier'", "order_date": "'date parts'", "region": "'category'",
        "customer": "CASE WHEN count(DISTINCT customer) > 100 OR count(DISTINCT customer) > 30 AND count(DISTINCT customer) / count(*) > 0.55 THEN 'drop: too many different texts' ELSE 'category' END",
        "product": "CASE WHEN count(DISTINCT product) > 100 OR count(DISTINCT product) > 30 AND count(DISTINCT product) / count(*) > 0.55 THEN 'drop: too many different texts' ELSE 'category' END",
        "category": "'category'", "quantity": "'numeric'"}.items()) + """
UNION ALL SELECT 'currency', 1, 'drop: constant' UNION ALL SELECT 'ship_day', count(DISTINCT order_date), 'date parts' FROM sales_flat
UNION ALL SELECT 'gone', 0, 'drop: all values missing'""")


def q_imputed_features(spark, sf):
    return learning.imputed_features(events_nulls(spark, sf), ["value", "user_id"], ["event_type"], ["event_id"])


SQL_IMPUTED_FEATURES = f"""WITH {EVENTS_NULLS_SQL}, m AS (SELECT quantile_cont(value, 0.5) AS v, quantile_cont(user_id, 0.5) AS u FROM events_nulls),
t AS (SELECT event_type AS top FROM events_nulls WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT event_id, coalesce(value, v) AS value, coalesce(user_id, u)::DOUBLE AS user_id, coalesce(event_type, top) AS event_type FROM events_nulls, m, t)
SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value,
  round((user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER (), 6) AS user_id, event_type FROM f"""


def q_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000 + 500).alias("predicted"))
    return learning.regression_metrics(li, "actual", "predicted")


SQL_REGRESSION_METRICS = """WITH p AS (SELECT l_extendedprice AS a, l_quantity * 2000 + 500 AS p FROM lineitem),
s AS (SELECT avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2,
  avg(abs((a - p) / a)) FILTER (abs(a) > 1e-12) * 100 AS mape FROM p)
SELECT round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2, round(mape, 2) AS mape_pct, round(greatest(0, 100 - mape), 2) AS accuracy_like_pct,
  r2 >= 0.3 OR 100 - mape >= 70 AS valid, CASE WHEN r2 >= 0.65 THEN 'high' WHEN r2 >= 0.3 OR 100 - mape >= 70 THEN 'medium' ELSE 'low' END AS reliability FROM s"""


def q_classification_metrics(spark, sf):
    o = table(spark, sf, "orders")
    said = F.when(F.col("o_orderkey") % 4 == 0, "F").when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus"))
    return learning.classification_metrics(o.select(F.col("o_orderstatus").alias("actual"), said.alias("predicted")), "actual", "predicted")


SQL_CLASSIFICATION_METRICS = """WITH p AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS p FROM orders),
c AS (SELECT a, count(*) AS s, count(*) FILTER (a = p) AS h FROM p GROUP BY 1), q AS (SELECT p, count(*) AS n FROM p GROUP BY 1),
m AS (SELECT sum(h) / sum(s) AS acc, sum(2 * h / (s + coalesce(n, 0)) * s) / sum(s) AS f1 FROM c LEFT JOIN q ON c.a = q.p)
SELECT round(acc * 100, 2) AS accuracy_pct, round(f1 * 100, 2) AS weighted_f1_pct, acc >= 0.65 AS valid,
  CASE WHEN acc >= 0.85 THEN 'high' WHEN acc >= 0.65 THEN 'medium' ELSE 'low' END AS reliability FROM m"""


def q_rf_predictions(spark, sf):
    """Price of a part from its brand, type and size."""
    parts = table(spark, sf, "part").withColumn("serial", F.col("p_partkey"))
    out, _, _ = learning.forest(parts.drop("p_name"), "p_retailprice", "p_partkey")
    return out.select("p_partkey", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))


def q_rf_classes(spark, sf):
    """Account class of a customer from nation, segment and balance."""
    c = table(spark, sf, "customer").withColumn("grade", F.when(F.col("c_acctbal") > 5000, "gold").when(F.col("c_acctbal") > 0, "silver").otherwise("none"))
    out, _, _ = learning.forest(c.drop("c_name"), "grade", "c_custkey")
    return out


def q_rf_importances(spark, sf):
    """How much each column says about the grade of a customer."""
    c = table(spark, sf, "customer").withColumn("grade", F.when(F.col("c_acctbal") > 5000, "gold").when(F.col("c_acctbal") > 0, "silver").otherwise("none"))
    _, task, weights = learning.forest(c.drop("c_name"), "grade", "c_custkey")
    return small_frame(spark, [(task, name, round(w, 4)) for name, w in weights], "task string, feature string, importance double")


def q_stratified_holdout(spark, sf):
    """Rows of both parts by order status, and how far the held ones are from a quarter of the class."""
    held = learning.stratified_holdout(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey")
    return held.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("trained"))


SQL_STRATIFIED_HOLDOUT = """SELECT o_orderstatus, count(*) AS "rows", round(count(*) * 0.25)::BIGINT AS held, count(*) - round(count(*) * 0.25)::BIGINT AS trained
FROM orders GROUP BY 1"""


def q_target_choice(spark, sf):
    """The column that each of several goals asks to predict, for three tables."""
    asked = (("orders", "Forecast the o_totalprice per month"), ("orders", "predict o_orderstatus"), ("customer", "which customers are best"),
             ("part", "Compare p_size and p_retailprice"), ("part", "list p_brand"))
    rows = [(t, goal, *learning.choose_target(table(spark, sf, t), goal)) for t, goal in asked]
    return small_frame(spark, rows, "table string, goal string, target string, reason string")


# --- streams -----------------------------------------------------------------------------------


def q_stream_period_sums(spark, sf):
    stream = jobs.read_table_stream(spark, f"{sf}/events.parquet")
    path = jobs.run_updates(jobs.window_sums(stream, "ts", ["event_type"], "value"), "sums")
    out = jobs.latest_updates(spark, path, ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("value", 2).alias("value"), "times")


SQL_STREAM_PERIOD_SUMS = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 2) AS value, count(*) AS times FROM events GROUP BY 1, 2"""


def q_stream_outliers(spark, sf):
    fences = kpis.iqr_fences(table(spark, sf, "events"), ["value"])
    stream = jobs.read_table_stream(spark, f"{sf}/events.parquet")
    path = jobs.run_append(jobs.flagged_stream(stream, fences, ["value"], ["event_id"]), "flags")
    return spark.read.parquet(path).select("event_id", "column", F.round("value", 2).alias("value"), "direction", "severity")


SQL_STREAM_OUTLIERS = f"""WITH {fence_sql('events', ['value'])} SELECT event_id, 'value' AS "column", round(value, 2) AS value,
  CASE WHEN value > high THEN 'high' ELSE 'low' END AS direction, CASE WHEN value > severe_high OR value < severe_low THEN 'high' ELSE 'medium' END AS severity
FROM events, fences WHERE value < low OR value > high"""


def q_stream_profiles(spark, sf):
    # Two batches: the table, and the table with values missing.
    folder, events = scratch_dir(spark, "batches"), table(spark, sf, "events").select("event_id", "event_type", "value")
    for batch in (events, events_nulls(spark, sf).select("event_id", "event_type", "value")):
        batch.coalesce(1).write.mode("append").parquet(folder)
    path = jobs.run_profiles(jobs.read_table_stream(spark, folder, 1), ["event_id", "event_type", "value"], "profiles")
    return jobs.profile_drift(spark, path)


SQL_STREAM_PROFILES = f"WITH {EVENTS_NULLS_SQL} " + " UNION ALL ".join(
    f"""SELECT {i} AS batch, '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls, min({c}::VARCHAR) AS low, max({c}::VARCHAR) AS high,
  {'NULL::DOUBLE' if not i else f'round((count(*) - count({c})) / count(*) * 100, 2)'} AS null_pct_change FROM {source}"""
    for i, source in enumerate(("events", "events_nulls")) for c in ("event_id", "event_type", "value"))


def q_stream_drift(spark, sf):
    """The same two batches, of as many files as their tables have: the second arrives after the stream has stopped, and
    the stream goes on from its state."""
    folder, out = scratch_dir(spark, "arrivals"), scratch_dir(spark, "drift")
    columns = ["event_id", "event_type", "value"]
    for batch in (table(spark, sf, "events"), events_nulls(spark, sf)):
        batch.select(*columns).repartition(4).write.mode("append").parquet(folder)
        path = jobs.run_append(jobs.drift_stream(jobs.read_table_stream(spark, folder), columns), "drift", out)
    return spark.read.schema(jobs.DRIFT).parquet(path)


QUERIES = {
    "feature_plan": (q_feature_plan, SQL_FEATURE_PLAN),
    "imputed_features": (q_imputed_features, SQL_IMPUTED_FEATURES),
    "regression_metrics": (q_regression_metrics, SQL_REGRESSION_METRICS),
    "classification_metrics": (q_classification_metrics, SQL_CLASSIFICATION_METRICS),
    "stratified_holdout": (q_stratified_holdout, SQL_STRATIFIED_HOLDOUT),
    "target_choice": (q_target_choice, None),
    "rf_predictions": (q_rf_predictions, None),
    "rf_classification": (q_rf_classes, None),
    "rf_importances": (q_rf_importances, None),
    "stream_period_sums": (q_stream_period_sums, SQL_STREAM_PERIOD_SUMS),
    "stream_outliers": (q_stream_outliers, SQL_STREAM_OUTLIERS),
    "stream_drift": (q_stream_drift, SQL_STREAM_PROFILES),
    "stream_profiles": (q_stream_profiles, SQL_STREAM_PROFILES),
}
