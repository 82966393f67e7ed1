"""Insight queries on order lines, orders and events."""

from __future__ import annotations

from tallyspark.operators import charts, kpis, periods, retail, segments
from tallyspark.plans.views import EVENTS_NULLS_SQL, SALES_SQL, events_nulls, sales_flat, table

MEASURES = ["quantity", "discount", "sales", "profit"]


def with_sales(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([SALES_SQL, *more]) + "\n" + body


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


# --- single measures ---------------------------------------------------------------------------


def q_kpis(spark, sf):
    return kpis.kpis(sales_flat(spark, sf, MEASURES), MEASURES)


SQL_KPIS = with_sales(union_all(
    f"""SELECT '{c}' AS "column", round(sum({c}), 2) AS "sum", round(avg({c}), 2) AS mean,
  round(quantile_cont({c}, 0.5), 2) AS median, round(min({c}), 2) AS "min", round(max({c}), 2) AS "max",
  round(stddev_samp({c}), 2) AS std, count({c}) AS "count", count(*) - count({c}) AS null_count
FROM sales_flat""" for c in MEASURES))


def q_kpis_with_nulls(spark, sf):
    return kpis.kpis(events_nulls(spark, sf), ["value", "user_id"])


SQL_KPIS_WITH_NULLS = f"WITH {EVENTS_NULLS_SQL} " + union_all(
    f"""SELECT '{c}' AS "column", round(sum({c}), 2)::DOUBLE AS "sum", round(avg({c}), 2) AS mean,
  round(quantile_cont({c}, 0.5), 2) AS median, min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max",
  round(stddev_samp({c}), 2) AS std, count({c}) AS "count", count(*) - count({c}) AS null_count
FROM events_nulls""" for c in ("value", "user_id"))


def q_zscore(spark, sf):
    return kpis.zscore_outliers(table(spark, sf, "events"), ["value"], ["event_id"])


SQL_ZSCORE = """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, count(value) AS n FROM events)
SELECT event_id, 'value' AS "column", round(value, 2) AS value, round((value - m) / sd, 2) AS z_score
FROM events, s WHERE n >= 4 AND sd > 0 AND abs((value - m) / sd) > 2"""


def fence_sql(source: str, columns) -> str:
    """CTE `fences` over a source with the named columns."""
    return "fences AS (" + union_all(
        f"""SELECT c AS "column", median, method,
  CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) ELSE mean - 2.5 * sd END AS low,
  CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) ELSE mean + 2.5 * sd END AS high,
  CASE WHEN q3 > q1 THEN q1 - 3.0 * (q3 - q1) ELSE mean - 3.5 * sd END AS severe_low,
  CASE WHEN q3 > q1 THEN q3 + 3.0 * (q3 - q1) ELSE mean + 3.5 * sd END AS severe_high
FROM (SELECT '{c}' AS c, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
  quantile_cont({c}, 0.75) AS q3, avg({c}) AS mean, stddev_samp({c}) AS sd, count({c}) AS n,
  CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN 'robust_range' ELSE 'fallback_range' END AS method
  FROM {source})
WHERE n >= 5 AND (q3 > q1 OR sd > 0)""" for c in columns) + ")"


OUTLIER_BODY = """SELECT {keys}, "column", round(value, 2) AS value,
  CASE WHEN value > high THEN 'high' ELSE 'low' END AS direction,
  CASE WHEN value > severe_high OR value < severe_low THEN 'high' ELSE 'medium' END AS severity,
  round(median, 2) AS typical_value, round(low, 2) AS expected_low, round(high, 2) AS expected_high,
  round(gap, 2) AS gap_pct, method, context
FROM (SELECT {keys}, f."column", value, median, low, high, severe_low, severe_high, method, context,
        CASE WHEN abs(median) > 1e-12 THEN (value - median) / abs(median) * 100 END AS gap
      FROM ({long}) v JOIN fences f ON v."column" = f."column"
      WHERE value < low OR value > high)
ORDER BY CASE WHEN value > severe_high OR value < severe_low THEN 0 ELSE 1 END, abs(coalesce(gap, 0)) DESC,
  "column", {keys}{top}"""


def outlier_sql(source, columns, keys, context, top=" LIMIT 30") -> str:
    long = union_all(
        f"""SELECT {keys}, '{c}' AS "column", {c} AS value, {context} AS context FROM {source}""" for c in columns)
    return OUTLIER_BODY.format(keys=keys, long=long, top=top)


def q_iqr(spark, sf):
    return kpis.iqr_outliers(table(spark, sf, "documents"), ["n_chars"], ["doc_id"], ["lang", "source"])


EVENT_FENCES = f"WITH {EVENTS_NULLS_SQL}, {fence_sql('events_nulls', ['value'])}\n"


def _event_outliers(spark, sf, top=30):
    return kpis.iqr_outliers(events_nulls(spark, sf), ["value"], ["event_id"], ["event_type"], top)


def q_event_outliers(spark, sf):
    return _event_outliers(spark, sf)


SQL_IQR = f"WITH {fence_sql('documents', ['n_chars'])} " + outlier_sql(
    "documents", ["n_chars"], "doc_id", "'lang=' || lang || ', source=' || source")
SQL_EVENT_OUTLIERS = EVENT_FENCES + outlier_sql("events_nulls", ["value"], "event_id", "'event type=' || event_type")
SQL_ALL_EVENT_OUTLIERS = EVENT_FENCES + outlier_sql("events_nulls", ["value"], "event_id", "'event type=' || event_type", "")


def q_outlier_summary(spark, sf):
    return kpis.outlier_summary(_event_outliers(spark, sf, None))


SQL_OUTLIER_SUMMARY = f"""WITH o AS ({SQL_ALL_EVENT_OUTLIERS})
SELECT count(*) AS unusual_values, count(*) FILTER (severity = 'high') AS strong_signals,
  count(*) FILTER (direction = 'high') AS above, count(*) FILTER (direction = 'low') AS below,
  string_agg(DISTINCT "column", ',') AS columns FROM o"""


def q_trends(spark, sf):
    return kpis.trends(sales_flat(spark, sf, ["order_date", "quantity", "sales"]), "order_date", ["quantity", "sales"])


def trend_sql(source, ts, columns) -> str:
    return union_all(f"""SELECT '{ts}' AS dimension, '{c}' AS "column",
  CASE WHEN min(d) = 0 AND max(d) = 0 THEN 'flat' WHEN min(d) >= 0 THEN 'increasing'
       WHEN max(d) <= 0 THEN 'decreasing' ELSE 'mixed' END AS direction,
  round(coalesce((arg_max(v, t) - arg_min(v, t)) / nullif(abs(arg_min(v, t)), 0) * 100, 0), 2) AS pct_change,
  count(*) AS points
FROM (SELECT t, v, v - lag(v) OVER (ORDER BY t) AS d
      FROM (SELECT {ts} AS t, sum({c}) AS v FROM {source} GROUP BY 1)) HAVING count(*) >= 3""" for c in columns)


SQL_TRENDS = with_sales(trend_sql("sales_flat", "order_date", ["quantity", "sales"]))


def q_event_trends(spark, sf):
    return kpis.trends(table(spark, sf, "events"), "ts", ["value", "event_id"])


SQL_EVENT_TRENDS = trend_sql("events", "ts", ["value", "event_id"])


# --- chart series ------------------------------------------------------------------------------


def q_category_top(spark, sf):
    return charts.category_top(sales_flat(spark, sf, ["customer", "sales"]), "customer", ["sales"])


SQL_CATEGORY_TOP = with_sales("""SELECT customer AS label, round(sum(sales), 4) AS sales FROM sales_flat
GROUP BY 1 ORDER BY sum(sales) DESC, 1 LIMIT 10""")


def q_category_share(spark, sf):
    return charts.category_share(sales_flat(spark, sf, ["region", "sales"]), "region", "sales")


SQL_CATEGORY_SHARE = with_sales("""SELECT region AS label, round(sum(sales), 2) AS value,
  round(sum(sales) / (SELECT sum(sales) FROM sales_flat) * 100, 2) AS share_pct
FROM sales_flat WHERE (SELECT count(DISTINCT region) FROM sales_flat) BETWEEN 2 AND 6 GROUP BY 1""")


def q_category_multi(spark, sf):
    df = sales_flat(spark, sf, ["country", "sales", "quantity", "profit"])
    return charts.category_top(df, "country", ["sales", "quantity", "profit"], top=8)


SQL_CATEGORY_MULTI = with_sales("""SELECT country AS label, round(sum(sales), 4) AS sales,
  round(sum(quantity), 4) AS quantity, round(sum(profit), 4) AS profit
FROM sales_flat GROUP BY 1 ORDER BY sum(sales) DESC, 1 LIMIT 8""")


def q_category_counts(spark, sf):
    return charts.category_counts(events_nulls(spark, sf), "event_type")


SQL_CATEGORY_COUNTS = f"""WITH {EVENTS_NULLS_SQL} SELECT event_type AS label, count(*) AS "count" FROM events_nulls
WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


def q_radar(spark, sf):
    return charts.radar_series(sales_flat(spark, sf, ["region", "quantity", "sales"]), "region", ["quantity", "sales"])


SQL_RADAR = with_sales("""SELECT region AS label, count(*) AS "count", round(sum(quantity), 4) AS quantity,
  round(sum(sales), 4) AS sales FROM sales_flat
WHERE (SELECT count(DISTINCT region) FROM sales_flat) BETWEEN 2 AND 8 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")


def q_time_series(spark, sf):
    return charts.time_series(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"])


SQL_TIME_SERIES = """SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS label, round(sum(o_totalprice), 4) AS o_totalprice
FROM orders GROUP BY 1"""


def q_histogram(spark, sf):
    return charts.histogram(sales_flat(spark, sf, ["sales"]), "sales")


SQL_HISTOGRAM = with_sales("""SELECT b.bin::INT AS bin,
  format('{:,.1f}', lo + b.bin * ((hi - lo) / 10)) || '-' || format('{:,.1f}', lo + (b.bin + 1) * ((hi - lo) / 10)) AS label,
  coalesce(c.n, 0) AS "count"
FROM (SELECT range AS bin FROM range(10)) b, r
LEFT JOIN (SELECT least(floor((sales - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) AS n FROM sales_flat, r GROUP BY 1) c
  ON b.bin = c.bin WHERE hi > lo""", "r AS (SELECT min(sales) AS lo, max(sales) AS hi FROM sales_flat)")


def q_scatter(spark, sf):
    return charts.scatter_points(events_nulls(spark, sf), "user_id", "value", ["event_id"])


SQL_SCATTER = f"""WITH {EVENTS_NULLS_SQL} SELECT event_id, user_id::DOUBLE AS x, value AS y FROM events_nulls
WHERE value IS NOT NULL ORDER BY event_id LIMIT 80"""


def q_bubble(spark, sf):
    return charts.bubble_points(table(spark, sf, "part"), "p_size", "p_partkey", "p_retailprice", ["p_partkey"])


SQL_BUBBLE = """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_partkey::DOUBLE AS y, p_retailprice AS z
  FROM part ORDER BY p_partkey LIMIT 60)
SELECT p_partkey, x, y, round(greatest(2, least(25, abs(z) / (SELECT max(abs(z)) FROM p) * 25)), 4) AS radius FROM p"""


# --- groups ------------------------------------------------------------------------------------


def q_dominant(spark, sf):
    df = sales_flat(spark, sf, ["region", "category", "quantity", "sales"])
    return segments.dominant_segments(df, ["region", "category"], ["quantity", "sales"])


def head_sql(source, dims, measures) -> str:
    """CTE `heads`: totals, first, last and first three groups per (dimension, column)."""
    grouped = union_all(
        f"""SELECT '{d}' AS dimension, '{m}' AS "column", {d} AS label, sum({m}) AS value FROM {source}
WHERE {d} IS NOT NULL GROUP BY {d}""" for d in dims for m in measures)
    return f"""heads AS (SELECT dimension, "column", count(*) AS groups, sum(value) AS total,
  max(label) FILTER (r = 1) AS top_label, max(value) FILTER (r = 1) AS top_value,
  sum(value) FILTER (r <= 3) AS top3_value, max(label) FILTER (b = 1) AS bottom_label,
  max(value) FILTER (b = 1) AS bottom_value
FROM (SELECT *, row_number() OVER (PARTITION BY dimension, "column" ORDER BY value DESC, label) AS r,
        row_number() OVER (PARTITION BY dimension, "column" ORDER BY value, label) AS b FROM ({grouped}))
GROUP BY 1, 2)"""


SQL_DOMINANT = with_sales("""SELECT dimension, "column", 'dominant' AS kind, top_label AS label,
  round(top_value / total * 100, 2) AS share_pct,
  CASE WHEN top_value / total >= 0.6 THEN 'high' WHEN top_value / total >= 0.35 THEN 'medium' ELSE 'low' END AS confidence,
  round(10 + top_value / total * 10, 2) AS score FROM heads WHERE top_value / total * 100 >= 20
UNION ALL SELECT dimension, "column", 'concentrated', NULL, round(top3_value / total * 100, 2), 'medium', 7.0
FROM heads WHERE top3_value / total * 100 >= 60 AND groups > 3""",
    head_sql("sales_flat", ["region", "category"], ["quantity", "sales"]))


def q_segments(spark, sf):
    return segments.segments(sales_flat(spark, sf, ["region", "customer", "sales"]), ["region", "customer"], "sales")


SQL_SEGMENTS = with_sales("""SELECT dimension, 'sales' AS measure, groups AS group_count, top_label,
  round(top_value, 2) AS top_value, round(top_value / total * 100, 2) AS top_share_pct, bottom_label,
  round(bottom_value, 2) AS bottom_value, round(top3_value / total * 100, 2) AS top3_share_pct FROM heads""",
    head_sql("sales_flat", ["region", "customer"], ["sales"]))

CONCENTRATION = {
    "customer_concentration": "customer", "product_concentration": "product",
    "category_concentration": "category", "regional_concentration": "region",
}


def q_concentration(spark, sf):
    return segments.concentration(sales_flat(spark, sf, [*CONCENTRATION.values(), "sales"]), CONCENTRATION, "sales")


SQL_CONCENTRATION = with_sales(f"""SELECT CASE dimension {' '.join(
    f"WHEN '{d}' THEN '{k}'" for k, d in CONCENTRATION.items())} END AS type, dimension, top_label AS top_segment,
  round(top_value / total * 100, 2) AS top_share_pct, round(top3_value / total * 100, 2) AS top3_share_pct
FROM heads WHERE groups >= 2""", head_sql("sales_flat", list(CONCENTRATION.values()), ["sales"]))


def q_volatility(spark, sf):
    return segments.volatility(sales_flat(spark, sf, MEASURES), MEASURES)


SQL_VOLATILITY = with_sales("""SELECT "column", round(cv, 6) AS variation,
  CASE WHEN "column" = (SELECT arg_max("column", cv) FROM v) AND cv > 0.5 THEN 'most_volatile'
       WHEN "column" = (SELECT arg_min("column", cv) FROM v) AND cv < 0.15 THEN 'steadiest' END AS role FROM v""",
    "v AS (" + union_all(f"""SELECT '{c}' AS "column", stddev_samp({c}) / abs(avg({c})) AS cv FROM sales_flat"""
                         for c in MEASURES) + ")")


def q_drivers(spark, sf):
    return segments.drivers(sales_flat(spark, sf, MEASURES), "sales", ["quantity", "discount", "profit"])


SQL_DRIVERS = with_sales("""SELECT 'sales' AS target, feature, round(r, 4) AS correlation,
  CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM c
ORDER BY abs(r) DESC, feature LIMIT 8""",
    "c AS (" + union_all(f"SELECT '{c}' AS feature, corr(sales, {c}) AS r FROM sales_flat"
                         for c in ("quantity", "discount", "profit")) + ")")


# --- periods -----------------------------------------------------------------------------------


def totals_sql(source, ts, metric) -> str:
    """CTE `totals`: granularity, start and value per period."""
    return f"""unit AS (SELECT CASE WHEN d >= 730 THEN 'year' WHEN d >= 90 THEN 'month' WHEN d >= 21 THEN 'week'
    ELSE 'day' END AS granularity FROM (SELECT datediff('second', min({ts}), max({ts})) // 86400 AS d FROM {source}
    WHERE {metric} IS NOT NULL)),
totals AS (SELECT granularity, date_trunc(granularity, {ts})::TIMESTAMP AS start, sum({metric}) AS value
  FROM {source}, unit WHERE {metric} IS NOT NULL GROUP BY 1, 2)"""


LABEL = """CASE granularity WHEN 'year' THEN strftime({0}, '%Y') WHEN 'month' THEN strftime({0}, '%Y-%m')
 WHEN 'week' THEN strftime({0}, '%Y-%m-%d') || '/' || strftime({0} + INTERVAL 6 DAY, '%Y-%m-%d')
 ELSE strftime({0}, '%Y-%m-%d') END"""


def comparison_sql(metric, ts) -> str:
    return f"""SELECT '{metric}' AS metric, '{ts}' AS date_column, granularity, {LABEL.format('p')} AS previous_period,
  {LABEL.format('c')} AS current_period, round(pv, 4) AS previous_value, round(cv, 4) AS current_value,
  round(cv - pv, 4) AS absolute_change, round((cv - pv) / nullif(abs(pv), 0) * 100, 2) AS pct_change,
  CASE WHEN cv > pv THEN 'increased' WHEN cv < pv THEN 'decreased' ELSE 'was unchanged' END AS direction,
  period_count
FROM (SELECT granularity, start AS c, value AS cv, lag(start) OVER (ORDER BY start) AS p,
        lag(value) OVER (ORDER BY start) AS pv, count(*) OVER () AS period_count,
        row_number() OVER (ORDER BY start DESC) AS r FROM totals) WHERE r = 1 AND p IS NOT NULL"""


def q_period_comparison(spark, sf):
    return periods.period_comparison(sales_flat(spark, sf, ["order_date", "sales"]), "sales", "order_date")


SQL_PERIOD_COMPARISON = with_sales(comparison_sql("sales", "order_date"), totals_sql("sales_flat", "order_date", "sales"))


def q_period_comparison_week(spark, sf):
    return periods.period_comparison(events_nulls(spark, sf), "value", "ts")


SQL_PERIOD_COMPARISON_WEEK = f"WITH {EVENTS_NULLS_SQL}, {totals_sql('events_nulls', 'ts', 'value')} " + comparison_sql("value", "ts")


def q_period_series(spark, sf):
    return periods.period_series(table(spark, sf, "orders"), "o_totalprice", "o_orderdate")


SQL_PERIOD_SERIES = f"""WITH {totals_sql('orders', 'o_orderdate', 'o_totalprice')}
SELECT {LABEL.format('start')} AS period, round(value, 4) AS value, round(value - prior, 4) AS change,
  round((value - prior) / nullif(abs(prior), 0) * 100, 2) AS pct_change
FROM (SELECT *, lag(value) OVER (ORDER BY start) AS prior, row_number() OVER (ORDER BY start DESC) AS r FROM totals)
WHERE r <= 24"""

DIMS = ["region", "segment", "category"]


def q_contribution_change(spark, sf):
    df = sales_flat(spark, sf, ["order_date", *DIMS, "sales"])
    window = periods.resolve_window(sales_flat(spark, sf, ["order_date", "sales"]), "sales", "order_date")
    return periods.contribution_change(df, "sales", DIMS, "order_date", window)


def window_sql(ts) -> str:
    """CTE `win`: bounds of the last two periods."""
    return """win AS (SELECT granularity, max(start) FILTER (r = 1) AS cur, max(start) FILTER (r = 2) AS prev
  FROM (SELECT *, row_number() OVER (ORDER BY start DESC) AS r FROM totals) WHERE r <= 2 GROUP BY 1)"""


def changes_sql(source, ts, metric, dims) -> str:
    return "changes AS (SELECT *, current - previous AS delta FROM (" + union_all(
        f"""SELECT '{d}' AS dimension, {d}::VARCHAR AS segment,
  coalesce(sum({metric}) FILTER (date_trunc(granularity, {ts}) = cur), 0) AS current,
  coalesce(sum({metric}) FILTER (date_trunc(granularity, {ts}) = prev), 0) AS previous
FROM {source}, win WHERE date_trunc(granularity, {ts}) IN (cur, prev) GROUP BY {d}""" for d in dims) + "))"


CONTRIBUTION_BODY = """SELECT dimension, rank, segment, round(current, 4) AS current, round(previous, 4) AS previous,
  round(delta, 4) AS absolute_change, round(delta / nullif(abs(previous), 0) * 100, 2) AS pct_change,
  round(CASE WHEN overall >= 0 AND delta > 0 THEN abs(delta) / up * 100
             WHEN overall < 0 AND delta < 0 THEN abs(delta) / down * 100 ELSE 0 END, 2) AS driver_share_pct
FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(delta) DESC, segment NULLS FIRST) AS rank,
        sum(delta) OVER (PARTITION BY dimension) AS overall,
        sum(CASE WHEN delta > 0 THEN delta END) OVER (PARTITION BY dimension) AS up,
        sum(CASE WHEN delta < 0 THEN -delta END) OVER (PARTITION BY dimension) AS down FROM changes)
WHERE rank <= 8"""

SALES_WINDOW = (totals_sql("sales_flat", "order_date", "sales"), window_sql("order_date"))

SQL_CONTRIBUTION_CHANGE = with_sales(
    CONTRIBUTION_BODY, *SALES_WINDOW, changes_sql("sales_flat", "order_date", "sales", DIMS))


def q_contribution_nulls(spark, sf):
    df = events_nulls(spark, sf)
    return periods.contribution_change(df, "value", ["event_type"], "ts", periods.resolve_window(df, "value", "ts"))


SQL_CONTRIBUTION_NULLS = f"""WITH {EVENTS_NULLS_SQL}, {totals_sql('events_nulls', 'ts', 'value')}, {window_sql('ts')},
{changes_sql('events_nulls', 'ts', 'value', ['event_type'])} {CONTRIBUTION_BODY}"""


def q_contribution_share(spark, sf):
    return periods.contribution_share(sales_flat(spark, sf, ["region", "product", "sales"]), "sales", ["region", "product"])


SQL_CONTRIBUTION_SHARE = with_sales("""SELECT dimension, rank, segment, round(value, 4) AS value,
  round(value / total * 100, 2) AS share_pct
FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, segment NULLS FIRST) AS rank,
        sum(value) OVER (PARTITION BY dimension) AS total FROM (
  SELECT 'region' AS dimension, region AS segment, sum(sales) AS value FROM sales_flat GROUP BY region
  UNION ALL SELECT 'product', product, sum(sales) FROM sales_flat GROUP BY product)) WHERE rank <= 10""")


def q_root_cause(spark, sf):
    df = sales_flat(spark, sf, ["order_date", *DIMS, "sales"])
    window = periods.resolve_window(sales_flat(spark, sf, ["order_date", "sales"]), "sales", "order_date")
    return periods.root_cause_path(df, "sales", DIMS, "order_date", window)


def _drill(n: int, dim: str, earlier: str) -> str:
    return f"""s{n} AS (SELECT {n} AS depth, '{dim}' AS dimension, {dim} AS segment, sum(cur) AS current, sum(prv) AS previous,
  sum(cur) - sum(prv) AS delta FROM base {earlier} GROUP BY {dim}
  ORDER BY (sum(cur) - sum(prv)) * (SELECT CASE WHEN sum(cur) >= sum(prv) THEN 1 ELSE -1 END FROM base) DESC,
    abs(sum(cur) - sum(prv)) DESC, {dim} LIMIT 1)"""


ROOT_CAUSE_CTES = (*SALES_WINDOW, f"""base AS (SELECT {', '.join(DIMS)},
  CASE WHEN date_trunc(granularity, order_date) = cur THEN sales ELSE 0 END AS cur,
  CASE WHEN date_trunc(granularity, order_date) = prev THEN sales ELSE 0 END AS prv
  FROM sales_flat, win WHERE date_trunc(granularity, order_date) IN (cur, prev))""",
    _drill(1, "region", ""), _drill(2, "segment", "WHERE region = (SELECT segment FROM s1)"),
    _drill(3, "category", "WHERE region = (SELECT segment FROM s1) AND base.segment = (SELECT segment FROM s2)"))

SQL_ROOT_CAUSE = with_sales("""SELECT depth, dimension, segment, round(current, 4) AS current,
  round(previous, 4) AS previous, round(delta, 4) AS absolute_change,
  round(delta / nullif(abs(previous), 0) * 100, 2) AS pct_change
FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)""", *ROOT_CAUSE_CTES)


def q_business_impact(spark, sf):
    slim = sales_flat(spark, sf, ["order_date", "sales"])
    window = periods.resolve_window(slim, "sales", "order_date")
    df = sales_flat(spark, sf, ["order_date", "region", "sales"])
    parts = periods.contribution_change(df, "sales", ["region"], "order_date", window)
    return periods.business_impact(periods.period_comparison(slim, "sales", "order_date"), parts, "region")


SQL_BUSINESS_IMPACT = f"""WITH p AS ({SQL_PERIOD_COMPARISON}), c AS ({SQL_CONTRIBUTION_CHANGE})
SELECT p.metric, CASE WHEN p.absolute_change > 0 THEN 'uplift' WHEN p.absolute_change < 0 THEN 'gap' ELSE 'no_change' END AS type,
  p.absolute_change, p.pct_change, c.segment AS leading_segment, c.absolute_change AS leading_change
FROM p LEFT JOIN c ON c.dimension = 'region' AND c.rank = 1"""


# --- retail ------------------------------------------------------------------------------------


def q_discount_effect(spark, sf):
    return retail.discount_effect(sales_flat(spark, sf, ["discount", "profit"]), "discount", "profit")


SQL_DISCOUNT_EFFECT = with_sales("""SELECT 'profit' AS metric, 'discount' AS discount_column, round(r, 4) AS correlation,
  CASE WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.35 THEN 'moderate' ELSE 'weak' END AS strength
FROM (SELECT corr(discount, profit) AS r, count(*) AS n, count(DISTINCT discount) AS d FROM sales_flat) WHERE n >= 8 AND d >= 3""")


def q_profit_margin(spark, sf):
    return retail.profit_margin(sales_flat(spark, sf, ["sales", "profit"]), "sales", "profit")


SQL_PROFIT_MARGIN = with_sales("SELECT round(sum(profit) / sum(sales) * 100, 2) AS margin_pct FROM sales_flat")


def q_revenue_per_unit(spark, sf):
    return retail.revenue_per_unit(sales_flat(spark, sf, ["sales", "quantity"]), "sales", "quantity")


SQL_REVENUE_PER_UNIT = with_sales("SELECT round(sum(sales) / sum(quantity), 4) AS revenue_per_unit FROM sales_flat")

QUERIES = {
    "kpis": (q_kpis, SQL_KPIS),
    "kpis_with_nulls": (q_kpis_with_nulls, SQL_KPIS_WITH_NULLS),
    "zscore_anomalies": (q_zscore, SQL_ZSCORE),
    "iqr_anomalies": (q_iqr, SQL_IQR),
    "iqr_anomalies_events": (q_event_outliers, SQL_EVENT_OUTLIERS),
    "anomaly_summary": (q_outlier_summary, SQL_OUTLIER_SUMMARY),
    "trends": (q_trends, SQL_TRENDS),
    "trends_events": (q_event_trends, SQL_EVENT_TRENDS),
    "category_top": (q_category_top, SQL_CATEGORY_TOP),
    "category_share": (q_category_share, SQL_CATEGORY_SHARE),
    "category_multi": (q_category_multi, SQL_CATEGORY_MULTI),
    "category_counts": (q_category_counts, SQL_CATEGORY_COUNTS),
    "radar_series": (q_radar, SQL_RADAR),
    "time_series": (q_time_series, SQL_TIME_SERIES),
    "histogram": (q_histogram, SQL_HISTOGRAM),
    "scatter_points": (q_scatter, SQL_SCATTER),
    "bubble_points": (q_bubble, SQL_BUBBLE),
    "dominant_segments": (q_dominant, SQL_DOMINANT),
    "segments": (q_segments, SQL_SEGMENTS),
    "concentration": (q_concentration, SQL_CONCENTRATION),
    "volatility": (q_volatility, SQL_VOLATILITY),
    "drivers": (q_drivers, SQL_DRIVERS),
    "period_comparison": (q_period_comparison, SQL_PERIOD_COMPARISON),
    "period_comparison_week": (q_period_comparison_week, SQL_PERIOD_COMPARISON_WEEK),
    "period_series": (q_period_series, SQL_PERIOD_SERIES),
    "contribution_change": (q_contribution_change, SQL_CONTRIBUTION_CHANGE),
    "contribution_change_nulls": (q_contribution_nulls, SQL_CONTRIBUTION_NULLS),
    "contribution_share": (q_contribution_share, SQL_CONTRIBUTION_SHARE),
    "root_cause_path": (q_root_cause, SQL_ROOT_CAUSE),
    "business_impact": (q_business_impact, SQL_BUSINESS_IMPACT),
    "discount_effect": (q_discount_effect, SQL_DISCOUNT_EFFECT),
    "profit_margin": (q_profit_margin, SQL_PROFIT_MARGIN),
    "revenue_per_unit": (q_revenue_per_unit, SQL_REVENUE_PER_UNIT),
}
