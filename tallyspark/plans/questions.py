"""The query shapes of business questions on order lines, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import metrics as M
from tallyspark.plans.insight import with_sales
from tallyspark.plans.views import sales_flat, table


def q_star_join(spark, sf):
    cols = ["order_id", "line", "order_date", "region", "country", "customer", "segment", "category", "product", "quantity", "sales"]
    df = sales_flat(spark, sf, cols).withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))
    return df.withColumn("sales", F.round("sales", 4))


SQL_STAR_JOIN = with_sales("""SELECT order_id, line, strftime(order_date, '%Y-%m-%d') AS order_date, region, country, customer, segment,
  category, product, quantity, round(sales, 4) AS sales FROM sales_flat""")


def q_metric_query(spark, sf):
    spec = M.MetricSpec(
        measures={"total_sales": ("sum", "sales"), "average_quantity": ("avg", "quantity"), "lines": ("count", "*")},
        dims={"country": "country", "month": F.date_format("order_date", "yyyy-MM")},
        filters=(("category", "=", "LARGE"), ("discount", ">=", 0.02)), year=("order_date", 1997), order_by="total_sales", limit=20)
    return M.metric_query(sales_flat(spark, sf, ["country", "order_date", "category", "discount", "sales", "quantity"]), spec)


SQL_METRIC_QUERY = with_sales("""SELECT country, strftime(order_date, '%Y-%m') AS month, round(sum(sales), 4) AS total_sales,
  round(avg(quantity), 4) AS average_quantity, count(*) AS lines FROM sales_flat
WHERE category = 'LARGE' AND discount >= 0.02 AND year(order_date) = 1997 GROUP BY 1, 2 ORDER BY sum(sales) DESC, 1, 2 LIMIT 20""")


def q_metric_scalar(spark, sf):
    spec = M.MetricSpec(measures={"orders": ("count_distinct", "o_custkey"), "largest": ("max", "o_totalprice"), "spread": ("stddev", "o_totalprice")})
    return M.metric_query(table(spark, sf, "orders"), spec)


SQL_METRIC_SCALAR = """SELECT count(DISTINCT o_custkey) AS orders, round(max(o_totalprice), 4) AS largest,
  round(stddev_samp(o_totalprice), 4) AS spread FROM orders"""


def q_metric_percentiles(spark, sf):
    """Middle and ends of sales and quantities; one month holds the rows of many."""
    month = F.when(F.year("order_date") < 1996, "earlier").otherwise(F.date_format("order_date", "yyyy-MM"))
    spec = M.MetricSpec(
        measures={"lines": ("count", "*"), "middle": ("median", "sales"), "high": ("p90", "sales"), "low": ("p2.5", "sales"), "middle_quantity": ("median", "quantity")},
        dims={"segment": "segment", "month": month}, digits=8)
    return M.metric_query(sales_flat(spark, sf, ["segment", "order_date", "sales", "quantity"]), spec)


SQL_METRIC_PERCENTILES = with_sales("""SELECT segment, CASE WHEN year(order_date) < 1996 THEN 'earlier' ELSE strftime(order_date, '%Y-%m') END AS month, count(*) AS lines,
  round(quantile_cont(sales, 0.5), 8) AS middle, round(quantile_cont(sales, 0.9), 8) AS high, round(quantile_cont(sales, 0.025), 8) AS low,
  round(quantile_cont(quantity, 0.5), 8) AS middle_quantity FROM sales_flat GROUP BY 1, 2""")


def q_average_order_value(spark, sf):
    return M.average_of_totals(sales_flat(spark, sf, ["order_id", "sales"]), "order_id", "sales")


SQL_AVERAGE_ORDER_VALUE = with_sales("""SELECT count(*) AS entities, round(avg(t), 4) AS average_total
FROM (SELECT order_id, sum(sales) AS t FROM sales_flat GROUP BY 1)""")


def q_metrics_overview(spark, sf):
    t = lambda n: table(spark, sf, n)
    orders = t("orders").withColumnRenamed("o_totalprice", "total")
    return M.metrics_overview(("customers", t("customer")), [("orders", orders, "total"), ("support_events", t("events"), "value"),
                                                             ("order_lines", t("lineitem").withColumnRenamed("l_quantity", "quantity"), "quantity")])


SQL_METRICS_OVERVIEW = """SELECT 'Total customers' AS metric, count(*)::DOUBLE AS value FROM customer
UNION ALL SELECT 'Total orders', count(*)::DOUBLE FROM orders UNION ALL SELECT 'Total order value', round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'Total support events', count(*)::DOUBLE FROM events UNION ALL SELECT 'Total support event value', round(sum(value), 2) FROM events
UNION ALL SELECT 'Total order lines', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'Total quantity', round(sum(l_quantity), 2) FROM lineitem"""


def q_filter_ops(spark, sf):
    p = table(spark, sf, "part")
    rows = M.filtered(p, ("p_name", "ILIKE", "%RING%"), ("p_size", ">=", 5), ("p_size", "<", 45), ("p_brand", "!=", "Brand#3"),
                      ("p_type", "LIKE", "%A%"), ("p_retailprice", "IS NOT", None))
    return rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


SQL_FILTER_OPS = """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_name ILIKE '%RING%' AND p_size >= 5 AND p_size < 45
  AND p_brand <> 'Brand#3' AND p_type LIKE '%A%' AND p_retailprice IS NOT NULL"""


def q_year_filter(spark, sf):
    rows = M.year_filter(table(spark, sf, "orders"), "o_orderdate", 1996)
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


SQL_YEAR_FILTER = """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE year(o_orderdate) = 1996 GROUP BY 1"""


def q_computed_measure(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.with_computed_measure(li, "l_quantity", "p_retailprice").groupBy("p_type").agg(F.round(F.sum("amount"), 2).alias("amount"))


SQL_COMPUTED_MEASURE = """SELECT p_type, round(sum(l_quantity * p_retailprice), 2) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""


def _customer_totals(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


TOTALS_SQL = "t AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"


def q_top_n(spark, sf):
    return M.top_n(_customer_totals(spark, sf), "total", ["o_custkey"], 15, offset=5)


SQL_TOP_N = f"WITH {TOTALS_SQL} SELECT * FROM t ORDER BY total DESC, o_custkey LIMIT 15 OFFSET 5"


def q_both_extremes(spark, sf):
    return M.both_extremes(_customer_totals(spark, sf), "total", ["o_custkey"], 5)


SQL_BOTH_EXTREMES = f"""WITH {TOTALS_SQL} SELECT *, 'highest' AS extreme FROM (SELECT * FROM t ORDER BY total DESC, o_custkey LIMIT 5)
UNION ALL SELECT *, 'lowest' FROM (SELECT * FROM t ORDER BY total, o_custkey LIMIT 5)"""


def q_preview(spark, sf):
    return M.preview(table(spark, sf, "customer"), ["c_custkey"])


SQL_PREVIEW = "SELECT * FROM customer ORDER BY c_custkey LIMIT 50"


def q_interleave(spark, sf):
    return M.interleave_groups(table(spark, sf, "part"), "p_type", ["p_retailprice", "p_partkey"], "p_name", 12)


SQL_INTERLEAVE = """WITH r AS (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS turn FROM part),
f AS (SELECT p_name, arg_min(p_type, (turn, p_type)) AS p_type, min(turn) AS turn FROM r GROUP BY 1)
SELECT p_type, turn, p_name FROM f ORDER BY turn, p_type, p_name LIMIT 12"""


def q_capped_result(spark, sf):
    return M.capped_result(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10_000)


SQL_CAPPED_RESULT = """SELECT o_orderkey, o_totalprice, (SELECT count(*) > 10000 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 10000"""

QUERIES = {
    "star_join": (q_star_join, SQL_STAR_JOIN),
    "metric_query": (q_metric_query, SQL_METRIC_QUERY),
    "metric_percentiles": (q_metric_percentiles, SQL_METRIC_PERCENTILES),
    "metric_scalar": (q_metric_scalar, SQL_METRIC_SCALAR),
    "average_order_value": (q_average_order_value, SQL_AVERAGE_ORDER_VALUE),
    "metrics_overview": (q_metrics_overview, SQL_METRICS_OVERVIEW),
    "filter_ops": (q_filter_ops, SQL_FILTER_OPS),
    "year_filter": (q_year_filter, SQL_YEAR_FILTER),
    "computed_measure": (q_computed_measure, SQL_COMPUTED_MEASURE),
    "top_n": (q_top_n, SQL_TOP_N),
    "both_extremes": (q_both_extremes, SQL_BOTH_EXTREMES),
    "preview": (q_preview, SQL_PREVIEW),
    "interleave_groups": (q_interleave, SQL_INTERLEAVE),
    "capped_result": (q_capped_result, SQL_CAPPED_RESULT),
}
