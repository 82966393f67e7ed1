"""The given tables and the views the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.joins import Edge, denormalize

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Output name -> column of the joined tables; sales and profit follow from price and discount.
SALES_COLUMNS = {
    "order_id": "l_orderkey", "line": "l_linenumber", "order_date": "o_orderdate", "region": "r_name",
    "country": "n_name", "customer": "c_name", "segment": "c_mktsegment", "category": "p_type",
    "product": "p_name", "quantity": "l_quantity", "discount": "l_discount",
}


def sales_flat(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Order lines with the asked columns; only the tables that supply them are joined."""
    t = lambda name: table(spark, sf_dir, name)
    edges = [
        Edge(t("orders"), "l_orderkey", "o_orderkey"), Edge(t("customer"), "o_custkey", "c_custkey"),
        Edge(t("nation"), "c_nationkey", "n_nationkey"), Edge(t("region"), "n_regionkey", "r_regionkey"),
        Edge(t("part"), "l_partkey", "p_partkey"),
    ]
    sales = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    made = {"sales": sales, "profit": sales * (0.28 - F.col("l_discount") * 0.55)}
    sources = {SALES_COLUMNS[c] for c in columns if c in SALES_COLUMNS}
    if set(columns) & set(made):
        sources |= {"l_extendedprice", "l_discount"}
    flat = denormalize(t("lineitem"), edges, sorted(sources))
    return flat.select(*[(made[c] if c in made else F.col(SALES_COLUMNS[c])).alias(c) for c in columns])


SALES_SQL = """sales_flat AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, o_orderdate AS order_date, r_name AS region,
         n_name AS country, c_name AS customer, c_mktsegment AS segment, p_type AS category,
         p_name AS product, l_quantity AS quantity, l_discount AS discount,
         l_extendedprice * (1 - l_discount) AS sales,
         l_extendedprice * (1 - l_discount) * (0.28 - l_discount * 0.55) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""


def events_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls: no type for errors, no value below two."""
    return table(spark, sf_dir, "events").withColumn(
        "event_type", F.nullif("event_type", F.lit("error"))
    ).withColumn("value", F.when(F.col("value") >= 2, F.col("value")))


EVENTS_NULLS_SQL = """events_nulls AS (
  SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
         CASE WHEN value >= 2 THEN value END AS value, props FROM events)"""


# Business names for the key columns: table -> (source table, {new name: source column}).
RENAMED = {
    "regions": ("region", {"region_id": "r_regionkey", "region_name": "r_name"}),
    "nations": ("nation", {"nation_id": "n_nationkey", "nation_name": "n_name", "region_id": "n_regionkey"}),
    "customers": ("customer", {
        "customer_id": "c_custkey", "name": "c_name", "nation_id": "c_nationkey", "balance": "c_acctbal",
        "market_segment": "c_mktsegment"}),
    "suppliers": ("supplier", {
        "supplier_id": "s_suppkey", "name": "s_name", "nation_id": "s_nationkey", "balance": "s_acctbal"}),
    "products": ("part", {
        "product_id": "p_partkey", "product_name": "p_name", "brand": "p_brand", "type": "p_type",
        "size": "p_size", "price": "p_retailprice"}),
    "orders": ("orders", {
        "order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus",
        "total": "o_totalprice", "order_date": "o_orderdate", "priority": "o_orderpriority"}),
    "order_items": ("lineitem", {
        "order_id": "l_orderkey", "product_id": "l_partkey", "supplier_id": "l_suppkey",
        "line_no": "l_linenumber", "quantity": "l_quantity", "extended_price": "l_extendedprice",
        "discount": "l_discount", "return_flag": "l_returnflag", "ship_date": "l_shipdate"}),
}

# The foreign keys these tables really have.
KNOWN_EDGES = [
    ("nations", "region_id", "regions", "region_id"),
    ("customers", "nation_id", "nations", "nation_id"),
    ("suppliers", "nation_id", "nations", "nation_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "supplier_id", "suppliers", "supplier_id"),
]


def renamed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        name: table(spark, sf_dir, source).select(*[F.col(old).alias(new) for new, old in cols.items()])
        for name, (source, cols) in RENAMED.items()
    }


def renamed_sql(name: str) -> str:
    source, cols = RENAMED[name]
    return f"(SELECT {', '.join(f'{old} AS {new}' for new, old in cols.items())} FROM {source})"
