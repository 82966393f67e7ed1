"""Profile queries: types, nulls, uniqueness, duplicates, quality, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import keys, profile
from tallyspark.plans.insight import union_all
from tallyspark.plans.views import EVENTS_NULLS_SQL, TABLES, events_nulls, table

# Orders as a careless export would hold them: everything text, missing words, padding, constants.
MESSY_COLUMNS = ("order_id", "sku", "amount", "active", "order_date", "placed_at", "note", "blank", "currency", "code")


def messy_orders(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("order_id"), F.lpad((key % 1000).cast("string"), 5, "0").alias("sku"),
        F.when(key % 10 == 0, "missing").otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("active"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed_at"),
        F.when(key % 3 == 0, F.concat(F.lit(" "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority")).alias("note"),
        F.when(key % 2 == 0, " ").alias("blank"), F.lit("EUR").alias("currency"), (key % 7).cast("string").alias("code"),
    )


MESSY_SQL = """messy AS (SELECT o_orderkey::VARCHAR AS order_id, lpad((o_orderkey % 1000)::VARCHAR, 5, '0') AS sku,
  CASE WHEN o_orderkey % 10 = 0 THEN 'missing' ELSE o_totalprice::VARCHAR END AS amount,
  CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS active,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed_at,
  CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority ELSE o_orderpriority END AS note,
  CASE WHEN o_orderkey % 2 = 0 THEN ' ' END AS blank, 'EUR' AS currency, (o_orderkey % 7)::VARCHAR AS code FROM orders)"""

TYPE_SQL = r"""CASE WHEN count(v) = 0 THEN 'UNKNOWN'
  WHEN bool_and(lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n')) THEN 'BOOLEAN'
  WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+')) THEN
    CASE WHEN bool_or(regexp_matches(v, '^[+-]*0[0-9]+$')) THEN 'STRING' ELSE 'INTEGER' END
  WHEN bool_and(regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')) AND bool_or(regexp_matches(v, '[.eE]')) THEN 'DECIMAL'
  WHEN bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?')
       AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) THEN CASE WHEN bool_or(regexp_matches(v, '[T ]')) THEN 'DATETIME' ELSE 'DATE' END
  ELSE 'STRING' END"""


def value_sql(source: str, c: str) -> str:
    return f"""(SELECT {c} AS raw, CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN ('', 'null', 'none', 'nan', 'missing')
    THEN trim({c}) END AS v FROM {source})"""


def q_column_profile(spark, sf):
    return profile.column_profile(messy_orders(spark, sf))


SQL_COLUMN_PROFILE = f"WITH {MESSY_SQL} " + union_all(f"""SELECT "column", inferred_type, null_count > 0 AS nullable,
  n - null_count AS non_null_count, null_count, round(null_count / n * 100, 2) AS null_percentage, distinct_count,
  round(distinct_count / n * 100, 2) AS distinct_percentage, n - null_count > 0 AND distinct_count = n - null_count AS is_unique,
  n - null_count > 0 AND distinct_count = n AND regexp_matches("column", '(^|_)(id|key|code)$') AS candidate_key,
  whitespace_value_count, sample_values,
  CASE WHEN num THEN round(mn, 4) END AS "min", CASE WHEN num THEN round(mx, 4) END AS "max",
  CASE WHEN num THEN round(mean, 4) END AS mean, CASE WHEN num THEN round(median, 4) END AS median,
  CASE WHEN inferred_type IN ('DATE', 'DATETIME') THEN strftime(earliest, '%Y-%m-%d %H:%M:%S') END AS earliest,
  CASE WHEN inferred_type IN ('DATE', 'DATETIME') THEN strftime(latest, '%Y-%m-%d %H:%M:%S') END AS latest
FROM (SELECT *, inferred_type IN ('INTEGER', 'DECIMAL') AS num FROM (
  SELECT '{c}' AS "column", {TYPE_SQL} AS inferred_type, count(*) AS n, count(*) - count(v) AS null_count,
    count(DISTINCT v) AS distinct_count, count(*) FILTER (v IS NOT NULL AND raw <> v) AS whitespace_value_count,
    (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT v AS s FROM {value_sql('messy', c)} WHERE v IS NOT NULL ORDER BY 1 LIMIT 5)) AS sample_values,
    min(TRY_CAST(v AS DOUBLE)) AS mn, max(TRY_CAST(v AS DOUBLE)) AS mx, avg(TRY_CAST(v AS DOUBLE)) AS mean,
    quantile_cont(TRY_CAST(v AS DOUBLE), 0.5) AS median, min(TRY_CAST(v AS TIMESTAMP)) AS earliest, max(TRY_CAST(v AS TIMESTAMP)) AS latest
  FROM {value_sql('messy', c)}))""" for c in MESSY_COLUMNS)


def q_logical_types(spark, sf):
    return profile.logical_types(profile.as_text(table(spark, sf, "lineitem")))


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
SQL_LOGICAL_TYPES = f"""WITH t AS (SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in LINE_COLUMNS)} FROM lineitem)
""" + union_all(f"""SELECT '{c}' AS "column", {TYPE_SQL} AS inferred_type FROM {value_sql('t', c)}""" for c in LINE_COLUMNS)


def q_null_stats(spark, sf):
    return profile.null_stats(events_nulls(spark, sf), "events").unionByName(
        profile.null_stats(table(spark, sf, "orders"), "orders"))


def null_sql(source, name, columns) -> str:
    return union_all(f"""SELECT '{name}' AS "table", '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct FROM {source}""" for c in columns)


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
SQL_NULL_STATS = f"WITH {EVENTS_NULLS_SQL} " + null_sql("events_nulls", "events", EVENT_COLUMNS) + "\nUNION ALL " + null_sql("orders", "orders", ORDER_COLUMNS)

KEY_COLUMNS = [
    ("orders", "o_orderkey"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("customer", "c_name"),
    ("part", "p_partkey"), ("part", "p_name"), ("lineitem", "l_orderkey"), ("lineitem", "l_linenumber"), ("events", "event_id"),
]


def _key_tables(spark, sf):
    return {t: table(spark, sf, t) for t in dict.fromkeys(t for t, _ in KEY_COLUMNS)}


def q_unique_keys(spark, sf):
    return keys.unique_keys(_key_tables(spark, sf), KEY_COLUMNS)


SQL_UNIQUE_KEYS = union_all(f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS "rows", count({c}) AS non_null,
  count(DISTINCT {c}) AS "distinct", count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS unique_key FROM {t}"""
                            for t, c in KEY_COLUMNS)

COUNTER_COLUMNS = [("lineitem", "l_linenumber"), ("conversations", "turn"), ("part", "p_size"), ("nation", "n_regionkey"),
                   ("labels", "quality"), ("turns", "turn_no")]


def q_line_counters(spark, sf):
    tables = {t: table(spark, sf, t) for t, _ in COUNTER_COLUMNS if t != "turns"}
    tables["turns"] = tables["lineitem"].select((F.col("l_linenumber") % 5 + 1).alias("turn_no"))
    return keys.line_counters(tables, COUNTER_COLUMNS)


SQL_LINE_COUNTERS = "WITH turns AS (SELECT l_linenumber % 5 + 1 AS turn_no FROM lineitem) " + union_all(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", count(DISTINCT {c}) AS "distinct",
  count(DISTINCT {c}) <= 6 AND min({c}) = 1 AND max({c}) = count(DISTINCT {c}) AS line_counter FROM {t}""" for t, c in COUNTER_COLUMNS)


def q_empty_columns(spark, sf):
    return profile.empty_columns(messy_orders(spark, sf), "messy")


SQL_EMPTY_COLUMNS = f"WITH {MESSY_SQL} " + union_all(
    f"""SELECT 'messy' AS "table", '{c}' AS "column", count(nullif(trim({c}), '')) AS populated,
  count(nullif(trim({c}), '')) = 0 AS empty FROM messy""" for c in MESSY_COLUMNS)


def q_row_counts(spark, sf):
    tables = {t: table(spark, sf, t) for t in TABLES}
    tables["orders_1990"] = tables["orders"].where("o_orderdate < '1991-01-01'")
    return profile.row_counts(tables)


SQL_ROW_COUNTS = union_all(
    f"""SELECT '{t}' AS "table", count(*) AS "rows", count(*) = 0 AS empty FROM {t}""" for t in TABLES
) + """ UNION ALL SELECT 'orders_1990', count(*), count(*) = 0 FROM orders WHERE o_orderdate < '1991-01-01'"""


def q_duplicate_rows(spark, sf):
    lines = table(spark, sf, "lineitem")
    return profile.duplicate_rows(lines.unionAll(lines.where("l_returnflag = 'R'")))


SQL_DUPLICATE_ROWS = """WITH l AS (FROM lineitem UNION ALL FROM lineitem WHERE l_returnflag = 'R')
SELECT n AS "rows", n - d AS duplicate_rows, round((n - d) / n * 100, 2) AS duplicate_percentage
FROM (SELECT (SELECT count(*) FROM l) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS d)"""


def q_data_quality(spark, sf):
    return profile.data_quality(messy_orders(spark, sf))


def _names_sql(cond: str) -> str:
    inner = ", ".join(f"CASE WHEN {cond.format(c=c)} THEN '{c}' END" for c in MESSY_COLUMNS)
    return f"array_to_string(list_filter([{inner}], lambda x: x IS NOT NULL), ',')"


SQL_DATA_QUALITY = f"""WITH {MESSY_SQL}, d AS (SELECT sum(n - 1)::BIGINT AS dup FROM (SELECT count(*) AS n FROM messy GROUP BY {', '.join(MESSY_COLUMNS)})),
s AS (SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in MESSY_COLUMNS)} AS nulls,
  {_names_sql('(count(*) - count({c})) / count(*) >= 0.4')} AS high_null_columns,
  {_names_sql('count(DISTINCT {c}) <= 1')} AS constant_columns FROM messy)
SELECT n AS "rows", {len(MESSY_COLUMNS)} AS "columns", nulls AS null_cells, round(nulls / (n * {len(MESSY_COLUMNS)}) * 100, 2) AS null_percentage,
  dup AS duplicate_rows, round(dup / n * 100, 2) AS duplicate_percentage, high_null_columns, constant_columns FROM s, d"""


def _doubled(spark, sf):
    df = messy_orders(spark, sf)
    return df.unionByName(df.where("code = '3'"))


def q_quality_warnings(spark, sf):
    return profile.quality_warnings(_doubled(spark, sf))


SQL_QUALITY_WARNINGS = f"WITH {MESSY_SQL}, m AS (SELECT * FROM messy UNION ALL SELECT * FROM messy WHERE code = '3') " + union_all(
    f"""SELECT subject, warning FROM (SELECT '{c}' AS subject, unnest([
    CASE WHEN (count(*) - count(v)) / count(*) > 0.5 THEN 'Column ''{c}'' is missing in more than half of the rows.' END,
    CASE WHEN count(v) = 0 THEN 'Column ''{c}'' has no values.' END,
    CASE WHEN count(DISTINCT v) = 1 AND count(v) > 1 THEN 'Column ''{c}'' is constant.' END,
    CASE WHEN count(*) FILTER (v IS NOT NULL AND raw <> v) > 0 THEN 'Column ''{c}'' has ' || count(*) FILTER (v IS NOT NULL AND raw <> v)
      || ' value(s) with surrounding whitespace.' END]) AS warning FROM {value_sql('m', c)}) WHERE warning IS NOT NULL"""
    for c in MESSY_COLUMNS) + f"""
UNION ALL SELECT '(table)', sum(n - 1)::BIGINT || ' repeated row(s).' FROM (SELECT count(*) AS n FROM m GROUP BY {', '.join(MESSY_COLUMNS)}) HAVING sum(n - 1) > 0"""


def _events_text(spark, sf):
    return profile.as_text(events_nulls(spark, sf)).withColumn("nothing", F.lit(None).cast("string"))


EVENTS_TEXT_SQL = f"""{EVENTS_NULLS_SQL}, e AS (SELECT event_id::VARCHAR AS event_id, ts::VARCHAR AS ts, user_id::VARCHAR AS user_id,
  event_type, value::VARCHAR AS value, props, NULL::VARCHAR AS nothing FROM events_nulls)"""


def q_column_roles(spark, sf):
    return profile.column_roles(_events_text(spark, sf))


SQL_COLUMN_ROLES = f"WITH {EVENTS_TEXT_SQL} " + union_all(
    f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'unknown' WHEN num >= 0.8 THEN 'numeric' WHEN dt >= 1 THEN 'datetime' ELSE 'category' END AS role,
  round(coalesce(num, 0), 4) AS numeric_share, round(CASE WHEN num >= 0.8 THEN 0 ELSE coalesce(dt, 0) END, 4) AS datetime_share
FROM (SELECT *, count(TRY_CAST({c} AS DOUBLE)) OVER () / nullif(count({c}) OVER (), 0) AS num, count(TRY_CAST({c} AS TIMESTAMP)) OVER () / nullif(count({c}) OVER (), 0) AS dt FROM e)
GROUP BY num, dt""" for c in (*EVENT_COLUMNS, "nothing"))


def q_coerce_columns(spark, sf):
    df = messy_orders(spark, sf).select("order_id", "amount", "note", "order_date")
    out = profile.coerce_columns(df, ["amount", "note"], ["order_date"])
    return out.select("order_id", "amount", "note", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"))


SQL_COERCE_COLUMNS = f"""WITH {MESSY_SQL} SELECT order_id, TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(note AS DOUBLE) AS note,
  strftime(TRY_CAST(order_date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS order_date FROM messy"""


def _sparse(spark, sf):
    return events_nulls(spark, sf).select(
        "event_type", F.col("value").cast("string").alias("value"), F.when(F.col("value") > 50, F.col("ts")).alias("ts"),
        F.lit(" ").alias("gap"), F.lit(None).cast("string").alias("nothing"))


SPARSE_SQL = f"""{EVENTS_NULLS_SQL}, s AS (SELECT event_type, value::VARCHAR AS value, CASE WHEN value > 50 THEN ts END AS ts,
  ' ' AS gap, NULL::VARCHAR AS nothing FROM events_nulls)"""


def q_clean_rows(spark, sf):
    return profile.clean_rows(_sparse(spark, sf))


SQL_CLEAN_ROWS = f"""WITH {SPARSE_SQL} SELECT event_type, TRY_CAST(value AS DOUBLE) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM s
WHERE NOT (event_type IS NULL AND value IS NULL AND ts IS NULL)"""


def q_clean_report(spark, sf):
    return profile.clean_report(_sparse(spark, sf))


SQL_CLEAN_REPORT = f"""WITH {SPARSE_SQL} SELECT 'gap,nothing' AS dropped_empty_columns,
  count(*) FILTER (event_type IS NULL AND value IS NULL AND ts IS NULL) AS dropped_empty_rows,
  3 * count(*) - count(event_type) - count(value) - count(ts) AS nulls_before, 'event_type,value,ts' AS columns_kept FROM s"""

QUERIES = {
    "column_profile": (q_column_profile, SQL_COLUMN_PROFILE),
    "logical_types": (q_logical_types, SQL_LOGICAL_TYPES),
    "null_stats": (q_null_stats, SQL_NULL_STATS),
    "unique_keys": (q_unique_keys, SQL_UNIQUE_KEYS),
    "line_counters": (q_line_counters, SQL_LINE_COUNTERS),
    "empty_columns": (q_empty_columns, SQL_EMPTY_COLUMNS),
    "row_counts": (q_row_counts, SQL_ROW_COUNTS),
    "duplicate_rows": (q_duplicate_rows, SQL_DUPLICATE_ROWS),
    "data_quality": (q_data_quality, SQL_DATA_QUALITY),
    "quality_warnings": (q_quality_warnings, SQL_QUALITY_WARNINGS),
    "column_roles": (q_column_roles, SQL_COLUMN_ROLES),
    "coerce_columns": (q_coerce_columns, SQL_COERCE_COLUMNS),
    "clean_rows": (q_clean_rows, SQL_CLEAN_ROWS),
    "clean_report": (q_clean_report, SQL_CLEAN_REPORT),
}
