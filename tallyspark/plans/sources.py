"""Source and sink queries: the given tables are written as files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.operators import profile
from tallyspark.plans.insight import union_all
from tallyspark.plans.profiling import MESSY_COLUMNS, MESSY_SQL, messy_orders
from tallyspark.plans.views import TABLES, table
from tallyspark.session import scratch_dir
from tallyspark.sources import files, snapshots, tables


def _as_csv(df, label, **options):
    path = scratch_dir(df.sparkSession, label)
    df.write.options(header=True, **options).csv(path)
    return path


def _csv_and_back(df, label, sep=",", **options):
    """`df` written as CSV and read again. Nulls are written as a word that no cell holds, so that empty texts stay empty texts."""
    null = f"null-{uuid.uuid4().hex}"
    path = _as_csv(df, label, sep=sep, nullValue=null, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options)
    return tables.read_csv_text(df.sparkSession, path, sep=sep, null=null)


def q_csv_raw_scan(spark, sf):
    return _csv_and_back(table(spark, sf, "customer").withColumn("c_name", F.concat(F.col("c_name"), F.lit('; "x"'))), "customer", sep=";")


SQL_CSV_RAW_SCAN = """SELECT c_custkey::VARCHAR AS c_custkey, c_name || '; "x"' AS c_name, c_nationkey::VARCHAR AS c_nationkey,
  c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer"""


def q_csv_quoted_breaks(spark, sf):
    """All documents as CSV: most cells of `text` hold line breaks."""
    return _csv_and_back(table(spark, sf, "documents"), "documents", quoteAll=True)


SQL_CSV_QUOTED_BREAKS = """SELECT doc_id::VARCHAR AS doc_id, text, lang, source, n_chars::VARCHAR AS n_chars FROM documents"""


def _messy_csv(spark, sf):
    return tables.read_csv_text(spark, _as_csv(messy_orders(spark, sf), "messy", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def q_typed_load(spark, sf):
    out = tables.typed_load(_messy_csv(spark, sf), scratch_dir(spark, "typed"))
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")).withColumn("placed_at", F.date_format("placed_at", "yyyy-MM-dd HH:mm:ss"))


SQL_TYPED_LOAD = f"""WITH {MESSY_SQL} SELECT order_id::BIGINT AS order_id, sku, TRY_CAST(amount AS DOUBLE) AS amount, active = 'yes' AS active, order_date, placed_at,
  trim(note) AS note, NULL::VARCHAR AS blank, currency, code::BIGINT AS code FROM messy"""


def q_csv_mapping(spark, sf):
    return tables.csv_mapping(_messy_csv(spark, sf), "messy")


_TYPES = dict(zip(MESSY_COLUMNS, ("bigint", "string", "double", "boolean", "date", "timestamp", "string", "string", "string", "bigint")))
SQL_CSV_MAPPING = f"WITH {MESSY_SQL} " + union_all(
    f"""SELECT 'messy' AS "table", '{c}' AS "column", '{_TYPES[c]}' AS data_type, n < t AS nullable, t AS total_rows, t - n AS nulls,
  round((t - n) / t * 100, 2) AS null_pct, {str(c in ('order_id', 'code')).upper()} AND n = t AND d = t AS inferred_key, NULL::BIGINT AS duplicate_rows
FROM (SELECT count(*) AS t, count({v}) AS n, count(DISTINCT {v}) AS d FROM messy)"""
    for c in MESSY_COLUMNS for v in [f"CASE WHEN lower(trim({c})) NOT IN ('', 'null', 'none', 'nan', 'missing') THEN trim({c}) END"]
) + """ UNION ALL SELECT 'messy', NULL, NULL, NULL, count(*), NULL, NULL, NULL, 0 FROM messy"""


def _csv_folder(spark, sf):
    """A folder with one sub-folder of CSV files per table."""
    base = scratch_dir(spark, "folder")
    for name, sep in (("nation", ","), ("region", ";"), ("part", "|"), ("supplier", "\t")):
        table(spark, sf, name).coalesce(1).write.options(header=True, sep=sep).csv(f"{base}/{name}")
    return base


def _by_folder(df, column="path"):
    """File names of a Spark writer are random; the folder names the table."""
    return df.withColumn("file", F.concat(F.element_at(F.split(column, "/"), -2), F.lit(".csv")))


def _inspected(spark, sf):
    found = files.inspect_files(files.list_files(spark, _csv_folder(spark, sf), "*.csv"))
    return found.withColumn("path", F.regexp_replace("path", r"/[^/]*$", ".csv"))


def q_file_admission(spark, sf):
    return files.file_admission(_inspected(spark, sf)).select("file", "admitted", "reason")


def _values(rows, names):
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({names})"


SQL_FILE_ADMISSION = union_all(f"SELECT '{t}.csv' AS file, count(*) > 0 AS admitted, NULL::VARCHAR AS reason FROM {t}" for t in ("nation", "region", "part", "supplier"))


def q_header_audit(spark, sf):
    twice = _inspected(spark, sf).withColumn("header", F.concat("header", F.array(F.lit(" "), F.upper(F.col("header")[0]))))
    return files.header_audit(twice)


_HEADERS = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "region": ("r_regionkey", "r_name"),
            "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")}
SQL_HEADER_AUDIT = union_all(
    [f"SELECT '{t}.csv' AS file, '{c}' AS name, {2 if i == 0 else 1} AS times, {i} AS first_place, '{'duplicate' if i == 0 else 'ok'}' AS finding"
     for t, cols in _HEADERS.items() for i, c in enumerate(cols)] + [f"SELECT '{t}.csv', '', 1, {len(cols)}, 'blank'" for t, cols in _HEADERS.items()])


def q_dialect_report(spark, sf):
    return files.dialect_report(_inspected(spark, sf)).withColumn("delimiter", F.replace("delimiter", F.lit("\t"), F.lit("tab")))


SQL_DIALECT_REPORT = union_all(
    f"SELECT '{t}.csv' AS file, 'utf-8' AS encoding, '{d}' AS delimiter, '\"' AS quotechar, {len(_HEADERS[t])} AS \"columns\""
    for t, d in (("nation", ","), ("region", ";"), ("part", "|"), ("supplier", "tab")))


def q_csv_folder_profile(spark, sf):
    found = files.inspect_files(files.list_files(spark, _csv_folder(spark, sf), "*.csv"))
    out = tables.csv_folder_profile(found)
    return out.select("column", "rows", "null_count", "distinct_count", "whitespace_value_count", "inferred_type", "candidate_key")


_KINDS = {"n_nationkey": "INTEGER", "n_regionkey": "INTEGER", "r_regionkey": "INTEGER", "p_partkey": "INTEGER", "p_size": "INTEGER", "p_retailprice": "DECIMAL",
          "s_suppkey": "INTEGER", "s_nationkey": "INTEGER", "s_acctbal": "DECIMAL"}
SQL_CSV_FOLDER_PROFILE = union_all(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", 0 AS null_count, count(DISTINCT {c}) AS distinct_count, 0 AS whitespace_value_count,
  '{_KINDS.get(c, 'STRING')}' AS inferred_type, FALSE AS candidate_key FROM {t}""" for t, cols in _HEADERS.items() for c in cols)


def q_file_fingerprint(spark, sf):
    """The tables' own files: length and SHA-256."""
    found = files.file_fingerprint(files.list_files(spark, sf, "*.parquet"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


def q_json_rows(spark, sf):
    """Customers in results of at most 500 records each."""
    path = scratch_dir(spark, "json")
    c = table(spark, sf, "customer")
    lists = c.groupBy(F.floor(F.col("c_custkey") / 500)).agg(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")).alias("data"))
    lists.select("data").write.json(path)
    return tables.json_rows(spark, path, schema="data array<struct<c_custkey: bigint, c_name: string, c_acctbal: double>>", one_per_file=False)


SQL_JSON_ROWS = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def q_sanitized_sink(spark, sf):
    li = table(spark, sf, "lineitem")
    odd = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_extendedprice"))
    path = scratch_dir(spark, "sanitized")
    df = li.select("l_orderkey", "l_linenumber", odd.alias("price"))
    tables.write_json(df, path)
    return spark.read.schema(df.schema).json(path)


SQL_SANITIZED_SINK = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_extendedprice END AS price FROM lineitem"""


def q_catalog_columns(spark, sf):
    return tables.catalog_columns({t: table(spark, sf, t) for t in ("orders", "nation", "events")}).select("table", "column", "ordinal", "total_rows", "nulls")


_CAT = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "nation": _HEADERS["nation"], "events": ("event_id", "ts", "user_id", "event_type", "value", "props")}
SQL_CATALOG_COLUMNS = union_all(f"""SELECT '{t}' AS "table", '{c}' AS "column", {i} AS ordinal, count(*) AS total_rows, count(*) - count({c}) AS nulls FROM {t}"""
                                for t, cols in _CAT.items() for i, c in enumerate(cols, 1))


def q_schema_table_counts(spark, sf):
    home = lambda t: "text" if t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings") else "shop"
    return tables.schema_table_counts(profile.row_counts({f"{home(t)}.{t}": table(spark, sf, t) for t in TABLES}))


_TEXT = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")
SQL_SCHEMA_TABLE_COUNTS = "SELECT schema, count(*) AS tables, sum(n)::BIGINT AS \"rows\", 'multi' AS mode FROM (" + union_all(
    f"SELECT '{'text' if t in _TEXT else 'shop'}' AS schema, count(*) AS n FROM {t}" for t in TABLES) + ") GROUP BY 1"


_MERGED = {"shop": ("nation", "customer", "orders"), "text": ("documents", "labels", "conversations")}
_MERGED_COLUMNS = {"nation": _HEADERS["nation"], "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "orders": _CAT["orders"],
                   "documents": ("doc_id", "text", "lang", "source", "n_chars"), "labels": ("doc_id", "quality", "toxic"),
                   "conversations": ("conv_id", "turn", "role", "text")}


def q_merged_profile(spark, sf):
    """Two schemas in one profile."""
    found = profile.merged_profile({f"{s}.{t}": table(spark, sf, t) for s, names in _MERGED.items() for t in names})
    return found.select("schema", "table", "column", "ordinal", "rows", "null_count", "distinct_count", "most", "min", "max", "is_unique", "candidate_key")


def _merged_sql(schema, t, c, place):
    v = f"CASE WHEN lower(trim({c}::VARCHAR)) NOT IN ('', 'null', 'none', 'nan', 'missing') THEN trim({c}::VARCHAR) END"
    key = f"regexp_matches('{c}', '(^|_)(id|key|code)$')"
    number = f"CASE WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (v IS NOT NULL) THEN {{}}(try_cast(v AS DOUBLE)) END"
    return f"""SELECT '{schema}' AS schema, '{t}' AS "table", '{c}' AS "column", {place} AS ordinal, sum(n)::BIGINT AS "rows", coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS null_count,
  count(v) AS distinct_count, coalesce(max(n) FILTER (v IS NOT NULL), 0) AS most, {number.format('min')} AS "min", {number.format('max')} AS "max",
  bool_and(v IS NOT NULL AND n = 1) AS is_unique, bool_and(v IS NOT NULL AND n = 1) AND {key} AS candidate_key
FROM (SELECT {v} AS v, count(*) AS n FROM {t} GROUP BY 1)"""


SQL_MERGED_PROFILE = union_all(_merged_sql(s, t, c, i) for s, names in _MERGED.items() for t in names for i, c in enumerate(_MERGED_COLUMNS[t], 1))


def q_snapshot_retention(spark, sf):
    ids = table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyyMMdd'T'HH").alias("snapshot_id"))
    return tables.snapshot_retention(ids, "event_type", "snapshot_id")


SQL_SNAPSHOT_RETENTION = """SELECT event_type, snapshot_id, rank, rank = 1 AS latest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY snapshot_id DESC) AS rank
  FROM (SELECT DISTINCT event_type, strftime(ts, '%Y%m%dT%H') AS snapshot_id FROM events)) WHERE rank <= 20"""

def q_snapshot_history(spark, sf):
    """Runs over the orders of one year after another, each stored as a profile; the newest three of each database stay."""
    root, orders = scratch_dir(spark, "snapshots"), table(spark, sf, "orders")
    for year in range(1995, 2000):
        for name, rows in (("all", orders), ("urgent", orders.where("o_orderpriority = '1-URGENT'")))[: 1 if year % 2 else 2]:
            upto = rows.where(F.year("o_orderdate") <= year)
            snapshots.write_snapshot(profile.null_stats(upto, "orders"), root, name, str(year), keep=3)
    return snapshots.read_history(spark, root).drop("null_pct")


SQL_SNAPSHOT_HISTORY = union_all(
    f"""SELECT '{name}' AS database, '{year}' AS snapshot_id, {rank} AS rank, {rank == 1} AS latest, 'orders' AS "table", '{c}' AS "column", count(*) AS total_rows,
  count(*) - count({c}) AS nulls FROM orders WHERE year(o_orderdate) <= {year}{where}"""
    for name, years, where in (("all", (1999, 1998, 1997), ""), ("urgent", (1998, 1996), " AND o_orderpriority = '1-URGENT'"))
    for rank, year in enumerate(years, 1) for c in _CAT["orders"])

QUERIES = {
    "csv_raw_scan": (q_csv_raw_scan, SQL_CSV_RAW_SCAN),
    "csv_quoted_breaks": (q_csv_quoted_breaks, SQL_CSV_QUOTED_BREAKS),
    "typed_load": (q_typed_load, SQL_TYPED_LOAD),
    "csv_mapping": (q_csv_mapping, SQL_CSV_MAPPING),
    "file_admission": (q_file_admission, SQL_FILE_ADMISSION),
    "header_audit": (q_header_audit, SQL_HEADER_AUDIT),
    "dialect_report": (q_dialect_report, SQL_DIALECT_REPORT),
    "csv_folder_profile": (q_csv_folder_profile, SQL_CSV_FOLDER_PROFILE),
    "file_fingerprint": (q_file_fingerprint, None),
    "json_rows": (q_json_rows, SQL_JSON_ROWS),
    "sanitized_sink": (q_sanitized_sink, SQL_SANITIZED_SINK),
    "catalog_columns": (q_catalog_columns, SQL_CATALOG_COLUMNS),
    "schema_table_counts": (q_schema_table_counts, SQL_SCHEMA_TABLE_COUNTS),
    "merged_profile": (q_merged_profile, SQL_MERGED_PROFILE),
    "snapshot_history": (q_snapshot_history, SQL_SNAPSHOT_HISTORY),
    "snapshot_retention": (q_snapshot_retention, SQL_SNAPSHOT_RETENTION),
}
