"""CSV and JSON tables in, typed tables and profiles out, relational sources, snapshots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyspark.functions.names import identifier_suffix_expr, safe_name_expr
from tallyspark.functions.numbers import finite
from tallyspark.operators.profile import MISSING_TOKENS, column_profile, duplicate_rows, logical_type, logical_types
from tallyspark.sources.records import csv_lines, csv_records, parsed_records

EXTRA = "_extra"
# Logical type -> Spark type.
SPARK_TYPES = {
    "INTEGER": "bigint", "DECIMAL": "double", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp",
    "STRING": "string", "UNKNOWN": "string",
}


# Bytes 0x80 to 0x9f, which are control characters in latin-1 and print in cp1252.
CP1252 = {chr(b): bytes([b]).decode("cp1252", errors="ignore") for b in range(0x80, 0xA0)}
CP1252_FROM = "".join(k for k, v in CP1252.items() if v)
CP1252_TO = "".join(v for v in CP1252.values() if v)


def quoted_break_files(spark: SparkSession, path: str | list[str], quote: str = '"') -> list[str]:
    """Files in which some line holds an odd number of quotes, so that a quoted cell goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    odd = spark.read.text(path).where(quotes % 2 == 1).select(F.input_file_name().alias("file")).distinct()
    return sorted(r["file"] for r in odd.collect())


def has_quoted_breaks(spark: SparkSession, path: str | list[str], quote: str = '"') -> bool:
    return bool(quoted_break_files(spark, path, quote))


def field_count(record: Column, sep: str, quote: str) -> Column:
    """Fields of a raw record: separators outside quoted cells, plus one."""
    q = re.escape(quote)
    bare = F.regexp_replace(record, f"{q}(?:[^{q}]|{q}{q})*{q}", "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1


def read_csv_text(
    spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', encoding: str = "UTF-8",
    columns: Sequence[str] | None = None, keep_extra: bool = False, multi_line: bool | None = None, null: str | None = None,
) -> DataFrame:
    """CSV with a header, every cell a string; empty and absent cells are null. With `null`, cells that hold this
    word are null, and empty ones in quotes are empty texts.

    Every file must have the header of the first one (or `columns`) in the same order; another header is an
    error when the file is read. Files whose quoted cells hold line breaks are found by a look at the lines and
    read record by record (`records`), by as many tasks as other files. With `multi_line` every file is one task's,
    which only UTF-16 needs.

    A row with more fields than the header, filled or blank, is an error when it is used; with `keep_extra`
    it is left to the caller, with its raw text in `_extra` (`rejected_rows`).
    """
    wide = encoding.lower().startswith("utf-16")
    odd = [] if wide or multi_line is not None else quoted_break_files(spark, path, quote)
    rest = sorted(set(spark.read.text(path).inputFiles()) - set(odd)) if odd else []
    if odd and rest:
        parts = [read_csv_text(spark, f, sep, quote, encoding, columns, keep_extra, null=null) for f in (odd, rest)]
        return parts[0].unionByName(parts[1])
    multi_line = wide if multi_line is None else multi_line
    windows = encoding.lower() in ("cp1252", "windows-1252")
    marked = encoding.lower() == "utf-8-sig"
    charset = "ISO-8859-1" if windows or encoding.lower() == "latin-1" else "UTF-8" if marked else encoding
    # Without a character of its own to escape the escape, the parser takes zero bytes for one and loses them.
    options = {"sep": sep, "quote": quote, "escape": quote, "charToEscapeQuoteEscaping": quote, "encoding": charset, "multiLine": multi_line,
               "header": True, "emptyValue": "", "nullValue": null or "", "mode": "PERMISSIVE", "columnPruning": False, "enforceSchema": marked,
               "columnNameOfCorruptRecord": EXTRA}
    if columns is None:
        columns = spark.read.options(**options | {"multiLine": multi_line or bool(odd)}).csv(odd[0] if odd else path).columns
    if odd:
        record = {k: options[k] for k in ("sep", "quote", "escape", "charToEscapeQuoteEscaping", "emptyValue", "nullValue", "mode")}
        rows = parsed_records(csv_records(csv_lines(spark, odd, sep, quote, charset)), list(columns), EXTRA, record)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, EXTRA]])
        rows = spark.read.options(**options).schema(schema).csv(path)
    if windows:
        rows = rows.withColumns({f"`{c}`" if "." in c else c: F.translate(F.col(f"`{c}`"), CP1252_FROM, CP1252_TO) for c in rows.columns})
    # The parser keeps the raw text of rows with another number of fields; short rows are filled up with nulls.
    long = F.when(field_count(F.col(EXTRA), sep, quote) > len(columns), F.col(EXTRA))
    cells = [F.col(f"`{c}`").alias(c.strip()) for c in columns]
    if keep_extra:
        return rows.select(*cells, long.alias(EXTRA))
    bad = F.raise_error(F.lit("CSV row has more fields than the header")).cast("string")
    return rows.select(F.when(long.isNotNull(), bad).otherwise(cells[0]).alias(columns[0].strip()), *cells[1:])


def rejected_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(EXTRA).isNotNull())


def typed_value(column: str, kind: str, missing: Sequence[str] = MISSING_TOKENS) -> Column:
    """A text cell as its logical type; missing words and what does not parse become null."""
    v = F.trim(F.col(f"`{column}`"))
    v = F.when(~F.lower(v).isin(*missing), v)
    if kind == "BOOLEAN":
        low = F.lower(v)
        return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)
    return v.try_cast(SPARK_TYPES[kind])


def typed_table(text: DataFrame) -> DataFrame:
    """The table with its inferred types; one row per column reaches the driver to build the plan."""
    kinds = {r["column"]: r["inferred_type"] for r in logical_types(text).collect()}
    return text.select(*[typed_value(c, kinds[c]).alias(c) for c in text.columns])


def typed_load(text: DataFrame, target: str) -> DataFrame:
    """Write the typed table as parquet and read it back."""
    typed = typed_table(text)
    typed.write.mode("overwrite").parquet(target)
    return text.sparkSession.read.schema(typed.schema).parquet(target)


def csv_mapping(text: DataFrame, table: str) -> DataFrame:
    """Profile record of a CSV table: one row per column and one (`column` null) for the table."""
    prof = column_profile(text)
    type_map = F.create_map(*[F.lit(x) for k, v in SPARK_TYPES.items() for x in (k, v)])
    cols = prof.select(
        F.lit(table).alias("table"), "column", type_map[F.col("inferred_type")].alias("data_type"), "nullable",
        (F.col("non_null_count") + F.col("null_count")).alias("total_rows"), F.col("null_count").alias("nulls"),
        F.col("null_percentage").alias("null_pct"), F.col("candidate_key").alias("inferred_key"), F.lit(None).cast("bigint").alias("duplicate_rows"))
    none = F.lit(None)
    whole = duplicate_rows(text).select(
        F.lit(table).alias("table"), none.cast("string").alias("column"), none.cast("string").alias("data_type"), none.cast("boolean").alias("nullable"),
        F.col("rows").alias("total_rows"), none.cast("bigint").alias("nulls"), none.cast("double").alias("null_pct"),
        none.cast("boolean").alias("inferred_key"), "duplicate_rows")
    return cols.unionByName(whole)


def csv_folder_profile(inspected: DataFrame) -> DataFrame:
    """Column profile of every CSV file of a folder, each file a table of its own.

    Files with the same header and dialect are read together. Only file names and headers reach the driver.
    """
    spark = inspected.sparkSession
    alike: dict[tuple, list[str]] = {}
    for r in inspected.where("length > 0").select("path", "encoding", "delimiter", "quotechar", "header").collect():
        alike.setdefault((r["encoding"], r["delimiter"], r["quotechar"], tuple(r["header"])), []).append(r["path"])
    out = None
    odd = set(quoted_break_files(spark, [p for paths in alike.values() for p in paths])) if alike else set()
    split = [(key, [p for p in paths if (p in odd) == m], m or key[0].startswith("utf-16")) for key, paths in alike.items() for m in (False, True)]
    for (encoding, sep, quote, header), paths, whole in [x for x in split if x[1]]:
        rows = read_csv_text(spark, sorted(paths), sep, quote, encoding, header, keep_extra=True, multi_line=whole)
        header = [h.strip() for h in header]
        file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("raw")) for c in header])
        trimmed = F.trim("raw")
        value = F.when(F.col("raw").isNotNull() & ~F.lower(trimmed).isin(*MISSING_TOKENS), trimmed)
        counts = (
            rows.select(file.alias("file"), F.inline(cells)).withColumn("value", value).groupBy("file", "column", "value")
            .agg(F.count("*").alias("times"), F.count_if(F.col("value").isNotNull() & (F.col("raw") != F.col("value"))).alias("padded"))
        )
        out = counts if out is None else out.unionByName(counts)
    v, n = F.col("value"), F.col("times")
    stats = out.groupBy("file", "column").agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"), F.count(v).alias("distinct_count"),
        F.sum("padded").alias("whitespace_value_count"), logical_type(v).alias("inferred_type"))
    full = (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("rows"))
    return stats.select(
        safe_name_expr(F.regexp_replace("file", r"\.[^.]*$", "")).alias("table"), "column", "rows", "null_count", "distinct_count",
        "whitespace_value_count", "inferred_type", (full & identifier_suffix_expr(F.col("column"))).alias("candidate_key"))


def json_rows(spark: SparkSession, path: str, field: str = "data", schema: str | None = None, one_per_file: bool = True) -> DataFrame:
    """The rows held as a list in one field of JSON results, one result per file or per line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=one_per_file).select(F.inline(field))


def sanitized(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, the only form JSON has for them."""
    return df.select(*[
        finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls written out."""
    sanitized(df).write.option("ignoreNullFields", "false").json(path)


# --- relational sources ------------------------------------------------------------------------

JDBC_PREFIX = {"postgresql": "jdbc:postgresql", "mysql": "jdbc:mysql"}
SYSTEM_SCHEMAS = {"postgresql": ("pg_catalog", "information_schema"), "mysql": ("mysql", "sys", "performance_schema", "information_schema")}


def jdbc_options(
    kind: str, host: str, port: int, database: str, user: str, password: str, table: str,
    partition: tuple[str, int, int, int] | None = None, fetch: int = 10_000, timeout: int = 30,
) -> dict[str, str]:
    """Options for `spark.read.format("jdbc")`; `partition` is (column, lower, upper, parts)."""
    options = {
        "url": f"{JDBC_PREFIX[kind]}://{host}:{port}/{database}", "user": user, "password": password, "dbtable": table,
        "fetchsize": str(fetch), "queryTimeout": str(timeout),
    }
    if partition:
        column, low, high, parts = partition
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def catalog_query(kind: str, schema: str | None = None) -> str:
    """Subquery for `dbtable`: columns of base tables in order."""
    where = f"t.table_schema = '{schema}'" if schema else "t.table_schema NOT IN (" + ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS[kind]) + ")"
    return (
        "(SELECT c.table_schema, c.table_name, c.column_name, c.ordinal_position, c.data_type, c.is_nullable "
        "FROM information_schema.columns c JOIN information_schema.tables t "
        "ON t.table_schema = c.table_schema AND t.table_name = c.table_name "
        f"WHERE t.table_type = 'BASE TABLE' AND {where}) AS catalog_columns")


def keys_query(kind: str, constraint: str = "PRIMARY KEY") -> str:
    """Subquery for `dbtable`: columns of primary or unique keys in key order."""
    return (
        "(SELECT k.table_schema, k.table_name, k.column_name, k.constraint_name, k.ordinal_position "
        "FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
        "ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = '{constraint}') AS key_columns")


def foreign_keys_query(kind: str) -> str:
    """Subquery for `dbtable`: one row per column pair of a declared foreign key, also across schemas."""
    if kind == "mysql":
        return (
            "(SELECT table_schema, table_name, column_name, referenced_table_schema, referenced_table_name, referenced_column_name, "
            "constraint_name, ordinal_position FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL) AS foreign_keys")
    return (
        "(SELECT k.table_schema, k.table_name, k.column_name, u.table_schema AS referenced_table_schema, u.table_name AS referenced_table_name, "
        "u.column_name AS referenced_column_name, k.constraint_name, k.ordinal_position "
        "FROM information_schema.referential_constraints r "
        "JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema "
        "JOIN information_schema.key_column_usage u ON u.constraint_name = r.unique_constraint_name "
        "AND u.constraint_schema = r.unique_constraint_schema AND u.ordinal_position = k.position_in_unique_constraint) AS foreign_keys")


# --- catalogs and snapshots --------------------------------------------------------------------


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of all tables in order with type, measured rows and nulls."""
    from tallyspark.operators.edges import catalog
    from tallyspark.operators.profile import null_stats

    stats = None
    for name, df in tables.items():
        one = null_stats(df, name)
        stats = one if stats is None else stats.unionByName(one)
    return catalog(tables).join(stats, ["table", "column"])


def schema_table_counts(counts: DataFrame) -> DataFrame:
    """Tables and rows per schema of qualified table names; more than one schema means multi mode."""
    schema = F.regexp_extract("table", r"^(.*)\.[^.]*$", 1)
    per = counts.groupBy(schema.alias("schema")).agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))
    n = per.agg(F.count("*")).scalar()
    return per.withColumn("mode", F.when(n > 1, "multi").otherwise("single"))


def snapshot_retention(snapshots: DataFrame, database: str, snapshot_id: str, keep: int = 20) -> DataFrame:
    """The newest snapshots of each database; rank 1 is the latest. The rank filter prunes before the shuffle."""
    ids = snapshots.select(database, snapshot_id).distinct()
    rank = F.row_number().over(W.partitionBy(database).orderBy(F.desc(snapshot_id)))
    return ids.withColumn("rank", rank).where(F.col("rank") <= keep).withColumn("latest", F.col("rank") == 1)
