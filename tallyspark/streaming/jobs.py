"""Period sums, outlier flags and profile snapshots as streams."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyspark.operators.kpis import flag_outliers, number
from tallyspark.session import scratch_dir, ship


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = spark.read.parquet(path).inputFiles()
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == name:
        return reader.option("pathGlobFilter", name).parquet(path.rstrip("/").rsplit("/", 1)[0])
    return reader.parquet(path)


def window_sums(events: DataFrame, ts: str, keys: Sequence[str], value: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Sum and count per tumbling window and segment; late rows are taken up to `delay`."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", length), *keys).agg(
        F.sum(number(value)).alias("value"), F.count("*").alias("times")
    ).select(F.col("window.start").alias("start"), *keys, "value", "times")


def run_updates(sums: DataFrame, label: str) -> str:
    """Run a stream of updated windows to the end of its input; each batch writes what changed.

    A window may be written by several batches; `latest_updates` keeps the last word. Batches write to
    a folder of their own, so a batch that is run again replaces itself.
    """
    spark = sums.sparkSession
    out = scratch_dir(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query: StreamingQuery = (
        sums.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return f"{out}/data"


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in keys and c != "batch"]
    last = F.max_by(F.struct(*fields), "batch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def flagged_stream(events: DataFrame, fences: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Outlier cells of a stream against fences, one row per column, which stand in the plan as literals."""
    fields = ("median", "low", "high", "severe_low", "severe_high", "method")
    known = {r["column"]: r for r in fences.select("column", *fields).collect()}

    def literal(column: str):
        parts = [F.lit(known[column][f] if column in known else None).cast("string" if f == "method" else "double").alias(f) for f in fields]
        return F.struct(*parts).alias(column)

    return flag_outliers(events, F.struct(*[literal(c) for c in columns]), columns, keep)


def run_append(rows: DataFrame, label: str, out: str | None = None) -> str:
    """Run a stream to the end of its input; with the folder of an earlier run it goes on where that one ended."""
    out = out or scratch_dir(rows.sparkSession, label)
    query = (
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/data").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{out}/data"


def run_profiles(events: DataFrame, columns: Sequence[str], label: str) -> str:
    """One profile row per column and micro-batch: rows, nulls, least and greatest value."""
    spark = events.sparkSession
    out = scratch_dir(spark, label)

    def profile(batch: DataFrame, batch_id: int) -> None:
        blocks = [
            F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("nulls"),
                     F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high"))
            for c in columns
        ]
        batch.agg(F.array(*blocks).alias("b")).select(F.inline("b")).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = (
        events.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(profile).start()
    )
    query.awaitTermination()
    return f"{out}/data"


def profile_drift(spark: SparkSession, path: str) -> DataFrame:
    """Each batch profile beside the one before it."""
    rows = spark.read.parquet(path)
    w = W.partitionBy("column").orderBy("batch")
    before = F.lag("nulls").over(w) / F.lag("rows").over(w)
    share = F.try_divide("nulls", "rows")
    return rows.select(
        F.col("batch").cast("bigint").alias("batch"), "column", "rows", "nulls", "low", "high",
        F.round((share - before) * 100, 2).alias("null_pct_change"))


PARTIAL = "column string, rows bigint, nulls bigint, low string, high string"
DRIFT = "batch bigint, column string, rows bigint, nulls bigint, low string, high string, null_pct_change double"


def drift_stream(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column's profile in every micro-batch, and how its share of nulls changed since the last batch with rows.

    Tasks first reduce their rows to one per column and Arrow batch, so a column is a few rows when it reaches its
    state: the number of its last batch, and that batch's rows and nulls. State and output are committed with the batch;
    a batch that is run again finds the state from before it and says the same.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])

    def reduced(batches):
        for cells in batches:
            found = cells.groupby("column", sort=False)["value"].agg(rows="size", known="count")
            found = found.assign(nulls=found["rows"] - found["known"]).join(
                cells.dropna(subset="value").groupby("column")["value"].agg(low="min", high="max")).reset_index()
            yield found[["column", "rows", "nulls", "low", "high"]].astype({"low": object, "high": object}).where(lambda f: f.notna(), None)

    def follow(key, parts, state):
        parts = pd.concat(list(parts))
        rows, nulls = int(parts["rows"].sum()), int(parts["nulls"].sum())
        batch, rows_before, nulls_before = state.get if state.exists else (-1, 0, 0)
        change = round((nulls / rows - nulls_before / rows_before) * 100, 2) if rows_before else None
        state.update((batch + 1, rows, nulls))
        low, high = parts["low"].dropna(), parts["high"].dropna()
        yield pd.DataFrame({"batch": [batch + 1], "column": [key[0]], "rows": [rows], "nulls": [nulls], "low": [low.min() if len(low) else None],
                            "high": [high.max() if len(high) else None], "null_pct_change": pd.Series([change], dtype="float64")})

    ship(events.sparkSession)
    parts = events.select(F.inline(cells)).mapInPandas(reduced, PARTIAL)
    return parts.groupBy("column").applyInPandasWithState(
        follow, DRIFT, "batch bigint, rows bigint, nulls bigint", "append", GroupStateTimeout.NoTimeout)
