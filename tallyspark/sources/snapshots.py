"""A history of profiles: every run is a snapshot of its database, the newest ones stay.

A snapshot's rows are a folder of Parquet files below its database. It counts from the moment its line stands in the
manifest, a table of small files that each appear at once; a run that fails before leaves the history as it was. Readers
go by the manifest only. Retention first takes snapshots out of the manifest, then removes their folders.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEEP = 20
LINE = "database string, snapshot_id string, folder string, live boolean, at bigint"


def _folder(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _write_line(spark: SparkSession, root: str, lines: list[tuple]) -> None:
    spark.createDataFrame(lines, LINE).coalesce(1).write.mode("append").json(_folder(root, "manifest"))


def history(spark: SparkSession, root: str) -> DataFrame:
    """(database, snapshot_id, folder, rank, latest) of the snapshots that count; rank 1 is the latest by id. An id that
    was written again is the later one."""
    files, path = _path(spark, _folder(root, "manifest"))
    lines = spark.read.schema(LINE).json(str(path.toString())) if files.exists(path) else spark.createDataFrame([], LINE)
    last = lines.groupBy("database", "snapshot_id").agg(F.max_by(F.struct("folder", "live"), "at").alias("last"))
    rank = F.row_number().over(W.partitionBy("database").orderBy(F.desc("snapshot_id")))
    live = last.where("last.live").select("database", "snapshot_id", F.col("last.folder").alias("folder"), rank.alias("rank"))
    return live.withColumn("latest", F.col("rank") == 1)


def write_snapshot(profile: DataFrame, root: str, database: str, snapshot_id: str, keep: int = KEEP) -> None:
    """Store the rows as a snapshot of the database, then drop all but the `keep` newest ones by id."""
    spark = profile.sparkSession
    folder = f"database={uuid.uuid5(uuid.NAMESPACE_URL, database).hex}/{uuid.uuid4().hex}"
    profile.write.parquet(_folder(root, "data", folder))
    _write_line(spark, root, [(database, snapshot_id, folder, True, time.time_ns())])
    prune(spark, root, database, keep)


def prune(spark: SparkSession, root: str, database: str, keep: int = KEEP) -> None:
    """Drop the older snapshots of a database. Folders go after the manifest has let go of them."""
    old = history(spark, root).where((F.col("database") == database) & (F.col("rank") > keep)).collect()
    if old:
        _write_line(spark, root, [(r.database, r.snapshot_id, r.folder, False, time.time_ns()) for r in old])
    for r in old:
        files, path = _path(spark, _folder(root, "data", r.folder))
        files.delete(path, True)


def read_snapshot(spark: SparkSession, root: str, database: str, snapshot_id: str | None = None) -> DataFrame:
    """The rows of a snapshot, the latest one unless named."""
    wanted = F.col("latest") if snapshot_id is None else F.col("snapshot_id") == snapshot_id
    found = history(spark, root).where((F.col("database") == database) & wanted).first()
    if found is None:
        raise ValueError(f"{database} has no snapshot {snapshot_id or ''}".rstrip())
    return spark.read.parquet(_folder(root, "data", found.folder))


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all snapshots that count, with database, snapshot_id, rank and latest before them."""
    out = None
    for r in history(spark, root).orderBy("database", "rank").collect():
        one = spark.read.parquet(_folder(root, "data", r.folder)).select(
            F.lit(r.database).alias("database"), F.lit(r.snapshot_id).alias("snapshot_id"), F.lit(r["rank"]).alias("rank"), F.lit(r.latest).alias("latest"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no snapshot has been written")
    return out
