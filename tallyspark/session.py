"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; `conf` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the session, once per application: functions that run in
    tasks are looked up there by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    The folder is named by `spark.checkpoint.dir`. Only a local session may have none set (tests, one
    machine) and gets a temporary one of its own; on a cluster every executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: cuts lineage, survives executor loss. `options` go to the writer."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table of known size (names, rules, edges), which the planner can ship to the other side."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T._parse_datatype_string(schema)
    names = struct.fieldNames()
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    arrow = to_arrow_schema(struct)
    arrays = [pa.array(list(c), type=arrow.field(i).type) for i, c in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)
