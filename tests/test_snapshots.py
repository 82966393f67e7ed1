import os

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import snapshots


def test_runs_retention_and_a_failed_run(spark, tmp_path):
    root = str(tmp_path / "store")
    assert snapshots.history(spark, root).collect() == []
    for run in range(6):
        snapshots.write_snapshot(spark.range(run + 1), root, "shop", f"2026010{run}", keep=4)
    snapshots.write_snapshot(spark.range(9), root, "a/b: other", "20250101", keep=4)
    found = [(r.snapshot_id, r["rank"], r.latest) for r in snapshots.history(spark, root).where("database = 'shop'").orderBy("rank").collect()]
    assert found == [("20260105", 1, True), ("20260104", 2, False), ("20260103", 3, False), ("20260102", 4, False)]
    assert snapshots.read_snapshot(spark, root, "shop").count() == 6 and snapshots.read_snapshot(spark, root, "shop", "20260103").count() == 4
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read_snapshot(spark, root, "shop", "20260101")
    assert sorted(len(os.listdir(f"{root}/data/{d}")) for d in os.listdir(f"{root}/data")) == [1, 4]
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("string").alias("id"))
    with pytest.raises(Exception, match="lost"):
        snapshots.write_snapshot(broken, root, "shop", "20260109", keep=4)
    assert snapshots.read_snapshot(spark, root, "shop").count() == 6
    # An older run that arrives late does not become the latest, and one written again replaces itself.
    snapshots.write_snapshot(spark.range(50), root, "shop", "20260103", keep=4)
    assert snapshots.read_snapshot(spark, root, "shop").count() == 6 and snapshots.read_snapshot(spark, root, "shop", "20260103").count() == 50
    whole = snapshots.read_history(spark, root)
    assert whole.groupBy("database").count().orderBy("database").collect() == [("a/b: other", 9), ("shop", 6 + 5 + 50 + 3)]
