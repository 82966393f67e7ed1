import datetime as dt

from tallyspark.operators import kpis
from tallyspark.streaming import jobs


def make(spark, path):
    for day in (1, 2, 3):
        rows = [(i, dt.datetime(2024, 1, day, i % 24), "ab"[i % 2], float(i % 10) if i else 500.0) for i in range(48)]
        spark.createDataFrame(rows, "id int, ts timestamp_ntz, kind string, value double").coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    make(spark, path)
    sums = jobs.window_sums(jobs.read_table_stream(spark, path, files_per_trigger=1), "ts", ["kind"], "value", delay="3 days")
    got = jobs.latest_updates(spark, jobs.run_updates(sums, "t"), ["start", "kind"])
    assert {(r["start"].day, r["kind"]): r["times"] for r in got.collect()} == {(d, k): 24 for d in (1, 2, 3) for k in "ab"}
    fences = kpis.iqr_fences(spark.read.parquet(path), ["value"])
    flags = jobs.run_append(jobs.flagged_stream(jobs.read_table_stream(spark, path, 1), fences, ["value"], ["id"]), "f")
    assert [r["value"] for r in spark.read.parquet(flags).collect()] == [500.0] * 3
    drift = jobs.profile_drift(spark, jobs.run_profiles(jobs.read_table_stream(spark, path, 1), ["kind", "value"], "p"))
    assert drift.count() == 6 and {r["null_pct_change"] for r in drift.where("batch > 0").collect()} == {0.0}


def test_drift_follows_its_state_through_a_restart(spark, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    batches = [[(1, "b"), (2, None)], [(3, None), (4, None), (5, "a"), (6, "c")], [(7, "é")]]
    for rows in batches:
        spark.createDataFrame(rows, "id int, kind string").repartition(2).write.mode("append").parquet(path)
        data = jobs.run_append(jobs.drift_stream(jobs.read_table_stream(spark, path), ["id", "kind"]), "d", out)
        # Nothing new arrives: the last batch is not said twice.
        jobs.run_append(jobs.drift_stream(jobs.read_table_stream(spark, path), ["id", "kind"]), "d", out)
    found = {(r.batch, r["column"]): tuple(r)[2:] for r in spark.read.schema(jobs.DRIFT).parquet(data).collect()}
    assert found == {
        (0, "id"): (2, 0, "1", "2", None), (0, "kind"): (2, 1, "b", "b", None), (1, "id"): (4, 0, "3", "6", 0.0),
        (1, "kind"): (4, 2, "a", "c", 0.0), (2, "id"): (1, 0, "7", "7", 0.0), (2, "kind"): (1, 0, "é", "é", -50.0)}
    # All at once from the files, a batch a file, gives the same counts.
    whole = jobs.run_append(jobs.drift_stream(jobs.read_table_stream(spark, path), ["id", "kind"]), "d", str(tmp_path / "again"))
    assert {(r["column"], r.rows, r.nulls) for r in spark.read.schema(jobs.DRIFT).parquet(whole).collect()} == {("id", 7, 0), ("kind", 7, 3)}
