import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import charts, joins, kpis, metrics, periods, profile, quantiles, retail, segments


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for month in (1, 2):
        for region in ("East", "West"):
            for category in ("A", "B"):
                for day in range(1, 7):
                    lift = 60.0 if month == 2 and region == "West" and category == "B" else 0.0
                    value = 100.0 + day + lift
                    discount = 0.05 * (day % 4)
                    rows.append((dt.datetime(2026, month, day * 4), region, category, discount, day, value, value * (0.28 - discount * 0.55)))
    return spark.createDataFrame(rows, "order_date timestamp_ntz, region string, category string, discount double, quantity int, sales double, profit double")


def test_exact_quantiles_in_few_and_in_many_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(50, 30_000), np.full(15_000, 7.0), rng.normal(0, 1e6, 200)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").union(spark.createDataFrame([(None,)], "v double"))
    probs = {"p": 0.25, "q": 0.5, "r": 0.9}
    want = np.quantile(values, [0.25, 0.5, 0.9])
    for buckets in (2_048, 3):
        monkeypatch.setattr(quantiles, "BUCKETS", buckets)
        got = quantiles.column_stats(df, ["v"], probs).first()
        assert np.allclose([got["p"], got["q"], got["r"]], want, rtol=1e-12)
        assert got["n"] == len(values) and got["nulls"] == 1


def test_spike_is_the_only_outlier(spark):
    data = [("r", float(v), i) for i, v in enumerate([98, 99, 100, 101, 102, 100, 99, 101, 100, 1000])]
    df = spark.createDataFrame(data, "region string, sales double, k int")
    out = kpis.iqr_outliers(df, ["sales"], ["k"], ["region"]).collect()
    assert [(r["k"], r["direction"], r["severity"], r["gap_pct"]) for r in out] == [(9, "high", "high", 900.0)]
    said = kpis.iqr_outliers(df, ["sales"], ["k"], ["region"]).select(kpis.outlier_sentence().alias("s")).first()["s"]
    assert said.startswith("Strong outlier: sales is 1,000 for region=r, about 900% over")
    flat = spark.createDataFrame([(5.0, i) for i in range(20)] + [(50.0, 99)], "v double, k int")
    assert [r["method"] for r in kpis.iqr_outliers(flat, ["v"], ["k"]).collect()] == ["fallback_range"]


def test_period_contribution_and_path(sales):
    comparison = periods.period_comparison(sales, "sales", "order_date").first()
    assert (comparison["granularity"], comparison["current_period"]) == ("week", "2026-02-23/2026-03-01")
    window = periods.PeriodWindow("month", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1))
    top = periods.contribution_change(sales, "sales", ["region", "category"], "order_date", window).where("rank = 1").collect()
    assert {(r["dimension"], r["segment"], r["absolute_change"], r["driver_share_pct"]) for r in top} == {("region", "West", 360.0, 100.0), ("category", "B", 360.0, 100.0)}
    path = periods.root_cause_path(sales, "sales", ["region", "category"], "order_date", window).orderBy("depth").collect()
    assert [r["segment"] for r in path] == ["West", "B"]


@pytest.mark.parametrize("days,unit", [(800, "year"), (100, "month"), (30, "week"), (10, "day")])
def test_granularity(spark, days, unit):
    df = spark.range(days + 1).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("t"), F.lit(1.0).alias("v"))
    assert periods.period_comparison(df, "v", "t").first()["granularity"] == unit
    window = periods.resolve_window(df, "v", "t")
    assert window.granularity == unit and window.previous_start < window.current_start


def test_one_period_gives_nothing(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "t timestamp_ntz, v double")
    assert periods.period_comparison(df, "v", "t").count() == 0 and periods.resolve_window(df, "v", "t") is None


def test_window_predicates_reach_the_scan(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    window = periods.PeriodWindow("month", dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 3, 1))
    plan = periods.contribution_change(df, "sales", ["region"], "order_date", window)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date" in plan and "profit" not in plan


def test_drivers_and_retail(spark, sales):
    got = segments.drivers(sales, "sales", ["quantity", "discount"]).collect()
    want = np.corrcoef([r["sales"] for r in sales.collect()], [r["quantity"] for r in sales.collect()])[0, 1]
    assert got[0]["feature"] == "quantity" and abs(got[0]["correlation"] - want) < 1e-4
    assert retail.discount_effect(sales, "discount", "profit").first()["strength"] == "moderate"
    assert retail.discount_effect(sales.withColumn("discount", F.col("discount") * 0 + F.col("quantity") % 2), "discount", "profit").count() == 0
    assert segments.drivers(sales.limit(4), "sales", ["quantity"]).count() == 0


def test_trends_over_many_slices(spark):
    up = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 37).alias("t"), F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"),
                                  F.when(F.col("id") == 2500, -1.0).otherwise(F.col("id")).alias("c"), F.lit(3.0).alias("d"))
    got = {r["column"]: r["direction"] for r in kpis.trends(up, "t", ["a", "b", "c", "d"]).collect()}
    assert got == {"a": "increasing", "b": "decreasing", "c": "mixed", "d": "flat"}
    assert kpis.trends(up.limit(2), "t", ["a"]).count() == 0


def test_nulls_and_empty_rows(spark):
    df = spark.createDataFrame([(None, "Rome", " "), (3.5, None, ""), (None, "null", None)], "total double, city string, gap string")
    out = profile.clean_rows(df).collect()
    assert [r.asDict() for r in out] == [{"total": None, "city": "Rome"}, {"total": 3.5, "city": None}]
    report = profile.clean_report(df).first()
    assert report["dropped_empty_columns"] == "gap" and report["dropped_empty_rows"] == 1


def test_query_shapes(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 31, 23, 30), "a", 1.0), (dt.datetime(2025, 1, 1), "b", 2.0), (dt.datetime(2024, 5, 1), "a", 4.0)], "t timestamp_ntz, g string, v double")
    assert metrics.year_filter(df, "t", 2024).count() == 2
    spec = metrics.MetricSpec({"total": ("sum", "v")}, {"g": "g"}, year=("t", 2024), order_by="total", limit=1)
    assert metrics.metric_query(df, spec).first().asDict() == {"g": "a", "total": 5.0}
    assert {r["extreme"] for r in metrics.both_extremes(df, "v", ["g"], 1).collect()} == {"highest", "lowest"}
    assert [r["truncated"] for r in metrics.capped_result(df, ["t"], 2).collect()] == [True, True]
    assert not metrics.capped_result(df, ["t"], 3).first()["truncated"]
    assert charts.histogram(df.where("g = 'b'"), "v").count() == 0


def test_join_elimination_keeps_only_needed_edges(spark):
    a = spark.createDataFrame([(1, 10)], "k int, x int")
    b = spark.createDataFrame([(1, 2, "n")], "bk int, ck int, bn string")
    c = spark.createDataFrame([(2, "m")], "cid int, cn string")
    path = [joins.Edge(b, "k", "bk"), joins.Edge(c, "ck", "cid")]
    assert "Join" not in joins.denormalize(a, path, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert joins.denormalize(a, path, ["x", "cn"]).first().asDict() == {"x": 10, "cn": "m"}
    assert joins.denormalize(a, path, ["bn"])._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_summary_counts_all_outliers(spark):
    df = spark.createDataFrame([(float(i % 7), i) for i in range(400)] + [(1000.0 + i, 1000 + i) for i in range(45)], "v double, k int")
    assert kpis.outlier_summary(kpis.iqr_outliers(df, ["v"], ["k"], top=None)).first()["unusual_values"] == 45
    assert kpis.iqr_outliers(df, ["v"], ["k"]).count() == 30


def test_no_measure_or_dimension_is_left_out(spark):
    names = [f"m{i}" for i in range(6)]
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1 + i), *(["x", "y"][i % 2] for _ in names), *map(float, range(i, i + 6))) for i in range(8)],
                               "at timestamp_ntz, " + ", ".join(f"d{i} string" for i in range(6)) + ", " + ", ".join(f"{n} double" for n in names))
    dims = [f"d{i}" for i in range(6)]
    assert charts.time_series(df, "at", names).columns == ["label", *names]
    assert charts.radar_series(df, "d0", names).columns == ["label", "count", *names]
    assert {r["dimension"] for r in segments.dominant_segments(df, dims, ["m1"]).collect()} == set(dims)
    assert {r["dimension"] for r in periods.contribution_share(df, "m1", dims).collect()} == set(dims)


@pytest.mark.parametrize("buckets", [32, 2_048])
def test_percentiles_by_group_equal_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    draw = np.random.default_rng(buckets)
    rows = [("hot", float(draw.normal() * 10.0 ** draw.integers(-3, 4))) for _ in range(900)] + [(None, float(i)) for i in range(4)]
    rows += [("one", 7.0), ("same", 2.0), ("same", 2.0), ("tiny", 0.0), ("tiny", 5e-324), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.5)]
    rows += [("none", None), ("odd", float("nan")), ("odd", 3.0), ("odd", float("inf"))]
    df = spark.createDataFrame([(g, v, "x") for g, v in rows], "kind string, v double, group string")
    spec = metrics.MetricSpec(measures={"rows": ("count", "*"), "mid": ("median", "v"), "top": ("p90", "v"), "least": ("p0", "v")}, dims={"kind": "kind"}, digits=12)
    found = {r.kind: r for r in metrics.metric_query(df, spec).collect()}
    assert set(found) == {g for g, _ in rows} and found["none"].mid is None and found["none"]["rows"] == 1
    for g in set(found) - {"none"}:
        own = [v for k, v in rows if k == g and v is not None and np.isfinite(v)]
        for name, p in (("mid", 0.5), ("top", 0.9), ("least", 0)):
            if g != "wide" or name != "top":
                assert found[g][name] == pytest.approx(float(np.quantile(own, p)), rel=1e-9, abs=1e-12)
    total = metrics.metric_query(df, metrics.MetricSpec(measures={"mid": ("median", "v")}, digits=12)).collect()
    assert len(total) == 1 and total[0].mid == pytest.approx(float(np.median([v for _, v in rows if v is not None and np.isfinite(v)])))
    assert metrics.metric_query(df.limit(0), spec).collect() == []


def test_quantiles_of_a_range_without_width(spark):
    df = spark.createDataFrame([(0.0,), (5e-324,), (5e-324,)], "v double")
    assert quantiles.column_stats(df, ["v"], {"m": 0.5}).first().m == 5e-324
