import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import learning, smoothing
from tallyspark.operators import series as S


def run_level(v, a):
    fits, level = [v[0]], v[0]
    for x in v[1:]:
        fits.append(level)
        level = a * x + (1 - a) * level
    return np.array(fits), level


def run_holt(v, a, b, phi=0.9):
    level, trend, fits = v[0], v[1] - v[0], [v[0]]
    for x in v[1:]:
        f = level + phi * trend
        fits.append(f)
        new = a * x + (1 - a) * f
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
    return np.array(fits), level, trend


def run_season(v, p, a, b, g):
    m = min(p, len(v))
    season = np.zeros(p)
    season[:m] = v[:m] - np.mean(v[:m])
    level, trend, fits = np.mean(v[:m]), 0.0, []
    for i, x in enumerate(v):
        s = i % p
        fits.append(level + trend + season[s])
        new = a * (x - season[s]) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[s] = g * (x - new) + (1 - g) * season[s]
        level = new
    return np.array(fits), level, trend, season


def best(v, grid, run):
    return min(((float(np.sum((v - run(v, *g)[0]) ** 2)), i, g) for i, g in enumerate(grid)), key=lambda x: (x[0], x[1]))[2]


SERIES = [np.array([12.0, 15, 11, 18, 21, 19, 25, 28, 24, 31, 35, 30, 39, 41, 38, 44.5]), 50 + 10 * np.sin(np.arange(40)) + np.arange(40) % 7]


@pytest.mark.parametrize("v", SERIES, ids=["short", "wave"])
def test_smoothers_equal_refitting_at_every_step(v):
    n, p = len(v), 7
    level = [(a,) for a in smoothing.LEVEL_GRID]
    holt = [(a, b) for a in smoothing.HOLT_ALPHA for b in smoothing.HOLT_BETA]
    season = [(a, b, g) for a in smoothing.SEASON_ALPHA for b in smoothing.SEASON_BETA for g in smoothing.SEASON_GAMMA]
    for k in (3, 5, p, n // 2, n - 1):
        h = v[:k]
        assert np.isclose(smoothing.level_smoothing(v, 3, p)[0][k], run_level(h, *best(h, level, run_level))[1])
        _, lev, tr = run_holt(h, *best(h, holt, run_holt))
        assert np.isclose(smoothing.damped_trend(v, 3, p)[0][k], lev + 0.9 * tr)
        _, lev, tr, cyc = run_season(h, p, *best(h, season, lambda x, *g: run_season(x, p, *g)))
        assert np.isclose(smoothing.seasonal_smoothing(v, 3, p)[0][k], lev + tr + cyc[k % p])
    _, lev, tr = run_holt(v, *best(v, holt, run_holt))
    want = []
    for _ in range(3):
        tr *= 0.9
        lev += tr
        want.append(lev)
    assert np.allclose(smoothing.damped_trend(v, 3, p)[2], want)
    _, lev, tr, cyc = run_season(v, p, *best(v, season, lambda x, *g: run_season(x, p, *g)))
    assert np.allclose(smoothing.seasonal_smoothing(v, 3, p)[2], [lev + tr * (i + 1) + cyc[(n + i) % p] for i in range(3)])


def monthly(spark, values, key="a"):
    return spark.createDataFrame([(key, "MS", dt.date(2020 + i // 12, i % 12 + 1, 1), float(x)) for i, x in enumerate(values)], "k string, period string, at date, value double")


def test_forecast_end_to_end(spark):
    line = monthly(spark, [100 + 5 * i for i in range(20)])
    few = monthly(spark, [3, 4, 5], "b")
    ser = S.indexed(line.unionByName(few), ["k"])
    rows = smoothing.smoother_rows(ser, ["k"])
    points = S.baseline_points(ser, ["k"]).unionByName(rows.where("step is null").select("k", "t", "n", "actual", "model", "ahead", "fitted"))
    futures = S.baseline_futures(ser, ["k"]).unionByName(rows.where("step is not null").select("k", "step", "model", "forecast"))
    got = {(r["k"], r["step"]): r for r in S.forecast_points(ser, points, futures, ["k"]).collect()}
    assert np.isclose(got["a", 6]["value"], 100 + 5 * 25) and got["a", 1]["label"] == "2021-09-01"
    assert got["a", 1]["valid"] and got["a", 1]["reliability"] == "excellent"
    assert not got["b", 1]["valid"] and got["b", 1]["method"] == "naive" and got["b", 1]["value"] == 5.0
    assert max(step for k, step in got if k == "b") == 3


def test_overfit_and_percent_errors_use_sizes(spark):
    ser = S.indexed(monthly(spark, [-10, -12, -9, -11, -10, -13, -9, -10]), ["k"])
    scores = {r["model"]: r for r in S.model_scores(S.baseline_points(ser, ["k"]), ["k"]).collect()}
    assert all(r["mape"] > 0 for r in scores.values())
    flat = S.indexed(monthly(spark, [5.0] * 8), ["k"])
    assert not any(r["overfit"] for r in S.model_scores(S.baseline_points(flat, ["k"]), ["k"]).collect())


def test_grid_fills_gaps_and_week_ends_on_sunday(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 5), 1.0), ("a", dt.datetime(2024, 1, 17), 2.0)], "k string, t timestamp_ntz, v double")
    weeks = [(r["at"].isoformat(), r["value"]) for r in S.resample_fill(df, "t", "v", ["k"], "W").orderBy("at").collect()]
    want = pd.Series([1.0, 2.0], index=pd.to_datetime(["2024-01-01 05:00", "2024-01-17 00:00"])).resample("W").sum()
    assert weeks == [(i.date().isoformat(), x) for i, x in want.items()]
    assert S.infer_period(df, "t", ["k"]).first()["period"] == "MS"


def test_learning(spark):
    rng = np.random.default_rng(42)
    data = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(days=i), ["East", "West", "North"][i % 3], None if i % 17 == 0 else float(i % 5) / 10, int(rng.integers(1, 9)), "x") for i in range(200)]
    df = spark.createDataFrame(data, "order_id int, order_date timestamp_ntz, region string, discount double, quantity int, fixed string").withColumn("sales", F.col("quantity") * 50.0 + F.when(F.col("region") == "West", 30.0).otherwise(0.0))
    plan = {r["column"]: r["plan"] for r in learning.feature_plan(df, "sales").collect()}
    assert plan == {"order_id": "drop: identifier", "order_date": "date parts", "region": "category", "discount": "numeric", "quantity": "numeric", "fixed": "drop: constant"}
    out, task, weights = learning.forest(df.withColumn("key", F.col("order_id")), "sales", "key", trees=20)
    assert task == "regression" and weights[0][0] == "quantity"
    assert learning.regression_metrics(out, "actual", "predicted").first()["valid"]
    out, task, _ = learning.forest(df.withColumn("key", F.col("order_id")).withColumn("big", F.when(F.col("quantity") > 4, "yes").otherwise("no")).drop("sales"), "big", "key", trees=20)
    assert task == "classification" and learning.classification_metrics(out, "actual", "predicted").first()["accuracy_pct"] > 85


def test_running_median_equals_numpy(spark):
    draw = np.random.default_rng(6)
    rows = [(k, t, float(v)) for k, n in (("a", 60), ("b", 1), (None, 7), ("c", 33)) for t, v in enumerate(draw.integers(0, 9, n) / 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [("d", 0, None, "x"), ("d", 1, 2.0, "x"), ("d", 2, None, "x")], "k string, t int, value double, n string")
    found = {(r.k, r.t): r.median_before for r in S.with_median_before(df, ["k"]).collect()}
    for k, t, _ in rows:
        own = [v for kk, tt, v in rows if kk == k and tt < t]
        assert found[k, t] == (float(np.median(own)) if own else None)
    assert [found["d", t] for t in range(3)] == [None, None, 2.0] and len(found) == len(rows) + 3
    assert len(S.with_median_before(df.where("k = 'a'").drop("k"), []).collect()) == 60


def test_a_series_of_100_000_points(spark):
    n = 100_000
    series = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.lit(n).alias("n"), F.lit(7).alias("season"),
                                   (F.xxhash64("id") % 1_000_003).cast("double").alias("value"))
    points = S.baseline_points(series, ["k"]).where("model = 'median'")
    found = {r.t: r.ahead for r in points.where("t % 9973 = 0").collect()}
    values = np.array([r.value for r in series.orderBy("t").select("value").collect()])
    assert len(found) == 11 and found[0] is None
    assert all(found[t] == np.median(values[:t]) for t in found if t)


def test_holdout_keeps_the_shares_of_all_classes(spark):
    rows = [(i, "hot" if i % 3 else "rare" if i % 30 == 0 else "some", i) for i in range(2_000)] + [(5_000, "one", 0), (5_001, None, 0), (5_002, None, 1), (5_003, None, 2)]
    df = spark.createDataFrame(rows, "id int, kind string, held_before int")
    found = learning.stratified_holdout(df, "kind", "id", 0.25).collect()
    assert len(found) == len(rows) and found[0].__fields__ == ["id", "kind", "held_before", "held"]
    for kind in {k for _, k, _ in rows}:
        own = [r.held for r in found if r.kind == kind]
        assert sum(own) == int(len(own) * 0.25 + 0.5)
    again = learning.stratified_holdout(df.repartition(5), "kind", "id", 0.25).where("held").select("id").collect()
    assert {r.id for r in again} == {r.id for r in found if r.held}
    assert learning.stratified_holdout(df.limit(0), "kind", "id").collect() == []
    assert not any(r.held for r in learning.stratified_holdout(df, "kind", "id", 0.0).collect())
    assert all(r.held for r in learning.stratified_holdout(df, "kind", "id", 1.0).collect())


def test_choice_of_the_target(spark):
    df = spark.createDataFrame([(1, "a", "10", 1.5, None, "x")] * 4 + [(1, "b", "n/a", 2.5, None, "y")],
                               "order_id int, region string, unit_price string, sales double, blank double, note string")
    choose = lambda goal, explicit=None: learning.choose_target(df, goal, explicit)
    assert choose("", "region") == ("region", "explicit") and choose("", "order_id") == ("sales", "last measure")
    assert choose("forecast Unit Price") == ("unit_price", "mentioned in goal") == choose("predict unit_price by region")
    assert choose("sales and unit price") == ("sales", "mentioned in goal")
    assert choose("predict the note or the region") == ("region", "mentioned in goal") and choose("the region") == ("sales", "last measure")
    assert learning.choose_target(df.select("region", "note"), "sales") == (None, "none") == learning.choose_target(df.select("order_id"), "")


def test_rows_of_a_forest_are_dealt_evenly(spark, monkeypatch):
    """One file, one class with nearly all rows: the trees still learn in tasks of about ROWS rows, and from the same
    rows whatever partitions they come in."""
    from pyspark.ml import Pipeline

    monkeypatch.setattr(learning, "ROWS", 500)
    seen, fit = [], Pipeline.fit

    def watched(self, rows, *more):
        seen.append([len(part) for part in rows.select("_key").rdd.glom().collect()])
        return fit(self, rows, *more)

    monkeypatch.setattr(Pipeline, "fit", watched)
    df = spark.range(0, 4000, 1, 1).selectExpr("id as row_key", "id % 37 * 1.5 as weight", "if(id % 50 < 2, 'rare', 'usual') as kind", "id % 37 * 3.0 as price")
    for target in ("kind", "price"):
        out, _, first = learning.forest(df, target, "row_key", trees=3, depth=3)
        again, _, second = learning.forest(df.repartition(7), target, "row_key", trees=3, depth=3)
        assert first == second and sorted(out.collect()) == sorted(again.collect())
    assert len(seen) == 4 and all(len(parts) == 8 and max(parts) < 600 for parts in seen)
