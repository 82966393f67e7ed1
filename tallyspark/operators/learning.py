"""Tabular prediction: which columns to use and how, imputation and encoding, a random forest, its scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.names import is_identifier
from tallyspark.functions.numbers import parsed
from tallyspark.operators.kpis import number
from tallyspark.operators.profile import value_counts
from tallyspark.operators.quantiles import column_stats, group_key, values_at_ranks
from tallyspark.session import stored

# Words that mark a time column; parts a time column is replaced by.
DATE_HINTS = ("date", "time", "timestamp", "year", "month", "day", "week", "quarter")
DATE_PARTS = ("year", "month", "day", "dayofweek")
TREES = 220
ROWS = 20_000  # rows of a training task


def feature_plan(df: DataFrame, target: str, most_texts: int = 100, some_texts: int = 30, varied: float = 0.55) -> DataFrame:
    """What to do with each column: drop ids, constants, empty and very varied text; expand dates; else numeric or category.

    Text is very varied with more than `most_texts` different values, or with more than `some_texts` that make up
    more than the share `varied` of all."""
    columns = [c for c in df.columns if c != target]
    counts = value_counts(df, columns, missing=())
    v, n = F.col("value"), F.col("times")
    stats = counts.groupBy("column").agg(
        F.count(v).alias("distinct"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("filled"),
        F.sum("times").alias("rows"),
        F.coalesce(F.sum(F.when(parsed(v).isNotNull(), n)), F.lit(0)).alias("numbers"),
        F.coalesce(F.sum(F.when(F.expr("try_cast(value as timestamp)").isNotNull(), n)), F.lit(0)).alias("times_ok"),
        F.coalesce(F.sum(F.when(v.rlike("[-/:T]"), n)), F.lit(0)).alias("time_like"),
    )
    by_type = {f.name: isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) for f in df.schema.fields}
    is_id = F.col("column").isin(*[c for c in columns if is_identifier(c, "wide")])
    typed = F.col("column").isin(*[c for c in columns if by_type[c]])
    hinted = F.col("column").isin(*[c for c in columns if any(h in c.lower() for h in DATE_HINTS)]) | (
        F.try_divide("time_like", "filled") >= 0.6)
    share = F.try_divide("distinct", "filled")
    plan = (
        F.when(is_id, "drop: identifier").when(F.col("filled") == 0, "drop: all values missing")
        .when(F.col("distinct") <= 1, "drop: constant")
        .when(typed | (hinted & (F.try_divide("times_ok", "rows") >= 0.8)), "date parts")
        .when(F.try_divide("numbers", "filled") >= 0.8, "numeric")
        .when((F.col("distinct") > most_texts) | ((F.col("distinct") > some_texts) & (share > varied)), "drop: too many different texts")
        .otherwise("category")
    )
    return stats.select("column", "distinct", plan.alias("plan"))


def planned_features(df: DataFrame, target: str, key: str) -> tuple[DataFrame, list[str], list[str]]:
    """Key, target and the planned columns, and the names of the numeric and the category ones."""
    plan = {r["column"]: r["plan"] for r in feature_plan(df.drop(key), target).collect()}
    numeric, category, out = [], [], []
    for c in df.columns:
        what = plan.get(c)
        if what == "numeric":
            numeric.append(c)
            out.append(number(c).alias(c))
        elif what == "category":
            category.append(c)
            out.append(F.col(f"`{c}`").cast("string").alias(c))
        elif what == "date parts":
            at = F.expr(f"try_cast(`{c}` as timestamp)")
            for part, value in zip(DATE_PARTS, (F.year(at), F.month(at), F.day(at), F.weekday(at))):
                numeric.append(f"{c}__{part}")
                out.append(value.cast("double").alias(f"{c}__{part}"))
    return df.select(key, target, *out), numeric, category


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the first in order among equals."""
    counts = value_counts(df, columns, missing=()).where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("times"), F.col("value"))).alias("value"))


def imputed_features(df: DataFrame, numeric: Sequence[str], category: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Medians for missing numbers, then centred and scaled by the population deviation; most frequent text for missing text."""
    med = column_stats(df, numeric, {"m": 0.5})
    medians = med.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in numeric]).alias("s")).scalar()
    top = modes(df, category).agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in category]).alias("s")).scalar()
    full = df.withColumn("_m", medians).withColumn("_t", top).select(
        *keys, *[F.coalesce(number(c), F.col("_m")[c]).alias(c) for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.col("_t")[c]).alias(c) for c in category])
    spread = full.agg(F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in numeric]).alias("s")).scalar()
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col("_s")[c]["mean"], F.col("_s")[c]["sd"]), F.lit(0.0))
    return full.withColumn("_s", spread).select(*keys, *[F.round(scaled(c), 6).alias(c) for c in numeric], *category)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2, MAPE over non-zero actuals, accuracy, validity and reliability."""
    a, p = number(actual), number(predicted)
    err = a - p
    s = df.where(a.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.sum(err * err).alias("sse"),
        (F.var_pop(a) * F.count(a)).alias("sst"), (F.avg(F.when(F.abs(a) > 1e-12, F.abs(F.try_divide(err, a)))) * 100).alias("mape"))
    r2 = F.when(F.col("sst") > 0, 1 - F.try_divide("sse", "sst"))
    like = F.greatest(F.lit(0.0), 100 - F.col("mape"))
    valid = F.coalesce(r2 >= 0.30, F.lit(False)) | F.coalesce(like >= 70, F.lit(False))
    return s.select(
        F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round(r2, 4).alias("r2"), F.round("mape", 2).alias("mape_pct"),
        F.round(F.when(F.col("mape").isNotNull(), like), 2).alias("accuracy_like_pct"), valid.alias("valid"),
        F.when(F.coalesce(r2 >= 0.65, F.lit(False)), "high").when(valid, "medium").otherwise("low").alias("reliability"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted F1 from the counts of (actual, predicted)."""
    cells = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    by_a = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    by_p = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("said"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.coalesce("said", F.lit(0))), F.lit(0.0))
    s = by_a.join(by_p, "k", "left").agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("acc"), F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1"))
    acc = F.col("acc")
    return s.select(
        F.round(acc * 100, 2).alias("accuracy_pct"), F.round(F.col("f1") * 100, 2).alias("weighted_f1_pct"), (acc >= 0.65).alias("valid"),
        F.when(acc >= 0.85, "high").when(acc >= 0.65, "medium").otherwise("low").alias("reliability"))


# Words of a goal that ask for a prediction.
PREDICTION_WORDS = ("predict", "prediction", "forecast", "estimate", "expected", "future")


def choose_target(df: DataFrame, goal: str = "", explicit: str | None = None, numeric: float = 0.8) -> tuple[str | None, str]:
    """Which column to predict, and why: one that is asked for by name, one that the goal mentions, else the last measure.

    Measures are columns whose values are numbers, at least the share `numeric` of them; identifiers are never predicted.
    Of several mentioned measures the last one counts; another kind of column counts, the first one mentioned, only if the
    goal asks for a prediction. One pass over the table says which columns are measures.
    """
    free = [c for c in df.columns if not is_identifier(c, "wide")]
    if explicit in free:
        return explicit, "explicit"
    share = [F.try_divide(F.count(parsed(F.col(f"`{c}`").cast("string"))), F.count(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(free)]
    found = df.agg(*share).first() if free else ()
    said = goal.strip().lower().replace("_", " ")
    asks = any(w in goal.lower() for w in PREDICTION_WORDS)
    # Kinds in the order of their claim; within a kind, the place of the column.
    claims = []
    for i, c in enumerate(free):
        plain = c.lower().replace("_", " ")
        measure, mentioned = (found[i] or 0) >= numeric, bool(plain) and plain in said
        if measure:
            claims.append((3 if mentioned else 1, i, c))
        elif mentioned and asks:
            claims.append((2, -i, c))
    kind, _, best = max(claims, default=(0, 0, None))
    return best, {0: "none", 1: "last measure"}.get(kind, "mentioned in goal")


def stratified_holdout(df: DataFrame, label: str, key: str, share: float = 0.25) -> DataFrame:
    """`df` with `held`: of each class of `label`, round(n * share) rows, those whose hash of `key` is least.

    The hash that parts a class is its value at that rank, found for all classes in the same rounds of counting
    (`values_at_ranks`), so a class with most rows is split like any other. Shares of both parts are those of the whole
    up to one row a class; rows with the same key and class stay together. A null label is a class too.
    """
    code = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 12).cast("double")  # 52 bits: exact as a double
    group = group_key([F.col(f"`{label}`").cast("string")])
    rows = stored(df.select(group.alias("group"), F.lit(0).alias("slot"), code.alias("x")), "codes")
    spans = stored(rows.groupBy("group", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "spans")
    quota = F.round(F.col("n") * F.lit(float(share))).cast("bigint")
    last = values_at_ranks(rows, spans, spans.select("group", "slot", (quota - 1).alias("rank")).where("rank >= 0"))
    cut = last.select(F.col("group").alias("_group"), F.col("value").alias("_cut"))
    met = df.withColumn("_group", group).withColumn("_code", code).join(cut, "_group", "left")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col("_code") <= F.col("_cut"), F.lit(False)).alias("held"))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """`df` in partitions of about ROWS of its `rows` rows, told by a hash of the key and sorted by it: however few
    files or classes it comes from, work and memory of a task stay the same."""
    return df.repartition(max(1, -(-rows // ROWS)), key).sortWithinPartitions(key)


def forest(df: DataFrame, target: str, key: str, trees: int = TREES, depth: int = 10, seed: int = 42, top: int = 12):
    """Train on three quarters of the rows, told by a hash of the key, and predict the rest; in a classification three
    quarters of each class.

    Returns the hold-out rows with `actual` and `predicted`, the task, and the `top` importances, by column. The task is
    regression when nine tenths of the target are numbers.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    found = df.agg(F.count(F.expr(f"try_cast(cast(`{target}` as string) as double)")).alias("numbers"), F.count(target).alias("n")).first()
    task = "regression" if found.n and found.numbers / found.n >= 0.9 else "classification"
    label = number(target) if task == "regression" else F.col(target).cast("string")
    usable = df.withColumn(target, label).where(F.col(target).isNotNull())
    wide, numeric, category = planned_features(usable, target, key)
    wide = wide.withColumnsRenamed({key: "_key", target: "_target"})
    wide = wide.fillna("(none)", category) if category else wide
    if task == "classification":
        wide = stratified_holdout(wide, "_target", "_key")
    else:
        wide = wide.withColumn("held", F.pmod(F.xxhash64("_key"), F.lit(4)) == 0)
    wide = dealt(stored(wide, "rows"), "_key", found.n)
    train, test = wide.where("not held"), wide.where("held")
    stages, inputs = [], []
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]))
        inputs += [f"{c}__i" for c in numeric]
    if category:
        stages.append(StringIndexer(inputCols=category, outputCols=[f"{c}__n" for c in category], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__n" for c in category], outputCols=[f"{c}__h" for c in category], handleInvalid="keep"))
        inputs += [f"{c}__h" for c in category]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep"))
    common = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "_said", "numTrees": trees, "maxDepth": depth, "seed": seed}
    if task == "regression":
        train = train.withColumn("_label", F.col("_target"))
        stages.append(RandomForestRegressor(minInstancesPerNode=2, **common))
        fitted = Pipeline(stages=stages).fit(train)
        said = F.col("_said")
    else:
        labels = StringIndexer(inputCol="_target", outputCol="_label", handleInvalid="skip").fit(train)
        # A row per class; a join on the class would put each class in one task.
        per = train.groupBy("_target").agg(F.count("*").alias("n")).collect()
        total = sum(r.n for r in per)
        weight = F.create_map(*[F.lit(x) for r in per for x in (r["_target"], total / (len(per) * r.n))])
        stages.append(RandomForestClassifier(weightCol="_w", **common))
        fitted = Pipeline(stages=stages).fit(labels.transform(train.withColumn("_w", F.element_at(weight, F.col("_target")))))
        stages.append(IndexToString(inputCol="_said", outputCol="_named", labels=labels.labels))
        fitted = PipelineModel([*fitted.stages, stages[-1]])
        said = F.col("_named")
    out = fitted.transform(test).select(F.col("_key").alias(key), F.col("_target").alias("actual"), said.alias("predicted"))
    model = next(m for m in fitted.stages if hasattr(m, "featureImportances"))
    return out, task, _importances(model, fitted.transform(test), [*numeric, *category], top)


def _importances(model, rows: DataFrame, columns: Sequence[str], top: int) -> list[tuple[str, float]]:
    """Importance per source column, the largest first: the slots of the feature vector know their column."""
    values, out = model.featureImportances.toArray(), dict.fromkeys(columns, 0.0)
    for group in rows.schema["_features"].metadata["ml_attr"]["attrs"].values():
        for slot in group:
            encoded = slot["name"].rpartition("__i")[0] or slot["name"].partition("__h_")[0]
            out[encoded] += float(values[slot["idx"]])
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))[:top]
