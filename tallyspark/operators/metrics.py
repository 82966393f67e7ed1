"""The query shapes of a business question: measures by dimensions, filtered, ranked, compared."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.operators.quantiles import group_key, group_quantiles

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "count_distinct": F.count_distinct, "stddev": F.stddev_samp, "variance": F.var_samp,
}


def quantile_share(kind: str) -> float | None:
    """0.5 for median, 0.9 for p90, 0.995 for p99.5; None for the other aggregates."""
    found = re.fullmatch(r"p(\d{1,2}(?:\.\d+)?|100)", kind)
    return 0.5 if kind == "median" else float(found[1]) / 100 if found else None


def predicate(column: str, op: str, value=None) -> Column:
    """One comparison: = != <> >= <= > < LIKE ILIKE, IS / IS NOT (null)."""
    c, op = F.col(column), " ".join(op.upper().split())
    if op in ("IS", "IS NOT"):
        return c.isNull() if op == "IS" else c.isNotNull()
    if op in ("LIKE", "ILIKE"):
        return c.like(value) if op == "LIKE" else c.ilike(value)
    return {
        "=": c == value, "!=": c != value, "<>": c != value, ">=": c >= value,
        "<=": c <= value, ">": c > value, "<": c < value,
    }[op]


def filtered(df: DataFrame, *conditions: tuple) -> DataFrame:
    """All conditions at once; the planner pushes them to the scan."""
    for condition in conditions:
        df = df.where(predicate(*condition))
    return df


def year_filter(df: DataFrame, ts: str, year: int) -> DataFrame:
    """Rows of one calendar year; the end is open, so times on the last day stay in."""
    kind = dict(df.dtypes)[ts]
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast(kind) for y in (year, year + 1))
    return df.where((F.col(ts) >= low) & (F.col(ts) < high))


def with_computed_measure(df: DataFrame, quantity: str, price: str, name: str = "amount") -> DataFrame:
    return df.withColumn(name, F.col(quantity) * F.col(price))


@dataclass(frozen=True)
class MetricSpec:
    """measures: output name -> (aggregate, column); dims: output name -> column expression.

    Aggregates are those of `AGGREGATES`, `median`, and percentiles as `p90`.
    """

    measures: dict[str, tuple[str, str]]
    dims: dict[str, Column | str] = field(default_factory=dict)
    filters: tuple[tuple, ...] = ()
    year: tuple[str, int] | None = None
    order_by: str | None = None
    ascending: bool = False
    limit: int | None = None
    digits: int = 4


def metric_query(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Measures by dimensions after filters, ranked and cut if asked; one row without dimensions."""
    rows = filtered(df, *spec.filters)
    if spec.year:
        rows = year_filter(rows, *spec.year)
    dims = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in spec.dims.items()]
    shares = {n: (c, p) for n, (kind, c) in spec.measures.items() if (p := quantile_share(kind)) is not None}
    aggs = [AGGREGATES[kind](c if c != "*" else F.lit(1)).alias(n) for n, (kind, c) in spec.measures.items() if n not in shares]
    if shares:
        key = group_key(dims)
        out = rows.groupBy(key.alias("__group"), *dims).agg(*aggs or [F.count(F.lit(1)).alias("__rows")])
        out = out.join(group_quantiles(rows, key, shares).withColumnRenamed("group", "__group"), "__group", "left")
    else:
        out = rows.groupBy(*dims).agg(*aggs)
    if spec.order_by:
        key = F.col(spec.order_by)
        out = out.orderBy(key.asc() if spec.ascending else key.desc(), *spec.dims)
    if spec.limit is not None:
        out = out.limit(spec.limit)
    rounded = [
        F.round(n, spec.digits).alias(n) if dict(out.dtypes)[n] == "double" else F.col(n) for n in spec.measures
    ]
    return out.select(*spec.dims, *rounded)


def average_of_totals(df: DataFrame, entity: str, measure: str, digits: int = 4) -> DataFrame:
    """Average of per-entity sums, e.g. the average order value."""
    totals = df.groupBy(entity).agg(F.sum(measure).alias("t"))
    return totals.agg(F.count("*").alias("entities"), F.round(F.avg("t"), digits).alias("average_total"))


def overview_row(df: DataFrame, label: str, measure: str | None = None, digits: int = 2) -> DataFrame:
    value = F.count("*").cast("double") if measure is None else F.coalesce(F.sum(measure), F.lit(0.0)).cast("double")
    return df.agg(value.alias("v")).select(F.lit(label).alias("metric"), F.round("v", digits).alias("value"))


def metrics_overview(entity: tuple[str, DataFrame], facts: Sequence[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """Entity count, then row count and sum of the first measure of each table that refers to it."""
    from tallyspark.functions.names import natural_label

    name, table = entity
    out = overview_row(table, f"Total {natural_label(name, many=True)}")
    for fact, rows, measure in facts:
        out = out.unionByName(overview_row(rows, f"Total {natural_label(fact, many=True)}"))
        if measure:
            label = natural_label(measure)
            label = f"Total {natural_label(fact)} value" if label in ("total", "amount", "value") else f"Total {label}"
            out = out.unionByName(overview_row(rows, label, measure))
    return out


def top_n(df: DataFrame, by: str, tie: Sequence[str], n: int, ascending: bool = False, offset: int = 0) -> DataFrame:
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    out = df.orderBy(key, *tie)
    return (out.offset(offset) if offset else out).limit(n)


def both_extremes(df: DataFrame, by: str, tie: Sequence[str], n: int) -> DataFrame:
    """The n highest and n lowest rows, each a top-k of its own; `extreme` tells which."""
    high = top_n(df, by, tie, n).withColumn("extreme", F.lit("highest"))
    low = top_n(df, by, tie, n, ascending=True).withColumn("extreme", F.lit("lowest"))
    return high.unionByName(low)


def preview(df: DataFrame, keys: Sequence[str], n: int = 50) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def interleave_groups(df: DataFrame, group: str, order: Sequence[str], item: str, n: int) -> DataFrame:
    """First rows of all groups, then second rows, and so on; an item counts where it is seen first.

    Only the first n of a group can be reached, and the rank filter prunes to those before the shuffle.
    """
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    first = F.min(F.struct("turn", group))
    return (
        df.withColumn("turn", turn).where(F.col("turn") <= n)
        .groupBy(item).agg(first.alias("at"))
        .orderBy("at.turn", f"at.{group}", item).limit(n)
        .select(F.col(f"at.{group}").alias(group), F.col("at.turn").alias("turn"), item)
    )


def capped_result(df: DataFrame, keys: Sequence[str], cap: int = 10_000) -> DataFrame:
    """At most `cap` rows in key order, each marked whether the whole result is longer."""
    longer = df.select(F.lit(1).alias("x")).limit(cap + 1).agg(F.count("*") > cap).scalar()
    return df.orderBy(*keys).limit(cap).withColumn("truncated", longer)
