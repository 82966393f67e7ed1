import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["kpis", "contribution_change", "root_cause_path", "column_profile", "unique_keys", "orphan_audit", "metric_query", "json_salvage", "resample_fill"]


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), cols)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
