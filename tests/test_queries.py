"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: round(x, 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted(repr([clean(r[i]) for i in order]) for r in got)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, data, name):
    df = core.queries()[name](spark, data)
    got = df.collect()
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_probe_learns_its_training_part(spark, data):
    got = core.queries()["probe_predictions"](spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/embeddings.parquet").count()
    train = [r for r in got if r["train"]]
    assert 0.7 <= len(train) / len(got) <= 0.8
    assert sum(r["pred"] == r["label"] for r in train) > 2 * len(train) / len({r["label"] for r in got})
    assert all(0 <= r["anomaly"] <= 1 and (r["pred"] != 0 or r["anomaly"] < 0.95) for r in got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_stay_in_the_jvm(spark, data):
    for name in ("incidents", "clusters", "scan_floor", "gate", "match_disjoint", "rule_health", "parsed_replies"):
        plan = core.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_clusters_shuffle_once(spark, data):
    plan = core.queries()["clusters"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
