"""Joins that make many more rows than they read."""

import pytest
from pyspark.sql import functions as F

from veldgraph import graph_queries, more_queries
from veldgraph.operators import lower, spread
from veldgraph.sources.tables import catalog


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(spread, "LEAST_ROWS", 100)
    monkeypatch.setattr(spread, "CELL_ROWS", 50)
    monkeypatch.setattr(spread, "TASK_ROWS", 200)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_frequent_key_is_spread_over_tasks(spark, small):
    a = spark.range(120).select(F.col("id").alias("a"), F.when(F.col("id") < 100, 1).when(F.col("id") < 110, 2).alias("k"))
    b = spark.range(90).select(F.col("id").alias("b"), F.when(F.col("id") < 80, 1).when(F.col("id") < 85, 3).alias("k"))
    found, wide = spread.spread_join(a, b, ["k"])
    assert wide and sorted((r["k"], r["a"], r["b"]) for r in found.collect()) == [(1, i, j) for i in range(100) for j in range(80)]
    assert most_in_a_task(found) < 1600  # 8,000 pairs of one key


def test_sides_without_a_common_column(spark, small):
    found, wide = spread.spread_join(spark.range(3).toDF("a"), spark.range(1000).selectExpr("id as b", "id * 2 as c"), [])
    assert wide and sorted((r["a"], r["b"], r["c"]) for r in found.collect()) == [(i, j, 2 * j) for i in range(3) for j in range(1000)]
    assert most_in_a_task(found) < 1000
    assert spread.spread_join(spark.range(3).toDF("a"), spark.range(0).toDF("b"), [])[0].count() == 0


@pytest.mark.parametrize("name", ["optional_then_join", "value_join", "theta_self_join"])
def test_queries_give_the_same_rows_spread(spark, sf, same, small, name):
    same(graph_queries.QUERIES[name], graph_queries.SQL[name])


def test_cross_join_of_unbound_rows_is_spread(spark, sf, small):
    found = graph_queries.QUERIES["optional_then_join"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert most_in_a_task(found) < 2000


def test_value_join_is_spread(spark, sf, small):
    assert most_in_a_task(graph_queries.QUERIES["value_join"](spark, sf)) < 150


def test_a_join_on_a_key_is_not_counted(spark, sf, monkeypatch):
    def counted(*_):
        raise AssertionError("counted")

    monkeypatch.setattr(spread, "_pairs", counted)
    for name in ("fk_inner", "chain3", "optional_star", "fan_out"):
        graph_queries.QUERIES[name](spark, sf)


PLAIN = [
    "SELECT $this ?path WHERE { $this a :Supplier ; :nation ?n . ?peer a :Supplier ; :nation ?n . FILTER(?peer != $this) BIND(:nation AS ?path) }",
    "SELECT $this WHERE { $this a :Supplier ; :nation ?n . ?peer a :Supplier ; :nation ?n . FILTER($this != ?peer) }",
    "SELECT $this ?path WHERE { $this a :Supplier ; :nation ?n . ?peer a :Customer ; :nation ?n . FILTER(?peer != $this) BIND(?n AS ?path) }",
    "SELECT $this WHERE { $this a :Supplier ; :nation ?n . ?peer a :Customer ; :nation ?n ; :segment 'BUILDING' }",
    "SELECT $this WHERE { $this a :Supplier ; :nation ?n ; :acctbal ?b . ?peer a :Supplier ; :nation ?n ; :acctbal ?d . FILTER(?peer != $this && ?d > ?b) }",
    "SELECT $this ?path WHERE { $this a :Supplier ; :nation ?n . ?path a :Supplier ; :nation ?n . FILTER(?path != $this) }",
    "SELECT $this WHERE { $this a :Supplier ; :nation ?n . ?p a :Supplier ; :nation ?n . ?q a :Customer ; :nation ?n . FILTER(?p != $this) FILTER(?p != ?q) }",
    "SELECT $this WHERE { $this a :Supplier ; :nation ?n . ?p a :Supplier ; :nation ?n . ?q a :Supplier ; :nation ?n . FILTER(?p != $this && ?q != $this && ?p != ?q) }",
    "SELECT $this WHERE { $this a :Nation . ?p a :Supplier ; :nation $this . ?q a :Supplier ; :nation $this . FILTER(?p != ?q) }",
    "SELECT $this WHERE { $this a :Order ; :customer ?c ; :status 'P' . ?peer a :Order ; :customer ?c ; :status 'F' . FILTER(?peer != $this) }",
    "SELECT $this WHERE { $this a :Supplier ; :nation ?n . ?peer a :Party ; :nation ?n . FILTER(?peer != $this) }",
]


@pytest.mark.parametrize("text", PLAIN)
def test_set_of_some_variables(spark, text):
    tables = catalog(spark, "/root/testdata/sf0.01")
    whole = lower.solutions(spark, tables, text).df
    found = lower.solutions(spark, tables, text, keep=("this", "path")).df
    columns = [c for c in ("this", "path") if c in whole.columns]
    assert set(map(tuple, found.select(*columns).collect())) == set(map(tuple, whole.select(*columns).collect())) != set()


def test_query_rule_makes_no_pairs(spark):
    found = lower.solutions(spark, catalog(spark, "/root/testdata/sf0.01"), PLAIN[0], keep=("this", "path")).df
    assert found.count() == 100 - found.sparkSession.read.parquet("/root/testdata/sf0.01/supplier.parquet").groupBy("s_nationkey").count().where("count = 1").count()


def test_registered_query_rule_makes_no_pairs(spark, sf):
    plan = more_queries.shacl_sparql(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(peer" in plan and "max(peer" in plan
