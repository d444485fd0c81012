"""Peers of query rules over whole tables."""

import pytest
from pyspark.sql import functions as F

from veldgraph import more_queries, rule_queries
from veldgraph.operators import solve, spread
from veldgraph.plans.rules import parse_shapes


def shapes(*slots):
    rule = 'e:R{i} a sh:NodeShape ; sh:sparql [ sh:select """SELECT $this ?path WHERE {{ {body} FILTER(?peer != $this) BIND(e:x AS ?path) }}""" ] . '
    body = lambda names: " ".join(f"$this e:{n} ?{n} . ?peer e:{n} ?{n} ." for n in names)
    return parse_shapes("@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . " + "".join(rule.format(i=i, body=body(names)) for i, names in enumerate(slots)))


def brute(rows, slots):
    return sorted({(x[0], y[0]) for x in rows for y in rows for names in slots if x[0] is not None and y[0] is not None and x[0] != y[0] and all(x["kab".index(n)] is not None and x["kab".index(n)] == y["kab".index(n)] for n in names)})


@pytest.mark.parametrize("slots", [["a", "b"], ["b", "a"], ["ab", "a"], ["a", "ab"], ["a", "a"], ["ab", "b", "a"]])
@pytest.mark.parametrize("repeated", [False, True])
def test_pairs_of_several_rules_count_once(spark, slots, repeated):
    rows = [(i, None if i % 7 == 0 else i % 3, None if i % 5 == 0 else i % 4) for i in range(24)] + [(None, 1, 1)] + [(3, 2, 1), (3, 2, 1)] * repeated
    df = spark.createDataFrame(rows, "k int, a int, b int")
    found = solve.scope_peers(df, shapes(*slots), "k").collect()
    assert sorted(map(tuple, found)) == brute(rows, slots)


def test_pairs_are_not_looked_up_among_all_others(spark, sf):
    plan = more_queries.scope_peers_batch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


@pytest.mark.parametrize("module, name", [(more_queries, "scope_peers_batch"), (rule_queries, "scope_peers")])
def test_peers_are_spread(spark, monkeypatch, module, name):
    monkeypatch.setattr(spread, "LEAST_ROWS", 10)
    monkeypatch.setattr(spread, "CELL_ROWS", 2)
    monkeypatch.setattr(spread, "TASK_ROWS", 4)
    found = module.QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = [(r["s_suppkey"], r["s_nationkey"], r["s_name"]) for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").collect()]
    assert sorted(map(tuple, found.collect())) == brute(rows, ["a", "b"]) != []
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 40
