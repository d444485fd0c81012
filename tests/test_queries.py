import pytest

import __spark_entry__ as entry
from veldgraph import graph_queries, history_queries, more_queries, rule_queries, stream_queries

OWN = {**graph_queries.QUERIES, **rule_queries.QUERIES, **history_queries.QUERIES, **more_queries.QUERIES, **stream_queries.QUERIES}
SQL = {**graph_queries.SQL, **rule_queries.SQL, **history_queries.SQL, **more_queries.SQL, **stream_queries.SQL}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_its_sql(name, same):
    same(OWN[name], SQL[name])


def test_entry_has_rows_and_every_own_query_has_sql(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) == set(OWN) and set(OWN) <= set(entry.queries())


def test_scan_reads_only_what_a_query_names(spark, sf):
    plan = graph_queries.QUERIES["inline_literal"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F), IsNotNull(o_totalprice)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_attribute_optional_needs_no_join(spark, sf):
    plan = graph_queries.QUERIES["optional_attr"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
