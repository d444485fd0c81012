"""Registered rule, solver and scope queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import rules, solve
from .plans.rules import UniqueByMember, parse_shapes

_HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix : <http://veldgraph.example/> . @prefix v: <http://veldgraph.example/annotation/> . "


def _shape(name: str, body: str, level: str = "serious", message: str = "broken") -> str:
    return f':{name} a sh:NodeShape ; sh:targetClass :Order ; v:enforcementLevel "{level}" ; sh:message "{message}"@en ; {body} . '


HAS_VALUE = _HEAD + _shape("HasValue", 'sh:property [ sh:path :o_orderstatus ; sh:hasValue "F" ]')
IN = _HEAD + _shape("In", 'sh:property [ sh:path :o_orderpriority ; sh:in ( "1-URGENT" "2-HIGH" ) ]', "critical")
COUNT = _HEAD + _shape("Count", "sh:property [ sh:path :o_orderpriority ; sh:minCount 1 ; sh:maxCount 1 ] ; sh:property [ sh:path :missing ; sh:minCount 1 ]")
EQUALS = _HEAD + _shape("Equals", "sh:property [ sh:path :first ; sh:equals :second ]", "error")
DISJOINT = _HEAD + _shape("Disjoint", "sh:property [ sh:path :first ; sh:disjoint :second ]", "unlikely")
_PAIRS = [("F", "1-URGENT"), ("F", "5-LOW"), ("O", "2-HIGH"), ("P", "3-MEDIUM")]
COMBOS = _HEAD + _shape("Combos", "sh:not [ sh:or ( " + " ".join(f'[ sh:and ( [ sh:property [ sh:path :o_orderstatus ; sh:hasValue "{s}" ] ] [ sh:property [ sh:path :o_orderpriority ; sh:hasValue "{p}" ] ] ) ]' for s, p in _PAIRS) + " ) ]", "serious", "status and priority exclude each other")
_KINDS = ("click", "view", "purchase")
UNIQUE = _HEAD + _shape("Unique", "sh:property [ sh:path ( :items :kind ) ; sh:in ( " + " ".join(f'"{k}"' for k in _KINDS) + " ) ] ; " + " ; ".join(f'sh:property [ sh:path :items ; sh:qualifiedValueShape [ sh:path :kind ; sh:hasValue "{k}" ] ; sh:qualifiedMaxCount 2 ]' for k in _KINDS))
SPARQL = _HEAD + _shape("Delegate", 'sh:sparql [ sh:message "one supplier a nation"@en ; sh:select """SELECT $this ?path WHERE { $this :s_nationkey ?n . ?other :s_nationkey ?n . FILTER(?other != $this) BIND(:s_nationkey AS ?path) }""" ]')


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _violated(turtle: str, table=_orders, keep=("o_orderkey",)):
    def run(spark, sf_dir):
        found = rules.violations(table(spark, sf_dir), parse_shapes(turtle), list(keep))
        return found.select(*keep, "shape", F.array_join("fields", ",").alias("fields"), "message", "enforcement_level", "is_blocking")

    return run


def _texts(spark, sf_dir):
    """Order pairs of fields that may be missing: the status and the priority's initial."""
    return _orders(spark, sf_dir).selectExpr("o_orderkey", "if(o_orderstatus = 'P', null, o_orderstatus) AS first", "if(o_orderpriority = '5-LOW', null, if(o_orderpriority = '1-URGENT', 'F', substring(o_orderpriority, 3, 1))) AS second")


_TEXTS_SQL = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS first, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE substr(o_orderpriority, 3, 1) END AS second FROM orders"


def _baskets(spark, sf_dir):
    """A user's events of a day, all of them, as members of an array."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    return events.groupBy("user_id", "day").agg(F.collect_list(F.struct(F.col("event_type").alias("kind"))).alias("items"))


_BASKETS_SQL = "SELECT user_id, ts::DATE::VARCHAR AS day, list(event_type) AS kinds FROM events GROUP BY ALL"


def _sql(shape: str, where: str, fields: str, level: str = "serious", message: str = "broken", source: str = "orders", key: str = "o_orderkey") -> str:
    return f"SELECT {key}, 'http://veldgraph.example/{shape}' AS shape, '{fields}' AS fields, '{message}' AS message, '{level}' AS enforcement_level, {str(level in ('critical', 'serious')).lower()} AS is_blocking FROM {source} WHERE {where}"


def violations_by_level(spark, sf_dir):
    turtle = _HEAD + _shape("A", 'sh:property [ sh:path :o_orderstatus ; sh:hasValue "F" ]') + _shape("B", 'sh:property [ sh:path :o_orderpriority ; sh:in ( "1-URGENT" ) ]', "critical") + _shape("C", "sh:property [ sh:path :o_totalprice ; sh:maxCount 0 ]", "unlikely")
    found = rules.violations(_orders(spark, sf_dir), parse_shapes(turtle), ["o_orderkey"])
    return found.groupBy("enforcement_level", "is_blocking").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("objects"))


def cross_reference(spark, sf_dir):
    """The nation reached through a line's supplier must be that of its order's customer."""
    shape = parse_shapes(_HEAD + _shape("Reach", "sh:property [ sh:path ( :l_suppkey :s_nationkey ) ; sh:equals :c_nationkey ]"))[0]
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_suppkey", "c_nationkey")
    return rules.cross_reference_violations(lines, shape, ["l_orderkey", "l_suppkey"], read("supplier"), "s_suppkey").groupBy("shape", "enforcement_level").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def scope_peers(spark, sf_dir):
    shape = parse_shapes(SPARQL)[0]
    return solve.peers(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", solve.shared_attributes(shape.select))


def allowed_values_batch(spark, sf_dir):
    return solve.allowed_values(_orders(spark, sf_dir), parse_shapes(COMBOS), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["o_orderkey", "o_orderstatus"])


def allowed_members_batch(spark, sf_dir):
    rule = parse_shapes(UNIQUE)[0].ast
    assert isinstance(rule, UniqueByMember)
    return solve.allowed_members(_baskets(spark, sf_dir), rule, ["user_id", "day"]).select("user_id", "day", F.array_join("allowed", ",").alias("allowed"))


def predicate_filter(spark, sf_dir):
    """Rows that satisfy what the rules leave for the priority of an order in status F."""
    found = solve.ConstraintSet.from_shacl(COMBOS).solve({"o_orderstatus": "F"}, "o_orderpriority")
    return _orders(spark, sf_dir).where(solve.predicate_column(solve.predicate_from_json(found["predicate"]))).select("o_orderkey", "o_orderpriority")


_COMBO_WHERE = " OR ".join(f"(o_orderstatus = '{s}' AND o_orderpriority = '{p}')" for s, p in _PAIRS)
_KIND_LIST = ", ".join(f"'{k}'" for k in _KINDS)

QUERIES = {
    "shacl_has_value": _violated(HAS_VALUE),
    "shacl_in": _violated(IN),
    "shacl_count": _violated(COUNT),
    "shacl_equals": _violated(EQUALS, _texts),
    "shacl_disjoint": _violated(DISJOINT, _texts),
    "shacl_not_or_and": _violated(COMBOS),
    "shacl_unique_member": _violated(UNIQUE, _baskets, ("user_id", "day")),
    "shacl_cross_reference": cross_reference,
    "violations_by_level": violations_by_level,
    "scope_peers": scope_peers,
    "allowed_values_batch": allowed_values_batch,
    "allowed_members_batch": allowed_members_batch,
    "predicate_filter": predicate_filter,
}

SQL = {
    "shacl_has_value": _sql("HasValue", "o_orderstatus <> 'F'", "o_orderstatus"),
    "shacl_in": _sql("In", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "o_orderpriority", "critical"),
    "shacl_count": _sql("Count", "true", "missing,o_orderpriority"),
    "shacl_equals": _sql("Equals", "(first IS NULL) <> (second IS NULL) OR first <> second", "first,second", "error", source=f"({_TEXTS_SQL})"),
    "shacl_disjoint": _sql("Disjoint", "first = second", "first,second", "unlikely", source=f"({_TEXTS_SQL})"),
    "shacl_not_or_and": _sql("Combos", _COMBO_WHERE, "o_orderpriority,o_orderstatus", message="status and priority exclude each other"),
    "shacl_unique_member": _sql("Unique", f"len(list_filter(kinds, lambda k: k NOT IN ({_KIND_LIST}) OR len(list_filter(kinds, lambda j: j = k)) > 2)) > 0", "items", source=f"({_BASKETS_SQL})", key="user_id, day"),
    "shacl_cross_reference": "SELECT 'http://veldgraph.example/Reach' AS shape, 'serious' AS enforcement_level, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey",
    "violations_by_level": "SELECT 'serious' AS enforcement_level, true AS is_blocking, count(*) AS n, count(*) AS objects FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'critical', true, count(*), count(*) FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT 'unlikely', false, count(*), count(*) FROM orders",
    "scope_peers": "SELECT a.s_suppkey AS s_suppkey, b.s_suppkey AS peer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey",
    "allowed_values_batch": f"SELECT o_orderkey, o_orderstatus, p AS o_orderpriority FROM (SELECT o_orderkey, o_orderstatus, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS p FROM orders) WHERE NOT ({_COMBO_WHERE.replace('o_orderpriority', 'p')})",
    "allowed_members_batch": f"SELECT user_id, day, array_to_string(list_filter([{_KIND_LIST}], lambda v: len(list_filter(kinds, lambda k: k = v)) < 2), ',') AS allowed FROM ({_BASKETS_SQL})",
    "predicate_filter": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')",
}
