"""Registered history, diff and reference queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import history
from .operators.lower import export_ntriples, import_ntriples, results_json, solutions
from .operators.references import foreign_edges
from .sources import objects
from .sources.tables import NAMESPACE, catalog

_FIELDS = ["event_type", "value", "k"]


def _events(spark, sf_dir):
    """Events as stages: object = user, seq = order of (ts, event_id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("object"), F.expr("unix_seconds(cast(ts as timestamp)) * 1000000000 + event_id").alias("seq"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("value"))).alias("rejected"))


def history_deltas(spark, sf_dir):
    d = history.flat_history(_events(spark, sf_dir), _FIELDS)
    return d.groupBy("object", "path", "op").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def history_rejected(spark, sf_dir):
    d = history.flat_history(_events(spark, sf_dir), _FIELDS, "rejected")
    return d.groupBy("object", "path").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def history_fold(spark, sf_dir):
    """The same by folding JSON objects."""
    e = _events(spark, sf_dir)
    stages = e.select("object", "seq", F.to_json(F.struct(*_FIELDS)).alias("value"), F.when(F.col("rejected").isNotNull(), F.array(F.array(F.lit("value")))).alias("rejected"))
    d = history.fold_history(stages)
    return d.groupBy("object", F.element_at("path", 1).alias("path")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def blame_latest(spark, sf_dir):
    e = _events(spark, sf_dir)
    d = history.flat_history(e, _FIELDS)
    writers = history.latest_writer(d, F.struct("seq", "new"))
    return writers.select("object", "path", F.col("writer.seq").alias("seq"), F.col("writer.new").alias("new"))


def _snapshots(spark, sf_dir):
    """Each customer's latest order of two spans of years: (status, priority) before 1994 and since 1997."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def latest(span):
        newest = o.where(span).groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")).alias("o"))
        return newest.selectExpr("o_custkey", "nullif(o.o_orderstatus, 'P') AS status", "nullif(o.o_orderpriority, '4-NOT SPECIFIED') AS priority")

    return latest("o_orderdate < timestamp'1994-01-01'"), latest("o_orderdate >= timestamp'1997-01-01'")


def _diff(missing: bool):
    return lambda spark, sf_dir: history.diff_tables(*_snapshots(spark, sf_dir), "o_custkey", ["status", "priority"], missing)


def foreign_refs(spark, sf_dir):
    return foreign_edges(catalog(spark, sf_dir), ["Customer", "Order", "Nation"]).withColumn("slot_path", F.array_join("slot_path", "/"))


def foreign_refs_with_ids(spark, sf_dir):
    return foreign_edges(catalog(spark, sf_dir), ["Customer", "Nation"], True).withColumn("slot_path", F.array_join("slot_path", "/"))


def ntriples_export(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return export_ntriples(c, c.classes["Nation"])


def ntriples_round_trip(spark, sf_dir):
    """Exported, parsed again, and turned back into rows."""
    t = import_ntriples(ntriples_export(spark, sf_dir))
    return t.groupBy("s").agg(F.max(F.when(F.col("p") == NAMESPACE + "name", F.col("o"))).alias("name"), F.max(F.when(F.col("p") == NAMESPACE + "region", F.col("o"))).alias("region"))


def object_turtle(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return objects.object_turtle(c, c.classes["Region"])


def construct_text(spark, sf_dir):
    """A constructed graph as lines of text."""
    from .operators.lower import query

    c = catalog(spark, sf_dir)
    return objects.graph_text(query(spark, c, "CONSTRUCT { ?n :inside ?r ; :size 1 } WHERE { ?n a :Nation ; :region ?r }"))


def term_json(spark, sf_dir):
    """Terms of all suppliers' triples as JSON, counted by shape."""
    from .operators.lower import triples

    c = catalog(spark, sf_dir)
    t = triples(c, c.classes["Supplier"])
    j = F.to_json(objects.term_struct(F.col("o"), F.col("is_iri"), F.col("datatype"), F.lit("")))
    return t.groupBy("p", F.get_json_object(j, "$.type").alias("type"), F.get_json_object(j, "$.datatype").alias("datatype")).agg(F.count("*").alias("n"))


def results_bindings(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return results_json(solutions(spark, c, "SELECT ?name ?none WHERE { ?x a :Region ; :name ?name . OPTIONAL { ?y :brand ?none . FILTER(?none = 'NONE') } }"))


QUERIES = {
    "history_deltas": history_deltas,
    "history_rejected": history_rejected,
    "history_fold": history_fold,
    "blame_latest": blame_latest,
    "diff_partial": _diff(False),
    "diff_missing_null": _diff(True),
    "foreign_refs": foreign_refs,
    "foreign_refs_with_ids": foreign_refs_with_ids,
    "ntriples_export": ntriples_export,
    "ntriples_round_trip": ntriples_round_trip,
    "object_turtle": object_turtle,
    "construct_text": construct_text,
    "term_json": term_json,
    "results_bindings": results_bindings,
}

_E = "SELECT user_id AS object, (epoch_us(ts) // 1000000) * 1000000000 + event_id AS seq, event_id, event_type, value, (props::JSON ->> '$.k')::INTEGER AS k FROM events"
_LONG = f"""SELECT object, seq, path, now, lag(now) OVER (PARTITION BY object, path ORDER BY seq) AS old, row_number() OVER (PARTITION BY object, path ORDER BY seq) AS i FROM (
SELECT object, seq, event_id, 'event_type' AS path, event_type AS now FROM ({_E}) UNION ALL SELECT object, seq, event_id, 'value', value::VARCHAR FROM ({_E}) UNION ALL SELECT object, seq, event_id, 'k', k::VARCHAR FROM ({_E})) x"""
_FIRST = f"SELECT object, min(seq) AS first_seq FROM ({_E}) GROUP BY object"
_KEPT = _LONG + f" JOIN ({_FIRST}) f USING (object) WHERE NOT (path = 'value' AND event_id % 3 = 0 AND seq <> first_seq)"
_REJECTED = f"SELECT object, path, count(*) AS n, max(seq) AS last FROM ({_KEPT}) WHERE i > 1 AND now <> old GROUP BY object, path"
_LATEST = "SELECT o_custkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders WHERE {span} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
_BEFORE, _AFTER = _LATEST.format(span="o_orderdate < TIMESTAMP '1994-01-01'"), _LATEST.format(span="o_orderdate >= TIMESTAMP '1997-01-01'")


def _diff_sql(missing: bool) -> str:
    one = lambda f: f"SELECT coalesce(a.o_custkey, b.o_custkey) AS object, '{f}' AS path, CASE WHEN b.{f} IS NOT NULL AND a.{f} IS NULL THEN 'add' WHEN b.{f} <> a.{f} THEN 'update' WHEN b.{f} IS NULL AND a.{f} IS NOT NULL AND {str(missing).lower()} THEN CASE WHEN b.o_custkey IS NULL THEN 'remove' ELSE 'update' END END AS op, a.{f} AS old, b.{f} AS new FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b USING (o_custkey)"
    return f"SELECT * FROM ({one('status')} UNION ALL {one('priority')}) WHERE op IS NOT NULL"


def _edges(table: str, cls: str, key: str, slot: str, column: str, target: str) -> str:
    return f"SELECT '{NAMESPACE}{cls}/' || {key} AS holder, '{NAMESPACE}{target}/' || {column} AS uri, '{target}' AS object_type, '{NAMESPACE}{target}' AS object_type_uri, '{slot}' AS slot_name, '{slot}' AS slot_path, 'foreign' AS kind FROM {table}"


def _ids(table: str, cls: str, key: str) -> str:
    return f"SELECT '{NAMESPACE}{cls}/' || {key}, '{NAMESPACE}{cls}/' || {key}, '{cls}', '{NAMESPACE}{cls}', 'id', 'id', 'primary' FROM {table}"


_C, _NA = _edges("customer", "Customer", "c_custkey", "nation", "c_nationkey", "Nation"), _edges("nation", "Nation", "n_nationkey", "region", "n_regionkey", "Region")

SQL = {
    "history_deltas": f"SELECT object, path, 'update' AS op, count(*) AS n, max(seq) AS last FROM ({_LONG}) WHERE i > 1 AND now <> old GROUP BY object, path",
    "history_rejected": _REJECTED,
    "history_fold": _REJECTED,
    "blame_latest": f"SELECT object, path, max(seq) AS seq, arg_max(now, seq) AS new FROM ({_LONG}) WHERE i > 1 AND now <> old GROUP BY object, path",
    "diff_partial": _diff_sql(False),
    "diff_missing_null": _diff_sql(True),
    "foreign_refs": f"{_C} UNION ALL {_NA} UNION ALL {_edges('orders', 'Order', 'o_orderkey', 'customer', 'o_custkey', 'Customer')}",
    "foreign_refs_with_ids": f"{_C} UNION ALL {_NA} UNION ALL {_ids('customer', 'Customer', 'c_custkey')} UNION ALL {_ids('nation', 'Nation', 'n_nationkey')}",
    "ntriples_export": f"""SELECT '<{NAMESPACE}Nation/' || n_nationkey || '> ' || unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NAMESPACE}Nation>', '<{NAMESPACE}name> "' || n_name || '"', '<{NAMESPACE}region> <{NAMESPACE}Region/' || n_regionkey || '>']) || ' .' AS value FROM nation""",
    "ntriples_round_trip": f"SELECT '{NAMESPACE}Nation/' || n_nationkey AS s, n_name AS name, '{NAMESPACE}Region/' || n_regionkey AS region FROM nation",
    "object_turtle": f"""SELECT '{NAMESPACE}Region/' || r_regionkey AS uri, '<{NAMESPACE}Region/' || r_regionkey || '>' || chr(10) || '  <http://veldgraph.example/name> "' || r_name || '" ;' || chr(10) || '  <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NAMESPACE}Region> .' AS turtle FROM region""",
    "construct_text": f"""SELECT '<{NAMESPACE}Nation/' || n_nationkey || '> ' || unnest(['<{NAMESPACE}inside> <{NAMESPACE}Region/' || n_regionkey || '>', '<{NAMESPACE}size> "1"^^<http://www.w3.org/2001/XMLSchema#integer>']) || ' .' AS value FROM nation""",
    "term_json": f"""SELECT unnest(['{NAMESPACE}name', '{NAMESPACE}acctbal', '{NAMESPACE}nation', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, unnest(['literal', 'literal', 'uri', 'uri']) AS type, unnest([NULL, 'http://www.w3.org/2001/XMLSchema#double', NULL, NULL]) AS datatype, (SELECT count(*) FROM supplier) AS n""",
    "results_bindings": """SELECT '{"name":{"type":"literal","value":"' || r_name || '"}}' AS binding FROM region""",
}
