"""Registered queries over parts that give plain values: each beside the SQL with the values it must give."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .errors import VeldgraphError
from .functions.templates import Environment
from .operators import history, rules, solve
from .operators.lower import ask_json, export_ntriples, import_ntriples, query, results_json, solutions
from .operators.references import foreign_references
from .plans.rules import local_name, parse_shapes
from .plans.scope import scope
from .rule_queries import COMBOS
from .shared import shared_dir
from .sources import objects
from .sources.schema import SchemaView, load_json, load_yaml
from .sources.tables import NAMESPACE, catalog

N = NAMESPACE

_SCHEMA = """
id: https://w3id.org/example/fleet
name: fleet
prefixes: {fleet: 'https://w3id.org/example/fleet/'}
default_prefix: fleet
default_range: string
classes:
  Vessel:
    annotations: {registered: true}
    attributes:
      imo: {identifier: true}
      kind: {designates_type: true}
      flag: {range: Flag}
      home: {range: Port}
      crew: {range: Sailor, multivalued: true, inlined_as_list: true}
  Ferry:
    is_a: Vessel
    annotations: {registered: true}
    attributes:
      cars: {range: integer}
  Port:
    attributes:
      code: {identifier: true}
      depth: {range: float}
  Sailor:
    attributes:
      badge: {key: true}
      rank: {}
enums:
  Flag:
    permissible_values: {'NO': {}, DK: {}, SE: {}}
"""


def _view() -> SchemaView:
    v = SchemaView()
    v.add_schema(_SCHEMA)
    return v


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def results_iris(spark, sf_dir):
    """Objects as URIs, literals with their types, unbound variables left out."""
    c = catalog(spark, sf_dir)
    return results_json(solutions(spark, c, "SELECT ?n ?r ?size ?name WHERE { ?n a :Nation ; :region ?r ; :name ?name . BIND(7 AS ?size) OPTIONAL { ?r :brand ?none } }"))


def ask_result(spark, sf_dir):
    c = catalog(spark, sf_dir)
    found = [ask_json(query(spark, c, f"ASK {{ ?o a :Order ; :status '{s}' }}")) for s in ("F", "NONE")]
    return found[0].unionAll(found[1])


def ntriples_corrupt(spark, sf_dir):
    """Lines without their last dot are told apart, and left out where that is asked for."""
    c = catalog(spark, sf_dir)
    lines = export_ntriples(c, c.classes["Nation"]).select(F.when(F.col("value").contains("Region/0>"), F.regexp_replace("value", r" \.$", "")).otherwise(F.col("value")).alias("value"))
    kept = import_ntriples(lines, "PERMISSIVE").select(F.lit("kept").alias("mode"), F.col("_corrupt_record").isNotNull().alias("corrupt"))
    dropped = import_ntriples(lines, "DROPMALFORMED").select(F.lit("dropped").alias("mode"), F.lit(False).alias("corrupt"))
    return kept.unionAll(dropped).groupBy("mode", "corrupt").agg(F.count("*").alias("n"))


def ntriples_escapes(spark, sf_dir):
    """Literals with every kind of escape, written and read again."""
    line = F.concat(F.lit(r'<urn:a> <urn:b> "é\U0001F600 \"x\" \\n \t'), F.col("r_name"), F.lit('"@en .'))
    return import_ntriples(spark.read.parquet(f"{sf_dir}/region.parquet").select(line.alias("value"))).select("o", "lang", "datatype")


def shacl_sparql(spark, sf_dir):
    """A query rule over whole tables: a nation should have one supplier."""
    shape = parse_shapes(
        '@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . e:One a sh:NodeShape ; sh:targetClass e:Supplier ; sh:sparql [ sh:message "one supplier a nation"@en ; sh:select """SELECT $this ?path WHERE { $this a :Supplier ; :nation ?n . ?peer a :Supplier ; :nation ?n . FILTER(?peer != $this) BIND(:nation AS ?path) }""" ] .'
    )
    found = rules.sparql_violations(spark, catalog(spark, sf_dir), shape)
    return found.select("this", "shape", F.array_join("fields", ",").alias("fields"), "message", "enforcement_level", "is_blocking")


def scope_peers_batch(spark, sf_dir):
    """The peers of two query rules together; pairs that both give count once."""
    head = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . "
    one = 'e:{name} a sh:NodeShape ; sh:sparql [ sh:select """SELECT $this ?path WHERE {{ $this e:{slot} ?v . ?peer e:{slot} ?v . FILTER(?peer != $this) BIND(e:{slot} AS ?path) }}""" ] . '
    shapes = parse_shapes(head + one.format(name="A", slot="s_nationkey") + one.format(name="B", slot="s_name"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return solve.scope_peers(suppliers, shapes, "s_suppkey")


def _lines(spark, sf_dir):
    """Orders as JSON: all their lines, and those that were not returned with the quantity of the accepted ones doubled."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("object")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    # the identifier of a line is its place in the order
    numbered = orders.select("object", F.expr("transform(l, (x, i) -> struct(i as no, int(x.l_quantity) as qty, x.l_returnflag as flag))").alias("l"))
    base = F.expr("transform(l, x -> struct(x.no, x.qty))")
    current = F.expr("transform(filter(l, x -> x.flag <> 'R'), x -> struct(x.no, if(x.flag = 'A', 2 * x.qty, x.qty) as qty))")
    return numbered.select("object", F.to_json(F.struct(base.alias("lines"))).alias("base"), F.to_json(F.struct(current.alias("lines"))).alias("current"))


def diff_keyed_lists(spark, sf_dir):
    """Members of lists align by their identifier: what goes is removed, what stays is compared in its own place."""
    return history.diff_rows(_lines(spark, sf_dir), "object", identifiers=["no"]).groupBy("object", "op").agg(F.count("*").alias("n"))


def patch_round_trip(spark, sf_dir):
    """Objects whose patched base is the current value."""
    return history.patched_rows(_lines(spark, sf_dir), "object", identifiers=["no"]).groupBy("same").agg(F.count("*").alias("n"))


def object_nodes(spark, sf_dir):
    """Keys, values and length of JSON objects, as columns."""
    found = objects.node_columns(F.col("props"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(found["keys"], ",").alias("keys"), F.array_join(found["values"], ",").alias("vals"), found["length"].alias("length"))


def sum_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", objects.sum_as_string(F.col("n_nationkey"), F.col("n_regionkey")).alias("total"))


def template_column(spark, sf_dir):
    """A message template over columns."""
    message = Environment().column("{{ n_name | lower }} in {{ n_regionkey }}{% if n_regionkey is none %}?{% endif %}", "n_name", "n_regionkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", message.alias("message"))


def schema_slots(spark, sf_dir):
    """Classes with their slots, inherited ones too, how they hold other objects, and the default managed classes."""
    v = _view()
    rows = [(c, s.name, s.range, s.inline_mode, s.container_mode) for c in ("Vessel", "Ferry", "Port", "Sailor") for s in v.slots(c)]
    return _rows(spark, rows, "class string, slot string, range string, inline string, container string")


def schema_managed(spark, sf_dir):
    found = _view().managed_classes(["registered"], only_default=False)
    return _rows(spark, [(t, c) for by in found.values() for t, c in by.items()], "designator string, class string")


def schema_enums(spark, sf_dir):
    return _rows(spark, [(f, v) for f, vs in _view().enums_of("Ferry").items() for v in vs], "field string, value string")


def tree_references(spark, sf_dir):
    """References of one object tree, in tree order."""
    found = foreign_references(_view(), "Ferry", {"imo": "9", "home": "OSL", "crew": [{"badge": "b1", "rank": "cook"}]})
    return _rows(spark, [(i, x["uri"], x["object_type"], x["slot_name"]) for i, x in enumerate(found)], "i int, uri string, object_type string, slot_name string")


def equality_rules(spark, sf_dir):
    """Loose equality, and local names, over pairs of values."""
    pairs = [("1", 1), (1, 1.0), (True, "true"), ("null", None), ([1], [1]), ("[1]", [1]), (None, None), ("a", "b")]
    return _rows(spark, [(i, rules.values_equal(a, b)) for i, (a, b) in enumerate(pairs)], "i int, same boolean")


def local_names(spark, sf_dir):
    return _rows(spark, [(x, local_name(x)) for x in ("http://e/a#b", "http://e/a/b", "plain")], "iri string, name string")


def solver_predicates(spark, sf_dir):
    """What rules leave for a field, by the value of the other field: as JSON predicates, judged value by value."""
    cs = solve.ConstraintSet.from_shacl(COMBOS)
    rows = []
    for status in ("F", "O", "P", "X"):
        found = cs.solve({"o_orderstatus": status}, "o_orderpriority")
        for value in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
            p = None if found is None else solve.predicate_from_json(json.loads(json.dumps(found["predicate"])))
            rows.append((status, value, p is None or solve.passes(p, "o_orderpriority", value)))
    return _rows(spark, rows, "status string, priority string, allowed boolean")


def rules_json(spark, sf_dir):
    """A rule set written as JSON and read again judges alike."""
    again = solve.ConstraintSet.from_json(solve.ConstraintSet.from_shacl(COMBOS).to_json())
    return rules.violations(spark.read.parquet(f"{sf_dir}/orders.parquet"), again.shapes, ["o_orderkey"]).select("o_orderkey", "message")


def plan_view(spark, sf_dir):
    """Stars of a plan with their classes' fields."""
    plan = scope('SELECT ?c ?n { ?o a :Order ; :customer ?c ; :status "F" . ?c a :Customer ; :name ?n . OPTIONAL { ?c :segment ?s } } LIMIT 3', catalog(spark, sf_dir))
    rows = [(s.variable, ",".join(s.required_fields), ",".join(s.optional_fields), json.dumps(s.filters), plan.limit) for s in plan.root.all_stars()]
    return _rows(spark, rows, "star string, required string, optional string, filters string, row_limit int")


def history_tree(spark, sf_dir):
    """Last writers of the nodes of a tree, by path, and stages that are read again from JSON."""
    versions = [{"k": 1, "box": {"a": 1, "b": [1]}}, {"k": 2, "box": {"a": 1, "b": [1, 2]}}, {"k": 2, "box": {"a": 3, "b": [1, 2], "c": None}}]
    _, stages = history.compute_history([history.Stage.from_json(history.Stage({"change_id": i}, v, class_id="Box").to_json()) for i, v in enumerate(versions)])
    value, blame = history.apply_deltas(versions[0], stages[1:])
    return _rows(spark, [("/".join(p), m["change_id"], history.blame_info(p, blame) == m) for p, m in history.blame_paths(value, blame)], "path string, change_id long, found boolean")


_SAILORS = [{"badge": "b1", "rank": "cook"}, {"badge": "b2"}]


def created_instances(spark, sf_dir):
    return objects.create_instances(spark, _view(), "Sailor", [*_SAILORS, {"badge": 7, "shoe": "left out"}])


def yaml_instances(spark, sf_dir):
    """Objects from YAML; what does not fit stands in its record."""
    return load_yaml(spark, "- {code: OSL, depth: 7.5}\n- {code: CPH}\n- {code: X, depth: deep}", _view(), "Port").select("code", "depth", F.col("_corrupt_record").isNotNull().alias("corrupt"))


def json_instances(spark, sf_dir):
    """Objects of a class from JSON lines in the shared folder."""
    path = f"{shared_dir(spark)}/veldgraph/ports-{uuid.uuid4().hex}"
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.select(F.to_json(F.struct(F.col("n_name").alias("code"), F.col("n_nationkey").cast("double").alias("depth"))).alias("value")).write.text(path)
    return load_json(spark, path, _view(), "Port").select("code", "depth")


def turtle_import(spark, sf_dir):
    """A Turtle document as triples: lists, blank nodes, tags, types."""
    text = '@prefix e: <http://e/> . e:a e:name "A"@en , "B" ; e:n 5 ; e:ok true ; e:to e:b . e:b a e:Thing ; e:d 1.5 .'
    return objects.import_turtle(spark, text).select("s", "p", "o", "is_iri", F.regexp_extract("datatype", "[^#/]*$", 0).alias("kind"), "lang")


def turtle_files(spark, sf_dir):
    """Regions written as Turtle files and read again, beside a file that does not parse."""
    path = f"{shared_dir(spark)}/veldgraph/turtle-{uuid.uuid4().hex}"
    c = catalog(spark, sf_dir)
    objects.object_turtle(c, c.classes["Region"]).select("turtle").write.text(path)
    spark.createDataFrame([("<a> <b> oops",)], "turtle string").write.mode("append").text(path)
    return objects.import_turtle_files(spark, path, strict=False).select("s", "p", "o")


def turtle_objects(spark, sf_dir):
    """Triples turned to a row for each subject."""
    rows = objects.objects_of(objects.import_turtle(spark, '@prefix e: <http://e/> . e:a e:t "y" , "x" . e:b e:t "z" ; e:u "w" .'), {"http://e/t": "t", "http://e/u": "u"})
    return rows.select("uri", F.array_join("t", ",").alias("t"), F.array_join("u", ",").alias("u"))


def error_kinds(spark, sf_dir):
    """What each kind of bad query raises."""
    rows = []
    for text in ("INSERT DATA { <a> <b> <c> }", "SELECT ?x WHERE { ?x }", "ASK { GRAPH <g> { ?s ?p ?o } }", "ASK { SERVICE <g> { ?s ?p ?o } }", "SELECT ?x { ?x :name ?n }"):
        try:
            scope(text, catalog(spark, sf_dir))
        except VeldgraphError as e:
            rows.append((text, type(e).__name__))
    return _rows(spark, rows, "query string, error string")


def prefixes_given(spark, sf_dir):
    return query(spark, catalog(spark, sf_dir), "SELECT ?n { ?r a v:Region ; v:name ?n }", {"v": N})


def schema_snapshot(spark, sf_dir):
    """A schema written as one text and read again."""
    again = SchemaView.from_snapshot(_view().snapshot())
    return _rows(spark, [(c, again.identifier(c) or "", len(again.slots(c))) for c in ("Vessel", "Ferry", "Port", "Sailor")], "class string, identifier string, slots int")


def pretty_tree(spark, sf_dir):
    return _rows(spark, list(enumerate(objects.pretty({"a": 1, "b": [True, {"c": "x"}], "d": {}}).split("\n"))), "i int, line string")


def node_access(spark, sf_dir):
    v = {"a": [1, 2], "b": {"c": None}}
    return _rows(spark, [(",".join(objects.keys(v)), objects.length(v["a"]), objects.at(v["a"], 1), objects.at(v["a"], 2), objects.get(v, "x") is None, len(objects.values(v["b"])), history.navigate(v, ("a", "0")))], "keys string, n int, second int, third int, missing boolean, vals int, first int")


def diff_deltas(spark, sf_dir):
    """Deltas of one object: changed, new, nulled, list tails, map keys."""
    found = history.diff({"a": 1, "m": {"k": 1}, "l": [1, 2], "z": 1}, {"a": 2, "m": {}, "l": [1], "n": "x"}, treat_missing_as_null=True, mappings=["m"])
    return _rows(spark, [("/".join(d.path), d.op, json.dumps(d.old), json.dumps(d.new)) for d in found], "path string, op string, old string, new string")


def patch_trace(spark, sf_dir):
    value, t = history.patch({"a": {"b": 1}, "l": [1]}, [history.Delta(("a", "c"), "add", None, [2]), history.Delta(("l", "0"), "update", 1, 3), history.Delta(("x", "y"), "add", None, 1), history.Delta(("a", "b"), "remove", 1)])
    rows = [(kind, "/".join(p)) for kind in ("added", "deleted", "updated", "failed") for p in getattr(t, kind)]
    return _rows(spark, [*rows, ("value", json.dumps(value))], "kind string, path string")


def blame_lines(spark, sf_dir):
    meta = {"change_id": 4, "author": "ann", "timestamp": "t1", "source": "app", "ics_id": 9}
    text = history.format_blame({"a": 1, "b": [2]}, {(): meta, ("b", "0"): meta})
    return _rows(spark, [(i, x[:72].rstrip(), x[72:]) for i, x in enumerate(text.split("\n"))], "i int, who string, node string")


def member_values(spark, sf_dir):
    """What a member's field may be beside the other members, and a predicate through a reference."""
    each = " ; ".join(f'sh:property [ sh:path e:pallets ; sh:qualifiedValueShape [ sh:path e:colour ; sh:hasValue "{c}" ] ; sh:qualifiedMaxCount 1 ]' for c in ("red", "green"))
    head = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . "
    cs = solve.ConstraintSet.from_shacl(head + f'e:Load a sh:NodeShape ; sh:property [ sh:path ( e:pallets e:colour ) ; sh:in ( "red" "green" ) ] ; {each} .')
    reach = solve.ConstraintSet.from_shacl(head + "e:Reach a sh:NodeShape ; sh:property [ sh:path ( e:track e:line ) ; sh:equals e:own ] .")
    rows = [("|".join(have), ",".join(cs.solve_member({"pallets": [{"colour": c} for c in have]}, "pallets", "colour")["values"])) for have in ([], ["red"], ["red", "green"])]
    return _rows(spark, [*rows, ("reference", json.dumps(reach.solve({"own": "L1"}, "track")["predicate"]))], "given string, allowed string")


QUERIES = {
    f.__name__: f
    for f in (
        results_iris, ask_result, ntriples_corrupt, ntriples_escapes, shacl_sparql, scope_peers_batch, diff_keyed_lists, patch_round_trip, object_nodes, sum_text, template_column,
        schema_slots, schema_managed, schema_enums, tree_references, equality_rules, local_names, solver_predicates, rules_json, plan_view, history_tree,
        created_instances, yaml_instances, json_instances, turtle_import, turtle_files, turtle_objects, error_kinds, prefixes_given, schema_snapshot, pretty_tree, node_access, diff_deltas, patch_trace, blame_lines, member_values,
    )
}

_FLEET = "https://w3id.org/example/fleet/"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_COMBO = "(o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' OR o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM')"

SQL = {
    "results_iris": f"""SELECT '{{"n":{{"type":"uri","value":"{N}Nation/' || n_nationkey || '"}},"r":{{"type":"uri","value":"{N}Region/' || n_regionkey || '"}},"size":{{"type":"literal","value":"7","datatype":"{_XSD}integer"}},"name":{{"type":"literal","value":"' || n_name || '"}}}}' AS binding FROM nation""",
    "ask_result": """SELECT '{"head":{},"boolean":' || b || '}' AS result FROM (VALUES ('true'), ('false')) v(b)""",
    "ntriples_corrupt": "SELECT 'kept' AS mode, false AS corrupt, (SELECT 3 * count(*) FROM nation) - (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS n UNION ALL SELECT 'kept', true, count(*) FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'dropped', false, (SELECT 3 * count(*) FROM nation) - (SELECT count(*) FROM nation WHERE n_regionkey = 0)",
    "ntriples_escapes": """SELECT chr(233) || chr(128512) || ' "x" ' || chr(92) || 'n ' || chr(9) || r_name AS o, 'en' AS lang, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS datatype FROM region""",
    "shacl_sparql": f"SELECT '{N}Supplier/' || s_suppkey AS this, 'http://e/One' AS shape, 'nation' AS fields, 'one supplier a nation' AS message, 'serious' AS enforcement_level, true AS is_blocking FROM supplier s WHERE EXISTS (SELECT 1 FROM supplier p WHERE p.s_nationkey = s.s_nationkey AND p.s_suppkey <> s.s_suppkey)",
    "scope_peers_batch": "SELECT DISTINCT a.s_suppkey AS s_suppkey, b.s_suppkey AS peer FROM supplier a JOIN supplier b ON (a.s_nationkey = b.s_nationkey OR a.s_name = b.s_name) AND a.s_suppkey <> b.s_suppkey",
    "diff_keyed_lists": "SELECT l_orderkey AS object, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'update' END AS op, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL",
    "patch_round_trip": "SELECT true AS same, count(DISTINCT l_orderkey) AS n FROM lineitem",
    "object_nodes": "SELECT event_id, array_to_string(json_keys(props), ',') AS keys, array_to_string(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)), ',') AS vals, len(json_keys(props))::INTEGER AS length FROM events",
    "sum_text": "SELECT n_nationkey, (n_nationkey + n_regionkey)::VARCHAR AS total FROM nation",
    "template_column": "SELECT n_nationkey, lower(n_name) || ' in ' || n_regionkey AS message FROM nation",
    "equality_rules": "SELECT * FROM (VALUES (0, true), (1, false), (2, true), (3, false), (4, true), (5, false), (6, true), (7, false)) v(i, same)",
    "local_names": "SELECT * FROM (VALUES ('http://e/a#b', 'b'), ('http://e/a/b', 'b'), ('plain', 'plain')) v(iri, name)",
    "solver_predicates": f"SELECT o_orderstatus AS status, o_orderpriority AS priority, NOT {_COMBO} AS allowed FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(o_orderstatus), (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) p(o_orderpriority)",
    "rules_json": f"SELECT o_orderkey, 'status and priority exclude each other' AS message FROM orders WHERE {_COMBO}",
    "schema_slots": """SELECT c AS class, slot, range, inline, container FROM (VALUES ('imo', 'string', 'Primitive', 'SingleValue'), ('kind', 'string', 'Primitive', 'SingleValue'), ('flag', 'Flag', 'Primitive', 'SingleValue'), ('home', 'Port', 'Reference', 'SingleValue'), ('crew', 'Sailor', 'Inline', 'List')) s(slot, range, inline, container), (VALUES ('Vessel'), ('Ferry')) k(c)
UNION ALL SELECT * FROM (VALUES ('Ferry', 'cars', 'integer', 'Primitive', 'SingleValue'), ('Port', 'code', 'string', 'Primitive', 'SingleValue'), ('Port', 'depth', 'float', 'Primitive', 'SingleValue'), ('Sailor', 'badge', 'string', 'Primitive', 'SingleValue'), ('Sailor', 'rank', 'string', 'Primitive', 'SingleValue')) v""",
    "schema_enums": "SELECT 'flag' AS field, v AS value FROM (VALUES ('DK'), ('NO'), ('SE')) x(v)",
    "schema_managed": f"SELECT * FROM (VALUES ('{_FLEET}Vessel', 'Vessel'), ('Vessel', 'Vessel'), ('{_FLEET}Ferry', 'Ferry'), ('Ferry', 'Ferry')) v(designator, class)",
    "tree_references": "SELECT 0 AS i, 'OSL' AS uri, 'Port' AS object_type, 'home' AS slot_name",
    "plan_view": """SELECT * FROM (VALUES ('o', 'customer,status', '', '[{"field": "status", "operator": "eq", "values": ["F"]}]', NULL), ('c', 'name', 'segment', '[]', NULL)) v(star, required, optional, filters, row_limit)""",
    "history_tree": "SELECT * FROM (VALUES ('box', 2, true), ('box/a', 2, true), ('box/b', 1, true), ('box/b/1', 1, true), ('box/c', 2, true), ('k', 1, true)) v(path, change_id, found)",
    "created_instances": "SELECT * FROM (VALUES ('b1', 'cook'), ('b2', NULL), ('7', NULL)) v(badge, rank)",
    "yaml_instances": "SELECT code, depth::FLOAT AS depth, corrupt FROM (VALUES ('OSL', 7.5, false), ('CPH', NULL, false), ('X', NULL, true)) v(code, depth, corrupt)",
    "json_instances": "SELECT n_name AS code, n_nationkey::FLOAT AS depth FROM nation",
    "turtle_import": "SELECT * FROM (VALUES ('http://e/a', 'http://e/name', 'A', false, 'langString', 'en'), ('http://e/a', 'http://e/name', 'B', false, 'string', ''), ('http://e/a', 'http://e/n', '5', false, 'integer', ''), ('http://e/a', 'http://e/ok', 'true', false, 'boolean', ''), ('http://e/a', 'http://e/to', 'http://e/b', true, '', ''), ('http://e/b', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://e/Thing', true, '', ''), ('http://e/b', 'http://e/d', '1.5', false, 'decimal', '')) v(s, p, o, is_iri, kind, lang)",
    "turtle_files": f"SELECT '{N}Region/' || r_regionkey AS s, '{N}name' AS p, r_name AS o FROM region UNION ALL SELECT '{N}Region/' || r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{N}Region' FROM region",
    "turtle_objects": "SELECT * FROM (VALUES ('http://e/a', 'x,y', ''), ('http://e/b', 'z', 'w')) v(uri, t, u)",
    "error_kinds": "SELECT * FROM (VALUES ('INSERT DATA { <a> <b> <c> }', 'UpdateRejected'), ('SELECT ?x WHERE { ?x }', 'ParseError'), ('ASK { GRAPH <g> { ?s ?p ?o } }', 'UnsupportedConstruct'), ('ASK { SERVICE <g> { ?s ?p ?o } }', 'UnsupportedConstruct'), ('SELECT ?x { ?x :name ?n }', 'Unscoped')) v(query, error)",
    "prefixes_given": "SELECT r_name AS n FROM region",
    "schema_snapshot": "SELECT * FROM (VALUES ('Vessel', 'imo', 5), ('Ferry', 'imo', 6), ('Port', 'code', 2), ('Sailor', '', 2)) v(class, identifier, slots)",
    "pretty_tree": "SELECT * FROM (VALUES (0, 'a: 1'), (1, 'b:'), (2, '  - true'), (3, '  -'), (4, '    c: x'), (5, 'd: {}')) v(i, line)",
    "node_access": "SELECT 'a,b' AS keys, 2 AS n, 2 AS second, NULL::INTEGER AS third, true AS missing, 1 AS vals, 1 AS first",
    "diff_deltas": """SELECT * FROM (VALUES ('a', 'update', '1', '2'), ('m/k', 'remove', '1', 'null'), ('l/1', 'remove', '2', 'null'), ('z', 'update', '1', 'null'), ('n', 'add', 'null', '"x"')) v(path, op, old, new)""",
    "patch_trace": """SELECT * FROM (VALUES ('added', 'a/c'), ('added', 'a/c/0'), ('updated', 'a'), ('updated', 'l/0'), ('failed', 'x/y'), ('deleted', 'a/b'), ('updated', 'a'), ('value', '{"a": {"c": [2]}, "l": [3]}')) v(kind, path)""",
    "blame_lines": "SELECT * FROM (VALUES (0, 'cid=  4 author=ann ts=t1 src=app ics=9', ' .'), (1, '', '   a: 1'), (2, '', '   b:'), (3, 'cid=  4 author=ann ts=t1 src=app ics=9', '     0: 2')) v(i, who, node)",
    "member_values": """SELECT * FROM (VALUES ('', 'red,green'), ('red', 'green'), ('red|green', ''), ('reference', '{"fieldId": "line", "predicateTypeId": "equals", "value": "L1"}')) v(given, allowed)""",
}
