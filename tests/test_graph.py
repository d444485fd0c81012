import json

import pytest

from veldgraph.errors import ParseError, ResultLimitExceeded, TripleLimitExceeded, Unscoped, UnsupportedConstruct, UpdateRejected
from veldgraph.operators.lower import Limits, execute, import_ntriples, query
from veldgraph.plans.parser import parse
from veldgraph.plans.scope import scope
from veldgraph.sources.catalog import golden_catalog
from veldgraph.sources.tables import NAMESPACE as N
from veldgraph.sources.tables import catalog


@pytest.fixture(scope="module")
def tables(spark, sf):
    return catalog(spark, sf)


def test_updates_and_bad_text_are_refused():
    for text in ("INSERT DATA { <a> <b> <c> }", "DELETE WHERE { ?s ?p ?o }", "PREFIX x: <http://x/> CLEAR ALL"):
        with pytest.raises(UpdateRejected):
            parse(text)
    for text in ("SELECT", "SELECT ?x WHERE { ?x }", "SELECT ?x { ?x a:b 1 }", "ASK { 'x' ?p ?o }", "SELECT ?x WHERE { ?x ?p ?y } nonsense"):
        with pytest.raises(ParseError):
            parse(text)
    for text in ("ASK { GRAPH <g> { ?s ?p ?o } }", "ASK { SERVICE <g> { ?s ?p ?o } }", "SELECT * FROM <g> { ?s ?p ?o }"):
        with pytest.raises(UnsupportedConstruct):
            parse(text)


def test_row_limit(spark, tables):
    with pytest.raises(ResultLimitExceeded):
        query(spark, tables, "SELECT ?r { ?r a :Region }", max_rows=4)
    assert query(spark, tables, "SELECT ?r { ?r a :Region }", max_rows=5).count() == 5


def test_unknown_names_give_no_rows(spark, tables):
    assert query(spark, tables, "SELECT ?x { ?x a :Nothing }").count() == 0
    assert query(spark, tables, "SELECT ?x ?y { ?x :nothing ?y }").count() == 0


def test_property_lists_and_object_lists(spark, tables):
    rows = query(spark, tables, "SELECT DISTINCT ?r { [ a :Nation ; :region [ :name ?r ] ] }").collect()
    assert len(rows) == 5


def test_plan_view(tables):
    plan = scope('SELECT ?c ?n { ?o a :Order ; :customer ?c ; :status "F" . ?c a :Customer ; :name ?n . OPTIONAL { ?c :nation ?x . ?x a :Nation ; :name ?y } }', tables)
    assert plan.root.kind == "left_join" and plan.limit is None
    stars = {s.variable: s for s in plan.root.all_stars()}
    assert stars["o"].filters == [{"field": "status", "operator": "eq", "values": ["F"]}]
    assert stars["c"].required_fields == ["name"] and stars["c"].optional_fields == ["nation"]
    assert stars["x"].is_optional
    assert sorted((j.left, j.right, j.right_slot, j.kind) for j in plan.root.all_joins()) == [("c", "o", "customer", "inner"), ("x", "c", "nation", "left")]
    assert scope("SELECT ?o { ?o a :Order } LIMIT 3", tables).limit == 3
    assert scope("SELECT ?o { ?o a :Order ; :status ?s } ORDER BY ?s LIMIT 3", tables).limit is None
    assert scope(f"SELECT ?n {{ <{N}Customer/5> :name ?n }}", tables).root.stars[0].identifier_values == [f"{N}Customer/5"]
    with pytest.raises(Unscoped):
        scope("SELECT ?x { ?x :name ?n }", tables)
    for text in ("SELECT ?o { { ?o a :Order } UNION { ?o a :Part } }", "SELECT ?o { ?o :customer/:nation ?n }", "SELECT ?o { ?o a :Order . OPTIONAL { ?p a :Part ; :brand ?b } }"):
        with pytest.raises(UnsupportedConstruct):
            scope(text, tables)


def test_golden_layout(spark):
    rows = [("u:1", "c:Signal", '{"name": "S1", "tags": ["a", "b"], "on": null}'), ("u:2", "c:Group", '{"refers": "u:1"}'), ("u:3", "c:Signal", '{"tags": []}')]
    golden = spark.createDataFrame(rows, "uri string, class_uri string, j string").selectExpr("uri", "class_uri", "parse_json(j) AS data")
    c = golden_catalog(golden, "s:", {"Signal": {"iri": "c:Signal", "slots": {"name": "string", "tags": ("string", None, True), "on": "string"}}, "Group": {"iri": "c:Group", "slots": {"refers": ("string", "Signal")}}})
    found = query(spark, c, "SELECT ?g ?n { ?g a <c:Group> ; :refers ?s . ?s :name ?n }").collect()
    assert [tuple(r) for r in found] == [("u:2", "S1")]
    assert sorted(r.t for r in query(spark, c, "SELECT ?t { ?s a <c:Signal> ; :tags ?t }").collect()) == ["a", "b"]
    assert query(spark, c, "ASK { <u:1> :on ?x }").first().answer is False


def test_whole_results_as_text(spark, tables):
    got = json.loads(execute(spark, tables, "SELECT ?n ?r ?none { ?n a :Nation ; :region ?r . OPTIONAL { ?r :brand ?none } }"))
    assert got["head"] == {"vars": ["n", "r", "none"]} and len(got["results"]["bindings"]) == 25
    assert all(set(b) == {"n", "r"} and b["r"]["type"] == "uri" and b["r"]["value"].startswith(N + "Region/") for b in got["results"]["bindings"])
    assert json.loads(execute(spark, tables, "ASK { ?n a :Nation }")) == {"head": {}, "boolean": True}
    lines = execute(spark, tables, f"DESCRIBE <{N}Nation/4>", "turtle").splitlines()
    assert len(lines) == 3 and all(x.startswith(f"<{N}Nation/4> <") and x.endswith(" .") for x in lines)
    with pytest.raises(UnsupportedConstruct):
        execute(spark, tables, f"DESCRIBE <{N}Nation/4>", "xml")


def test_guards_of_whole_results(spark, tables):
    with pytest.raises(TripleLimitExceeded):
        execute(spark, tables, "SELECT ?r { ?r a :Region }", limits=Limits(max_triples=9))
    assert execute(spark, tables, "SELECT ?r { ?r a :Region }", limits=Limits(max_triples=10, max_rows=5))
    with pytest.raises(ResultLimitExceeded):
        execute(spark, tables, "SELECT ?r { ?r a :Region }", limits=Limits(max_rows=4))
    assert (Limits().max_triples, Limits().max_rows) == (500_000, 10_000)


def test_joins_on_maybe_unbound_variables_are_equi_joins(spark, tables):
    for text in (
        "SELECT ?c ?o ?t { ?c a :Customer . OPTIONAL { ?o a :Order ; :customer ?c ; :status 'P' } ?o a :Order ; :totalPrice ?t ; :priority '5-LOW' . ?c :segment 'NONE' }",
        "SELECT ?c ?p { ?c a :Customer . OPTIONAL { ?o a :Order ; :customer ?c ; :priority ?p } ?q a :Order ; :customer ?c ; :priority ?p }",
    ):
        plan = query(spark, tables, text)._jdf.queryExecution().optimizedPlan().toString()
        assert " OR isnull" not in plan and "isnull(" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_a_malformed_line(spark):
    lines = spark.createDataFrame([("<a:s> <a:p> <a:o> .",), ("<a:s> <a:p> oops",), ("# note",), ("",)], "value string")
    with pytest.raises(Exception, match="not a triple"):
        import_ntriples(lines).collect()
    assert import_ntriples(lines, "DROPMALFORMED").count() == 1
    assert [r._corrupt_record for r in import_ntriples(lines, "PERMISSIVE").collect()] == [None, "<a:s> <a:p> oops"]


def test_negated_paths():
    from veldgraph.plans import algebra as A

    def path(text):
        return parse(f"SELECT ?s {{ ?s {text} ?o }}", {"": "n:"}).node.node.triples[0].p

    assert path("!:a") == A.Negated(("n:a",), None) and path("!(:a|^:b)") == A.Negated(("n:a",), ("n:b",)) and path("!^:b") == A.Negated(None, ("n:b",))
    with pytest.raises(ParseError):
        path("!(:a|")
