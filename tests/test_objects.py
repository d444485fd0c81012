import pytest

from veldgraph.errors import ParseError, TripleLimitExceeded, UnsupportedConstruct
from veldgraph.operators.lower import import_ntriples
from veldgraph.sources import objects
from veldgraph.sources.schema import SchemaView

TTL = '@prefix e: <http://e/> . e:a e:p "x"@en , "y"^^<http://e/t> , 3 , "q\\"\\n" ; e:q [ e:r ( 1 2 ) ] .'


def test_turtle_to_triples(spark):
    got = objects.import_turtle(spark, TTL).collect()
    assert ("http://e/a", "http://e/p", "x", False, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en") in [tuple(r) for r in got]
    assert len(got) == 4 + 1 + 1 + 4 and sum(r.s.startswith("_:") for r in got) == 5
    with pytest.raises(TripleLimitExceeded):
        objects.import_turtle(spark, TTL, max_triples=9)
    with pytest.raises(ParseError):
        objects.import_turtle(spark, "<a> <b> .")
    rows = objects.objects_of(objects.import_turtle(spark, TTL), {"http://e/p": "p"}).collect()
    assert [(r.uri, r.p) for r in rows] == [("http://e/a", ["3", 'q"\n', "x", "y"])]


def test_ntriples_lines(spark):
    lines = ["# note", "", '<http://e/a> <http://e/p> "x\\"\\n\\\\y"@en .', "_:b <http://e/q> <http://e/c> .", '<http://e/a> <http://e/p> "3"^^<http://e/t> .']
    got = import_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.s, r.o, r.is_iri, r.lang) for r in got] == [("http://e/a", 'x"\n\\y', False, "en"), ("_:b", "http://e/c", True, ""), ("http://e/a", "3", False, "")]


def test_terms_and_formats(spark):
    t = objects.import_turtle(spark, TTL)
    shown = {(r.x["type"], r.x["datatype"], r.x["xml:lang"]) for r in t.select(objects.term_struct(t.o, t.is_iri, t.datatype, t.lang).alias("x")).collect()}
    assert shown == {("literal", None, "en"), ("literal", "http://e/t", None), ("literal", "http://www.w3.org/2001/XMLSchema#integer", None), ("literal", None, None), ("bnode", None, None), ("uri", None, None)}
    with pytest.raises(UnsupportedConstruct):
        objects.graph_text(t.select("s", "p", "o"), "rdfxml")
    with pytest.raises(TripleLimitExceeded):
        objects.check_triples(t, 3)
    assert objects.check_triples(t, 10).count() == 10


def test_instances_and_printing(spark):
    v = SchemaView()
    v.add_schema("name: s\nclasses: {A: {attributes: {id: {identifier: true}, n: {range: integer}}}}")
    got = objects.create_instances(spark, v, "A", [{"id": "a", "n": 1, "extra": 2}, {"id": "b", "n": "no"}]).collect()
    assert [tuple(r) for r in got] == [("a", 1), ("b", None)]
    with pytest.raises(ParseError):
        objects.create_instances(spark, v, "B", [])
    assert objects.pretty({"a": {"b": [1, {"c": None}]}, "d": []}) == "a:\n  b:\n    - 1\n    -\n      c: null\nd: []"
