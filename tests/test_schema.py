import pytest
from pyspark.sql import types as T

from veldgraph.errors import ParseError
from veldgraph.functions.templates import Environment
from veldgraph.operators.references import foreign_edges, foreign_references
from veldgraph.sources.catalog import Catalog, ClassTable, Slot
from veldgraph.sources.schema import SchemaView, load_yaml

BASE = """
name: base
id: http://s/base
prefixes: {s: "http://s/"}
default_prefix: s
default_range: string
types: {weblink: {typeof: uri}}
enums: {Kind: {permissible_values: {b: , a: }}, More: {inherits: [Kind], permissible_values: {c: }}}
classes:
  Asset: {slots: [id, type], annotations: {managed: true}}
  Signal:
    is_a: Asset
    class_uri: s:Sig
    slots: [post, refs, frame, kind, lines]
    slot_usage: {id: {annotations: {id-slot: "yes"}}}
  Post: {is_a: Asset}
  Ref: {attributes: {key: {key: true}, target: {range: Post}}}
  Frame: {attributes: {name: , inner: {range: Frame}}}
slots:
  id: {identifier: true, required: true}
  type: {designates_type: true, range: uriorcurie}
  post: {range: Post}
  lines: {range: Post, multivalued: true}
  refs: {range: Ref, multivalued: true, inlined: true}
  frame: {range: Frame}
  kind: {range: More}
"""


@pytest.fixture(scope="module")
def view():
    v = SchemaView()
    v.add_schema(BASE)
    return v


def test_views(view):
    slots = {s.name: s for s in view.slots("Signal")}
    assert list(slots)[:2] == ["id", "type"]
    assert (slots["post"].inline_mode, slots["refs"].container_mode, slots["frame"].inline_mode, slots["lines"].container_mode) == ("Reference", "Mapping", "Inline", "List")
    assert view.find_class("s:Sig") == view.find_class("http://s/Sig") == "Signal" and view.find_class("x") is None
    assert view.descendants("Asset") == ["Post", "Signal"] and view.common_ancestor(["Signal", "Post"]) == "Asset"
    assert view.permissible_values("More") == ["a", "b", "c"] and view.enums_of("Signal")["kind"] == ["a", "b", "c"]
    assert view.identifier("Signal") == "id" and view.type_designator("Post") == "type"
    assert [s.name for s in view.slots_for_path("Signal", ["post", "id"])] == ["id"] and view.slots_for_path("Signal", ["post", "id"], False) == []
    assert view.managed_classes(["managed"]) == {"base": {"http://s/Asset": "Asset"}}
    assert set(view.managed_classes([], only_registered=False)["base"].values()) == {"Asset", "Signal", "Post"}
    assert SchemaView.from_snapshot(view.snapshot()).slots("Signal") == view.slots("Signal")


def test_spark_types(view, spark):
    t = view.spark_type("Signal", 2)
    assert isinstance(t["refs"].dataType, T.MapType) and t["refs"].dataType.valueType["target"].dataType == T.StringType()
    assert isinstance(t["frame"].dataType["inner"].dataType["inner"].dataType, T.VariantType)
    rows = load_yaml(spark, "- {id: a, post: p1}\n- {id: b, lines: [p1, p2]}", view, "Signal").collect()
    assert [(r.id, r.post, r.lines) for r in rows] == [("a", "p1", None), ("b", None, ["p1", "p2"])]


def test_imports(tmp_path):
    (tmp_path / "one.yaml").write_text("name: one\nid: http://o\nimports: [two]\nclasses: {A: {is_a: B}}")
    (tmp_path / "two.yml").write_text("name: two\nid: http://t\nclasses: {B: {attributes: {x: }}}")
    v = SchemaView()
    v.add_path(str(tmp_path / "one.yaml"))
    assert v.unresolved_imports() == ["two"]
    v.resolve_imports()
    assert [s.name for s in v.slots("A")] == ["x"]
    v.add_schema("name: three\nimports: [gone]")
    with pytest.raises(ParseError, match="gone"):
        v.resolve_imports(str(tmp_path))
    with pytest.raises(ParseError):
        v.add_schema("a: [")


def test_references_of_an_object(view):
    signal = {"id": "s1", "post": "p1", "lines": ["p2", None, "p3"], "refs": {"k": {"target": "p4"}}, "kind": "a"}
    found = foreign_references(view, "Signal", signal)
    assert [(r["uri"], "/".join(r["slot_path"]), r["kind"]) for r in found] == [("p1", "post", "foreign"), ("p4", "refs/k/target", "foreign"), ("p2", "lines/0", "foreign"), ("p3", "lines/2", "foreign")]
    assert found[0]["object_type_uri"] == "http://s/Post"
    assert foreign_references(view, "Signal", {"id": "s1"}) == []
    assert [r["kind"] for r in foreign_references(view, "Signal", {"id": "s1", "post": None}, True)] == ["primary"]


def test_edges_of_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [5, 6], None), (2, None, 7)], "k int, many array<int>, one int")
    a = ClassTable("A", "n:A", df, F.col("k"), "a/", {"many": Slot("many", F.col("many"), "B", True), "one": Slot("one", F.col("one"), "B")})
    b = ClassTable("B", "n:B", df, F.col("k"), "b/", {})
    got = foreign_edges(Catalog("n:", [a, b]), ["A"]).collect()
    assert sorted((r.holder, r.uri, "/".join(r.slot_path)) for r in got) == [("a/1", "b/5", "many/0"), ("a/1", "b/6", "many/1"), ("a/2", "b/7", "one")]


def test_templates():
    e = Environment()
    e.add_filter("twice", lambda x: x * 2)
    e.add_test("big", lambda x: x > 9)
    e.add_global("site", "S")
    assert e.render("{{ site }}/{{ a.b | upper }}/{{ none }}/{% if n is big %}big{% else %}{{ n | twice }}{% endif %}{% for x in l %}[{{ x }}]{% endfor %}", {"a": {"b": "x"}, "n": 4, "l": [1, 2]}) == "S/X//8[1][2]"
    assert e.evaluate("n | default(3)", {}) == 3
    e.add_template("t", "{{ x }}")
    assert e.render_template("t", {"x": True}) == "true"
    for bad in ("{{ x", "{% if x %}", "{{ x | nope }}", "{% endfor %}"):
        with pytest.raises(ParseError):
            e.render(bad, {"x": 1})


def test_template_options(spark):
    text = "a\n  {% if x %}\nb\n  {% endif %}\nc\n"
    assert Environment().render(text, {"x": 1}) == "a\n  \nb\n  \nc"
    assert Environment(trim_blocks=True, lstrip_blocks=True, keep_trailing_newline=True).render(text, {"x": 1}) == "a\nb\nc\n"
    assert Environment().render("[{{ x }}]", {}) == "[]" and Environment(undefined="chainable").render("[{{ x.y.z }}]", {}) == "[]"
    for options, bad in ((dict(undefined="strict"), "{{ x }}"), ({}, "{{ x.y }}"), (dict(fuel=5), "{% for i in l %}{{ i }}{% endfor %}")):
        with pytest.raises(ParseError):
            Environment(**options).render(bad, {"l": list(range(9))})
    assert Environment(fuel=50).render("{% for i in l %}{{ i }}{% endfor %}", {"l": [1, 2]}) == "12"
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    assert [r.m for r in df.select(Environment().column("{{ id }}{{ name | default('?') }}", "id", "name").alias("m")).collect()] == ["1x", "2?"]
