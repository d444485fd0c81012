import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veldgraph.errors import VeldgraphError
from veldgraph.operators import history as h
from veldgraph.operators.history import Delta, Stage

# A garden in four seasons.
SEASONS = [
    {"plot": "G7", "beds": [{"bed": "b1", "crop": "rye"}, {"bed": "b2", "crop": "peas"}], "water": {"tank": 300, "pump": "off"}},
    {"plot": "G7", "beds": [{"bed": "b1", "crop": "rye"}, {"bed": "b2", "crop": "beans"}], "water": {"tank": 120, "pump": "off"}, "fence": True},
    {"plot": "G7", "beds": [{"bed": "b1", "crop": "clover", "rows": 4}], "water": {"tank": 120, "pump": "on"}, "fence": True},
    {"plot": "G7", "beds": [{"bed": "b1", "crop": "clover", "rows": 6}, {"bed": "b9", "crop": "kale"}], "water": {"tank": 500, "pump": "on"}},
]


def test_diff_kinds():
    assert h.diff({"a": 1, "b": {"c": 2}}, {"b": {"c": 3}, "d": [1]}) == [Delta(("b", "c"), "update", 2, 3), Delta(("d",), "add", None, [1])]
    assert h.diff({"a": 1, "m": {"k": 1}}, {"m": {}}, treat_missing_as_null=True, mappings=["m"]) == [Delta(("a",), "update", 1, None), Delta(("m", "k"), "remove", 1, None)]
    assert h.diff([1, 2, 3], [1]) == [Delta(("2",), "remove", 3), Delta(("1",), "remove", 2)]
    assert h.diff({"o": {"pid": 1, "x": 1}}, {"o": {"pid": 2, "x": 1}}, identifiers=["pid"]) == [Delta(("o",), "update", {"pid": 1, "x": 1}, {"pid": 2, "x": 1})]
    assert h.diff({"o": {"pid": 1}}, {"o": {"pid": 2}}, treat_changed_identifier_as_new_object=False, identifiers=["pid"]) == [Delta(("o", "pid"), "update", 1, 2)]


def test_blame_of_the_garden():
    stages = [Stage({"change_id": i}, SEASONS[i], h.diff(SEASONS[i - 1], SEASONS[i], treat_missing_as_null=True, identifiers=["bed"])) for i in (1, 2, 3)]
    value, blame = h.apply_deltas(SEASONS[0], stages)
    assert h.equals(value, SEASONS[3], True)
    who = {p: m["change_id"] for p, m in h.blame_paths(value, blame)}
    assert [who["beds", "0", k] for k in ("crop", "rows")] == [2, 3] and who["beds", "1", "crop"] == 3
    assert [who["water", k] for k in ("tank", "pump")] == [3, 2] and who["fence",] == 3
    assert ("plot",) not in who and ("beds", "0", "bed") not in who
    assert [p for p, _ in h.blame_paths(value, blame)][0] == ()
    lines = h.format_blame(value, blame).split("\n")
    assert all(line[72] == " " for line in lines) and any("cid=  3" in line and "kale" in line for line in lines)


def test_history_uses_the_running_value():
    stages = [Stage({"n": 0}, {"a": 1, "b": 1}), Stage({"n": 1}, {"a": 2}, rejected_paths=[("a",)]), Stage({"n": 2}, {"a": 2, "m": {"k": {"x": 1}}})]
    value, out = h.compute_history(stages)
    assert out[1].deltas == [] and out[2].deltas == [Delta(("a",), "update", 1, 2), Delta(("m",), "add", None, {"k": {"x": 1}})]
    assert value == {"a": 2, "b": 1, "m": {"k": {"x": 1}}}
    with pytest.raises(VeldgraphError):
        h.compute_history([])
    assert Stage.from_json(out[2].to_json()) == out[2]


def test_patch_reports_paths():
    value, t = h.patch({"a": {"b": 1}, "l": [1]}, [Delta(("a", "b"), "update", 1, 1), Delta(("x", "y"), "add", None, 1), Delta(("l", "1"), "add", None, {"z": 1}), Delta(("a", "b"), "remove", 1), Delta(("q",), "update", 1, 2)])
    assert value == {"a": {}, "l": [1, {"z": 1}]}
    assert t.failed == [("x", "y"), ("q",)] and t.added == [("l", "1"), ("l", "1", "z")] and t.deleted == [("a", "b")] and t.updated == [("l",), ("a",)]
    assert h.equals({"a": None}, {}, True) and not h.equals({"a": None}, {})


def test_diff_then_patch_gives_the_target():
    rng = random.Random(2)

    def tree(d=3):
        r = rng.random()
        if d == 0 or r < 0.3:
            return rng.choice([1, 2, "a", None, True])
        return {k: tree(d - 1) for k in rng.sample("abcd", rng.randrange(4))} if r < 0.75 else [tree(d - 1) for _ in range(rng.randrange(3))]

    for _ in range(300):
        a, b = {"r": tree()}, {"r": tree()}
        got, trace = h.patch(a, h.diff(a, b, treat_missing_as_null=True))
        assert not trace.failed and h.equals(got, b, True)


def test_lists_align_by_identifier():
    a = {"rows": [{"no": 1, "x": 1}, {"no": 2, "x": 2}, {"no": 3, "x": 3}]}
    b = {"rows": [{"no": 1, "x": 1}, {"no": 9, "x": 0}, {"no": 3, "x": 5}]}
    found = h.diff(a, b, identifiers=["no"])
    assert found == [Delta(("rows", "1"), "remove", {"no": 2, "x": 2}), Delta(("rows", "1"), "add", None, {"no": 9, "x": 0}), Delta(("rows", "2", "x"), "update", 3, 5)]
    assert h.patch(a, found)[0] == b
    turned = {"rows": a["rows"][::-1]}
    assert h.diff(a, turned, identifiers=["no"]) == [Delta(("rows",), "update", a["rows"], turned["rows"])]
    rng = random.Random(8)
    for _ in range(200):
        x, y = ([{"no": n, "v": rng.randrange(3)} for n in rng.sample(range(6), rng.randrange(5))] for _ in range(2))
        got, trace = h.patch({"l": x}, h.diff({"l": x}, {"l": y}, identifiers=["no"]))
        assert got == {"l": y} and not trace.failed


def test_blame_moves_with_list_members():
    base = {"l": [{"no": 1, "v": 0}, {"no": 2, "v": 0}]}
    steps = [{"l": [{"no": 1, "v": 0}, {"no": 2, "v": 7}]}, {"l": [{"no": 0, "v": 0}, {"no": 1, "v": 0}, {"no": 2, "v": 7}]}, {"l": [{"no": 2, "v": 7}]}]
    stages, value = [], base
    for i, s in enumerate(steps):
        stages.append(Stage({"change_id": i}, s, h.diff(value, s, identifiers=["no"])))
        value = s
    value, blame = h.apply_deltas(base, stages[:2])
    assert value == steps[1] and h.blame_info(("l", "2", "v"), blame) == {"change_id": 0} and h.blame_info(("l", "0", "no"), blame) == {"change_id": 1} and h.blame_info(("l", "1", "no"), blame) is None
    value, blame = h.apply_deltas(base, stages)
    assert value == steps[2] and h.blame_info(("l", "0", "v"), blame) == {"change_id": 0}
    assert base["l"][1]["v"] == 0


def test_patch_with_missing_as_null():
    deltas = [Delta(("a",), "update", None, 1), Delta(("b",), "update", 2, None), Delta(("c",), "remove", 3)]
    assert h.patch({}, deltas)[1].failed == [("a",), ("b",), ("c",)]
    assert h.patch({}, deltas, treat_missing_as_null=True) == ({"a": 1}, h.Trace(added=[("a",)], updated=[()]))


def test_stages_are_of_one_class():
    with pytest.raises(VeldgraphError):
        h.compute_history([Stage({}, {}, class_id="A"), Stage({}, {}, class_id="B")])
    assert json.loads(h.diff_json('{"a": 1}', '{"a": 2}')) == [{"path": ["a"], "op": "update", "old": 1, "new": 2}]


def test_flat_and_folded_agree(spark):
    rng = random.Random(3)
    rows = [(o, s, rng.choice([None, "x", "y"]), rng.choice([None, 1, 2]), rng.choice([None, ["a"], ["b"], ["a", "b"]])) for o in range(8) for s in range(12)]
    df = spark.createDataFrame(rows, "object long, seq long, a string, b int, rejected array<string>")
    flat = h.flat_history(df, ["a", "b"], "rejected")
    stages = df.select("object", "seq", F.to_json(F.struct("a", "b")).alias("value"), F.transform("rejected", lambda x: F.array(x)).alias("rejected"))
    folded = h.fold_history(stages)
    text = lambda j: None if j == "null" else str(json.loads(j))
    assert sorted((r.object, r.seq, r.path, r.op, r.old, r.new) for r in flat.collect()) == sorted(((r.object, r.seq, r.path[0], r.op, text(r.old), text(r.new)) for r in folded.collect()), key=lambda x: (x[0], x[1], x[2]))


def test_alike_means_one_json_text():
    values = [None, True, False, 0, 1, 1.0, 0.0, -0.0, float("nan"), "1", "", [], [1], [1.0], [None], {}, {"a": None}, {"a": 1}, {"a": True}, {"a": 1, "b": None}, {"b": 1}, {"a": {"c": None}}, {"a": {}}, {"a": [{"c": None}]}, {"a": [{}]}]
    for a in values:
        for b in values:
            assert h._alike(a, b) == (json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)) == h.equals(a, b), (a, b)
            assert not h._alike(a, b, True) or h.equals(a, b, True)
    assert h.equals({"a": None, "b": {"c": None}}, {"b": {}}, True) and not h.equals({"a": None}, {})
    assert not h.equals({"a": [None]}, {"a": []}, True)


def test_keyed_lists_align_in_time_that_follows_their_length():
    # with a search through the list for each member this took minutes
    n = 60_000
    a = [{"no": i, "q": 1} for i in range(n)]
    b = [{"no": i, "q": 1 + (i % 2)} for i in range(n)]
    began = time.process_time()
    assert len(h.diff(a, b, True, identifiers=["no"])) == n // 2
    assert time.process_time() - began < 20


def test_patched_rows_leave_deltas_and_current_alone(spark):
    rows = [(1, '{"l": [{"no": 0, "q": 1}, {"no": 1, "q": 2}]}', '{"l": [{"no": 1, "q": 4}], "m": {"x": [1]}}'), (2, None, "[1]"), (3, "[1, 2]", None), (4, '{"a": 1}', '{"a": 1.0}')]
    found = h.patched_rows(spark.createDataFrame(rows, "k int, base string, current string"), "k", identifiers=["no"]).collect()
    assert {r["k"]: (json.loads(r["value"]), r["same"]) for r in found} == {k: (json.loads(b or "null"), True) for k, _, b in rows}
