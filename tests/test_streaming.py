import json

from veldgraph.plans.rules import parse_shapes
from veldgraph.streaming import live

RULE = '@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . e:R a sh:NodeShape ; sh:property [ sh:path e:kind ; sh:in ( "a" "b" ) ] .'


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_violations_and_counts(spark, tmp_path):
    rows = [(1, "2024-01-01 10:05:00", "a"), (2, "2024-01-01 10:15:00", "x"), (3, "2024-01-01 11:05:00", "y"), (3, "2024-01-01 11:05:00", "y"), (4, "2024-01-03 00:00:00", "a")]
    spark.createDataFrame(rows, "id int, t string, kind string").selectExpr("id", "cast(t as timestamp) t", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t timestamp, kind string").parquet(str(tmp_path / "in"))
    once = live.distinct_stages(stream, "t", ["id", "t"])
    found = live.validate(once, parse_shapes(RULE), ["id", "t"])
    assert sorted(r.id for r in run(found, "found")) == [2, 3]
    counted = live.counts(live.validate(stream, parse_shapes(RULE), ["id", "t"]), "t")
    assert sorted(r.n for r in run(counted, "counted", "complete")) == [1, 2]


def test_running_history(spark, tmp_path):
    stages = [(1, 1, {"a": 1}), (1, 2, {"a": 2}), (1, 2, {"a": 9}), (2, 1, {"a": 1}), (1, 3, {"b": 1})]
    spark.createDataFrame([(o, s, json.dumps(v)) for o, s, v in stages], "object long, seq long, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("object long, seq long, value string").parquet(str(tmp_path / "in"))
    got = run(live.running_history(stream), "deltas")
    assert sorted((r.object, r.seq, r.path, r.op, r.new) for r in got) == [(1, 2, [], "late", '{"a": 9}'), (1, 2, ["a"], "update", "2"), (1, 3, ["b"], "add", "1")]


def test_running_history_with_rejected_paths(spark, tmp_path):
    stages = [(1, 1, {"a": 1, "b": 1}, None), (1, 2, {"a": 2, "b": 2}, [["a"]]), (1, 3, {"a": 2}, [])]
    spark.createDataFrame([(o, s, json.dumps(v), r) for o, s, v, r in stages], "object long, seq long, value string, rejected array<array<string>>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("object long, seq long, value string, rejected array<array<string>>").parquet(str(tmp_path / "in"))
    got = run(live.running_history(stream), "partly")
    assert sorted((r.seq, r.path, r.old, r.new) for r in got) == [(2, ["b"], "1", "2"), (3, ["a"], "1", "2")]
