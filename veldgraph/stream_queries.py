"""Registered streaming queries: each reads its table as a stream, writes what comes of it to the shared folder and gives that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history_queries import _LONG
from .plans.rules import parse_shapes
from .shared import shared_dir
from .streaming import live

_RULE = '@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . e:Kind a sh:NodeShape ; sh:property [ sh:path e:event_type ; sh:in ( "click" "view" "purchase" ) ] . e:Value a sh:NodeShape ; e:enforcementLevel "unlikely" ; sh:property [ sh:path e:event_type ; sh:hasValue "click" ] .'


def _events(spark, sf_dir) -> DataFrame:
    # a pattern, for a stream's source is a folder or a pattern, not a file
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/[e]vents.parquet")


def _written(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the data that is there now."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/veldgraph/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_violations(spark, sf_dir):
    """Rules judge each event as it comes."""
    return _written(live.validate(_events(spark, sf_dir), parse_shapes(_RULE), ["event_id"]).select("event_id", "shape", "enforcement_level"))


def stream_counts(spark, sf_dir):
    """Violations by level and day, once a day can't get more of them."""
    found = live.validate(_events(spark, sf_dir), parse_shapes(_RULE), ["event_id", "ts"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return _written(live.counts(found, "ts", "1 day", "2 days")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "enforcement_level", "n")


def stream_distinct(spark, sf_dir):
    """Events that come twice count once."""
    e = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return _written(live.distinct_stages(e, "ts", ["ts", "user_id"], "100 days").select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def stream_history(spark, sf_dir):
    """Running values of objects, kept as state: the same deltas as the batch form gives."""
    seq = F.expr("unix_seconds(cast(ts as timestamp)) * 1000000000 + event_id")
    value = F.to_json(F.struct("event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")))
    stages = _events(spark, sf_dir).select(F.col("user_id").alias("object"), seq.alias("seq"), value.alias("value"))
    d = _written(live.running_history(stages))
    return d.groupBy("object", F.element_at("path", 1).alias("path"), "op").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


QUERIES = {f.__name__: f for f in (stream_violations, stream_counts, stream_distinct, stream_history)}

_BROKEN = "SELECT event_id, ts, 'http://e/Kind' AS shape, 'serious' AS enforcement_level FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL SELECT event_id, ts, 'http://e/Value', 'unlikely' FROM events WHERE event_type <> 'click'"

SQL = {
    "stream_violations": f"SELECT event_id, shape, enforcement_level FROM ({_BROKEN})",
    "stream_counts": f"SELECT strftime(d, '%Y-%m-%d') AS day, enforcement_level, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d, enforcement_level FROM ({_BROKEN})) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM ({_BROKEN})) - INTERVAL 2 DAY GROUP BY ALL",
    "stream_distinct": "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT ON (ts, user_id) * FROM events) GROUP BY ALL",
    "stream_history": f"SELECT object, path, 'update' AS op, count(*) AS n, max(seq) AS last FROM ({_LONG}) WHERE i > 1 AND now <> old GROUP BY object, path",
}
