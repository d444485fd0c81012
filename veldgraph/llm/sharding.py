"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by leading bits of a row's hash. A bucket whose rows
exceed the byte limit is split on one more bit, and only such a bucket, so
shards differ in depth. Sizes are first summed for short prefixes, each level
of the directory is summed from these, and rows are looked at again only if
their bucket needs more bits than the prefixes have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, ceil_div, stash

#: A shard's limit in bytes of UTF-8 text.
LIMIT = 1 << 20
#: Bits of the hash.
BITS = 60


def hash_column(doc_id: str = "doc_id", text: str = "text"):
    """60 bits of the MD5 of the id as text; rows without an id are told apart by their text."""
    return F.expr(f"cast(conv(substring(md5(cast(coalesce(cast({doc_id} as string), concat('null ', coalesce({text}, ''))) as binary)), 1, 15), 16, 10) as bigint)")


def _directory(sizes: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """prefix (of ``bits`` bits) -> depth of its shard, the shard's bytes and rows; depth null: needs more bits."""
    levels = sizes.select("prefix", "bytes", "n", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth"))
    held = levels.groupBy("depth", F.expr(f"shiftright(prefix, {bits} - depth)").alias("head")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    # Bytes fall with the depth, so the first depth at which a bucket fits is where splitting stops.
    fits = held.where((F.col("shard_bytes") <= limit) | F.lit(bits >= BITS) & (F.col("depth") == bits))
    return (
        levels.select("prefix", "depth", F.expr(f"shiftright(prefix, {bits} - depth)").alias("head"))
        .join(fits, ["depth", "head"], "left")
        .groupBy("prefix")
        .agg(F.min_by(F.struct("depth", "shard_bytes", "shard_rows"), F.when(F.col("shard_bytes").isNotNull(), F.col("depth"))).alias("leaf"))
        .select("prefix", "leaf.depth", "leaf.shard_bytes", "leaf.shard_rows")
    )


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """Per row: doc_id, n_bytes, h, shard, depth, shard_bytes, shard_rows."""
    rows = stash(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_column().alias("h")), "sizes")
    total = int(rows.agg(F.sum("n_bytes")).first()[0] or 0)
    done, least, bits = [], 0, min(BITS, bits_for(ceil_div(total, limit) + 1) + 3)
    while True:
        here = rows.withColumn("prefix", F.shiftright("h", BITS - bits))
        table = stash(_directory(here.groupBy("prefix").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), bits, least, limit), "directory")
        found = here.join(table, "prefix")
        done.append(found.where("depth is not null"))
        if bits == BITS or table.where("depth is null").isEmpty():
            break
        rows = stash(found.where("depth is null").select("doc_id", "n_bytes", "h"), "oversized")
        least, bits = bits + 1, min(BITS, bits + 6)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    shard = F.expr(f"if(depth = 0, '', substring(lpad(conv(cast(shiftright(h, {BITS} - depth) as string), 10, 2), depth, '0'), 1, depth))")
    return out.select("doc_id", "n_bytes", "h", shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows.

    ``shard`` is the shard's hash prefix in bits (the empty string if all rows
    fit in one shard). A null text has 0 bytes. Rows with the same doc_id share
    a shard, and so do rows without an id and with the same text; only where one
    such id alone exceeds the limit is a shard larger than it. Repeated rows
    give repeated rows; other columns are ignored; an empty table has no shards.
    """
    return _placed(docs, limit).drop("h")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` with one folder for each shard, ``shard=b<bits>`` (``shard_id=...`` if ``docs`` has a column shard)."""
    name = "shard_id" if "shard" in docs.columns else "shard"
    of = _placed(docs, limit).select(F.col("h").alias("of"), F.concat(F.lit("b"), "shard").alias("place")).dropDuplicates(["of"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), hash_column().alias("h"))
    rows.join(of, F.col("h") == F.col("of")).select("row.*", F.col("place").alias(name)).repartition(name).write.partitionBy(name).parquet(path)


#: DuckDB SQL for ``shards`` over documents (ids not null).
SQL = f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT d.depth, (r.h >> ({BITS} - d.depth)) AS head, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM r, (SELECT unnest(range(0, 25))::INTEGER AS depth) d GROUP BY ALL),
m AS (SELECT r.doc_id, r.n_bytes, r.h, min(l.depth) AS depth FROM r JOIN l ON l.head = (r.h >> ({BITS} - l.depth)) WHERE l.shard_bytes <= {LIMIT} GROUP BY ALL)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.depth = 0 THEN '' ELSE right(lpad(bin(m.h >> ({BITS} - m.depth)), 64, '0'), m.depth) END AS shard, m.depth, l.shard_bytes, l.shard_rows
FROM m JOIN l ON l.depth = m.depth AND l.head = (m.h >> ({BITS} - m.depth))
"""
