"""Exact deduplication by content sort.

Sampled splitters range-partition the rows on their normalised bytes (a prefix
and, beyond it, the digest that orders equal prefixes); Spark's external sorter
places equal texts side by side; each row is then compared in full with its
neighbour. The doc_id is the last sort key, so a group of copies of any size is
cut over many partitions; the at most two groups that each partition may share
with its neighbours are put together from one row a partition and side.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, ceil_div, stash, text_bytes

#: Bytes of the normalised text that take part in the splitters.
PREFIX = 32
#: Text bytes a sorted partition should hold.
PARTITION_BYTES = 32 << 20
#: Range partitions at most: Spark samples 100 keys of each on the driver, and the edge groups (two a partition) are broadcast.
MAX_PARTITIONS = 10_000


def _normalise(batches):
    for b in batches:
        norm, digest = [], []
        for text in b.column("text"):
            raw = text.as_buffer() if text.is_valid else b""
            raw = bytes(raw).translate(None, SPACE_BYTES)
            norm.append(raw)
            digest.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n"), pa.array([x[:PREFIX] for x in norm], pa.binary()), pa.array(digest, pa.binary()), pa.array(norm, pa.binary())],
            names=["doc_id", "n", "prefix", "digest", "norm"],
        )


def _runs(batches):
    """Group sorted rows by full comparison of neighbours.

    Gives each row the run's first row (longest, then smallest doc_id), the size
    of the run within this partition, and whether the run touches the
    partition's first or last row.
    """
    last: bytes | None = None
    held: list[pa.RecordBatch] = []  # ids and lengths of the open run; no texts
    head: tuple = ()
    first_run = True

    def close(at_end: bool):
        nonlocal first_run
        rows = sum(len(x[0]) for x in held)
        edge = first_run or at_end
        lead = True
        for ids, ns in held:
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, ns, pa.array([head[2]] * k, pa.string()), pa.array([head[0]] * k, pa.int64()), pa.array([head[1]] * k, pa.int64()), pa.array([rows] * k, pa.int64()), pa.array([edge] * k, pa.bool_()), pa.array([lead] + [False] * (k - 1), pa.bool_())],
                names=["doc_id", "n", "text_sha256", "keep_id", "keep_n", "group_size", "edge", "lead"],
            )
            lead = False
        first_run = False
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column("norm")
        fresh = [0] if last is None or norm[0].as_py() != last else []
        if b.num_rows > 1:
            fresh += [i + 1 for i, same in enumerate(pc.equal(norm[1:], norm[:-1]).to_pylist()) if not same]
        if not fresh or fresh[0] != 0:
            held.append((b.column("doc_id")[: fresh[0] if fresh else b.num_rows], b.column("n")[: fresh[0] if fresh else b.num_rows]))
        for i, j in zip(fresh, [*fresh[1:], b.num_rows]):
            if held:
                yield from close(False)
            head = b.column("doc_id")[i].as_py(), b.column("n")[i].as_py(), b.column("digest")[i].as_py().hex()
            held.append((b.column("doc_id")[i:j], b.column("n")[i:j]))
        last = norm[b.num_rows - 1].as_py()
    if held:
        yield from close(True)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after every character of ``[\\x20\\x09-\\x0D]`` is
    deleted; a null text counts as empty, so null, empty and blank texts form
    one group. Of a group the row with the most code points in its original
    text stays, then the smallest doc_id. A null doc_id sorts after all others;
    of rows that agree in text and doc_id every one is returned, and each counts
    towards group_size, but all of them carry ``kept`` if that id is kept. Other
    columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"))
    n_parts = min(MAX_PARTITIONS, max(2, spark.sparkContext.defaultParallelism, ceil_div(text_bytes(rows), PARTITION_BYTES)))
    keyed = rows.mapInArrow(_normalise, "doc_id long, n long, prefix binary, digest binary, norm binary")
    order = ["prefix", "digest", F.col("n").desc(), F.col("doc_id").asc_nulls_last()]
    runs = stash(
        keyed.repartitionByRange(n_parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_runs, "doc_id long, n long, text_sha256 string, keep_id long, keep_n long, group_size long, edge boolean, lead boolean"),
        "content-sort",
    )
    # One row for each run at a partition's edge: two a partition at most.
    whole = (
        runs.where("edge and lead")
        .groupBy("text_sha256")
        .agg(F.min_by("keep_id", F.struct(-F.col("keep_n"), F.col("keep_id").isNull(), "keep_id")).alias("all_keep"), F.sum("group_size").alias("all_size"))
    )
    out = runs.where("not edge").select("doc_id", "keep_id", "group_size", "text_sha256").unionAll(
        runs.where("edge").join(F.broadcast(whole), "text_sha256").select("doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), "text_sha256")
    )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
