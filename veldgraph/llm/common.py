"""Helpers shared by the text operators: stashes, sizing and byte-level words."""

from __future__ import annotations

import gc
import math
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: ASCII white space as the operators understand it: space and 0x09-0x0D.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of a batch of rows that Spark hands to Python (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldgraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python have at most BATCH_BYTES; a session that sets a limit of its own keeps it.

    Else a batch has 10,000 rows of any length, and an executor keeps the memory
    of several such batches outside its heap, and each Python worker that of its own.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a column; one pass that reads only this column."""
    return int(docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and its row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, column: int, limit: int):
    """Cut record batches so that each holds at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        _, at = joined(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(separator: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators, and the word offsets of each row.

    ``separator`` marks bytes; rows never share a word.
    """
    n = len(separator)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separator, out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = at[(at > 0) & (at < n)]
    if len(edges):
        begins[edges] |= inside[1:-1][edges]
        ends[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, at)


#: Bases of the running polynomial sums, odd and so invertible modulo 2^64.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xB5026F5AA96619E9))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, _BASES[which]), np.full(size, np.uint64(pow(int(_BASES[which]), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[which]


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (in order, without overlap); ``which`` (0 or 1) picks one of two.

    Hashes come from running polynomial sums over stretches of about a MiB.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + (1 << 20), "right")))
        first, last = starts[i], stops[j - 1]
        up, down = _power_tables(last - first + 1, which)
        total = np.zeros(last - first + 1, np.uint64)
        values = raw[first:last].astype(np.uint64)
        values += np.uint64(1)
        values *= up[: last - first]
        np.cumsum(values, out=total[1:])
        begin, end = starts[i:j] - first, stops[i:j] - first
        out[i:j] = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows: the row of each element and its position in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def bits_for(n: int) -> int:
    return max(1, math.ceil(math.log2(max(2, n))))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects garbage."""
    for _ in range(2):  # what the first round lets go of, the second collects
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of each element's value."""
    order = np.argsort(h)
    ranked = h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return ranked[fresh], order[fresh], of
