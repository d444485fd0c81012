"""Texts packed into blocks, and names (hashes) that blocks exchange by bucket."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: Text bytes of a block (a longer document is a block of its own).
BLOCK_BYTES = 6 << 20
#: Names that one task ranks at a time.
BUCKET_NAMES = 2_000_000

BLOCK = "block long, ids array<long>, at array<long>, data binary"


def packer(together: bool):
    """For mapInArrow: pack (doc_id, bytes) rows into blocks, numbered in order of the partitions.

    ``together`` keeps adjacent rows of one doc_id in one block.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        ids: list[int] = []
        texts: list[bytes] = []
        size = number = 0

        def packed():
            at = np.cumsum([0, *(len(x) for x in texts)])
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 24) + number]), "ids": pa.array([ids], pa.list_(pa.int64())), "at": pa.array([at], pa.list_(pa.int64())), "data": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary())})

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and size + len(raw) > BLOCK_BYTES and not (together and i == ids[-1]):
                    yield packed()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield packed()

    return run


def unpack_texts(at, data: bytes) -> np.ndarray:
    size = int(at[-1])
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=size), np.uint8) if size else np.empty(0, np.uint8)


def pack_names(names: np.ndarray, more: np.ndarray, n_more: int) -> bytes:
    """Sorted names as differences in byte planes, with ``n_more`` bytes of the second names."""
    gaps = np.diff(names, prepend=np.uint64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + more.view(np.uint8).reshape(-1, 8)[:, :n_more].T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_names(data: bytes, n_more: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8 + n_more, -1)
    names = np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=np.uint64)
    more = np.zeros((planes.shape[1], 8), np.uint8)
    more[:, :n_more] = planes[8:].T
    return names, more.view("<u8").ravel()


def by_bucket(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (leading bits) that sorted names fall in, and their offsets."""
    bucket = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[first], np.append(first, len(names))


def bucket_bits(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n / BUCKET_NAMES))))
