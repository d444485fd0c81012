"""Removal of repeated passages by blockwise suffix sorting over a difference cover.

A passage is repeated if a string of ``LENGTH`` bytes also starts in a document
with a smaller doc_id. The texts are packed into blocks ordered by doc_id. Two
suffixes agree in ``LENGTH`` bytes only if they agree in the ``SAMPLE`` bytes at
the shift below ``COVER`` at which both hit the difference cover, so:

1. The cover samples of each block (positions whose number modulo COVER is in
   the cover) are named by their SAMPLE bytes and ranked, one bucket of names at
   a time, over all blocks. What comes back to a block is one bit a name: whether
   another block has it.
2. Suffixes that reach no shared sample within LENGTH have no equal elsewhere
   and are dropped. The others are sorted, in each block one suffix bucket after
   the other, and met over all blocks, again one bucket at a time; a bit comes
   back for each: whether an earlier block has the same LENGTH bytes. Ties
   beyond a suffix's first bytes are settled by fixed-length names of these
   strings, never by reading on in the text, so memory does not depend on how
   long repeats are.
3. Each block marks the bytes its repeated suffixes cover.

Only names and bits are exchanged: each block sends a name once, however often
its documents hold it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, BLOCK_BYTES, bucket_bits, by_bucket, pack_names, packer, unpack_names, unpack_texts
from .common import bits_for, ceil_div, mix64, release, stash, text_bytes

LENGTH = 50
#: A perfect difference set: every residue is the difference of two members in one way.
COVER, MEMBERS = 21, (3, 6, 7, 12, 14)
SAMPLE = LENGTH - COVER + 1
#: Suffix buckets that a block sorts one after the other.
SUFFIX_BUCKETS = 8

_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MULTIPLIERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))


class Block:
    """The texts of a block end to end."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.n = len(raw)
        self.at = at
        self.padded = np.concatenate((raw, np.zeros(LENGTH + 8, np.uint8)))
        self.words = np.ndarray((self.n + LENGTH + 1,), "<u8", self.padded.data, strides=(1,))

    @property
    def raw(self) -> np.ndarray:
        return self.padded[: self.n]

    def inside(self, length: int) -> np.ndarray:
        """Whether a string of ``length`` that starts at a position lies within one text."""
        edges = np.zeros(self.n + 1, np.int8)
        first, last = self.at[:-1], self.at[1:] - length + 1
        some = last > first
        np.add.at(edges, first[some], 1)
        np.add.at(edges, last[some], -1)
        return np.cumsum(edges[:-1], dtype=np.int8).view(bool)

    def row(self, positions: np.ndarray) -> np.ndarray:
        """The text of each of sorted positions."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(np.searchsorted(positions, self.at)))

    def names(self, positions: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """64-bit names of the strings of ``length`` bytes at the positions."""
        h = np.full(len(positions), _SALTS[which])
        for shift in [*range(0, length - 8, 8), length - 8]:
            h ^= self.words[positions + shift]
            h *= _MULTIPLIERS[which]
            h ^= h >> np.uint64(32)
        return mix64(h)

    def samples(self) -> np.ndarray:
        member = np.zeros(COVER, bool)
        member[list(MEMBERS)] = True
        return np.flatnonzero(np.resize(member, self.n) & self.inside(SAMPLE)) if self.n else np.empty(0, np.int64)


_NAMES = "bucket int, block long, n long, data binary"
_BITS = "phase int, block long, bucket int, n long, bits binary"


def _open(ids, at, data) -> tuple[np.ndarray, Block]:
    return np.asarray(ids, np.int64), Block(unpack_texts(at, data), np.asarray(at, np.int64))


def _ranked(block: Block, ids: np.ndarray, name_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sample positions, the sorted distinct names, each sample's name number, and names that two doc_ids of the block share."""
    p = block.samples()
    # Names so short that by chance about one in a thousand is shared: samples only say where to look.
    h = block.names(p, SAMPLE) & ~np.uint64((1 << (64 - name_bits)) - 1)
    order = np.argsort(h)
    ranked = h[order]
    fresh = np.diff(ranked, prepend=~ranked[:1]) != 0 if len(h) else np.empty(0, bool)
    number = np.cumsum(fresh) - 1
    names = ranked[fresh]
    of = np.empty(len(h), np.int64)
    of[order] = number
    doc = ids[block.row(p)]
    first = np.flatnonzero(fresh)
    multi = np.zeros(len(names), bool)
    if len(names):
        by = doc[order]
        multi = np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first)
    return p, names, of, multi


def _suffixes(block: Block, ids: np.ndarray, shared: np.ndarray, name_bits: int):
    """For each suffix bucket in turn: (sorted names, second names, positions, name number of each, repeats an earlier doc_id of this block)."""
    p, names, of, multi = _ranked(block, ids, name_bits)
    live = np.zeros(block.n + 1, np.int32)
    on = p[(shared | multi)[of]] if len(p) else p
    # Suffixes from which a live sample lies wholly within LENGTH.
    np.add.at(live, np.maximum(on - (COVER - 1), 0), 1)
    np.add.at(live, on + 1, -1)
    reach = np.cumsum(live[:-1]) > 0
    starts = np.flatnonzero(reach & block.inside(LENGTH))
    del live, reach
    h, row = block.names(starts, LENGTH), block.row(starts)
    for bucket in range(SUFFIX_BUCKETS):
        mine = np.flatnonzero((h >> np.uint64(61)) == bucket)
        if not len(mine):
            continue
        at, key = starts[mine], h[mine]
        more = block.names(at, LENGTH, 1)
        order = np.argsort(key)
        ranked = key[order]
        tied = np.zeros(len(key) + 1, bool)
        tied[1:-1] = ranked[1:] == ranked[:-1]
        tied = np.flatnonzero(tied[1:] | tied[:-1])
        # Equal names by the second name, then by position: documents stand in doc_id order.
        some = order[tied]
        order[tied] = some[np.lexsort((at[some], more[some], key[some]))]
        at, key, more = at[order], key[order], more[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        number = np.cumsum(fresh) - 1
        doc = ids[row[mine[order]]]
        repeated = doc > doc[np.flatnonzero(fresh)][number]
        yield key[fresh], more[fresh], at, number, repeated


def _send(names, more, n_more, bits, block_id):
    for bucket, i, j in zip(*(lambda b, o: (b, o[:-1], o[1:]))(*by_bucket(names, bits))):
        yield {"bucket": int(bucket), "block": block_id, "n": int(j - i), "data": pack_names(names[i:j], more[i:j], n_more)}


_NAMES_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_BITS_ARROW = pa.schema([("phase", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


def _sample_names(bits: int, name_bits: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, block = _open(r["ids"], r["at"], r["data"])
                _, names, _, _ = _ranked(block, ids, name_bits)
                yield pa.RecordBatch.from_pylist(list(_send(names, names, 0, bits, r["block"])), _NAMES_ARROW)

    return run


def _meet(phase: int, n_more: int):
    """Rank a bucket's names over all blocks: phase 1 asks for any other block, phase 2 for an earlier one."""

    def run(t: pa.Table) -> pa.Table:
        blocks, sizes = np.asarray(t.column("block")), np.asarray(t.column("n"))
        got = [unpack_names(x.as_py(), n_more) for x in t.column("data")]
        names = np.concatenate([x for x, _ in got])
        more = np.concatenate([x for _, x in got]) if n_more else np.zeros(0, np.uint64)
        del got
        part = np.repeat(np.arange(len(blocks), dtype=np.int32), sizes)
        by_block = np.argsort(blocks)
        place = np.empty(len(blocks), np.int32)
        place[by_block] = np.arange(len(blocks))
        order = np.argsort(names)
        ranked = names[order]
        same = np.zeros(len(names) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        flags = np.zeros(len(names), bool)
        if phase == 1:
            flags[order] = same[:-1] | same[1:]  # a block sends a name once
        else:
            tied = np.flatnonzero(same[:-1] | same[1:])
            who = order[tied]
            key, second, when = names[who], more[who] if n_more else np.zeros(len(who), np.uint64), place[part[who]]
            settle = np.lexsort((when, second, key))
            key, second, who = key[settle], second[settle], who[settle]
            flags[who[1:]] = (key[1:] == key[:-1]) & (second[1:] == second[:-1])
        offsets = np.cumsum(sizes) - sizes
        return pa.Table.from_pydict(
            {
                "phase": pa.array([phase] * len(blocks), pa.int32()),
                "block": t.column("block"),
                "bucket": t.column("bucket"),
                "n": t.column("n"),
                "bits": pa.array([np.packbits(flags[o : o + n]).tobytes() for o, n in zip(offsets, sizes)], pa.binary()),
            },
            _BITS_ARROW,
        )

    return run


def _flags(t: pa.Table, phase: int) -> np.ndarray:
    rows = sorted((r for r in t.to_pylist() if r["phase"] == phase), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in rows)])


def _suffix_names(bits: int, n_more: int, name_bits: int):
    def run(blocks: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        for r in blocks.to_pylist():
            ids, block = _open(r["ids"], r["at"], r["data"])
            for names, more, *_ in _suffixes(block, ids, _flags(flags, 1), name_bits):
                out += _send(names, more, n_more, bits, r["block"])
        return pa.Table.from_pylist(out, _NAMES_ARROW)

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _removed(name_bits: int):
    def run(blocks: pa.Table, flags: pa.Table) -> pa.Table:
        rows = []
        for r in blocks.to_pylist():
            ids, block = _open(r["ids"], r["at"], r["data"])
            earlier, done = _flags(flags, 2), 0
            cover = np.zeros(block.n + 1, np.int32)
            for names, _, at, number, repeated in _suffixes(block, ids, _flags(flags, 1), name_bits):
                mine = earlier[done : done + len(names)]
                done += len(names)
                hit = at[repeated | mine[number]]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + LENGTH, -1)
            covered = np.cumsum(cover[:-1]) > 0
            begin, end = covered.copy(), covered.copy()
            begin[1:] &= ~covered[:-1]
            end[:-1] &= ~covered[1:]
            edges = block.at[(block.at > 0) & (block.at < block.n)]
            begin[edges] = covered[edges]
            end[edges - 1] = covered[edges - 1]
            first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
            lo, hi = np.searchsorted(first, block.at[:-1]), np.searchsorted(first, block.at[1:])
            for i, doc in enumerate(ids.tolist()):
                a, b = block.at[i], block.at[i + 1]
                spans = list(zip(first[lo[i] : hi[i]].tolist(), last[lo[i] : hi[i]].tolist()))
                kept = block.raw[a:b][~covered[a:b]] if spans else block.raw[a:b]
                rows.append({"doc_id": doc, "n_bytes": int(b - a), "n_removed": sum(y - x for x, y in spans), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(), "spans": [{"begin": x - int(a), "end": y - int(a)} for x, y in spans]})
        return pa.Table.from_pylist(rows, _RESULT_ARROW)

    return run


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that are removed).

    A null text counts as empty; texts under LENGTH bytes lose nothing. Rows
    with the same doc_id are judged each for itself and never remove from one
    another. A row without a doc_id has no place in the order: it loses nothing
    and removes nothing. Other columns are ignored; an empty table gives an
    empty result. Strings are compared by names of 64 and more bits, as many as
    keep the chance of one false match in the corpus under 2^-24.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    placed = base.where("doc_id is not null")
    # Copies of whole texts are settled by the digest: the first copy stands for all.
    digests = stash(placed.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id <> last_id").select("digest", "first_id")
    copies = stash(digests.where("n_bytes > 0").join(firsts, "digest").where("doc_id <> first_id").select("doc_id", "n_bytes", "digest"), "copies")
    few = copies.limit(500_001).count() <= 500_000  # ids and digests: 50 MB at most
    gone = copies.select("doc_id", "digest").distinct()
    left = placed.withColumn("digest", F.sha2("data", 256)).join(F.broadcast(gone) if few else gone, ["doc_id", "digest"], "left_anti").select("doc_id", "data")

    total = text_bytes(left, "data")
    n_parts = max(spark.sparkContext.defaultParallelism, ceil_div(total, BLOCK_BYTES))
    blocks = stash(left.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(packer(True), BLOCK), "blocks")
    release(spark)

    samples = int(total * len(MEMBERS) / COVER)
    bits, name_bits = bucket_bits(samples), min(64, bits_for(samples) + 10)
    shared = stash(blocks.mapInArrow(_sample_names(bits, name_bits), _NAMES).groupBy("bucket").applyInArrow(_meet(1, 0), _BITS), "shared-samples")
    release(spark)
    names = int(shared.agg(F.sum("n")).first()[0] or 0)  # about as many suffixes at most reach a shared sample
    n_more = min(8, max(0, ceil_div(2 * math.ceil(math.log2(max(2, total))) + 24 - 64, 8)))
    suffix_bits = max(3, bucket_bits(names))  # no bucket of names spans two suffix buckets
    earlier = stash(
        blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_suffix_names(suffix_bits, n_more, name_bits), _NAMES).groupBy("bucket").applyInArrow(_meet(2, n_more), _BITS),
        "earlier-suffixes",
    )
    release(spark)
    done = blocks.groupBy("block").cogroup(shared.unionAll(earlier).groupBy("block")).applyInArrow(_removed(name_bits), _RESULT)

    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.col("n_bytes") >= LENGTH
    copied = copies.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, none).otherwise(F.col("digest")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"),
    )
    nowhere = base.where("doc_id is null").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    return done.unionByName(copied).unionByName(nowhere)
