"""Near-duplicate classes by order MinHash and banded alignment.

A sketch of a document takes, under one hash function, the few smallest of its
occurrence-labelled k-mers of words and keeps them in text order, so that it
depends on their order as an edit distance does. Documents that share a sketch
are candidates; a banded alignment of their words decides.

Copies with the same words are one document from the start. Then, in a bucket of
documents that share a sketch:

1. Each is aligned with the bucket's first document, its leader. The near copies
   of one text settle here, in linear work.
2. Each pair that is left (neither member is the leader, not both are like it) is
   settled in the first bucket that the two share, unless the metric decides it:
   the distances of the two from the leader differ by more than a link allows.
   A bucket's open documents are cut into chunks, and two chunks at a time meet
   in a task, so that no task holds a whole bucket.

No pair that shares a sketch is left undecided. Work is linear in a bucket of one
class and quadratic in the texts of a bucket that are like nothing else in it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import alike, allowed, edit_distance
from .common import joined, mix64, slices, span_hashes, stash, word_bounds

#: Words of a k-mer; k-mers of a sketch. More k-mers of a sketch part texts that
#: share passages only; more sketches make up for what that costs in recall.
K = 5
KEPT = 6
#: Sketches that two texts with a k-mer similarity of SIMILARITY share on average.
MEETINGS = 7
#: Least share of words that align.
SIMILARITY = 0.8
#: Ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
SLICE_BYTES = 1 << 20
#: Documents, and bytes of text, of a chunk of a bucket.
CHUNK_ROWS = 128
CHUNK_BYTES = 16 << 20


def n_sketches() -> int:
    """27: of pairs with a k-mer similarity of just SIMILARITY about one in 2,600 shares no sketch (one in 500 of texts of 20 words)."""
    return math.ceil(MEETINGS / SIMILARITY**KEPT)


def _fold(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw).astype(np.uint8)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def _labelled(kmers: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers with the number of times each occurred before in its row."""
    key = mix64(kmers ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return mix64(kmers)
    nth = np.zeros(len(kmers), np.uint64)
    groups = np.split(same, np.flatnonzero(np.diff(same) > 1) + 1)
    for g in groups:
        at = np.sort(order[g[0] : g[-1] + 2])
        nth[at] = np.arange(len(at), dtype=np.uint64)
    return mix64(kmers + nth * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Bytes, digest of the words, and the sketches (rows x n_sketches) of texts.

    Fewer than K words, but not none, are one k-mer; a text without words has
    the sketches of no k-mer.
    """
    raw, at = joined(column)
    raw = _fold(raw)
    starts, stops, rows = word_bounds((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)), at)
    h = span_hashes(raw, starts, stops)
    n_words = np.diff(rows)
    n = len(n_words)
    digests = [hashlib.blake2b(h[rows[i] : rows[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)]

    many = np.where(n_words >= K, n_words - K + 1, np.minimum(n_words, 1))  # k-mers of each row
    row = np.repeat(np.arange(n), many)
    first = np.cumsum(many) - many
    begin = rows[:-1][row] + np.arange(len(row)) - first[row]
    kmers = np.zeros(len(row), np.uint64)
    left = rows[1:][row]
    for i in range(K):
        word = begin + i
        inside = word < left
        kmers = kmers * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(word, len(h) - 1)] if len(h) else 0, np.uint64(i))
    labelled = _labelled(kmers, row)

    count = n_sketches()
    multipliers = np.random.default_rng(11).integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bands = np.zeros((n, count), np.uint64)
    # The KEPT smallest of a row lie under a bound that its number of k-mers gives; the few rows for which
    # too few do are taken whole.
    wanted = np.minimum(many, KEPT)
    part = np.minimum((3.0 * KEPT + 8) / np.maximum(many, 1), 1.0)
    bound = np.where(part < 1, (part * 2.0**63).astype(np.uint64) << np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))[row]
    padded = np.append(labelled, np.uint64(0))
    for s in range(count):
        g = labelled * multipliers[s]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xD6E8FEB86659FD93)
        low = g <= bound
        if len(few := np.flatnonzero(np.bincount(row[low], minlength=n) < wanted)):
            low[np.isin(row, few)] = True
        hit = np.flatnonzero(low)
        of = row[hit]
        held = np.bincount(of, minlength=n)
        order = np.lexsort((g[hit], of))
        best = hit[order][np.arange(len(hit)) - (np.cumsum(held) - held)[of] < KEPT]
        best.sort()  # rows in turn, each in text order
        begin = np.cumsum(wanted) - wanted
        code = np.full(n, np.uint64(s + 1))
        for j in range(KEPT):
            code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + padded[np.where(wanted > j, np.append(best, 0)[np.minimum(begin + j, len(best))], len(labelled))])
        bands[:, s] = np.where(many > 0, code, np.uint64(0))
    return np.diff(at), digests, bands


def _sketches(batches):
    for b in slices(batches, 1, SLICE_BYTES):
        n_bytes, digests, bands = sketch(b.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.astype(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(digests, pa.binary()), flat], names=["doc_id", "n_bytes", "digest", "bands"])


_SKETCHED = "doc_id long, n_bytes long, digest binary, bands array<long>"


def _semi(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Join on doc_id; ids are broadcast if they are few enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _loose(of: int, leader: int, similarity: float) -> int:
    """Beyond this distance from its leader a text is like no text that is like the leader (the triangle inequality)."""
    reach = (1 - similarity) * leader / similarity  # how far from the leader, at most, a text like it can be
    return int(reach + (1 - similarity) * max(of, leader / similarity) + 1e-9)


def _aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Adds to (doc_id, leader) pairs: ok (they are alike), low and high (bounds of their distance, high null beyond the loose bound)."""
    names = ["doc_id", "leader", "ok", "low", "high"]

    def run(batches):
        cached: tuple = (None, None)
        for b in batches:
            ok, low, high = [], [], []
            a, c = b.column("text"), b.column("leader_text")
            for i, leader in enumerate(b.column("leader").to_pylist()):
                if leader != cached[0]:
                    cached = leader, words_of(c[i].as_py())
                mine, other = words_of(a[i].as_py()), cached[1]
                most = _loose(len(mine), len(other), similarity)
                d = edit_distance(mine, other, most)
                ok.append(d <= most and d <= allowed(len(mine), len(other), similarity))
                low.append(d)
                high.append(d if d <= most else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("leader"), pa.array(ok, pa.bool_()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=names)

    both = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("leader_text")), "leader")
    # Rows that share a doc_id are one document: the bounds hold for all its texts.
    return (
        both.select("doc_id", "leader", "text", "leader_text")
        .mapInArrow(run, "doc_id long, leader long, ok boolean, low long, high long")
        .groupBy("doc_id", "leader")
        .agg(F.max("ok").alias("ok"), F.min("ok").alias("near"), F.min("low").alias("low"), F.when(F.count("high") == F.count("*"), F.max("high")).alias("high"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge (u, v).

    Alternates large-star and small-star steps (Kiveris et al. 2014), each
    written to the shared folder, until only stars are left.
    """

    def oriented(df):
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def stars(df):
        """Whether each edge leads from a node without others to a node that has none of its own."""
        ends = df.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(df.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)").isEmpty()

    edges = stash(oriented(edges), "edges")
    while not stars(edges):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        # Minima are written, so that the joins that follow are of plain tables, whose hot nodes Spark can split.
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stash(oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stash(oriented(small), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, nth, doc_id, leader) of the sketches that several documents have; ``nth`` is the number of the hash function."""
    members = reps.select(F.col("rep").alias("doc_id"), F.posexplode("bands").alias("nth", "key"))
    leaders = members.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("other")).where("leader <> other").select("key", "leader")
    return stash(members.join(leaders, "key").select("key", "nth", "doc_id", "leader"), "members")


_TILE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _settle(similarity: float):
    """Links between the documents of two chunks of a bucket (or within one, if both are the same)."""

    def run(t: pa.Table) -> pa.Table:
        ids, side, nth = t.column("doc_id").to_pylist(), np.asarray(t.column("side")), t.column("nth")[0].as_py()
        words = [words_of(x.as_py()) for x in t.column("text")]
        sizes = np.array([len(w) for w in words])
        bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        low = np.asarray(t.column("low"))
        high = np.array([np.inf if x is None else x for x in t.column("high").to_pylist()])
        root = {r: r for r in t.column("root").to_pylist()}
        of = t.column("root").to_pylist()

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out: list[tuple[int, int]] = []
        one_chunk = bool(t.column("within")[0].as_py())
        for i in range(len(ids)):
            if not one_chunk and side[i]:
                continue
            other = np.arange(i + 1, len(ids)) if one_chunk else np.flatnonzero(side)
            limit = (1 - similarity) * np.maximum(sizes[i], sizes[other]) + 1e-9
            open_ = (np.abs(sizes[i] - sizes[other]) <= limit) & (low[i] - high[other] <= limit) & (low[other] - high[i] <= limit)
            other = other[open_]
            if len(other):  # the bucket that two documents share first decides about them
                other = other[~(bands[other, :nth] == bands[i, :nth]).any(axis=1)]
            for j in other.tolist():
                a, b = top(of[i]), top(of[j])
                if a != b and alike(words[i], words[j], similarity):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())}, _TILE)

    return run


def _links(members: DataFrame, reps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified (u, v) links among the members (key, nth, doc_id, leader) of all buckets."""
    met = stash(_aligned(members.where("doc_id <> leader").select("doc_id", "leader").distinct(), texts, similarity), "aligned")
    links = met.where("ok").select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))
    labels = stash(components(links), "labels")

    # A document is near (like the leader), open otherwise; an open one within the loose bound may be like near ones.
    follow = members.where("doc_id <> leader").join(met.select("doc_id", "leader", "near", "low", "high"), ["doc_id", "leader"])
    bytes_of = reps.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n_bytes").alias("bytes"))
    state = stash(follow.join(bytes_of, "doc_id").select("key", "nth", "doc_id", "near", "low", "high", (~F.col("near") & F.col("high").isNotNull()).alias("ring"), "bytes"), "state")
    count = lambda which: F.count(F.when(which, 1))
    chunks = lambda which: F.greatest(F.ceil(count(which) / CHUNK_ROWS), F.ceil(F.sum(F.when(which, F.col("bytes"))) / CHUNK_BYTES), F.lit(1)).cast("int")
    mixed = stash(
        state.groupBy("key")
        .agg(count(~F.col("near")).alias("n_open"), count(F.col("ring")).alias("n_ring"), count(F.col("near")).alias("n_near"), chunks(~F.col("near")).alias("open_chunks"), chunks(F.col("near")).alias("near_chunks"))
        .where("n_open > 1 or n_ring > 0 and n_near > 0")
        .select("key", F.expr("n_ring > 0").alias("with_near"), "open_chunks", "near_chunks"),
        "mixed",
    )
    at = lambda n: F.pmod(F.xxhash64("doc_id", "key"), F.col(n)).cast("int")
    placed = (
        state.join(mixed, "key")
        .where("not near or with_near")
        .join(labels.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
        .select("key", "nth", "doc_id", "near", "ring", "low", "high", F.coalesce("root", "doc_id").alias("root"), "with_near", "open_chunks", "near_chunks", F.when(F.col("near"), at("near_chunks")).otherwise(at("open_chunks")).alias("chunk"))
    )
    # A task for each two chunks of open documents, and for each chunk of open ones within the loose bound with each of near ones.
    tile = lambda kind, first, second, side: f"named_struct('kind', '{kind}', 'first', {first}, 'second', {second}, 'side', {side})"
    tiles = F.expr(
        f"""if(near, transform(sequence(0, open_chunks - 1), c -> {tile('near', 'c', 'chunk', 1)}),
               concat(transform(sequence(0, chunk), c -> {tile('open', 'c', 'chunk', 'if(c = chunk, 0, 1)')}),
                      if(chunk + 1 < open_chunks, transform(sequence(chunk + 1, open_chunks - 1), c -> {tile('open', 'chunk', 'c', 0)}), array()),
                      if(with_near and ring, transform(sequence(0, near_chunks - 1), c -> {tile('near', 'chunk', 'c', 0)}), array())))"""
    )
    dealt = placed.withColumn("tile", F.explode(tiles)).select("key", "nth", "doc_id", "low", "high", "root", "tile.*", F.expr("tile.kind = 'open' and tile.first = tile.second").alias("within"))
    full = dealt.join(texts, "doc_id").join(reps.select(F.col("rep").alias("doc_id"), "bands"), "doc_id")
    more = full.groupBy("key", "kind", "first", "second").applyInArrow(_settle(similarity), "u long, v long")
    return links.unionAll(stash(more, "settled"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per doc_id: doc_id, class_id (the smallest doc_id of its class), class_size.

    Two texts are linked if at least ``similarity`` of their words align
    (1 - distance / words of the longer) and they share a sketch (see
    ``n_sketches``). Classes are the connected components; copies count. Words are
    compared without the case of A-Z and white space, so texts that are null,
    empty or blank form one class. Rows that share a doc_id are one document,
    linked through all their texts. Rows without a doc_id have no class and are
    left out; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    sketched = stash(base.mapInArrow(_sketches, _SKETCHED), "sketches")
    copies = sketched.groupBy("digest").agg(F.min_by("bands", "doc_id").alias("bands"), F.max("n_bytes").alias("n_bytes"), F.min("doc_id").alias("rep"))
    reps = stash(copies, "representatives")
    members = _buckets(reps)
    ids = stash(members.select("doc_id").distinct(), "ids")
    texts = stash(_semi(base, ids), "texts")
    links = _links(members, reps, texts, similarity)

    of = stash(sketched.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "copies")
    first = of.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    # rows that share a doc_id tie the classes of their texts
    ties = of.join(first.where("rep <> last").select("doc_id", F.col("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v")
    roots = components(links.unionAll(ties))
    classed = stash(first.select("doc_id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id")), "classes")
    sizes = stash(classed.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    return classed.join(sizes, "class_id").select("doc_id", "class_id", "class_size")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest doc_id of their class; rows without one stay."""
    dropped = stash(near_classes(docs, similarity).where("doc_id <> class_id").select("doc_id"), "dropped")
    gone = F.broadcast(dropped) if dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else dropped
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
