"""Mixing sources to target weights over fixed-length token blocks.

Each source is one stream of words cut into blocks. Output shards draw
multinomial counts of their slots from the sources' open quotas; slot j of a
source takes the block to which a pseudorandom permutation of the source's
block numbers maps j (one permutation for each pass over the source); slots and
blocks meet in an equi-join on the block number.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, joined, mix64, slices, stash, word_bounds

BLOCK = 256
SHARD_SLOTS = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20
#: Documents whose word offsets are summed in one window.
CHUNK_ROWS = 500
#: Chunks whose sums are added up in one window.
CHUNK_GROUP = 4_096
#: Output shards whose slots one task draws and permutes.
TASK_SHARDS = 64
#: The table of sources (names and sizes) is held by the driver and each task; more raise an error.
MAX_SOURCES = 100_000


class Permutation:
    """A keyed permutation of range(n): a Feistel network with cycle walking."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, ((max(1, n) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [mix64(np.array([(key + r * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0] for r in range(1, 5)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in self.keys:
            a, b = b, a ^ (mix64(b + k) & self.mask)
        return (a << self.half) | b

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in reversed(self.keys):
            a, b = b ^ (mix64(a + k) & self.mask), a
        return (a << self.half) | b

    def _walk(self, x, step) -> np.ndarray:
        with np.errstate(over="ignore"):
            y = step(np.asarray(x).astype(np.uint64))
            while len(out := np.flatnonzero(y >= np.uint64(self.n))):
                y[out] = step(y[out])
        return y.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Share ``share`` of all words by weight; no source gets over ``cap`` times its size.

    Sources are taken by code point, null last; the weights repeat. What a
    capped source can't take is shared again among the others.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, got = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not over:
            return got | {s: unit * weight[s] for s in open_}
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ = [s for s in open_ if s not in got]
    return got


@dataclass(frozen=True)
class Stream:
    """What the mix takes from one source."""

    number: int
    source: str | None
    size: int
    target: float
    block: int

    @property
    def blocks(self) -> int:
        return ceil_div(self.size, self.block)

    def permutation(self, epoch: int) -> Permutation:
        name = b"\x00" if self.source is None else b"s" + self.source.encode()
        return Permutation(self.blocks, (SEED << 40) + (zlib.crc32(name) << 8) + epoch)

    def slots(self) -> tuple[int, int]:
        """Number of slots, and the words that the last one leaves out, to take round(target) words."""
        want, taken, n = round(self.target), 0, 0
        short = self.blocks * self.block - self.size  # words that the last block lacks
        epoch = 0
        while taken < want:
            rest = want - taken
            if rest >= self.size:
                taken, n = taken + self.size, n + self.blocks
            else:
                at = int(self.permutation(epoch).inverse(np.array([self.blocks - 1]))[0])
                count = ceil_div(rest, self.block)
                if count > at:
                    count = ceil_div(rest + short, self.block)
                words = count * self.block - (short if count > at else 0)
                return n + count, words - rest
            epoch += 1
        return n, 0


def _drawn(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of ``n`` slots from open quotas; draws beyond a quota are drawn again from the others."""
    drawn = np.zeros(len(left), np.int64)
    while (room := n - int(drawn.sum())) > 0:
        p = (left - drawn).astype(float)
        drawn = np.minimum(drawn + rng.multinomial(room, p / p.sum()), left)
    return drawn


def n_shards(slots: list[int], shard_slots: int = SHARD_SLOTS) -> int:
    return ceil_div(sum(slots), shard_slots)


def shard_counts(slots: list[int], shard_slots: int = SHARD_SLOTS, first: int = 0, last: int | None = None, seed: int = SEED):
    """For the output shards first..last - 1, multinomial draws of their slots by source; over all shards they add up to ``slots``.

    Shards are the leaves of a binary tree. At each node the slots of its left
    half are drawn from the node's own; the draw depends on the seed and the
    node alone, so that any task finds its shards by walking down to them.
    Yields (shard, source number, first slot, count).
    """
    total = n_shards(slots, shard_slots)
    last = total if last is None else last
    open_ = [(0, total, np.array(slots, np.int64), np.zeros(len(slots), np.int64))]
    while open_:
        begin, end, own, done = open_.pop()
        if begin >= end or end <= first or begin >= last:
            continue
        if end - begin == 1:
            for s in np.flatnonzero(own):
                yield begin, int(s), int(done[s]), int(own[s])
            continue
        middle = (begin + end) // 2
        left = _drawn(own, (middle - begin) * shard_slots, np.random.default_rng((seed, begin, end)))
        open_ += [(middle, end, own - left, done + left), (begin, middle, left, done)]


def _count_words(batches):
    for b in slices(batches, 3, 8 << 20):
        raw, at = joined(b.column(3))
        _, _, rows = word_bounds((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)), at)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(rows), pa.int64())], names=["doc_id", "source", "h", "size"])


@dataclass
class Mix:
    #: doc_id, source, h (hash of the text), size, s (source's number), start (word offset in the source's stream)
    placed: DataFrame
    #: s, source, source_size, target
    sources: DataFrame
    #: shard, s, slot, epoch, block, words (that the slot takes of the block)
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """A row for each document and block that share words: adds block, at (word in the block), length."""
        b = self.block
        return self.placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block")).selectExpr(
            "*", f"greatest(start - block * {b}, 0) as at", f"least(start + size, (block + 1) * {b}) - greatest(start, block * {b}) as length"
        )

    def taken_rows(self) -> DataFrame:
        """Per document: s, doc_id, source, h, size, taken."""
        cut = "greatest(least(length, words - at), 0)"
        own = ["s", "doc_id", "source", "h", "size"]
        used = (
            self.pieces()
            # a hint, for Spark takes what Python makes of a short range for small, and would broadcast it
            .join(self.slots.select("s", "block", "words").hint("merge"), ["s", "block"], "left")
            .groupBy(*own, "start")
            .agg(F.sum(F.expr(f"coalesce({cut}, 0)")).cast("long").alias("taken"))
            .select(*own, "taken")
        )
        return used.unionAll(self.placed.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken")))

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken."""
        # one row a source, MAX_SOURCES at most
        return self.taken_rows().join(F.broadcast(self.sources.drop("source")), "s").select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> Mix:
    """Plan a mix of ``docs``; see the module's text for the method.

    A null text has no words; documents without words are placed nowhere and
    take nothing. A null source is a source of its own. Repeated rows and
    doc_ids are documents of their own; only of rows that agree in doc_id, source
    and text is it left open which is placed first. Other columns are ignored.
    An empty table gives an empty mix. Only the table of sources (one row each,
    MAX_SOURCES at most) comes to the driver.
    """
    spark = docs.sparkSession
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = stash(columns.select("doc_id", "source", F.xxhash64("text").alias("h"), "text").mapInArrow(_count_words, "doc_id long, source string, h long, size long"), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in per_source}
    goal = targets(sizes, weights, share, cap)
    streams = [Stream(i, s, sizes[s], goal[s], block) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))]
    sources = spark.createDataFrame([(x.number, x.source, x.size, x.target) for x in streams], "s int, source string, source_size long, target double")

    # Word offsets in steps, so that no window holds a whole source.
    chunks = max(1, ceil_div(sum(r["rows"] for r in per_source), CHUNK_ROWS))
    numbered = sized.join(F.broadcast(sources.select("s", F.col("source").alias("name"))), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.lit(chunks)))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("s", "chunk").agg(F.sum("size").alias("n")).withColumn("span", F.expr(f"chunk div {CHUNK_GROUP}"))
    spans = sums.groupBy("s", "span").agg(F.sum("n").alias("n")).select("s", "span", F.coalesce(F.sum("n").over(earlier("s", "span")), F.lit(0)).alias("spans"))
    chunked = sums.select("s", "span", "chunk", F.coalesce(F.sum("n").over(earlier("s", "span", "chunk")), F.lit(0)).alias("chunks"))
    before = chunked.join(spans, ["s", "span"]).select("s", "chunk", (F.col("spans") + F.col("chunks")).alias("before"))
    inside = Window.partitionBy("s", "chunk").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        numbered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(before, ["s", "chunk"])
        .select("doc_id", "source", "h", "size", "s", (F.col("before") + F.col("inside")).cast("long").alias("start"))
    )

    plans = [x.slots() for x in streams]
    counts = [n for n, _ in plans]
    shards = n_shards(counts, shard_slots)

    def drawn(numbers):
        """The slots of the shards that the task with one of the given numbers draws, a shard at a time."""
        for number in numbers:
            held: list[tuple] = []
            for row in shard_counts(counts, shard_slots, number * TASK_SHARDS, min(shards, (number + 1) * TASK_SHARDS)):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append(row)
            if held:
                yield held

    def permuted(batches):
        for ranges in drawn(x for b in batches for x in b.column(0).to_pylist()):
            for shard, number, first, n in ranges:
                x, slot = streams[number], np.arange(first, first + n)
                epoch, place, at = slot // x.blocks, slot % x.blocks, np.zeros(n, np.int64)
                for e in np.unique(epoch):
                    at[epoch == e] = x.permutation(int(e))(place[epoch == e])
                words = np.minimum(x.block, x.size - at * x.block) - np.where(slot == plans[number][0] - 1, plans[number][1], 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, number, np.int32)), pa.array(slot), pa.array(epoch), pa.array(at), pa.array(words)], names=["shard", "s", "slot", "epoch", "block", "words"])

    tasks = max(1, ceil_div(shards, TASK_SHARDS))
    slots = spark.range(0, tasks if shards else 0, 1, tasks).mapInArrow(permuted, "shard long, s int, slot long, epoch long, block long, words long")
    return Mix(placed, sources, slots, block)


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, source, slot, epoch, block and the slot's text, words joined by a space."""
    m = mix(docs, **options)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("all"))
    cut = m.pieces().join(words, "doc_id").select("s", "block", "at", "length", F.expr("slice(all, greatest(int(block * %d - start), 0) + 1, int(length))" % m.block).alias("w"))
    blocks = cut.groupBy("s", "block").agg(F.expr("flatten(transform(array_sort(collect_list(struct(at, w))), x -> x.w))").alias("w"))
    return (
        m.slots.hint("merge").join(blocks, ["s", "block"])
        .join(F.broadcast(m.sources), "s")
        .select("shard", "source", "slot", "epoch", "block", F.expr("array_join(slice(w, 1, int(words)), ' ')").alias("text"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents in the mix's numbers: each row as often as its words were taken.

    A row comes floor(taken / size) times, and once more for a share
    taken / size of the rows, by a hash. Rows without words come once. Rows that
    agree in doc_id, source and text share evenly what was taken of them.
    """
    # The text itself is not in the shuffle of the mix; rows are found again by its hash.
    each = mix(docs, **options).taken_rows().groupBy("doc_id", "source", "h", "size").agg((F.sum("taken") / F.count("*")).alias("taken"))
    more = "if(pmod(xxhash64(doc_id, h, 4), 1000003) / 1000003D < taken / size - floor(taken / size), 1, 0)"
    times = stash(each.select("doc_id", "source", "h", F.expr(f"if(size = 0, 1, cast(floor(taken / size) as int) + {more})").alias("times")), "times")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("d"), docs["source"].cast("string").alias("o"), F.xxhash64(docs["text"].cast("string")).alias("t"))
    met = rows.join(times, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("o").eqNullSafe(F.col("source")) & (F.col("t") == F.col("h"))).where("times > 0")
    return met.select("row", F.explode(F.expr("sequence(1, times)")).alias("nth")).select("row.*")
