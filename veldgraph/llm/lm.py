"""Language-model scoring of whole documents.

Word and subword counts come from every training document: each block of texts
sends its distinct words once, by bucket of their names, and gets back the
corpus counts of its words. The attention model (``attention``) learns from all
training documents, whole: its groups of subwords from what stands around them
anywhere; its weights from chunks, one of which starts the model; then, in rounds,
every chunk trains a copy in a task of its own and the copies are averaged. All
texts are scored in overlapping windows.
"""

from __future__ import annotations

import base64
import math
import os
import pickle
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .blocks import BLOCK, bucket_bits, by_bucket, pack_names, packer, unpack_names, unpack_texts
from .common import ceil_div, distinct, release, span_hashes, stash, text_bytes, word_bounds

#: A public byte-level vocabulary; it must lie at this path on every machine.
VOCABULARY = os.environ.get("VELDGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that cuts texts for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes of a chunk, and how often each chunk is gone through.
CHUNK_BYTES = 6 << 20
ROUNDS = 1
#: Subwords that the first chunk is gone through for at the start: several times, if it has fewer.
START_SUBWORDS = 3_000_000
#: Subwords of a training sequence; a longer document is several.
SEQUENCE = 1 << 18
#: Arrays of weights that one task adds up.
FAN_IN = 64
#: Subwords that are scored at once, and that are made training sequences at once.
SCORED, LEARNT = 200_000, 1_000_000
#: Subwords whose surroundings are one row, and how many subwords a task reads before it sends its sums.
RANGE = 1024
SUMMED = 64_000_000
#: What a row without a bucket holds: subword counts, surroundings of a range of subwords, a training sequence.
TOKENS, AROUND, SEQUENCES = -1, -2, -3

_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


@lru_cache(2)
def _encoding(path: str):
    """(encoder, whether each id's bytes begin with a space, id of the end symbol)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end = max(ranks.values()) + 1
    spaced = np.zeros(end + 1, bool)
    for token, i in ranks.items():
        spaced[i] = token[:1] == b" "
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), spaced, end


def subwords(words: list[bytes], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words' subwords end to end (each word with a space before it), and how many each has."""
    encoder, spaced, _ = _encoding(path)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids = np.array(encoder.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int64)
    of = np.cumsum(spaced[ids]) - 1
    if of[-1] != len(words) - 1 or of[0] != 0:  # a word with white space of its own
        each = [encoder.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.concatenate([np.array(x, np.int64) for x in each]), np.array([len(x) for x in each], np.int64)
    return ids, np.bincount(of, minlength=len(words))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Words:
    """The words of a block: ``rows`` their offsets by document, ``of`` the number of each one's distinct word."""

    def __init__(self, at, data: bytes):
        self.at = np.asarray(at, np.int64)
        raw = np.frombuffer(unpack_texts(at, data).tobytes().translate(_FOLD), np.uint8)
        starts, stops, self.rows = word_bounds((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)), self.at)
        h = span_hashes(raw, starts, stops)
        self.names, first, self.of = distinct(h)
        whole = raw.tobytes()
        self.distinct = [whole[i:j] for i, j in zip(starts[first].tolist(), stops[first].tolist())]

    def second_names(self) -> np.ndarray:
        """Other 64 bits of the distinct words' names."""
        ends = np.cumsum([len(w) for w in self.distinct], dtype=np.int64)
        return span_hashes(np.frombuffer(b"".join(self.distinct), np.uint8), np.concatenate((ends[:1] * 0, ends[:-1])), ends, 1)


def _pack_counts(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


_SENT = "bucket int, block long, n long, data binary, counts binary, chunk long, place long, k long, ids binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("counts", pa.binary()), ("chunk", pa.int64()), ("place", pa.int64()), ("k", pa.int64()), ("ids", pa.binary())])
_COUNTED = "bucket int, block long, n long, counts binary, distinct long, total long"
_COUNTED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def _send_counts(bits: int, n_more: int, n_chunks: int, path: str):
    """A block's distinct words with their training counts, by bucket; without a bucket what the attention model learns from."""

    def sums(around: np.ndarray):
        for i in range(0, len(around), RANGE):
            if (part := around[i : i + RANGE]).any():
                yield pa.RecordBatch.from_pylist([{"bucket": AROUND, "block": i, "n": len(part), "counts": _pack_counts(part.ravel())}], _SENT_ARROW)

    def run(batches):
        end = _encoding(path)[2]
        around, read = None, 0
        for b in batches:
            for r in b.to_pylist():
                w = Words(r["at"], r["data"])
                training = np.array([not is_held_out(i) for i in r["ids"]], float)
                counts = np.bincount(w.of, weights=np.repeat(training, np.diff(w.rows)), minlength=len(w.names)).astype(np.int64)
                ids, lengths = subwords(w.distinct, path)
                tokens = np.bincount(ids, weights=np.repeat(counts, lengths), minlength=end + 1).astype(np.int64)
                tokens[end] = int(training.sum())
                rows = [{"bucket": TOKENS, "block": r["block"], "n": end + 1, "counts": _pack_counts(tokens)}]
                more = w.second_names()
                buckets, cut = by_bucket(w.names, bits)
                for bucket, i, j in zip(buckets, cut[:-1], cut[1:]):
                    rows.append({"bucket": int(bucket), "block": r["block"], "n": int(j - i), "data": pack_names(w.names[i:j], more[i:j], n_more), "counts": _pack_counts(counts[i:j])})
                yield pa.RecordBatch.from_pylist(rows, _SENT_ARROW)
                for i, j in _slabs(w, lengths, LEARNT):
                    seq, per_doc = _sequences(w, ids, lengths, i, j, end)
                    learnt = training[i:j] > 0
                    seq, per_doc, of = seq[np.repeat(learnt, per_doc)], per_doc[learnt], np.flatnonzero(learnt) + i
                    if not len(seq):
                        continue
                    read += len(seq)
                    if around is None:
                        around = np.zeros((end + 1, 3, attention.SLOTS), np.int32)
                    some, own = attention.surroundings(seq, per_doc, end + 1)
                    around[some] += own.astype(np.int32)
                    yield pa.RecordBatch.from_pylist(list(_cut(seq.astype(_id_type(end)), per_doc, [r["ids"][x] for x in of], n_chunks)), _SENT_ARROW)
                    if read > SUMMED:
                        yield from sums(around)
                        around, read = None, 0
        if around is not None:
            yield from sums(around)

    return run


def _id_type(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<i4"


def _cut(seq: np.ndarray, per_doc: np.ndarray, doc_ids: list, n_chunks: int):
    """Documents as training sequences of at most SEQUENCE subwords, each with its chunk."""
    at = np.cumsum(per_doc) - per_doc
    for doc_id, first, n in zip(doc_ids, at.tolist(), per_doc.tolist()):
        whole = seq[first : first + n]
        place = zlib.crc32(whole, zlib.crc32(str(doc_id).encode()))
        for k, i in enumerate(range(0, n - 1, SEQUENCE)):
            part = whole[i : i + SEQUENCE + 1]
            yield {"bucket": SEQUENCES, "chunk": (place + k) % n_chunks, "place": place, "k": k, "ids": part.tobytes()}


def _add_up(n_more: int):
    def run(t: pa.Table) -> pa.Table:
        got = [unpack_names(x.as_py(), n_more) for x in t.column("data")]
        names, more = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        counts = np.concatenate([_unpack_counts(x.as_py()) for x in t.column("counts")])
        order = np.lexsort((more, names))
        key, second = names[order], more[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
        sums = np.add.reduceat(counts[order], np.flatnonzero(fresh))
        totals = np.empty(len(names), np.int64)
        totals[order] = sums[np.cumsum(fresh) - 1]
        sizes = np.asarray(t.column("n"))
        at = np.cumsum(sizes) - sizes
        rows = len(sizes)
        return pa.Table.from_pydict(
            {
                "bucket": t.column("bucket"),
                "block": t.column("block"),
                "n": t.column("n"),
                "counts": pa.array([_pack_counts(totals[i : i + n]) for i, n in zip(at, sizes)], pa.binary()),
                "distinct": pa.array([int((sums > 0).sum())] * rows, pa.int64()),
                "total": pa.array([int(sums.sum())] * rows, pa.int64()),
            },
            _COUNTED_ARROW,
        )

    return run


def _token_rows(batches):
    for b in batches:
        total = None
        for x in b.column("counts"):
            c = _unpack_counts(x.as_py())
            total = c if total is None else total + c
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["token", "n"])


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sequences(words: Words, ids: np.ndarray, lengths: np.ndarray, first: int, last: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents first..last as sequences (end symbol, subwords, end symbol) end to end, and their lengths."""
    rows = words.rows[first : last + 1]
    of = words.of[rows[0] : rows[-1]]
    n = lengths[of]
    at = np.concatenate(([0], np.cumsum(n)))  # of each word among the subwords
    of_docs = np.diff(at[rows - rows[0]])
    place = np.arange(at[-1])
    from_ids = np.repeat((np.cumsum(lengths) - lengths)[of] - at[:-1], n)
    from_ids += place
    place += np.repeat(1 + 2 * np.arange(last - first), of_docs)
    out = np.full(len(place) + 2 * (last - first), end, np.int64)
    out[place] = ids.take(from_ids)
    return out, of_docs + 2


def _slabs(words: Words, lengths: np.ndarray, limit: int):
    """Ranges of documents of at most ``limit`` subwords together, one document at least."""
    sub_rows = np.concatenate(([0], np.cumsum(lengths[words.of])))[words.rows] + 2 * np.arange(len(words.rows))
    i, n = 0, len(words.rows) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(sub_rows, sub_rows[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _score(model: attention.Model, n_words: int, v_words: int, n_docs: int, path: str):
    train_tokens, distinct = n_words + n_docs, v_words + (n_docs > 0)

    def run(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        sent = sorted(counted.select(["bucket", "counts"]).to_pylist(), key=lambda x: x["bucket"])
        for r in blocks.to_pylist():
            w = Words(r["at"], r["data"])
            c = np.concatenate([np.zeros(0, np.int64), *(_unpack_counts(x["counts"]) for x in sent)])
            ids, lengths = subwords(w.distinct, path)
            end = _encoding(path)[2]
            floor = train_tokens + 0.5 * (distinct + 1)
            for i, j in _slabs(w, lengths, SCORED):
                seq, per_doc = _sequences(w, ids, lengths, i, j, end)
                log_p = model.log_probabilities(seq, per_doc).astype(float)
                n_units = np.diff(w.rows[i : j + 1]) + 1  # words, then the end
                cuts = np.cumsum(n_units) - n_units
                count = np.full(int(n_units.sum()), n_docs, np.int64)
                is_word = np.ones(len(count), bool)
                is_word[cuts + n_units - 1] = False
                count[is_word] = c[w.of[w.rows[i] : w.rows[j]]]
                out["n_tokens"] += n_units.tolist()
                out["n_known"] += np.add.reduceat((count > 0).astype(np.int64), cuts).tolist()
                out["base_score"] += np.add.reduceat(np.log10((count + 0.5) / floor), cuts).tolist()
                out["score"] += (np.add.reduceat(log_p, np.cumsum(per_doc) - per_doc) / attention.LOG10).tolist()
            out["doc_id"] += r["ids"]
        rows = len(out["doc_id"])
        return pa.table(
            {
                "doc_id": pa.array(out["doc_id"], pa.int64()),
                "held_out": pa.array([is_held_out(x) for x in out["doc_id"]], pa.bool_()),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "n_known": pa.array(out["n_known"], pa.int64()),
                "train_tokens": pa.array([train_tokens] * rows, pa.int64()),
                "base_score": pa.array(out["base_score"], pa.float64()),
                "score": pa.array(out["score"], pa.float64()),
            }
        )

    return run


def _joined(t: pa.Table, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's sequences end to end, in an order that does not depend on the run."""
    t = t.sort_by([("place", "ascending"), ("k", "ascending"), ("ids", "ascending")])
    seqs = [np.frombuffer(x.as_py(), _id_type(end)).astype(np.int64) for x in t.column("ids")]
    return np.concatenate(seqs), np.array([len(x) for x in seqs])


_WEIGHTS = "weights binary"


def _sum_weights(batches):
    total = None
    for b in batches:
        for x in b.column("weights"):
            own = np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["weights"])


def _sum_around(t: pa.Table) -> pa.Table:
    total = sum(_unpack_counts(x.as_py()) for x in t.column("counts"))
    return pa.table({"block": t.column("block")[:1], "counts": pa.array([_pack_counts(total)], pa.binary())})


def _grouped(counts: np.ndarray):
    """The group of each subword, from the sums of its surroundings in the corpus."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        some, around = [], []
        for i, data in zip(t.column("block").to_pylist(), t.column("counts")):
            part = _unpack_counts(data.as_py()).reshape(-1, 3, attention.SLOTS)
            seen = np.flatnonzero(part.any(axis=(1, 2)))
            some.append(seen + i)
            around.append(part[seen].astype(np.float32))
        groups = attention.grouped(counts, np.concatenate(some), np.concatenate(around))
        return pa.table({"groups": pa.array([groups.astype("<i4").tobytes()], pa.binary())})

    return run


def _trained(sent: DataFrame, n_chunks: int, counts: np.ndarray) -> attention.Model:
    """The model after its rounds over all training documents, from what the blocks sent."""
    spark = sent.sparkSession
    sample = sent.where(F.col("bucket") == SEQUENCES).select("chunk", "place", "k", "ids")
    first = sample.agg(F.min("chunk")).first()[0]
    if first is None:
        return attention.Model(counts, np.empty(0, np.int64))
    sums = sent.where(F.col("bucket") == AROUND).select("block", "counts").groupBy("block").applyInArrow(_sum_around, "block long, counts binary")
    groups = np.frombuffer(sums.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_grouped(counts), "groups binary").first()["groups"], "<i4")

    def start(t: pa.Table) -> pa.Table:
        ids, lengths = _joined(t, len(counts) - 1)
        model = attention.Model(counts, ids, group=groups)
        model.train(ids, lengths, max(1, min(10, START_SUBWORDS // len(ids))))
        return pa.table({"model": pa.array([pickle.dumps(model.compact())], pa.binary())})

    def more(shared, rate: float, seed: int):
        def run(t: pa.Table) -> pa.Table:
            ids, lengths = _joined(t, len(counts) - 1)
            model = shared.value
            kept = {k: x.copy() for k, x in model.p.items()}  # a worker may get several chunks
            model.train(ids, lengths, rate=rate, seed=seed)
            out = model.weights(ids)
            model.p = kept
            return pa.table({"weights": pa.array([out.astype("<f4").tobytes()], pa.binary())})

        return run

    model = pickle.loads(sample.where(F.col("chunk") == first).groupBy("chunk").applyInArrow(start, "model binary").first()["model"])
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.compact())
        # Each row is a whole copy of the weights (some MB): trees of FAN_IN keep any one task small.
        copies, n = stash(sample.groupBy("chunk").applyInArrow(more(shared, 0.01 / (r + 1), r), _WEIGHTS), "lm-weights"), n_chunks
        while n > FAN_IN:
            n = ceil_div(n, FAN_IN)
            copies = stash(copies.repartition(n).mapInArrow(_sum_weights, _WEIGHTS), "lm-weights")
        model.take_mean(np.frombuffer(copies.repartition(1).mapInArrow(_sum_weights, _WEIGHTS).first()["weights"], "<f4"))
        shared.unpersist()
    return model


def lm_scores(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end symbol alone. Rows without a doc_id count as
    training documents. Repeated rows each count and each get a row. With no
    training document the model knows nothing and train_tokens is 0. Other
    columns are ignored; an empty table gives an empty result. Words are told
    apart by names of 64 and more bits, as many as keep the chance of one
    mistake in the corpus under 2^-24.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    total = text_bytes(base, "data")
    blocks = stash(base.mapInArrow(packer(False), BLOCK), "blocks")
    release(spark)
    bits = bucket_bits(total // 16)
    n_more = min(8, max(0, ceil_div(2 * math.ceil(math.log2(max(2, total))) + 24 - 64, 8)))
    n_chunks = max(1, ceil_div(total, CHUNK_BYTES))
    sent = stash(blocks.mapInArrow(_send_counts(bits, n_more, n_chunks, path), _SENT), "word-counts")
    counted = stash(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_add_up(n_more), _COUNTED), "corpus-counts")
    release(spark)
    sums = counted.groupBy("bucket").agg(F.max("distinct").alias("v"), F.max("total").alias("n")).agg(F.sum("v"), F.sum("n")).first()
    v_words, n_words = int(sums[0] or 0), int(sums[1] or 0)
    tokens = sent.where(F.col("bucket") == TOKENS).select("counts").mapInArrow(_token_rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    end = _encoding(path)[2]
    counts = np.zeros(end + 1, np.int64)
    for r in tokens.collect():  # a row for each id of the vocabulary at most
        counts[r["token"]] = r["n"]
    model = _trained(sent, n_chunks, counts)
    shared = spark.sparkContext.broadcast(model.compact())

    def score(blocks_table: pa.Table, counted_table: pa.Table) -> pa.Table:
        return _score(shared.value.ready(), n_words, v_words, int(counts[end]), path)(blocks_table, counted_table)

    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, _RESULT)
