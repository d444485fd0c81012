"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

A window is 13 consecutive words of a benchmark item. Each holds one whole block
of 7 words that begins at a multiple of 7, so the automaton's patterns are those
blocks, one node for each word of the benchmark; a block that is found is
extended by comparing the words beside it with the item's, and counts if a whole
window agrees. Items of fewer than 13 words are patterns as they are. A document
is normalised and scanned once, and hits are mapped back to word numbers and to
character offsets of the original text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Item text, in bytes, of one automaton (about 20 times that in memory). A larger
#: benchmark is scanned in several passes over the same rows, with the same results.
ITEM_BYTES = 16 << 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
#: A-Z to lower case; bytes of ASCII that no word holds to spaces.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text; null has none."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Items:
    """Part of a benchmark as word numbers, items end to end between separators (-1)."""

    size: int
    ids: list[int | None] = field(default_factory=list)
    numbers: dict[bytes, int] = field(default_factory=dict)  # from 1
    flat: list[int] | np.ndarray = field(default_factory=lambda: [-1])
    first: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)

    def add(self, item_id: int | None, text: str | None) -> None:
        if found := words(text):
            self.ids.append(item_id)
            self.first.append(len(self.flat))
            self.length.append(len(found))
            self.flat += [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found]
            self.flat.append(-1)

    def packed(self) -> Items:
        self.flat = np.array(self.flat, np.int32)
        return self

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """The automaton of a part of a benchmark."""

    def __init__(self, items: Items):
        import ahocorasick

        self.items, self.size, self.block = items, items.size, (items.size + 1) // 2
        self.beside = self.size - self.block
        self.flat = np.concatenate((np.full(self.beside, -1, np.int32), items.flat, np.full(self.beside, -1, np.int32)))
        owners: dict[tuple, list[tuple[int, int, bool]]] = {}
        for i, (first, n) in enumerate(zip(items.first, items.length)):
            whole = n < self.size
            for at in [0] if whole else range(0, n - self.block + 1, self.block):
                key = tuple(items.flat[first + at : first + (n if whole else at + self.block)].tolist())
                owners.setdefault(key, []).append((first + at + self.beside, i, whole))
        self.owners = [(len(key), np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own])) for key, own in owners.items()]
        self.automaton, self.stretch = None, None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for number, key in enumerate(owners):
                self.automaton.add_word(key, number)
            self.automaton.make_automaton()
            # words of the benchmark in a row, as many as the shortest pattern has
            self.stretch = re.compile(b"\x01{%d,}" % min(map(len, owners)))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set, bool]:
        """Number of words, runs [first, last) of hit words, ids of the items hit, whether a window of full size is hit."""
        found = words(text)
        if self.automaton is None or not found:
            return len(found), [], set(), False
        numbers = self.items.numbers
        hit, items, full = None, set(), False
        # The automaton would fall back to its root at any word that the benchmark lacks: it is run between them.
        for m in self.stretch.finditer(bytes(map(numbers.__contains__, found))):
            own, padded = tuple(map(numbers.__getitem__, found[m.start() : m.end()])), None
            for end, number in self.automaton.iter(own):
                if padded is None:
                    hit = np.zeros(len(found), bool) if hit is None else hit
                    here = hit[m.start() : m.end()]
                    padded = np.concatenate((np.full(self.beside, -2, np.int32), np.array(own, np.int32), np.full(self.beside, -2, np.int32)))
                n, places, of, whole = self.owners[number]
                start = end - n + 1
                if whole.any():
                    here[start : end + 1] = True
                    items.update(self.items.ids[i] for i in of[whole])
                if not whole.all():
                    places, of = places[~whole], of[~whole]
                    steps = np.arange(1, self.beside + 1)
                    left = self.flat[places[:, None] - steps] == padded[start + self.beside - steps]
                    right = self.flat[places[:, None] + n - 1 + steps] == padded[end + self.beside + steps]
                    before, after = (np.minimum.accumulate(x, axis=1).sum(axis=1) for x in (left, right))
                    for i in np.flatnonzero(before + n + after >= self.size):
                        here[start - before[i] : end + after[i] + 1] = True
                        items.add(self.items.ids[of[i]])
                        full = True
        if hit is None:
            return len(found), [], set(), False
        return len(found), _runs(hit), items - {None}, full


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as character offsets of the original text."""
    raw = text.encode()
    bounds = [m.span() for m in _WORD.finditer(raw)]
    at = np.frombuffer(raw, np.uint8)
    chars = np.cumsum((at & 0xC0) != 0x80)  # characters begun up to a byte
    return [{"begin": int(chars[bounds[i][0]]) - 1, "end": int(chars[bounds[j - 1][1] - 1])} for i, j in runs]


_HITS = "struct<n_words:long,runs:array<struct<first:long,last:long>>,items:array<long>,full:boolean>"
_RUN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_HITS_TYPE = pa.struct([("n_words", pa.int64()), ("runs", _RUN_TYPE), ("items", pa.list_(pa.int64())), ("full", pa.bool_())])
_SPAN_TYPE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

_scanners: dict[int, Scanner] = {}  # of a worker: the one used last


def _scanner_of(shared) -> Scanner:
    part = shared.value
    if id(part) not in _scanners:
        _scanners.clear()
        _scanners[id(part)] = part.scanner()
        _scanners[id(part)].kept = part  # its id stays taken
    return _scanners[id(part)]


def _texts(b: pa.RecordBatch) -> pa.Array:
    return b.column("row").field("text").cast(pa.string())


def _scan(shared):
    """For mapInArrow over (row, hits): the hits with those of one part of the benchmark added."""

    def run(batches):
        for b in batches:
            scanner, out = _scanner_of(shared), []
            for text, before in zip(_texts(b), b.column("hits").to_pylist()):
                n, runs, items, full = scanner.scan(text.as_py())
                if before:
                    items, full = items | set(before["items"]), full or before["full"]
                    hit = np.zeros(n, bool)
                    for x, y in [*runs, *((r["first"], r["last"]) for r in before["runs"])]:
                        hit[x:y] = True
                    runs = _runs(hit)
                out.append({"n_words": n, "runs": [{"first": x, "last": y} for x, y in runs], "items": sorted(items), "full": bool(full)})
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, _HITS_TYPE)], names=["row", "hits"])

    return run


def _parts(items: DataFrame, size: int, item_bytes: int):
    """The benchmark in parts of bounded size, read by the driver one row at a time."""
    part, held = Items(size), 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].encode())
        if held and held + n > item_bytes:
            yield part.packed()
            part, held = Items(size), 0
        part.add(row["item_id"], row["text"])
        held += n
    yield part.packed()


def scanned(docs: DataFrame, items: DataFrame, size: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Each row of ``docs`` whole, as ``row``, with its ``hits`` (n_words, runs, items, full)."""
    spark = docs.sparkSession
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(None).cast(_HITS).alias("hits"))
    for part in _parts(items, size, item_bytes):
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(part)), out.schema)
    return out


def overlaps(docs: DataFrame, items: DataFrame, size: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, runs (of hit words), items, full (a window of full size is hit), spans (of the original text).

    A null or empty text has no words and no hits. Items that are null or have
    no words are ignored; an item without an id hits words but is not listed;
    repeated items count once. Each row of ``docs`` gives one row, repeated
    doc_ids too, and its other columns are ignored. An empty benchmark hits
    nothing. Long texts and long items are taken whole.
    """

    def spans(batches):
        for b in batches:
            out = [_original_spans(text.as_py(), [(r["first"], r["last"]) for r in h["runs"]]) if h["runs"] else [] for text, h in zip(_texts(b), b.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row").field("doc_id"), b.column("hits"), pa.array(out, _SPAN_TYPE)], names=["doc_id", "hits", "spans"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = scanned(ids, items, size, item_bytes).mapInArrow(spans, f"doc_id long, hits {_HITS}, spans array<struct<begin:long,end:long>>")
    return hits.select("doc_id", "hits.n_words", "hits.runs", "hits.items", "hits.full", "spans")


def n_hit(runs: str = "runs"):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"])


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from those of ``overlaps``."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, item_bytes: int = ITEM_BYTES, any_window: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    A row is contaminated if its hit words are a twentieth of its words or more,
    or (``any_window``) if it holds a window of full size, however long the row
    is. Each row is judged by its own text, whatever its doc_id; null and empty
    texts stay. An empty benchmark takes nothing away.
    """
    hits = scanned(docs, items, size, item_bytes)
    hit = n_hit("hits.runs")
    dirty = (hit > 0) & (20 * hit >= F.col("hits.n_words"))
    if any_window:
        dirty = dirty | F.col("hits.full")
    return hits.where(~dirty).select("row.*")
