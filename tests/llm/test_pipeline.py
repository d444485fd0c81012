import hashlib
import re
import string
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldgraph.llm import mixing, quality
from veldgraph.llm.alignment import alike
from veldgraph.llm.common import BATCH_BYTES, BATCH_SETTING
from veldgraph.llm import queries
from veldgraph.llm.near_dedup import near_classes, words_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_pipeline_stages(spark, sf):
    """Each stage keeps rows of its input, whole, and takes effect."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).persist()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.join(docs, docs.columns, "left_anti").count() == 0, name
        if name == "near dedup":
            assert near_classes(out).where("class_size > 1").count() == 0
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] != sizes[3] and sizes[5] == sizes[4]


def test_run_gives_the_last_stage(spark, sf):
    a = corpus_pipeline.run(spark, sf)
    assert a.count() > 0 and a.columns == ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the one before kept, against the plainest way to say what it does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filter_, dedup, clean, mix, shard = (stage for _, stage in corpus_pipeline.STAGES)

    kept = filter_(spark, docs, sf).persist()
    score = {r.doc_id: r.predicted for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert rows_of(kept) == Counter({(i, t): n for (i, t), n in rows_of(docs).items() if score[i] == 1})

    texts = sorted((i, words_of(t)) for i, t in rows_of(kept))
    gone = set()
    for a, (i, x) in enumerate(texts):
        for j, y in texts[:a]:
            if (x == y or alike(x, y, 0.8)) and i not in gone:
                gone.add(i)
    one = dedup(spark, kept, sf).persist()
    assert {i for i, _ in rows_of(one)} == {i for i, _ in texts} - gone

    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    cut = lambda t: word.findall((t or "").translate(low))
    windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [cut(r.text)] if w for k in range(max(1, len(w) - 12))}
    assert min(map(len, windows)) == 13
    dirty = {i for i, t in rows_of(one) for w in [cut(t)] for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows}
    left = clean(spark, one, sf).persist()
    assert dirty and {i for i, _ in rows_of(left)} == {i for i, _ in rows_of(one)} - dirty

    mixed = mix(spark, left, sf).persist()
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(left).taken().collect()}
    for (i, t), n in (rows_of(mixed) + Counter({k: 0 for k in rows_of(left)})).items():
        size, words = taken[i]
        assert n == 1 if not size else words // size <= n <= -(-words // size)

    out = shard(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: n for (i, _), n in rows_of(mixed).items()})
    for r in out:
        bits = bin(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r.shard) and r.depth == len(r.shard) and r.n_bytes == len(next(t for i, t in rows_of(mixed) if i == r.doc_id).encode())


@pytest.mark.parametrize("number", range(5))
def test_a_stage_on_odd_rows(spark, sf, number):
    """Nulls in every column, empty and blank texts, ties, repeated rows, no rows, columns with clashing names, one long text."""
    long = "word and more words of it " * 30_000
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n", None, "s", 2), (4, "one text", "en", "s", 8), (4, "one text", "en", "s", 8), (5, "one text", "en", "t", 8), (6, long, "en", "t", len(long)), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "hits", "h", "s", "key", "root", "shard", "prefix", "times", "score", "class_id", "_dropped", "size", "taken"):
        docs = docs.withColumn(name, F.lit(7))
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, docs, sf)
    got = out.collect()
    if number == 4:
        assert len(got) == len(rows)
    else:
        assert out.columns == docs.columns and all(r.hits == r.row == r.taken == 7 for r in got)
        assert {(r.doc_id, r.text) for r in got} <= {(r[0], r[1]) for r in rows}
    if number == 1:
        assert Counter(r.doc_id for r in got) == Counter({None: 2, 1: 1, 4: 2, 6: 1})
    if number == 2:
        assert len(got) == len(rows)
    if number == 3:
        assert {r.doc_id for r in got} >= {1, 2, 3}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_hand_texts_to_python_in_batches_of_bounded_bytes(spark, sf):
    """Batches of 10,000 long texts took an executor beyond its memory."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    def largest(texts):
        return max(r["size"] for r in texts.mapInArrow(sizes, "n long, size long").collect())

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    long = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word ', 600) as text")
    before = spark.conf.get(BATCH_SETTING, None)
    try:
        for name, stage in corpus_pipeline.STAGES[:-1]:
            spark.conf.unset(BATCH_SETTING)
            assert largest(long) > 3 * BATCH_BYTES
            stage(spark, docs, sf)
            assert largest(long) < 1.1 * BATCH_BYTES, name
            assert largest(spark.range(1).selectExpr("id", f"repeat('x', {2 * BATCH_BYTES}) as text")) > 2 * BATCH_BYTES  # a long row stays whole
        spark.conf.set(BATCH_SETTING, "1000000")
        stage(spark, docs, sf)
        assert spark.conf.get(BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)
