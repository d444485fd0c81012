"""The registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

import secrets

from . import decontam, exact_dedup, lm, mixing, near_dedup, pii, quality, sharding, suffix_dedup, warc
from .common import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_warc_index(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc.lookup(warc.write_archive(pages), pages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pii_key(spark) -> bytes:
    """The key of surrogates: the setting ``spark.veldgraph.pii.key`` (hex), else one drawn for this session."""
    if spark.conf.get(_KEY, None) is None:
        spark.conf.set(_KEY, secrets.token_hex(32))
    return bytes.fromhex(spark.conf.get(_KEY))


_KEY = "spark.veldgraph.pii.key"


def op3_pii_surrogates(spark, sf_dir):
    return pii.pseudonymised(table(spark, sf_dir, "documents"), pii_key(spark))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).taken()


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.digest(decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_extendible_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc_index, op3_pii_surrogates, op4_source_mixing, op5_suffix_dedup, op6_near_dedup, op7_decontamination, op8_extendible_sharding, op9_lm_scores, op10_quality_scores)}

_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""

_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
h AS (SELECT *, unhex(sha1(html)) AS raw FROM f),
b AS (SELECT page_id, first_id, html, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 1 + 5 * i, 5))::INTEGER, 1)), '') AS digest
      FROM (SELECT *, raw::BIT::VARCHAR AS bits FROM h))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

_OP7 = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM fold LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

SQL = {"op1_exact_dedup": _OP1, "op2_warc_index": _OP2, "op7_decontamination": _OP7, "op8_extendible_sharding": sharding.SQL}
