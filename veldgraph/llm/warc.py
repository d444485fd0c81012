"""WARC archives with a two-level capture index.

Records are written as gzip members, one a record. The index holds a line for
each record, sorted by reversed-host URL key and cut into compressed blocks; a
sparse directory holds each block's first and last key, and a short table those
of each span of the directory. A look-up bisects the short table, then the span
of the directory, then the sorted lines of the blocks that this names, and reads
only the byte ranges of the records; for many URLs each step is spread over tasks.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ceil_div, shared_dir, stash, text_bytes

#: Payloads of fewer bytes are always stored.
REVISIT_MIN_BYTES = 0
BLOCK_LINES = 1000
#: Payload bytes that an archive file holds at most, as a rule (a single record may be larger).
FILE_BYTES = 32 << 20
#: Blocks of a span of the directory.
SPAN_BLOCKS = 64
#: Spans that the driver and each task hold at most (64 million records a thousand); more raise an error.
MAX_SPANS = 1_000_000
#: Bytes that a reader of archive files unpacks at a time.
PIECE = 8 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: The text writer ends each row with this. A member's last byte is the top byte
#: of its length, zero below 16 MiB, so the writer's byte completes the member.
_END = "\x00"


def target_uri(url: str | None) -> str | None:
    """A URL as records carry it: what a URI may not hold is quoted."""
    return None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")


def url_key(url: str | None) -> str:
    """``http://m.a.com:80/p?q#f`` -> ``com,a,m)/p?q``; a null URL has the key ``)``."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return ")" + (url or "").strip()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/" * bool(host)) + ("?" + parts.query if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit's block holds the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target_uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member; if it does not end in a zero byte, an empty member follows."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        out += b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + struct.pack("<II", 0, 0)
    return out


def members(content: bytes):
    """(offset, length, data) of the members of an archive file; empty members belong to the one before."""
    view = memoryview(content)
    at, start, held = 0, 0, b""
    while at < len(content):
        reader, data, end = zlib.decompressobj(31), [], at
        while not reader.eof:  # a piece at a time: what a member leaves over is copied
            piece = view[end : end + PIECE]
            if not piece:
                raise ValueError(f"the member at byte {at} is cut short")
            data.append(reader.decompress(piece))
            end += len(piece)
        end -= len(reader.unused_data)
        if data := b"".join(data):
            if held:
                yield start, at - start, held
            start, held = at, data
        at = end
    if held:
        yield start, at - start, held


def parse(data: bytes) -> dict:
    """Fields of a record, and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != n or payload_digest(body) != digest):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-Id"), "payload": None if revisit else body}


@dataclass
class Archive:
    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        """block, first_key, lines (zlib-compressed JSON lines, sorted by key)."""
        return self.spark.read.parquet(f"{self.path}/index")

    @property
    def directory(self) -> DataFrame:
        """span, first_key, last_key, block."""
        return self.spark.read.parquet(f"{self.path}/directory")

    def spans(self) -> list[tuple[str, str, int]]:
        """(first_key, last_key, span), in order: one for SPAN_BLOCKS blocks."""
        rows = self.directory.groupBy("span").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).limit(MAX_SPANS + 1).collect()
        if len(rows) > MAX_SPANS:
            raise ValueError(f"the directory has more than {MAX_SPANS} spans; raise BLOCK_LINES")
        return sorted((r["a"], r["b"], r["span"]) for r in rows)

    def files(self, columns=("path", "content")) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{self.path}/archive").select(*columns)


def _digests(batches):
    for b in batches:
        html = [x.as_py() for x in b.column("html")]
        raw = [(x or "").encode() for x in html]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), b.column("html"), pa.array([payload_digest(x) for x in raw]), pa.array([len(x) for x in raw], pa.int64())],
            names=["page_id", "url", "html", "digest", "n"],
        )


def _write_members(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            out.append(member(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["first_id"], r["revisit"]))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


_LINE = "key string, page_id long, path string, at long, length long"


def _list_members(batches):
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            rows = []
            for at, length, data in members(content.as_py()):
                r = parse(data)
                rows.append({"key": url_key(r["url"]), "page_id": r["page_id"], "path": path, "at": at, "length": length})
            yield pa.RecordBatch.from_pylist(rows, _LINE_ARROW)


def _pack_lines(block_lines: int):
    """Sorted index lines in compressed blocks, with the first and last key of each."""

    def packed(held: list[dict]) -> pa.RecordBatch:
        lines = "\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode()
        return pa.RecordBatch.from_pydict({"first_key": pa.array([held[0]["key"]]), "last_key": pa.array([held[-1]["key"]]), "lines": pa.array([zlib.compress(lines)], pa.binary())})

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == block_lines:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return run


def _unpack_lines(batches):
    for b in batches:
        for lines in b.column("lines"):
            rows = [json.loads(x) for x in zlib.decompress(lines.as_py()).decode().split("\n")]
            yield pa.RecordBatch.from_pylist(rows, _LINE_ARROW)


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = REVISIT_MIN_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Write a record for each row of ``pages`` (page_id, url, html), then index the archive.

    The payload is the html in UTF-8; a null html is an empty payload. Of rows
    with equal payloads of at least ``min_bytes`` bytes the smallest page_id is
    stored as a response, the others as revisits of it; a null page_id comes
    last. Rows that repeat the smallest page_id and its payload are all
    responses. A null URL gives a record without a target. An empty table gives
    an archive without records. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/veldgraph/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digested = rows.mapInArrow(_digests, "page_id long, url string, html string, digest string, n long")
    ids = stash(digested.select("page_id", "digest", "n"), "digests")
    first = ids.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # One key for the join, by which both sides are dealt out beforehand: its partitions become the files.
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest")
    n_files = max(2, ceil_div(2 * text_bytes(rows, "html"), FILE_BYTES))
    plan = ids.distinct().join(first, "digest", "left").select(key.alias("key"), "first_id", F.expr("first_id is not null and not (page_id <=> first_id)").alias("revisit"))
    dealt = digested.withColumn("key", key).repartition(n_files, "key")
    out = dealt.join(plan.repartition(n_files, "key"), "key").select("page_id", "url", "html", "digest", "first_id", "revisit").mapInArrow(_write_members, "member binary")
    # The cast relabels the bytes; the writer stores them as they are.
    out.select(F.col("member").cast("string").alias("member")).write.option("lineSep", _END).text(f"{path}/archive")
    archive = Archive(spark, path)
    lines = stash(archive.files().mapInArrow(_list_members, _LINE), "index-lines")
    order = ["key", "page_id", "path", "at"]
    sorted_lines = lines.repartitionByRange(max(2, n_files // 8), *order).sortWithinPartitions(*order)
    # Blocks are numbered in order of their keys: by partition, then within it.
    sorted_lines.mapInArrow(_pack_lines(block_lines), "first_key string, last_key string, lines binary").withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{path}/index")
    part, nth = F.shiftright("block", 33), F.col("block").bitwiseAND((1 << 33) - 1)
    span = F.shiftleft(part, 33) + F.floor(nth / SPAN_BLOCKS)
    archive.blocks.select(span.alias("span"), "first_key", "last_key", "block").write.parquet(f"{path}/directory")
    return archive


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_ROW_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(data: bytes) -> dict:
    reader = zlib.decompressobj(31)
    return parse(reader.decompress(data) + reader.flush())


def _file_system(path: str):
    """A file system with range reads for a path, and the path in it; None where only Spark reads."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:").lstrip("/"))
    try:
        return pafs.FileSystem.from_uri(path) if path.split(":")[0] in ("s3", "gs") else None
    except (OSError, ValueError, pa.ArrowException):
        return None


def _fetch(archive: Archive, lines: DataFrame, payload: bool) -> DataFrame:
    """The records that index lines name, each by a read of its byte range."""
    fields = _ROW if payload else _ROW.remove(_ROW.get_field_index("payload"))
    ddl = _ROW_DDL if payload else _ROW_DDL.rpartition(",")[0]
    record_of = lambda data: {k: v for k, v in _read(data).items() if payload or k != "payload"}

    def ranges(batches):
        name = opened = None
        for b in batches:
            rows = []
            for path, at, length in zip(*(b.column(k).to_pylist() for k in ("path", "at", "length"))):
                if path != name:
                    if opened is not None:
                        opened.close()
                    system, place = _file_system(path)
                    name, opened = path, system.open_input_file(place)
                rows.append(record_of(opened.read_at(length, at)))
                if payload and len(rows) == 100:
                    yield pa.RecordBatch.from_pylist(rows, fields)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, fields)

    if _file_system(archive.path) is not None:
        return lines.select("path", "at", "length").repartition("path").sortWithinPartitions("path", "at").mapInArrow(ranges, ddl)

    def cut(files_table: pa.Table, lines_table: pa.Table) -> pa.Table:
        out = []
        for content in files_table.column("content"):
            raw = content.as_py()
            out += [record_of(raw[at : at + n]) for at, n in zip(lines_table.column("at").to_pylist(), lines_table.column("length").to_pylist())]
        return pa.Table.from_pylist(out, fields)

    # A store without range reads: Spark reads the files (of FILE_BYTES), ranges are cut from them.
    return archive.files().groupBy("path").cogroup(lines.groupBy("path")).applyInArrow(cut, ddl)


def read_all(archive: Archive, payload: bool = True) -> DataFrame:
    """Every record, by way of the whole index."""
    return _fetch(archive, archive.blocks.select("lines").mapInArrow(_unpack_lines, _LINE), payload)


def _within(firsts: list, lasts: list, key: str) -> range:
    """Which of sorted ranges may hold a key; a key may go over several."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("key", pa.string())])
_LINE_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())])


def lookup(archive: Archive, urls: list[str | None] | DataFrame, payload: bool = True) -> DataFrame:
    """The records of the given URLs: a list, or a DataFrame with a column ``url`` of any length.

    A URL is asked for once, however often it is given; one that the archive
    lacks gives nothing; null stands for the records without a target.
    """
    asked = urls if isinstance(urls, DataFrame) else archive.spark.createDataFrame([(u,) for u in urls], "url string")
    shared = archive.spark.sparkContext.broadcast(archive.spans())  # MAX_SPANS at most

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(target_uri(u)) for u in b.column("url").to_pylist()], pa.string())], names=["key"])

    def to_spans(batches):
        spans = shared.value
        firsts, lasts = [x[0] for x in spans], [x[1] for x in spans]
        for b in batches:
            found = [(spans[i][2], k) for k in b.column("key").to_pylist() for i in _within(firsts, lasts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())], names=["span", "key"])

    def to_blocks(asked_table: pa.Table, directory_table: pa.Table) -> pa.Table:
        entries = sorted(zip(*(directory_table.column(c).to_pylist() for c in ("first_key", "last_key", "block"))))
        firsts, lasts = [e[0] for e in entries], [e[1] for e in entries]
        found = [(entries[i][2], k) for k in asked_table.column("key").to_pylist() for i in _within(firsts, lasts, k)]
        return pa.table({"block": [x for x, _ in found], "key": [k for _, k in found]}, _BLOCKS_ARROW)

    def to_lines(asked_table: pa.Table, block_table: pa.Table) -> pa.Table:
        out = []
        if asked_table.num_rows:
            for packed in block_table.column("lines"):
                lines = [json.loads(x) for x in zlib.decompress(packed.as_py()).decode().split("\n")]
                held = [x["key"] for x in lines]
                for k in asked_table.column("key").to_pylist():
                    out += lines[bisect.bisect_left(held, k) : bisect.bisect_right(held, k)]
        return pa.Table.from_pylist(out, _LINE_ARROW)

    spans = asked.select(F.col("url").cast("string").alias("url")).mapInArrow(keys, "key string").distinct().mapInArrow(to_spans, "span long, key string")
    blocks = spans.groupBy("span").cogroup(archive.directory.groupBy("span")).applyInArrow(to_blocks, "block long, key string")
    lines = blocks.groupBy("block").cogroup(archive.blocks.select("block", "lines").groupBy("block")).applyInArrow(to_lines, _LINE)
    return _fetch(archive, lines, payload)
