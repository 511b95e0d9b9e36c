"""WARC archives of pages with a two-level capture index.

Writing: each task packs its pages into one archive, a gzip member per record,
and reports where each record lies. A payload of ``REVISIT_BYTES`` or more that
several pages share is stored once, with the largest page_id; the others are
revisit records that name it. Rows equal in page_id and payload are all stored;
a null page_id never becomes the one referred to unless all are null, when each
row is a response. Null html is an empty payload, a null url an empty key.

Index: captures sorted by reversed-host URL key are packed into compressed blocks
of ``BLOCK_CAPTURES``; each index file carries a sparse directory of its blocks,
and one short list names the first key of each index file. A look-up binary
searches list, directory and block, and only then reads byte ranges. Files are
written under fresh names, and only files of successful tasks are listed, so a
lost or repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import materialise, shared_folder
from .common import utf8

REVISIT_BYTES = 1000
BLOCK_CAPTURES = 3000
# Shared payloads up to this many are sent to every task (about 80 bytes each); beyond it they are joined by shuffle.
SENT_PAYLOADS = 100_000
# Neighbouring records are read together up to this many bytes.
RANGE_BYTES = 4 << 20

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id bigint, file string, start bigint, length bigint"


def url_key(url: Column) -> Column:
    """Reversed host, ``)`` and the rest: ``org,example,www)/a?b``. Without ``://`` the text itself; null gives the empty key."""
    shape = r"(?s)^[^/?#]*?://([^/?#]*)(.*)$"
    host = F.concat_ws(",", F.reverse(F.split(F.lower(F.regexp_extract(url, shape, 1)), r"\.")))
    return F.coalesce(F.when(url.rlike(shape), F.concat(host, F.lit(")"), F.regexp_extract(url, shape, 2))).otherwise(url), F.lit(""))


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Output:
    """A new file of a folder, opened at the first write."""

    def __init__(self, folder: str, suffix: str):
        self.uri, self.at, self.stream = f"{folder}/{uuid.uuid4().hex}{suffix}", 0, None

    def write(self, data: bytes) -> tuple[int, int]:
        if self.stream is None:
            system, path = _place(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.stream = system.open_output_stream(path, compression=None)
        start, self.at = self.at, self.at + len(data)
        self.stream.write(data)
        return start, len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


# --- records -----------------------------------------------------------------


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    digits = name[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has no payload, but the HTTP header of the full one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of an unpacked record; the block length is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not fit its block")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


# --- writing -----------------------------------------------------------------


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, size, digest, response_id); response_id is null for responses."""
    all_pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", utf8("html").alias("payload")).withColumns(
        {"size": F.length("payload"), "digest": F.sha1("payload")}
    )
    shared = materialise(
        all_pages.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("rows"))
        .where("rows > 1 AND response_id IS NOT NULL")
        .drop("rows")
    )
    few = shared.count() <= SENT_PAYLOADS
    joined = all_pages.join(F.broadcast(shared) if few else shared, "digest", "left")
    other = F.when(F.col("page_id").eqNullSafe(F.col("response_id")), F.lit(None)).otherwise(F.col("response_id"))
    return joined.withColumn("response_id", other)


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into archives under ``folder``; the captures, stored."""
    rows = mark_revisits(pages).select("page_id", "url", url_key(F.col("url")).alias("key"), "payload", "size", "digest", "response_id")
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, ".warc.gz")

        def written() -> Iterator[tuple]:
            for page_id, url, key, payload, size, digest, response in _rows(batches):
                data = record(page_id, url, payload if response is None else None, size, digest, response, date)
                yield key, page_id, out.uri, *out.write(_gzip(data))
            out.close()

        yield from _batches(written(), schema)

    return materialise(rows.mapInArrow(run, CAPTURES))


# --- index -------------------------------------------------------------------


class Index:
    """``files``: (first key, last key, file, directory start, directory length) of each index file, in key order."""

    def __init__(self, files: list[tuple]):
        self.files = sorted(files)


def write_index(captures: DataFrame, folder: str) -> Index:
    """Sort captures by key into compressed blocks. What comes back is one short row for each index file."""
    order = ["key", "page_id", "file", "start"]
    columns = ["key", "page_id", "file", "start", "length"]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    fields = "first string, last string, file string, start bigint, length bigint"
    schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, block = _Output(folder, ".cdx"), [], []

        def close() -> None:
            text = "\n".join(json.dumps(c) for c in block).encode()
            directory.append((block[0][0], block[-1][0], *out.write(zlib.compress(text, 6))))
            block.clear()

        for row in _rows(batches):
            block.append(row)
            if len(block) >= BLOCK_CAPTURES:
                close()
        if block:
            close()
        if directory:
            place = out.write(zlib.compress(json.dumps(directory).encode(), 6))
            out.close()
            yield _batch([(directory[0][0], directory[-1][1], out.uri, *place)], schema)

    stored = materialise(ordered.mapInArrow(run, fields))
    return Index([tuple(r) for r in stored.toLocalIterator()])


@lru_cache(maxsize=64)
def _read(uri: str, start: int, length: int) -> list:
    """An unpacked directory, or the captures of a block."""
    system, path = _place(uri)
    with system.open_input_file(path) as file:
        text = zlib.decompress(file.read_at(length, start)).decode()
    return json.loads(text) if text.startswith("[[") else [json.loads(line) for line in text.split("\n")]


def _between(first: list, last: list, key: str) -> range:
    """Entries whose sorted, possibly touching key ranges hold ``key``."""
    return range(bisect_left(last, key), bisect_right(first, key))


def find_blocks(files: list[tuple], key: str) -> Iterator[tuple[str, int, int]]:
    """(file, start, length) of the index blocks that may hold a key."""
    for i in _between([f[0] for f in files], [f[1] for f in files], key):
        _, _, uri, start, length = files[i]
        directory = _read(uri, start, length)
        for j in _between([d[0] for d in directory], [d[1] for d in directory], key):
            yield uri, directory[j][2], directory[j][3]


def find_captures(block: list, key: str) -> list:
    keys = [c[0] for c in block]
    return block[bisect_left(keys, key) : bisect_right(keys, key)]


def look_up(keys: DataFrame, index: Index, key: str = "key") -> DataFrame:
    """All captures of the distinct keys of a frame. A key with many captures spans many blocks, which are read by different tasks."""
    files = keys.sparkSession.sparkContext.broadcast(index.files)  # a row per index file
    wanted = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    blocks_schema = pa.schema([("key", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((k, *place) for (k,) in _rows(batches) for place in find_blocks(files.value, k))
        yield from _batches(found, blocks_schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (tuple(c) for k, uri, start, length in _rows(batches) for c in find_captures(_read(uri, start, length), k))
        yield from _batches(found, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    places = wanted.sortWithinPartitions("key").mapInArrow(locate, "key string, file string, start bigint, length bigint")
    by_block = places.repartition("file", "start").sortWithinPartitions("file", "start")
    return by_block.mapInArrow(fetch, CAPTURES)


# --- reading -----------------------------------------------------------------


def read_records(captures: DataFrame) -> DataFrame:
    """The records at given places: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to."""
    near = captures.select("file", "start", "length").withColumn("__part", F.floor(F.col("start") / (4 * RANGE_BYTES)))
    ordered = near.repartition("file", "__part").sortWithinPartitions("file", "start").select("file", "start", "length")
    fields = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        uri, held = None, []
        for file, start, length in _rows(batches):
            if held and (file != uri or start + length - held[0][0] > RANGE_BYTES):
                yield uri, held
                held = []
            uri = file
            held.append((start, length))
        if held:
            yield uri, held

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, file = None, None
        for uri, places in ranges(batches):
            if uri != name:
                system, path = _place(uri)
                name, file = uri, system.open_input_file(path)
            first = places[0][0]
            data = file.read_at(places[-1][0] + places[-1][1] - first, first)
            for start, length in places:
                head, http, payload = parse_record(zlib.decompress(data[start - first : start - first + length], 31))
                kind = head["WARC-Type"]
                refers = _number(head["WARC-Refers-To"]) if kind == "revisit" else None
                digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
                yield _number(head["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(parsed(batches), schema)

    return ordered.mapInArrow(run, fields)


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, index them, look every page's URL up and read the records found."""
    folder = folder or shared_folder(spark)
    captures = write_archives(pages, f"{folder}/archives")
    index = write_index(captures, f"{folder}/index")
    keys = pages.select(url_key(F.col("url")).alias("key"))
    return read_records(look_up(keys, index))
