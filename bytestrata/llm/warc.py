"""WARC archives of captures, and a two-level index to read them back by URL.

Each write task appends gzip members, a record each, to archives in the shared folder; file names hold the task attempt, so
a repeated task never touches what a finished one wrote, and only rows of finished tasks name files. Captures of one
payload: the one with the largest id is a response, the others are revisits that name it.

The index sorts entries by reversed-host key and id, by range, into compressed blocks (second level: a directory row per
block, first key and place). The first level is the first key of each range. A lookup finds its range by binary search in
the first level, goes there, finds its block by binary search in that range's directory, and reads one block. Archives are
then read in order, neighbouring records in one range read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch, bounded_broadcast_rows

NO_ID = -(2**63)


@dataclass(frozen=True)
class Params:
    """least: payloads of fewer bytes are never revisits. archive: bytes at which a task starts another file."""

    least: int = 0
    archive: int = 64 << 20
    block_entries: int = 256
    range_entries: int = 16_384
    level: int = 1
    read: int = 8 << 20
    broadcast_heads: int = 100_000


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.example.org:80/a?b -> org,example,www:80)/a?b. What can't be split keeps its form."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").lower()
        port = f":{u.port}" if u.port else ""
    except ValueError:
        return url or ""
    return f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    revisit = refers_to is not None
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest_text(sha1)}", f"X-Page-Id: {'' if page_id is None else page_id}",
        *([f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, body = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = body[: int(fields["Content-Length"])]
    return fields, body.split(b"\r\n\r\n", 1)[1] if body else b""


class Files:
    """Numbered files of one task attempt."""

    def __init__(self, root: str, kind: str, most: int):
        self.fs, self.root = filesystem(root)
        ctx = TaskContext.get()
        self.name = f"{kind}-{ctx.partitionId()}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.kind, self.most, self.n, self.out, self.at = kind, most, 0, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.file = f"{self.name}-{self.n}"
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.file}"), 0
            self.n += 1
        self.out.write(data)
        self.at += len(data)
        return self.file, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
BLOCK = pa.schema([("part", pa.int32()), ("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _writer(root: str, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root, "captures", p.archive)
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c for c in batch.columns), strict=True):
                payload = (html.as_py() or "").encode()
                i = page_id.as_py()
                raw = record(i, url.as_py(), payload, hashlib.sha1(payload).digest(), refers_to.as_py())
                rows.append((surt(url.as_py()), i, *files.add(_gzip(raw, p.level))))
            yield _table(rows, ENTRY)
        files.close()

    return run


def _blocks(root: str, p: Params):
    """Sorted entries of one range to blocks of lines; a directory row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root, "index", p.archive)
        part = TaskContext.get().partitionId()
        entries = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        while chunk := list(itertools.islice(entries, p.block_entries)):
            place = files.add(zlib.compress("\n".join(json.dumps(e) for e in chunk).encode(), p.level))
            yield _table([(part, chunk[0][0], chunk[0][1], *place)], BLOCK)
        files.close()

    return run


def _order(key: str, page_id: int | None) -> tuple[str, int]:
    return key, NO_ID if page_id is None else page_id


def _router(firsts):
    """The range that each probe's key lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys = firsts.value
        schema = pa.schema([("part", pa.int32()), ("key", pa.string()), ("page_id", pa.int64())])
        for batch in batches:
            rows = []
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = surt(url)
                rows.append((parts[max(0, bisect.bisect_right(keys, _order(k, i)) - 1)], k, i))
            yield _table(rows, schema)

    return run


def _lookup(root: str):
    """Entries of the probes of one range, by binary search in its directory."""

    def run(key, probes, blocks):
        found: list[tuple] = []
        if probes.num_rows and blocks.num_rows:
            fs, base = filesystem(root)
            directory = sorted((_order(b["key"], b["page_id"]), b["file"], b["offset"], b["length"]) for b in blocks.to_pylist())
            firsts = [d[0] for d in directory]
            held: tuple[int, list] = (-1, [])
            handle: tuple[str, object] = ("", None)
            for k, i in sorted({(x["key"], x["page_id"]) for x in probes.to_pylist()}, key=lambda x: _order(*x)):
                at = max(0, bisect.bisect_left(firsts, _order(k, i)) - 1)
                while at < len(directory) and firsts[at] <= _order(k, i):
                    if held[0] != at:
                        _, file, offset, length = directory[at]
                        if handle[0] != file:
                            handle = (file, fs.open_input_file(f"{base}/{file}"))
                        handle[1].seek(offset)
                        held = (at, [json.loads(x) for x in zlib.decompress(handle[1].read(length)).split(b"\n")])
                    keys = [_order(e[0], e[1]) for e in held[1]] if len(held) == 2 else held[2]
                    held = (held[0], held[1], keys)
                    a, b = bisect.bisect_left(keys, _order(k, i)), bisect.bisect_right(keys, _order(k, i))
                    found += [tuple(e) for e in held[1][a:b]]
                    at += 1
        return pa.Table.from_batches([_table(found, ENTRY)])

    return run


def _reader(root: str, p: Params):
    """Records of one archive at the given places."""

    def run(key, table):
        fs, base = filesystem(root)
        places = sorted(zip(table.column("offset").to_pylist(), table.column("length").to_pylist(), strict=True))
        rows = []
        with fs.open_input_file(f"{base}/{key[0].as_py()}") as f:
            at = 0
            while at < len(places):
                to, start = at, places[at][0]
                end = start
                while to < len(places) and places[to][0] <= end and places[to][0] + places[to][1] - start <= max(p.read, places[at][1]):
                    end = places[to][0] + places[to][1]
                    to += 1
                f.seek(start)
                data = f.read(end - start)
                for offset, length in places[at:to]:
                    fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    number = lambda x: int(x) if x else None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and digest_text(hashlib.sha1(payload).digest()) != digest:
                        raise ValueError(f"payload of page {fields['X-Page-Id']} does not match its digest")
                    rows.append((number(fields["X-Page-Id"]), len(payload) if kind == "response" else None, digest, kind, number(fields.get("X-Refers-To-Page-Id", ""))))
                at = to
        return pa.Table.from_batches([_table(rows, READ)])

    return run


def revisits(pages: DataFrame, p: Params, spark_scratch: Scratch) -> DataFrame:
    """pages with refers_to: the largest page_id of the same payload, null for that one and for small payloads."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    df = pages.withColumn("sha", F.sha1(payload)).withColumn("size", F.octet_length(payload))
    heads = df.where(F.col("size") >= p.least).groupBy("sha", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads = spark_scratch.save(heads.select("sha", "size", "head"))
    if bounded_broadcast_rows(heads, p.broadcast_heads):
        heads = F.broadcast(heads)
    df = df.join(heads, ["sha", "size"], "left")
    return df.select("page_id", "url", "html", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"))


def write(pages: DataFrame, p: Params = Params()) -> tuple[str, DataFrame, DataFrame]:
    """Archives and index of pages(page_id, url, html): their folder, the capture entries, the block directory."""
    scratch = Scratch(pages.sparkSession, "warc")
    root = f"{scratch.root}/files"
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    entries = scratch.save(revisits(slim, p, scratch).mapInArrow(_writer(root, p), "key string, page_id long, file string, offset long, length long"))
    ranges = max(1, -(-entries.count() // p.range_entries))
    ordered = entries.repartitionByRange(ranges, "key", "page_id").sortWithinPartitions("key", "page_id")
    blocks = scratch.save(ordered.mapInArrow(_blocks(root, p), "part int, key string, page_id long, file string, offset long, length long"))
    return root, entries, blocks


def capture_lookup(root: str, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries of wanted(page_id, url), through the index."""
    spark = blocks.sparkSession
    firsts = sorted((_order(r.first.key, r.first.page_id), r.part) for r in blocks.groupBy("part").agg(F.min(F.struct("key", "page_id")).alias("first")).collect())
    shared = spark.sparkContext.broadcast(([f[1] for f in firsts] or [0], [f[0] for f in firsts]))
    probes = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(_router(shared), "part int, key string, page_id long")
    directory = blocks.withColumnRenamed("part", "at")
    return probes.groupBy("part").cogroup(directory.groupBy("at")).applyInArrow(_lookup(root), "key string, page_id long, file string, offset long, length long")


def read(root: str, entries: DataFrame, p: Params = Params()) -> DataFrame:
    """The records at the entries' places; a revisit's payload_bytes are those of the response it names."""
    got = entries.select("file", "offset", "length").groupBy("file").applyInArrow(_reader(root, p), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return got


def round_trip(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per row of pages, from archives written and read.

    Null html is an empty payload, null url an empty key. Rows that repeat a page_id and payload are all responses where
    that id is the largest. A null page_id refers to the largest id of its payload, if there is one. Columns other than
    page_id, url and html are not read. An empty table writes no archive.
    """
    scratch = Scratch(pages.sparkSession, "warc-read")
    root, _, blocks = write(pages, p)
    got = scratch.save(read(root, capture_lookup(root, blocks, pages), p))
    sizes = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("head"), F.col("payload_digest").alias("head_digest")).agg(F.max("payload_bytes").alias("head_bytes"))
    sizes = sizes.join(got.where("record_type = 'revisit'").select(F.col("refers_to").alias("head")).distinct(), "head", "left_semi")
    if bounded_broadcast_rows(sizes, p.broadcast_heads):
        sizes = F.broadcast(sizes)
    done = got.join(sizes, (F.col("refers_to") == F.col("head")) & (F.col("payload_digest") == F.col("head_digest")), "left")
    return done.select("page_id", F.coalesce("payload_bytes", "head_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
