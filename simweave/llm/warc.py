"""WARC archives with a two-level capture index.

Writing: every task writes its own gzipped archives (a member a record) into
the shared folder, by pyarrow's file systems, under names that no other attempt
uses; only archives that the index names count. Of records with equal payloads
the one with the largest id is the response, the others are revisits that refer
to it.

Index: captures are sorted by key (reversed host, then path and query) and
page over the whole table and cut into blocks of ``LINES`` lines, each
compressed; a sparse directory keeps the first and last key of every block. A
lookup bisects the directory, then the lines of a block, and reads only the
records' byte ranges. For many captures the directory is broadcast, thinned to
``DIRECTORY_ROWS`` entries if it has more, requests meet the blocks that they
were bisected to, and archives are read in a task each.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simweave.llm.sifting import marked
from simweave.scratch import materialize, scratch_path

LINES = 3000
ARCHIVE_BYTES = 64 << 20
#: A directory of up to so many blocks is searched in memory, a larger one by a filter over its table, or by every k-th of its rows.
DIRECTORY_ROWS = 1_000_000
READERS = 100_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard one for URLs

ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("type", pa.string())])
ENTRY_DDL = "key string, page_id long, url string, file string, offset long, length long, digest string, type string"
BLOCK = pa.schema([("block", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("first_key", pa.string()), ("first_page", pa.int64()), ("last_key", pa.string()), ("lines", pa.int32()), ("data", pa.binary())])
BLOCK_DDL = "block string, part int, number int, first_key string, first_page long, last_key string, lines int, data binary"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + (uri[5:] if uri.startswith("file:") else uri))


def capture_key(url: str | None) -> str:
    """``http://Blog.example.com:80/a?b`` -> ``com,example,blog)/a?b``; anything without ``://`` is its own key, null the empty one."""
    if url is None:
        return ""
    _, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:].partition("#")[0]
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.rpartition(":")
    if colon and port.isdigit():
        host = name
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_safe(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """(a WARC/1.1 record, its payload digest, its type)."""
    digest, kind = base32_sha1(payload), "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date)]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _header_safe(url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head.append(("X-Payload-Length", str(len(payload))))
    if refers_to is None:
        body += payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n", digest, kind


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a record; a revisit's payload is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _write(root: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data, digest, kind = record(page_id, url, (html or "").encode(), refers, date)
                    member = gzip.compress(data, compresslevel=1, mtime=0)
                    out.write(member)
                    rows.append((capture_key(url), page_id, url, name, at, len(member), digest, kind))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ENTRY]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)
        finally:
            if out is not None:
                out.close()

    return run


def _blocks(size: int):
    """Sorted entries -> compressed blocks of ``size`` JSON lines, numbered inside their range of keys (the task)."""

    def block(rows: list[list], part: int, number: int) -> pa.RecordBatch:
        data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), 6)
        columns = [[uuid.uuid4().hex], [part], [number], [rows[0][0]], [rows[0][1]], [rows[-1][0]], [len(rows)], [data]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, BLOCK, strict=True)], schema=BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            held += [list(r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            while len(held) >= size:
                yield block(held[:size], part, number)
                held, number = held[size:], number + 1
        if held:
            yield block(held, part, number)

    return run


def _place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """The order of the index; a null page comes first."""
    return key, page_id is not None, page_id or 0


def _route(directory, every: int):
    """(url, page_id) -> (part, part_of, key, page_id): the runs of ``every`` blocks in which the capture may lie, by bisecting their first lines."""
    schema = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("key", pa.string()), ("page_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [_place(*d[:2]) for d in directory.value]
        for batch in batches:
            rows = []
            for url, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = capture_key(url)
                at = _place(key, page_id)
                for i in range(max(0, bisect.bisect_left(firsts, at) - 1), bisect.bisect_right(firsts, at)):
                    rows.append((directory.value[i][2], directory.value[i][3] // every, key, page_id))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _find(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
    """The byte ranges (file, offset, length) of the wanted (key, page_id), by bisecting the lines of a run of blocks."""
    lines = []
    for _, data in sorted(zip(blocks.column("number").to_pylist(), blocks.column("data").to_pylist(), strict=True)) if wanted.num_rows else []:
        lines += [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
    order = [_place(*x[:2]) for x in lines]
    found = []
    for at in sorted({_place(k, i) for k, i in zip(wanted.column("key").to_pylist(), wanted.column("page_id").to_pylist(), strict=True)}):
        found += lines[bisect.bisect_left(order, at) : bisect.bisect_right(order, at)]
    return pa.table({"file": pa.array([x[3] for x in found], pa.string()), "offset": pa.array([x[4] for x in found], pa.int64()), "length": pa.array([x[5] for x in found], pa.int64())})


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            columns = list(zip(*(json.loads(line) for line in zlib.decompress(data).decode().split("\n")), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ENTRY, strict=True)], schema=ENTRY)


@dataclass(frozen=True)
class Archive:
    """``archives`` files below ``root``, the index's ``blocks`` and the sparse ``directory`` (block, part, number, first_key, first_page, last_key, lines) of them."""

    root: str
    blocks: DataFrame
    directory: DataFrame
    archives: int

    def entries(self) -> DataFrame:
        """All captures, read from the index."""
        return self.blocks.select("data").mapInArrow(_entries, ENTRY_DDL)

    def lookup(self, urls: list[str]) -> list[dict]:
        """The captures of a few URLs, by url and page_id: headers and payload."""
        keys = sorted({capture_key(u) for u in urls})
        if self.directory.count() <= DIRECTORY_ROWS:
            rows = sorted((r["first_key"], r["last_key"], r["block"]) for r in self.directory.select("first_key", "last_key", "block").collect())
            firsts, names = [r[0] for r in rows], set()
            for k in keys:
                # equal keys may start in earlier blocks
                i = bisect.bisect_right(firsts, k) - 1
                while i >= 0 and rows[i][1] >= k:
                    names.add(rows[i][2])
                    i -= 1
        else:
            names = {r["block"] for k in keys for r in self.directory.where((F.col("first_key") <= k) & (F.col("last_key") >= k)).select("block").collect()}
        fs, base = _open(self.root)
        out = []
        for r in self.blocks.where(F.col("block").isin(sorted(names))).select("data").collect() if names else []:
            lines = [json.loads(x) for x in zlib.decompress(r["data"]).decode().split("\n")]
            order = [x[0] for x in lines]
            for k in keys:
                for e in lines[bisect.bisect_left(order, k) : bisect.bisect_right(order, k)]:
                    if e[2] in urls:
                        with fs.open_input_file(f"{base}/{e[3]}") as f:
                            headers, payload = parse(gzip.decompress(f.read_at(e[5], e[4])))
                        out.append({"url": e[2], "page_id": e[1], "type": e[7], "headers": headers, "payload": payload})
        return sorted(out, key=lambda x: (x["url"], x["page_id"] is None, x["page_id"] or 0))

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures of ``wanted`` (url, page_id), a row for each capture that the index has.

        Requests are bisected into the directory and then into the blocks they
        fall in; repeated ones count once. A response's payload is measured and
        hashed anew, and must agree with its header.
        """
        spark = wanted.sparkSession
        every = -(-max(1, self.directory.count()) // DIRECTORY_ROWS)
        sparse = self.directory.where(F.col("number") % every == 0).select("first_key", "first_page", "part", "number")
        # at most DIRECTORY_ROWS rows and one for each task that wrote blocks
        rows = sorted((tuple(r) for r in sparse.collect()), key=lambda r: r[2:])
        routed = wanted.select("url", "page_id").mapInArrow(_route(spark.sparkContext.broadcast(rows), every), "part int, run int, key string, page_id long").distinct()
        blocks = self.blocks.select("part", F.floor(F.col("number") / every).cast("int").alias("run"), "number", "data")
        ranges = blocks.groupBy("part", "run").cogroup(routed.groupBy("part", "run")).applyInArrow(_find, "file string, offset long, length long")
        return self._records(ranges)

    def read(self) -> DataFrame:
        """:meth:`fetch` of all captures, without a search."""
        return self._records(self.entries().select("file", "offset", "length"))

    def _records(self, ranges: DataFrame) -> DataFrame:
        # a number of tasks is given, as the ranges are small and what they stand for is not
        placed = ranges.repartition(max(1, min(self.archives, READERS)), "file").sortWithinPartitions("file", "offset")
        return placed.mapInArrow(_read(self.root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _read(root: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, f = None, None
        try:
            for batch in batches:
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f = file, fs.open_input_file(f"{base}/{file}")
                    h, payload = parse(gzip.decompress(f.read_at(length, offset)))
                    digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response" and (base32_sha1(payload), len(payload)) != (digest, size):
                        raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page-id")))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
        finally:
            if f is not None:
                f.close()

    return run


def write(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", lines: int = LINES) -> Archive:
    """Archive ``pages`` (page_id, url, html) below the shared folder ``root``.

    A null html is an empty payload, a null url has the empty key, and a page
    without id is a response that nothing refers to. Payloads of fewer than
    ``least_bytes`` bytes are never revisits. Rows that share the largest id of
    a payload are all responses. An empty table gives an empty index.
    """
    payload: Column = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload).alias("sha"))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha", "last")
    groups = materialize(groups, "payloads")
    # rows of which the bitmap lacks the payload stay where they are; the others meet their reference by page, so that a frequent payload is not one key
    sifted = marked(rows, groups, "sha")
    alone = sifted.where("not near").select("row.page_id", "row.url", "row.html", F.lit(None).cast("long").alias("refers"))
    near = sifted.where("near").select("row.*")
    refers = near.select("page_id", "sha").distinct().join(groups, "sha").where("page_id < last").select("page_id", "sha", F.col("last").alias("refers"))
    typed = alone.unionByName(near.join(refers, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers"))
    fs, base = _open(root)
    fs.create_dir(base, recursive=True)
    entries = materialize(typed.mapInArrow(_write(root, date), ENTRY_DDL), "captures")
    by_key = entries.repartitionByRange("key", "page_id", "url").sortWithinPartitions("key", "page_id", "url")
    blocks = materialize(by_key.mapInArrow(_blocks(lines), BLOCK_DDL), "index")
    return Archive(root, blocks, blocks.drop("data"), entries.select("file").distinct().count())


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read all of them back, each by its url and id through the directory: see :meth:`Archive.fetch`."""
    ours = pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"))
    return write(pages, scratch_path(pages.sparkSession, "warc")).fetch(ours)
