"""WARC archives with a two-level capture index.

Writing. Each task writes its rows as gzip members (one a record) into archives in the shared folder. Of records
with equal payloads of at least 100 bytes, that with the smallest page_id is a response and the others revisit it:
they carry its HTTP headers, digest, record id and url, but no payload. Files appear whole, under a name that no other
attempt at a task has; captures only name the files of attempts that succeeded.

Index. Captures are range-sorted by key (host reversed, then path and query) and page_id and go, 256 to a block, into
compressed blocks; beside each block file lies its sparse directory (first key and page_id, offset, length). Files that
list the first keys of at most 512 block files (or of lists, for as many levels as it takes) lead to the directories, so
the driver and every task hold the at most 512 entries of the topmost list, whatever the number of files. A lookup
bisects the lists, then the directory, reads the block's byte range, finds the capture, and reads the record's byte range
from its archive. A page of a key that many pages share is found as fast as any other.

Reading back. Every record is found by its key and page_id. A response's payload is hashed and measured; for a revisit
its response is looked up by the url and id that the revisit names, and that payload is hashed and measured.

Null html is an empty payload; a null url has the key ``-``; a null page_id is never a revisit's target unless no row
of the payload has an id. Rows that repeat the smallest page_id of a payload are responses, each. Malformed urls are
kept whole as keys. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, mounted, read_table, shipped, staged

MIN_REVISIT_BYTES = 100
BLOCK_LINES = 256
#: Captures in one index file, about.
FILE_LINES = 250_000
#: Entries of a list of files, at most.
LIST_FILES = 512
#: Records that one task reads back, about, and responses of revisits whose checks it remembers.
READ_RECORDS = 4_000
#: Range partitions at most; beyond, tasks stream more rows each and hold no more of them.
MOST_PARTS = 50_000
CHECKED = 1_024
#: Payload digests of copies that are broadcast (about 150 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 100_000
ARCHIVE_BYTES = 256_000_000
CAPTURED = "20240101000000"
_DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """Host reversed and lowered, then path and query: captures of a site are neighbours."""
    url = _line(url)
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    if (parts.scheme, port) in (("http", 80), ("https", 443)):
        port = None
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "%20".join(key.split())


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def record_id(page_id: int | None, mark: str = "") -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}{mark}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """One record: named fields, HTTP headers and, for a response, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url) or '-'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {_line(refers_url) or '-'}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Named fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:]) | {"version": lines[0]}
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_CRLF * 2)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def read_archive(path: str):
    """Offset, length and content of each record of an archive."""
    with open(path, "rb") as f:
        data = f.read()
    at = 0
    while at < len(data):
        opener = zlib.decompressobj(31)
        content = opener.decompress(data[at:]) + opener.flush()
        end = len(data) - len(opener.unused_data)
        yield at, end - at, content
        at = end


class _Out:
    """A file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.path, self.part, self.size = path, f"{path}.{uuid.uuid4().hex}.part", 0
        self.file = open(self.part, "wb")

    def write(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        at, self.size = self.size, self.size + len(data)
        return at, len(data)

    def close(self) -> None:
        self.file.close()
        os.replace(self.part, self.path)


def targets(pages: DataFrame) -> DataFrame:
    """digest, keep_id and keep_url of payloads of several rows."""
    hashed = pages.select("page_id", "url", F.sha2("_html", 256).alias("digest"), F.octet_length("_html").alias("n")).filter(F.col("n") >= MIN_REVISIT_BYTES)
    return hashed.groupBy("digest").agg(F.min("page_id").alias("keep_id"), F.min_by(F.struct("url"), "page_id").alias("keep"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "keep_id", F.col("keep.url").alias("keep_url"))


CAPTURE = "key string, page_id long, type string, digest string, archive string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all rows; returns their captures. ``folder`` is a mounted shared folder."""
    shipped(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html"))
    kept = staged(targets(rows), "warc-targets")
    few = kept.count() <= BROADCAST_ROWS
    marked = rows.withColumn("digest", F.sha2("_html", 256)).join(F.broadcast(kept) if few else kept, "digest", "left")
    is_revisit = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    marked = marked.select("page_id", "url", "_html", "digest", F.when(is_revisit, F.col("keep_id")).alias("refers_to"), "keep_url")

    def run(batches):
        out, part, task = None, 0, f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            captures = []
            for row in batch.to_pylist():
                if out is None:
                    name = f"archive-{task}-{part:04d}.warc.gz"
                    out, part = _Out(f"{folder}/{name}"), part + 1
                revisit = row["refers_to"] is not None
                at, n = out.write(_member(record(row["page_id"], row["url"], row["_html"].encode(), row["digest"], row["refers_to"], revisit, row["keep_url"])))
                captures.append((url_key(row["url"]), row["page_id"], "revisit" if revisit else "response", row["digest"], name, at, n))
                if out.size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield _batch(captures, CAPTURE)
        if out is not None:
            out.close()

    return staged(marked.mapInArrow(run, CAPTURE), "warc-captures")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def place_of(key: str | bytes, page_id: int | None) -> tuple[bytes, bool, int]:
    """Order of captures: by key's bytes, then page_id, without one first."""
    return key if isinstance(key, bytes) else key.encode(), page_id is not None, page_id or 0


ENTRY = "first string, page_id long, name string"


def build_index(captures: DataFrame, folder: str) -> list[tuple[tuple, str]]:
    """Block files, their directories and lists; returns the first place and the name of the topmost files, in order."""
    files = min(int(1 + captures.count() // FILE_LINES) * 4, MOST_PARTS)

    def run(batches):
        name, out, block, directory = f"index-{TaskContext.get().partitionId():09d}-{TaskContext.get().taskAttemptId()}", None, [], []

        def flush():
            at, n = out.write(zlib.compress("".join(block).encode()))
            key, _, info = block[0].split(" ", 2)
            directory.append([key, json.loads(info)["page_id"], at, n])
            block.clear()

        for batch in batches:
            for r in batch.to_pylist():
                out = out or _Out(f"{folder}/{name}.blocks")
                info = {k: r[k] for k in ("page_id", "type", "digest", "archive", "offset", "length")}
                block.append(f"{r['key']} {CAPTURED} {json.dumps(info)}\n")
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            _write_json(f"{folder}/{name}.directory", directory)
            yield _batch([(*directory[0][:2], name)], ENTRY)

    order = ["key", "page_id", "archive", "offset"]
    ordered = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)
    entries = staged(ordered.mapInArrow(run, ENTRY), "warc-index")  # one row a file
    while entries.count() > LIST_FILES:
        entries = staged(listed(entries, folder), "warc-index")
    return sorted((place_of(r["first"], r["page_id"]), r["name"]) for r in entries.collect())  # LIST_FILES at most


def listed(entries: DataFrame, folder: str) -> DataFrame:
    """Files that list runs of ``entries`` in order, LIST_FILES at most each; returns the entry of each such file.

    Names of block files rise with their range, so they order files that start at the same place.
    """

    def run(batches):
        task, part, held = f"{TaskContext.get().partitionId():09d}-{TaskContext.get().taskAttemptId()}", 0, []

        def flush():
            nonlocal part
            name, part = f"list-{task}-{part:09d}", part + 1
            _write_json(f"{folder}/{name}.list", held)
            return _batch([(*held[0][:2], name)], ENTRY)

        for batch in batches:
            for r in batch.to_pylist():
                held.append([r["first"], r["page_id"], r["name"]])
                if len(held) == LIST_FILES:
                    yield flush()
                    held = []
        if held:
            yield flush()

    order = ["first", "page_id", "name"]
    parts = max(1, min(entries.count() // (LIST_FILES * 16), MOST_PARTS))
    return entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, ENTRY)


def _write_json(path: str, rows: list) -> None:
    out = _Out(path)
    out.write(json.dumps(rows).encode())
    out.close()


def _reach(firsts: list[tuple], low: tuple, high: tuple):
    """Positions from the last that starts before ``low``, on while they start at or before ``high``."""
    for k in range(max(0, bisect.bisect_left(firsts, low) - 1), len(firsts)):
        if firsts[k] > high:
            return
        yield k


class Index:
    """Lookups through lists, directory, block and archive; keeps the last list of a level, directory and block it read."""

    def __init__(self, folder: str, files: list[tuple[tuple, str]]):
        self.folder, self.firsts, self.names = folder, [f for f, _ in files], [n for _, n in files]
        self.lists: dict[int, tuple] = {}
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, {})
        self.archive: tuple = (None, None)

    def _files(self, firsts: list[tuple], names: list[str], low: tuple, high: tuple, level: int = 0):
        """Names of the block files that may hold captures from ``low`` to ``high``."""
        for k in _reach(firsts, low, high):
            if not names[k].startswith("list-"):
                yield names[k]
                continue
            if self.lists.get(level, (None,))[0] != names[k]:
                with open(f"{self.folder}/{names[k]}.list", "rb") as f:
                    entries = json.load(f)
                self.lists[level] = (names[k], [place_of(*e[:2]) for e in entries], [e[2] for e in entries])
            yield from self._files(*self.lists[level][1:], low, high, level + 1)

    def _open(self, name: str):
        if self.directory[0] != name:
            with open(f"{self.folder}/{name}.directory", "rb") as f:
                entries = json.load(f)
            self.directory = (name, [place_of(*e[:2]) for e in entries], entries)
        return self.directory[1:]

    def _block(self, name: str, at: int, n: int) -> dict[str, list[dict]]:
        if self.block[0] != (name, at):
            with open(f"{self.folder}/{name}.blocks", "rb") as f:
                f.seek(at)
                lines = zlib.decompress(f.read(n)).decode().split("\n")[:-1]
            found: dict[str, list[dict]] = {}
            for line in lines:
                key, _, info = line.split(" ", 2)
                found.setdefault(key, []).append(json.loads(info))
            self.block = ((name, at), found)
        return self.block[1]

    def _between(self, key: str, low: tuple, high: tuple):
        """Captures of a key from the last block that starts before ``low``, on while blocks start at or before ``high``."""
        for name in self._files(self.firsts, self.names, low, high):
            firsts, entries = self._open(name)
            for b in _reach(firsts, low, high):
                yield from self._block(name, entries[b][2], entries[b][3]).get(key, [])

    def captures(self, key: str):
        """All captures of a key."""
        raw = key.encode()
        return self._between(key, (raw, False, 0), (raw, True, 2**63))

    def captures_of(self, key: str, page_id: int | None):
        """Captures of a page under a key."""
        place = place_of(key, page_id)
        return (c for c in self._between(key, place, place) if c["page_id"] == page_id)

    def read(self, capture: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
        if self.archive[0] != capture["archive"]:
            if self.archive[1]:
                self.archive[1].close()
            self.archive = (capture["archive"], open(f"{self.folder}/{capture['archive']}", "rb"))
        self.archive[1].seek(capture["offset"])
        return parse(zlib.decompress(self.archive[1].read(capture["length"]), 31))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _checked(fields: dict[str, str], http: dict[str, str], payload: bytes) -> tuple[int, str]:
    """Length and digest of a response's payload, which must be those that the record states."""
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"] or len(payload) != int(http["Content-Length"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return len(payload), digest


def _page_of(urn: str) -> int | None:
    page = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if page == "none" else int(page)


def read_back(captures: DataFrame, folder: str, files: list[tuple[tuple, str]]) -> DataFrame:
    """Every capture read from its archive by a lookup of its key and page; neighbours in key order share blocks."""

    def run(batches):
        index, responses, checked = Index(folder, files), Index(folder, files), {}

        def referred(urn: str, url: str) -> tuple[int, str]:
            """Of the response that a revisit names."""
            if urn not in checked:
                page = _page_of(urn)
                found = next((c for c in responses.captures_of(url_key(url), page) if c["type"] == "response"), None)
                if found is None:
                    raise LookupError(f"the response of page {page} at {url} is not in the index")
                if len(checked) >= CHECKED:
                    checked.clear()
                checked[urn] = _checked(*responses.read(found))
            return checked[urn]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                want = (row["archive"], row["offset"])
                capture = next((c for c in index.captures_of(row["key"], row["page_id"]) if (c["archive"], c["offset"]) == want), None)
                if capture is None:
                    raise LookupError(f"{row['key']} of page {row['page_id']} is not in the index")
                fields, http, payload = index.read(capture)
                if fields["WARC-Type"] == "response":
                    size, digest, target = *_checked(fields, http, payload), None
                else:
                    urn = fields["WARC-Refers-To"]
                    size, digest = referred(urn, fields["WARC-Refers-To-Target-URI"])
                    target = _page_of(urn)
                    if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{fields['WARC-Record-ID']} does not repeat {urn}")
                out.append((row["page_id"], size, digest, fields["WARC-Type"], target))
            yield _batch(out, READ)

    order = ["key", "page_id", "archive", "offset"]
    ordered = captures.select(*order).repartitionByRange(min(1 + captures.count() // READ_RECORDS, MOST_PARTS), *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, index the archives, and read every record back."""
    folder = mounted(fresh_path(pages.sparkSession, "warc"))
    os.makedirs(folder, exist_ok=True)
    captures = write_archives(pages, folder)
    return read_back(captures, folder, build_index(captures, folder))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), k AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS keep_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN keep_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep_id <> page_id THEN keep_id END AS refers_to
FROM k
"""
