"""WARC archives with a two-level capture index.

Writing: each task streams its pages into one archive of its own in the shared folder, a gzip member
a record, under a name that no other attempt has; only what a successful attempt returns is used.
Index: captures sorted by reversed-host URL key go into compressed blocks of ``BLOCK_LINES`` lines,
a part of the key range a file.  A sparse directory holds the first key and the byte range of each
block, and one row a part names the parts.  Reading: binary search over parts, then over the part's
directory, then in the one block read; then a range read of the record itself.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_path

#: Payloads of fewer bytes are stored again each time.
LEAST_REVISIT = 100
BLOCK_LINES = 1000
#: Repeated payloads are broadcast while they are at most so many (about 20 MB), else joined by shuffle.
MOST_BROADCAST = 200_000
#: Parts of the index at most: their first keys are sent to every reader (a few hundred bytes each).
MOST_PARTS = 20_000
#: Captures of one part of the index, and requests that one task reads, about.
PART_ROWS = 50_000

# An id stands in archives and index as text: empty for null, else behind an equals sign.
MANIFEST = "key string, id string, archive string, at bigint, size bigint"
PART = "first_key string, first_id string, blocks string, directory string"


def reversed_url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: hosts of one domain, then its paths, stand together."""
    lowered = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(F.array_join(F.reverse(F.split(lowered, r"\.")), ","), F.lit(")"), rest)).otherwise(F.concat(F.lit(")"), url)), F.lit(")"))


def id_text(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), page_id.cast("string")), F.lit(""))


def _open(path: str):
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# --- records ---------------------------------------------------------------------------------------


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, as a gzip member.  A revisit keeps the HTTP header of the full payload, not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{json.dumps(page_id)[1:-1]}>",
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{json.dumps(refers_to)[1:-1]}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[str | None, int, str, str, str | None]:
    """(page, payload bytes, payload digest, type, page referred to); a response's digest is computed from its payload."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: json.loads(f'"{s[len("<urn:page:") : -1]}"')[1:] if len(s) > len("<urn:page:>") else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record of page {fields['WARC-Record-ID']} is damaged")
        return number(fields["WARC-Record-ID"]), len(payload), digest, kind, None
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields["WARC-Refers-To"])


# --- writing ---------------------------------------------------------------------------------------


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and returns their ``MANIFEST``, one row a record.

    Of pages with equal payloads of ``LEAST_REVISIT`` bytes or more, the smallest id is a response
    and the others revisit it (a row repeated whole with that id is a response each time; null ids
    come last).  A null html is an empty payload, a null URL an empty one.  Ids may be of any type
    that orders; texts of any length are one record each.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), reversed_url_key(F.col(url_col)).alias("key"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "payloads")
    first = F.broadcast(first) if first.count() <= MOST_BROADCAST else first
    rows = rows.join(first, F.col("digest") == F.col("d"), "left")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), id_text(F.col("first")))
    rows = rows.select(id_text(F.col("id")).alias("id"), "url", "key", "html", "digest", refers_to.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            places, sizes = [], []
            for page_id, url, _, text, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(page_id, url, text.encode(), digest, refers_to)
                out.write(raw)
                places.append(at)
                sizes.append(len(raw))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([f"{folder}/{name}"] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["key", "id", "archive", "at", "size"])
        if out:
            out.close()

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def tasks(rows: DataFrame) -> int:
    """How many tasks share so many rows: their number counts, as the bytes behind a key are far more than its own."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(-(-n // PART_ROWS), min(cores, -(-n // BLOCK_LINES)), 1)


def build_index(manifest: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Writes blocks and directories and returns the parts of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name, out, at, directory, lines = uuid.uuid4().hex, None, 0, [], []

        def flush() -> None:
            nonlocal out, at, lines
            out = out or system.open_output_stream(f"{base}/{name}.cdx.z", compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(raw)
            directory.append([lines[0][0], lines[0][1], at, len(raw)])
            at, lines = at + len(raw), []

        for b in batches:
            for key, page_id, *place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append([key, page_id, *place])
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with system.open_output_stream(f"{base}/{name}.idx", compression=None) as f:
                f.write("\n".join(json.dumps(x) for x in directory).encode())
            first = directory[0]
            yield pa.RecordBatch.from_pydict({"first_key": [first[0]], "first_id": [first[1]], "blocks": [f"{folder}/{name}.cdx.z"], "directory": [f"{folder}/{name}.idx"]})

    order = ["key", "id"]
    ranged = manifest.repartitionByRange(parts or tasks(manifest), *order)
    return materialize(ranged.sortWithinPartitions(*order).mapInArrow(run, PART), "parts")


class Reader:
    """Finds and reads records; holds one directory, one block and a few open files at a time."""

    def __init__(self, parts: list[tuple]):
        self.parts = sorted(((k.encode(), i.encode()), blocks, directory) for k, i, blocks, directory in parts)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[str, int, list] = ("", -1, [])

    def _range(self, path: str, at: int, size: int) -> bytes:
        f = self.files.pop(path, None)
        if f is None:
            system, place = _open(path)
            f = system.open_input_file(place)
        self.files[path] = f
        if len(self.files) > 32:
            self.files.popitem(last=False)[1].close()
        f.seek(at)
        return f.read(size)

    def find(self, key: str, page_id: str) -> Iterator[tuple[str, int, int]]:
        """Archive, place and size of every capture of this key and id."""
        want = (key.encode(), page_id.encode())
        p = max(0, bisect.bisect_left(self.parts, (want,)) - 1)
        while p < len(self.parts) and self.parts[p][0] <= want:
            _, blocks, directory = self.parts[p]
            if self.directory[0] != directory:
                system, place = _open(directory)
                with system.open_input_stream(place, compression=None) as f:
                    self.directory = (directory, [((k.encode(), i.encode()), at, size) for k, i, at, size in map(json.loads, f.read().decode().split("\n"))])
            entries = self.directory[1]
            e = max(0, bisect.bisect_left(entries, (want,)) - 1)
            while e < len(entries) and entries[e][0] <= want:
                if self.block[:2] != (blocks, e):
                    raw = zlib.decompress(self._range(blocks, *entries[e][1:])).decode()
                    self.block = (blocks, e, [((k.encode(), i.encode()), a, at, size) for k, i, a, at, size in map(json.loads, raw.split("\n"))])
                lines = self.block[2]
                x = bisect.bisect_left(lines, (want,))
                while x < len(lines) and lines[x][0] == want:
                    yield lines[x][1:]
                    x += 1
                e += 1
            p += 1

    def read(self, place: tuple[str, int, int]) -> tuple:
        return parse(self._range(*place))


def read_back(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """The records of the distinct ``key, id`` rows of ``wanted``, found through the index; ids come back as text."""
    found = [tuple(r) for r in parts.limit(MOST_PARTS + 1).collect()]
    if len(found) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} index parts: build it with fewer")
    shared = wanted.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            out = [reader.read(place) for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for place in reader.find(key, page_id)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # Sorted requests visit each block once.
    rows = wanted.select("key", id_text(F.col("id")).alias("id")).distinct()
    rows = rows.repartitionByRange(tasks(wanted), "key", "id").sortWithinPartitions("key", "id")
    return rows.mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Archives ``pages``, indexes the archives, and returns every record as read back through the index.

    One row per row of ``pages``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``,
    ids of the type they had.  Of ties (repeated rows) each has a record.  Null ids, URLs and html
    are kept as ``write`` has them; texts of any length are whole.  An empty table writes nothing and
    returns nothing.  Other columns are not read, so their names cannot clash.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = write(pages, folder, id_col, url_col, html_col)
    read = read_back(pages.select(reversed_url_key(F.col(url_col)).alias("key"), F.col(id_col).alias("id")), build_index(manifest, folder))
    kind = pages.schema[id_col].dataType
    return read.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
