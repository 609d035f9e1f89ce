"""WARC archives with a two-level capture index.

Records are gzip members of archive files. The index is sorted by a key of the reversed host and
the rest of the URL; about LINES captures at a time form a compressed block of an index file, and
a sparse directory holds the first key of every block. A look-up finds the index file by its
first key, searches that file's directory for the block, reads only that block, and the record
with one range read.

Files are written by tasks through Arrow's file systems into the folder given, under names that
no other attempt of a task uses; only files that a finished task has reported count.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import in_batches, partitions, stored
from netweir.session import work_dir

LEAST_SHARED = 100  # payloads of at least so many bytes are stored once
LINES = 1000  # captures in a block of the index
FILE_BYTES = 256 << 20  # an archive file is closed when it has grown so large
DATE = "2024-01-01T00:00:00Z"


def files_of(path: str):
    """Arrow's file system of a folder and the folder's name in it; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def surt(url: str | None) -> str:
    """Sort key of a URL: host reversed and lower-cased, port, path and query; no scheme, no fragment."""
    url = re.sub(r"[\r\n]+", " ", url or "")
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f")/{url}"
    if not host:
        return f")/{url}"
    standard = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port != standard else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another record's payload."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload or b'')}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + (payload or b"") + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); returns the stored captures:
    key, page_id, file, offset, length.

    Of rows with equal payloads of at least LEAST_SHARED bytes, those with the smallest page_id
    are responses and the others revisit it; rows with a null page_id are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.filter((F.octet_length("payload") >= LEAST_SHARED) & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first")
    )
    # Only payloads that occur twice are joined; the others stay where they are.
    shared = stored(firsts, "shared")
    joined = rows.join(shared, "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")

    def write(batches):
        store, root = files_of(folder)
        out, name, at = None, None, 0
        for batch in batches:
            rows = ([], [], [], [], [])
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, None if refers_to is not None else payload, len(payload), digest, refers_to), 3, mtime=0)
                out.write(member)
                for column, x in zip(rows, (surt(url), page_id, name, at, len(member))):
                    column.append(x)
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, CAPTURES)], schema=CAPTURES)
        if out is not None:
            out.close()

    files_of(folder)[0].create_dir(files_of(folder)[1], recursive=True)
    written = joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "key string, page_id long, file string, offset long, length long")
    return stored(written, "captures")


def _line(key, page_id, file, offset, length) -> str:
    return f"{key} {'' if page_id is None else page_id} {file} {offset} {length}\n"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted, compressed index; returns the stored directory: index (file), block,
    first and last (keys), offset, length, captures; one row per block."""
    ordered = captures.repartitionByRange(max(2, partitions(captures.sparkSession)), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    schema = pa.schema([("index", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("captures", pa.int64())])

    def write(batches):
        store, root = files_of(folder)
        name, out, at, block, held = f"index-{uuid.uuid4().hex}.gz", None, 0, 0, []

        def close():
            nonlocal out, at, block, held
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("".join(_line(*r) for r in held).encode("utf-8", "replace"))
            out.write(data)
            row = (name, block, held[0][0], held[-1][0], at, len(data), len(held))
            at, block, held = at + len(data), block + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in CAPTURES.names)):
                held.append(row)
                if len(held) == LINES:
                    yield close()
        if held:
            yield close()
        if out is not None:
            out.close()

    return stored(ordered.mapInArrow(write, "index string, block long, first string, last string, offset long, length long, captures long"), "directory")


def look_up(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """All captures of the distinct ``key`` values in ``keys``: key, page_id, file, offset, length.

    The first and last key of each index file (as many rows as the index has files, which is the
    number of shuffle partitions it was sorted in) go to every task; the directory of one file
    goes only to the tasks that look into it.
    """
    bounds = sorted(((r["first"], r["last"], r["index"]) for r in directory.groupBy("index").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()))
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]
    schema = pa.schema([("key", pa.string()), ("index", pa.string())])

    def route(batches):
        for batch in batches:
            rows = ([], [])
            for key in batch.column("key").to_pylist():
                # A key of many captures may reach over several files.
                for k in range(max(0, bisect_left(lasts, key)), bisect_right(firsts, key)):
                    rows[0].append(key)
                    rows[1].append(bounds[k][2])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], schema=schema)

    routed = keys.select("key").distinct().mapInArrow(route, "key string, index string")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            store, root = files_of(folder)
            right = right.sort_values("block")
            firsts, lasts = right["first"].tolist(), right["last"].tolist()
            wanted: dict[int, set[str]] = {}
            for key in left["key"]:
                for k in range(max(0, bisect_left(lasts, key)), bisect_right(firsts, key)):
                    wanted.setdefault(k, set()).add(key)
            with store.open_input_file(f"{root}/{right['index'].iloc[0]}") as f:
                for k in sorted(wanted):
                    data = f.read_at(int(right["length"].iloc[k]), int(right["offset"].iloc[k]))
                    for line in zlib.decompress(data).decode("utf-8").split("\n")[:-1]:
                        key, page_id, file, offset, length = line.rsplit(" ", 4)
                        if key in wanted[k]:
                            out.append((key, int(page_id) if page_id else None, file, int(offset), int(length)))
        frame = pd.DataFrame(out, columns=CAPTURES.names)
        return frame.astype({"page_id": "Int64", "offset": "int64", "length": "int64"})

    return routed.groupBy("index").cogroup(directory.groupBy("index")).applyInPandas(search, "key string, page_id long, file string, offset long, length long")


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at (file, offset, length), with a range read each; a file is read front to back.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked
    for, the payload (null for a revisit). The digest of a response is that of the bytes read; a
    record whose bytes do not agree with its header fails the task.
    """
    spread = captures.select("file", "offset", "length").repartitionByRange(partitions(captures.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches):
        store, root = files_of(folder)
        name, source = None, None
        for batch in batches:
            rows = tuple([] for _ in RECORDS.names)
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                fields, payload = parse(gzip.decompress(source.read_at(length, offset)))
                revisit = fields["WARC-Type"] == "revisit"
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"broken record in {file} at {offset}")
                number = lambda field: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", fields.get(field, ""))) else None
                values = (number("WARC-Record-ID"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number("WARC-Refers-To"), None if revisit or not payloads else payload)
                for column, x in zip(rows, values):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, RECORDS)], schema=RECORDS)
        if source is not None:
            source.close()

    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def write_and_read(pages: DataFrame) -> DataFrame:
    """Archive pages, index the archives, find every page's captures by its URL and read them.

    A null url has the key of an empty one, a null html an empty payload; rows that repeat are
    records each. An empty table gives no rows.
    """
    folder = work_dir(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    directory = write_index(captures, folder)
    schema = pa.schema([("key", pa.string())])
    keys = pages.select(F.col("url").cast("string").alias("url")).mapInArrow(in_batches(["url"], lambda urls: [[surt(u) for u in urls]], schema), "key string")
    return read_records(look_up(keys, directory, folder), folder, payloads=False).drop("payload")
