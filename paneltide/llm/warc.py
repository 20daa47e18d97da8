"""WARC archives with a two-level capture index.

Writing: tasks write gzip-per-record WARC files in the shared folder. A file's name is unique to its attempt, and only what
the committed table of captures names exists for readers, so failed or repeated attempts leave unread files at most.

Indexing: captures are range-partitioned by reversed-host URL key (ties by place, so a hot URL spans partitions). Each
partition writes an index shard of gzip blocks of BLOCK_LINES lines, and a sparse directory with a first key, offset and length per
block. The second level is a table of the shards' first and last keys, at most about MAX_SHARDS rows, and that is what a lookup
takes to the tasks.

Lookup: URL keys find their shards in the table, each shard's task finds the blocks by binary search in its directory, reads those
byte ranges, and returns the captures; records are then read by range, neighbours in one read.

A record with the payload of an earlier one (by digest, MIN_REVISIT bytes or more, smallest page_id first) is a revisit: it
holds the HTTP head only. Defined cases: null html is an empty payload; null or odd URLs are keys like others; rows with equal
page_id and payload are all responses if they hold the smallest page_id; a null page_id is never referred to; empty tables
give empty archives; other columns are not read.
"""
from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.scale import staged, staging_path

MIN_REVISIT, FILE_BYTES = 100, 256 << 20
BLOCK_LINES, SHARD_LINES, MAX_SHARDS = 1000, 50_000, 4096
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def filesystem(uri: str):
    """A pyarrow file system and the path in it; local, HDFS and object-store URIs."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: com,example)/a?b. Safe for a line with tabs."""
    url = url or ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        parts, host, port = None, "", ""
    key = url if parts is None or not host else ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="!#$%&'()*+,/:;=?@[]~|\"<>^`{}\\")


def record(page_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """One WARC record; `first` is the page_id that a revisit refers to, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            "WARC-Target-URI: " + quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"), f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parsed(raw: bytes) -> dict:
    """What a record says; the payload of a response is held against its digest."""
    data = zlib.decompress(raw, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    names = [fields[k][len("<urn:page:"):-1] if k in fields else "None" for k in ("WARC-Record-ID", "WARC-Refers-To")]
    ids = [None if x == "None" else int(x) for x in names]
    return {"page_id": ids[0], "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ids[1]}


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, _first: the page_id that the record refers to, null for a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "_digest", F.sha2(F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")), 256))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT
    firsts = rows.where(large).groupBy(F.col("_digest").alias("_same")).agg(
        F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    out = rows.join(firsts, F.col("_digest") == F.col("_same"), "left")
    return out.select("page_id", "url", "html", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("_first"))


CAPTURES = "key string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; returns the captures (key, file, offset, length), committed as a table."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = at = name = None
        where = filesystem(folder)
        for part in parts:
            rows = []
            for page_id, url, html, first in zip(part["page_id"], part["url"], part["html"], part["_first"]):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = where[0].open_output_stream(f"{where[1]}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                raw = record(None if pd.isna(page_id) else int(page_id), url, payload, hashlib.sha256(payload).hexdigest(),
                             None if pd.isna(first) else int(first))
                out.write(raw)
                rows.append((url_key(url), name, at, len(raw)))
                at += len(raw)
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    where = filesystem(folder)
    where[0].create_dir(where[1], recursive=True)
    return staged(decided(pages).mapInPandas(run, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index shards; returns the shard table: file, first, last."""
    where = filesystem(folder)
    where[0].create_dir(where[1], recursive=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, name, out = filesystem(folder), f"shard-{uuid.uuid4().hex}", None
        directory, lines, at, first, last = [], [], 0, None, None

        def flush() -> None:
            nonlocal at
            raw = gzip.compress("".join(lines).encode(), 6, mtime=0)
            out.write(raw)
            directory.append((lines[0].split("\t", 1)[0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for part in parts:
            for row in part.itertuples(index=False):
                if out is None:
                    out, first = where[0].open_output_stream(f"{where[1]}/{name}.cdx.gz", compression=None), row.key
                last = row.key
                lines.append(f"{row.key}\t{row.file}\t{row.offset}\t{row.length}\n")
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with where[0].open_output_stream(f"{where[1]}/{name}.dir") as f:
                f.write(json.dumps(directory).encode())
            yield pd.DataFrame([(name, first, last)], columns=["file", "first", "last"])

    rows = captures.count()
    n = max(1, min(MAX_SHARDS, -(-rows // SHARD_LINES)))
    order = ["key", "file", "offset"]
    return staged(captures.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(
        run, "file string, first string, last string"), "shards")


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """keys: key. The captures of those keys: key, file, offset, length."""
    top = sorted((r["first"], r["last"], r["file"]) for r in shards.collect())
    firsts, lasts = [t[0] for t in top], [t[1] for t in top]

    @F.pandas_udf("array<string>")
    def shards_of(key: pd.Series) -> pd.Series:
        # shards are in order, so both bounds are
        return key.map(lambda k: [t[2] for t in top[bisect.bisect_left(lasts, k):bisect.bisect_right(firsts, k)]])

    def search(part: pd.DataFrame) -> pd.DataFrame:
        where, name = filesystem(folder), part["shard"].iloc[0]
        with where[0].open_input_file(f"{where[1]}/{name}.dir") as f:
            directory = json.loads(f.read())
        starts, blocks = [d[0] for d in directory], set()
        for k in part["key"]:
            blocks |= set(range(max(0, bisect.bisect_left(starts, k) - 1), bisect.bisect_right(starts, k)))
        wanted, found = set(part["key"]), []
        with where[0].open_input_file(f"{where[1]}/{name}.cdx.gz") as f:
            for b in sorted(blocks):
                for line in zlib.decompress(f.read_at(directory[b][2], directory[b][1]), 31).decode().splitlines():
                    key, file, offset, length = line.split("\t")
                    if key in wanted:
                        found.append((key, file, int(offset), int(length)))
        return pd.DataFrame(found, columns=["key", "file", "offset", "length"])

    return keys.select("key").distinct().withColumn("shard", F.explode(shards_of("key"))).groupBy("shard").applyInPandas(search, CAPTURES)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range-read the records: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = filesystem(folder)
        name = file = None
        for part in parts:
            names, starts, sizes = part["file"].tolist(), part["offset"].tolist(), part["length"].tolist()
            rows, i = [], 0
            while i < len(names):
                j = i + 1
                while j < len(names) and names[j] == names[i] and starts[j] == starts[j - 1] + sizes[j - 1] and starts[j] - starts[i] < READ_BYTES:
                    j += 1
                if names[i] != name:
                    if file is not None:
                        file.close()
                    name, file = names[i], where[0].open_input_file(f"{where[1]}/{names[i]}")
                raw = memoryview(file.read_at(starts[j - 1] + sizes[j - 1] - starts[i], starts[i]))
                for k in range(i, j):
                    at = starts[k] - starts[i]
                    rows.append(parsed(bytes(raw[at:at + sizes[k]])))
                i = j
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if file is not None:
            file.close()

    n = max(1, captures.sparkSession.sparkContext.defaultParallelism)
    return captures.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(
        run, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
                           T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
                           T.StructField("refers_to", T.LongType())]))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and index, look every URL up, and read its records."""
    spark = pages.sparkSession
    archives, index = staging_path(spark, "warc"), staging_path(spark, "cdx")
    if "://" not in archives and not archives.startswith("file:"):
        archives, index = f"file://{archives}", f"file://{index}"
    shards = write_index(write_archives(pages, archives), index)

    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    keys = pages.select(key("url").alias("key"))
    return read_records(staged(lookup(keys, shards, index), "found"), archives)
