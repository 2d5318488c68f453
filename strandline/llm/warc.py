"""WARC archives, index first: every record's file, offset, length, URL and digest are known before anything is read.

Writing: payload digests are grouped first, so that of equal payloads of at least `least` bytes the record with the
smallest id is the response and the others are revisits; smaller payloads take no part in it, and a payload that many
pages share is looked up in a broadcast. Each task then writes gzip members, one per record, to files of bounded size of
its own in the shared folder and returns the index rows. A file that a lost or repeated attempt wrote is in no index row,
so nothing is read twice. Reading: the selected index rows are sorted by (file, offset), neighbouring byte ranges are
coalesced into one read, and each record is cut out and parsed.

A response's block is an HTTP response with the payload as its body; the payload digest is that of the body. A record is
named by its file and its place there, so repeated rows and null ids have names of their own; page ids are in fields of
their own, which the standard allows.

Null html: an empty payload. Null url: an empty target. A null page_id is written and read as null; it counts as larger
than every other. Repeated rows are records of their own; of rows that share the smallest id of a payload all are
responses, and revisits name the first url of them. Empty table: no archive, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.shared import new_dir

from .common import dropped, looked_up, partitions_for, stored

#: Bytes of one archive file, of the gap that is read over rather than skipped, and of one coalesced read.
FILE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
INDEX = "page_id bigint, url string, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
READ = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
KINDS = ("response", "revisit")


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + (path.removeprefix("file:") if path.startswith("file:") else path))


def record(name: str, page_id: int | None, url: str, digest: str, kind: str, refers_to: int | None, refers_url: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has no block; its payload is that of the record it refers to."""
    told = lambda x: "" if x is None else str(x)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {told(page_id)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {told(refers_url)}", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"Refers-To-Page-ID: {told(refers_to)}"]
        block = b""
    else:
        lines.append("Content-Type: application/http; msgtype=response")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload): of an HTTP response its body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block


def _id(told: str) -> int | None:
    return int(told) if told else None


def writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    else:
                        store.create_dir(base, recursive=True)
                    path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                url, refers_url = (" ".join((r[c] or "").split()) for c in ("url", "refers_url"))
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                name = f"{path.removesuffix('.warc.gz')}:{at}"
                member = packer.compress(record(name, r["page_id"], url, r["payload_digest"], r["record_type"], r["refers_to"], refers_url, (r["html"] or "").encode())) + packer.flush()
                out.write(member)
                rows.append((r["page_id"], r["url"], r["payload_digest"], r["record_type"], r["refers_to"], f"{folder}/{path}", at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "url", "payload_digest", "record_type", "refers_to", "file", "offset", "length"])
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row under `folder` (a new one in the shared folder by default) and return the stored INDEX."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = rows.select("*", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("size"))
    # small payloads are never shared: they ask for nothing
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = sized.where(f"size >= {least}").groupBy("payload_digest").agg(F.min(named).alias("of"), F.count("*").alias("n")).where("n > 1 and of is not null")
    firsts = stored(groups.select("payload_digest", "n", F.col("of.page_id").alias("first"), F.col("of.url").alias("refers_url")), "warc-firsts")
    told = looked_up(sized, firsts, "payload_digest", F.struct("page_id", "url"), F.col("size") >= least)
    second = (F.col("first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = told.withColumn("record_type", F.when(second, "revisit").otherwise("response")).withColumn("refers_to", F.when(second, F.col("first")))
    folder = folder or new_dir(pages.sparkSession, "warc")
    index = stored(marked.select("page_id", "url", "payload_digest", "record_type", "refers_to", "refers_url", "html").mapInArrow(writer(folder), INDEX), "warc-index")
    dropped(firsts)
    return index


def reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, file, handle = {}, None, None
        for batch in batches:
            rows, at = batch.to_pylist(), 0
            while at < len(rows):
                first, end = rows[at], at + 1
                stop = first["offset"] + first["length"]
                while end < len(rows) and rows[end]["file"] == first["file"] and 0 <= rows[end]["offset"] - stop <= GAP_BYTES and rows[end]["offset"] + rows[end]["length"] - first["offset"] <= READ_BYTES:
                    stop = rows[end]["offset"] + rows[end]["length"]
                    end += 1
                if file != first["file"]:
                    if handle:
                        handle.close()
                    file = first["file"]
                    folder, _, name = file.rpartition("/")
                    if folder not in stores:
                        stores[folder] = filesystem(folder)
                    store, base = stores[folder]
                    handle = store.open_input_file(f"{base}/{name}")
                data = handle.read_at(stop - first["offset"], first["offset"])
                out = []
                for r in rows[at:end]:
                    begin = r["offset"] - first["offset"]
                    fields, payload = parse(zlib.decompress(data[begin : begin + r["length"]], 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    out.append((_id(fields["Page-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], _id(fields["Refers-To-Page-ID"]) if revisit else None, None if revisit else len(payload), digest, payload if keep_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                at = end
        if handle:
            handle.close()

    return run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """READ of the index rows given (select what you need from the index first): coalesced reads in file order.

    payload_digest is computed from the bytes read; a revisit has the digest it names, and null size and payload.
    """
    tasks = partitions_for(index, 8 << 20, index.sparkSession.sparkContext.defaultParallelism)
    spans = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return spans.mapInArrow(reader(payloads), READ)


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the size of the response that has its digest; records of one archive set, which are read twice, so
    they should be stored."""
    asked = records.where("record_type = 'revisit'").groupBy("payload_digest").agg(F.count("*").alias("n"))
    sizes = records.where("record_type = 'response' and payload_bytes is not null").groupBy("payload_digest").agg(F.max("payload_bytes").alias("known"))
    known = stored(asked.join(sizes, "payload_digest"), "warc-sizes")
    told = looked_up(records, known, "payload_digest", F.struct("page_id", "url"), F.col("payload_bytes").isNull())
    return told.withColumn("payload_bytes", F.coalesce("payload_bytes", "known")).drop("known")
