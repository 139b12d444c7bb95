"""WARC archives with revisit resolution: equal payloads are stored once.

Headers (page_id, payload digest and size), not payloads, are shuffled by payload digest: the response of each group is the
record with the largest page_id, and the headers of the others are joined to it. What was decided for a header goes
to its payload by page_id, so that a payload that very many pages share is no hot key. Revisit records carry no payload
and refer to the response. Archives are gzip files
with one member for each record, at most FILE_BYTES of content each, with fresh headers: new record ids, dates, digests
and lengths. A file is written under another name and moved, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, column_names, in_batches, left_by_key, new_path, saved

#: Payloads below this many bytes are always stored, and bytes of content after which a task begins another archive.
LEAST_BYTES, FILE_BYTES = 1000, 64_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def resolve_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and refers_to, null for responses."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    headed = column_names(pages, "page_id", "url", "html").withColumn("payload_bytes", F.length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    digest = ["payload_digest", "payload_bytes"]
    headers = saved(headed.filter(F.col("payload_bytes") >= least).select("page_id", *digest), "headers")
    shared = headers.groupBy(*digest).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null")
    shared = apart(shared.select(*digest, "response"), "shared")
    # Equal headers share what is decided, and those without a page_id have a key of their own.
    joined = headers.join(shared, digest).filter(~F.col("page_id").eqNullSafe(F.col("response")))
    revisits = joined.groupBy("page_id", *digest).agg(F.max("response").alias("refers_to"))
    key = [F.col("page_id").isNull().alias("__none"), F.coalesce("page_id", F.lit(0)).alias("__page"), F.col("payload_digest").alias("__digest")]
    revisits = apart(revisits.select(*key, "refers_to"), "revisits")
    keyed = headed.select("*", *key)
    return keyed.join(revisits, ["__none", "__page", "__digest"], "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, with the two line ends that close it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages; the manifest (file, records) comes back. All executors must share the folder."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)

    def run(batches):
        task = TaskContext.get()
        store, base = _store(folder)
        n, name, out, held, records = 0, "", None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{base}/_{name}.{task.taskAttemptId()}", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "records": pa.array([records], pa.int64())})

        for batch in batches:
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "refers_to"))
            html = batch.column("html")
            for i in range(batch.num_rows):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{n:04d}.warc.gz"
                    out, held, records = store.open_output_stream(f"{base}/_{name}.{task.taskAttemptId()}", compression=None), 0, 0
                text = html[i].as_buffer()
                raw = record(ids[i], urls[i], b"" if text is None else text.to_pybytes(), digests[i], refers[i], date)
                out.write(gzip.compress(raw, 1, mtime=0))
                held, records = held + len(raw), records + 1
                if held >= file_bytes:
                    yield close()
                    out, n = None, n + 1
        if out is not None:
            yield close()

    return saved(in_batches(resolve_revisits(pages, least), run, "file string, records long"), "manifest")


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[key.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a record is cut off")
        yield head, block


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, record_id, refers_id, url, html) of each record.

    Digests of responses are computed from what was read and must be those of the headers. html is null for revisits.
    """

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_id", "url", "html"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    for head, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                        response = head["warc-type"] == "response"
                        if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page = head.get("warc-x-page-id")
                        rows.append((None if page is None else int(page), size, digest, head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), head.get("warc-target-uri"), payload if response else None))
                        held += len(payload)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = manifest.select("file").repartition(max(1, manifest.count()))
    return in_batches(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string, url string, html binary")


def archived(pages: DataFrame, least: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row of pages, from archives written of them.

    A null html is an empty payload; a null url gives a record without a target. Of rows with equal payloads of at
    least `least` bytes, those with the largest page_id are responses (rows that repeat it as well) and the others refer
    to it; rows without a page_id never are the original, and are responses if all of a group are like that. No rows
    give no archives and no rows. Further columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder, least), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_id")
    records = saved(records, "records")
    originals = records.filter("record_type = 'response'").join(records.filter("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct(), "record_id", "left_semi")
    named = originals.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).distinct()
    # Most records are responses, which refer to nothing.
    return left_by_key(records, apart(named, "originals"), "refers_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["archived", "read_archives", "read_records", "record", "resolve_revisits", "write_archives"]
