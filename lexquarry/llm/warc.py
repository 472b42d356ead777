"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. The reader's tasks get byte ranges of the archives: a task looks for the gzip
magic in its range, checks each candidate by decoding its first bytes (they must be a WARC version line), reads the
whole member, beyond the end of its range if need be, and goes on behind it. It owns the records that start inside its
range, so every record is read once, whatever the ranges.

The writer's tasks write files of names of their own in the shared folder; the manifest, kept in a checkpoint, lists
those of the attempts that succeeded, so a lost executor leaves at most an unlisted file. Archives are a result and
stay: `archive_pages` reads them when its rows are asked for.

Defined results: a null page is an empty payload; empty payloads equal each other; of rows with one payload those with
the largest page id are responses, the others revisit it; without any page id all of them are responses; a null URL is
left out of the record; payloads of any length are one record; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import persisted, pruned, shared_folder, struct

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
MOST_TASKS = 20_000
CHUNK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:lexquarry:page:none>" if page_id is None else f"<urn:lexquarry:page:{page_id}>"


def record(page_id, url: str | None, size: int, digest: str, payload: bytes | None, refers_to=None) -> bytes:
    """One gzip member that holds one record; without a payload a revisit, which holds the HTTP header only."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(data: bytes) -> dict | None:
    """A decoded record's header fields, HTTP header fields and payload; None if it is not whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    fields = _fields(head)
    size = int(fields.get("content-length", -1))
    if size < 0 or len(rest) < size:
        return None
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return {"fields": fields, "http": _fields(http), "payload": payload}


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows to write: page_id, url, size, digest, latest (the largest page id with the same payload) and html, null for revisits.

    Only the rows that stay responses carry html through a shuffle, dealt by payload and page id; those that revisit a
    payload are a few bytes each, however many share it.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    columns = ["page_id", "url", "size", "digest", "latest", "html"]
    whole = pages.where(F.col("size") >= min_bytes) if min_bytes > 0 else pages
    latest = whole.groupBy("digest", "size").agg(F.max("page_id").alias("latest"))
    largest = latest.select(F.col("digest").alias("d"), F.col("size").alias("s"), F.col("latest").alias("l"))
    responses = whole.join(largest, F.expr("digest = d AND size = s AND page_id <=> l"), "left_semi").withColumn("latest", F.col("page_id"))
    revisits = whole.drop("html").join(latest, ["digest", "size"]).where("NOT page_id <=> latest").withColumn("html", F.lit(None).cast("string"))
    rows = responses.select(columns).unionByName(revisits.select(columns))
    return rows if min_bytes <= 0 else rows.unionByName(pages.where(F.col("size") < min_bytes).withColumn("latest", F.col("page_id")).select(columns))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows of with_revisits as archives under folder; the manifest: path, size, records."""
    schema = struct("path string, size bigint, records bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, records = None, "", 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, n, digest, latest, html in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns]):
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        fs, inner = pafs.FileSystem.from_uri(path)
                        fs.create_dir(inner.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(inner, compression=None, buffer_size=1 << 20)
                    payload = None if html is None else html.encode("utf-8", "surrogatepass")
                    data = record(page_id, url, n, base64.b32encode(bytes.fromhex(digest)).decode(), payload, latest)
                    out.write(data)
                    size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])], schema=to_arrow_schema(schema))

    return persisted(pages.sparkSession, pages.mapInArrow(run, schema))


def records_from(stream, start: int, end: int, size: int) -> Iterator[bytes]:
    """Decoded records whose members start in [start, end) of an open file of `size` bytes."""
    at, window = start, b""  # window: bytes from `at` on
    while at < end:
        # find the magic; the window may reach past the end by the bytes a member needs
        k = window.find(MAGIC)
        if k < 0:
            keep = window[-2:]
            at += len(window) - len(keep)
            stream.seek(at + len(keep))
            more = stream.read(min(CHUNK, size - at - len(keep)))
            if not more:
                return
            window = keep + more
            continue
        at, window = at + k, window[k:]
        if at >= end:
            return
        # the chunks of a long member are read one by one and not kept
        inflate, data, used, ok, chunk = zlib.decompressobj(31), [], 0, False, window
        try:
            while True:
                if not chunk:
                    stream.seek(at + used)
                    if not (chunk := stream.read(min(CHUNK, size - at - used))):
                        break
                data.append(inflate.decompress(chunk))
                used += len(chunk) - len(inflate.unused_data)
                if inflate.eof:
                    ok = True
                    break
                chunk = b""
                if not b"WARC/1.".startswith(data[0][:7]) and data[0]:
                    break
        except zlib.error:
            ok = False
        whole = b"".join(data)
        if ok and whole.startswith(b"WARC/1."):
            yield whole
            at, window = at + used, inflate.unused_data
        else:  # chance bytes inside a member
            at, window = at + 1, window[1:]


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Records of the files in manifest (path, size): page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact, payload."""
    ranges = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    # a number of its own: adaptive execution would put rows this small into one task
    tasks = manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes)).alias("n")).first()["n"] or 1
    ranges = ranges.repartition(min(int(tasks), most_tasks), "path", "start")
    schema = struct("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean, payload binary")
    arrow = to_arrow_schema(schema)

    def number(urn: str | None):
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                fs, inner = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(inner) as stream:
                    for data in records_from(stream, start, min(size, start + range_bytes), size):
                        found = parse(data)
                        if found is None:
                            continue
                        fields, payload = found["fields"], found["payload"]
                        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if fields.get("warc-type") == "revisit":
                            row = ("revisit", number(fields.get("warc-refers-to")), int(found["http"].get("content-length", 0)), said, True, None)
                        else:
                            digest = payload_digest(payload)
                            row = ("response", None, len(payload), digest, digest == said, payload)
                        rows.append((number(fields.get("warc-record-id")), fields.get("warc-target-uri"), *row))
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    return ranges.select("path", "size", "start").mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives and return what the reader finds in them."""
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and ":/" in folder:  # file:/x
        folder = folder.replace(":/", ":///", 1)
    manifest = write_archives(with_revisits(pruned(pages, page_id="page_id", url="url", html="html"), min_bytes), folder)
    return read_archives(manifest)


def digest_rows(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return archive_pages(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), latest AS (
  SELECT hex, max(page_id) AS latest FROM p GROUP BY hex
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM p JOIN latest USING (hex)
"""
